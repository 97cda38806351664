"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as registered
from tableflow.plans import registry
from tests.conftest import SF
from tests.oracle import compare, connect

QUERIES = registered.queries()
ORACLES = registered.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(con, QUERIES[name](spark, SF), ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    assert registered.entry(spark).count() > 0
