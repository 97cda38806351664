"""What the plans look like: pushed filters, pruned columns, shuffles, no pair-wise joins."""

import re

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF, rows

import __spark_entry__ as registered
from tableflow.operators import joins
from tableflow.operators.joins import join
from tableflow.plans.inputs import table

QUERIES = registered.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan(df)))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark):
    text = formatted(QUERIES["filter_where"](spark, SF))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text
    text = formatted(QUERIES["join_where"](spark, SF))
    assert "EqualTo(c_mktsegment,BUILDING)" in text and "GreaterThan(o_totalprice,1000.0)" in text


@pytest.mark.parametrize(
    "name, most",
    [
        ("project", 0),
        ("decode_json", 0),
        ("log_earliest", 0),
        ("cdc_decode", 0),
        ("agg_multi_key", 1),
        ("cdc_initial", 1),
        ("prune_to_latest", 1),
        ("load_unique", 1),
        ("infer_json_schema", 1),
        ("window_tumble", 1),
        ("window_hop", 1),
        ("window_session", 2),
        ("join_inner", 2),
        ("latest_child_and_count", 2),
        ("reconcile_status", 2),
        ("merge_nonnull", 3),
        ("changelog_join_inner", 2),
        ("changelog_join_right", 2),
        ("prune_by_name", 3),
    ],
)
def test_shuffles(spark, no_broadcast, name, most):
    df = QUERIES[name](spark, SF)
    assert shuffles(df) <= most, plan(df)


# These run their work when they are built; what they return is a plain read of the target.
EAGER = ("stream", "sink", "sync", "multi", "job", "late", "state", "exactly", "resume", "restore", "dedup", "auto", "load", "agg_to")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_pairwise_joins_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text and "BatchEvalPython" not in text


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_salt_changes_nothing(spark, no_broadcast, how):
    left = spark.createDataFrame([(i, i % 4 if i % 5 else None) for i in range(40)], "id int, k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c"), (None, "d")], "k int, name string")
    native = left.alias("l").join(right.alias("r"), left.k == right.k, how).select("l.id", "r.name")
    for choice in ({}, {"salt": 5}):
        assert rows(join(left, right, [("k", "k")], how, ["id"], ["name"], **choice)) == rows(native)


@pytest.mark.parametrize("how", ["right", "full"])
def test_unique_left_keys_join_in_one_go(spark, no_broadcast, how):
    left = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, a string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r")], "k int, b string")
    once = join(left, right, [("k", "k")], how, ["a"], ["b"], unique=True)
    assert shuffles(once) == 2
    assert rows(once) == rows(join(left, right, [("k", "k")], how, ["a"], ["b"]))


def test_hot_key_is_split(spark, no_broadcast):
    """Adaptive execution cuts the partition of a key that holds most rows, also in a full join."""
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "20KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    try:
        left = spark.range(0, 60000, 1, 8).selectExpr("id", "if(id % 10 < 9, 0, id) k", "repeat('x', 20) pad")
        right = spark.range(0, 60000, 7, 2).selectExpr("id k", "id * 2 v")
        for how in ("inner", "left", "right", "full"):
            out = join(left, right, [("k", "k")], how, ["id", "pad"], ["v"])
            out.write.format("noop").mode("overwrite").save()
            native = left.join(right, "k", how)
            assert out.count() == native.count()
            final = out._jdf.queryExecution()
            out.collect()
            assert "skew=true" in final.executedPlan().toString() or "isSkew=true" in final.executedPlan().toString(), how
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_tables_are_read_whole(spark):
    assert QUERIES["log_earliest"](spark, SF).count() == table(spark, SF, "events").count()


def test_only_keys_with_many_rows_are_copied(spark, no_broadcast):
    n = F.col("id")
    left = spark.range(10_050).select(n.alias("a"), F.when(n < 10_010, 1).when(n < 10_030, 2).alias("k"))
    right = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "w")], "k int, t string")
    spread, copies, on = joins.salted_hot(left, right, [("k", "k")], 8)
    assert copies.count() == 8 + 3 and spread.where("k = 1").select("_salt").distinct().count() == 8
    assert spread.where("k = 2").select("_salt").distinct().count() == 1 and on[-1] == ("_salt", "_salt")
    for how in ("inner", "left", "right", "full"):
        got, want = (joins.join(left, right, [("k", "k")], how, ["a"], ["t"], salt=s) for s in (8, 1))
        assert rows(got) == rows(want)
