"""Registered queries with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableflow.session import apply_settings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a key, with equivalent SQL where there is one."""

    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return run(spark, sf_dir)

        QUERIES[name] = with_settings
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def load() -> None:
    """Import the modules that register queries."""
    from tableflow.plans import (  # noqa: F401
        batch_queries,
        feed_queries,
        keyed_queries,
        log_queries,
        sink_queries,
        stream_queries,
    )
