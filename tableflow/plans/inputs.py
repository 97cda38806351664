"""Frames the registered queries run on, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableflow.session import work_dir

# A point inside the time range of ``events`` at which streams are cut in two.
MIDDLE = "2024-01-15 00:00:00"

LOG_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, props string"

# Order status codes as run states.
STATES = {"F": "FINISHED", "O": "RUNNING", "P": "CREATED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zoned(df: DataFrame, *columns: str) -> DataFrame:
    """Naive times as instants: watermarks take no other type. The session runs in UTC."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def change_feed(events: DataFrame) -> DataFrame:
    """A change feed keyed by user: an error event deletes its row, any other writes it."""
    op = F.when(F.col("event_type") == "error", "d").otherwise("u")
    return events.select("user_id", "event_type", "value", op.alias("op"), "ts", "event_id")


def order_feed(orders: DataFrame) -> DataFrame:
    """A change feed keyed by customer: a pending order deletes its row."""
    op = F.when(F.col("o_orderstatus") == "P", "d").otherwise("u")
    return orders.select("o_custkey", "o_orderpriority", "o_totalprice", op.alias("op"), "o_orderdate", "o_orderkey")


def log(events: DataFrame) -> DataFrame:
    """A message log: one topic per event type, offsets that rise with gaps, as in a compacted log."""
    body = F.to_json(F.struct("event_id", "user_id", "event_type", "value", "props"))
    return events.select(
        F.col("user_id").cast("string").alias("key"),
        body.alias("value"),
        F.col("event_type").alias("topic"),
        F.pmod("user_id", F.lit(3)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
    )


def runs(orders: DataFrame) -> DataFrame:
    """A run log: one run per order, named after its customer."""
    state = F.col("o_orderstatus")
    named = F.when(state == "F", STATES["F"]).when(state == "O", STATES["O"]).otherwise(STATES["P"])
    start = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return orders.select("o_orderkey", "o_custkey", named.alias("state"), start.alias("start"), "o_orderdate")


def halves(df: DataFrame, time: str) -> list[DataFrame]:
    """The rows before and from ``MIDDLE`` on."""
    cut = F.to_timestamp_ntz(F.lit(MIDDLE))
    return [df.where(F.col(time) < cut), df.where(F.col(time) >= cut)]


def heartbeat(spark: SparkSession, df: DataFrame, time: str, key: str) -> DataFrame:
    """``df`` as a stream input with one more row, years later and with a negative key.

    It moves the watermark past all real rows, so that a join gives out what it holds back.
    """
    late = F.max(time) + F.expr("interval 10 years")
    rest = [F.lit(-1 if f.name == key else None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != time]
    row = df.agg(late.alias(time)).select(time, *rest).select(*df.columns)
    path = work_dir(spark, "heartbeat")
    row.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)
