"""Message logs: rows with ``key, value, topic, partition, offset, timestamp``.

Every start mode works on any frame with these columns. For a live broker
``read_log`` passes the same choice to Spark's Kafka reader.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Documented start modes, and the short names forms store.
START_MODES = ("earliest-offset", "latest-offset", "group-offsets", "timestamp", "specific-offsets")
SHORT_MODES = {"earliest": "earliest-offset", "latest": "latest-offset"}
DEFAULT_START = "latest-offset"
INTERNAL_PREFIX = "__"


def start_mode(name: str | None) -> str:
    mode = SHORT_MODES.get(name or DEFAULT_START, name or DEFAULT_START)
    if mode not in START_MODES:
        raise ValueError(f"start mode {name!r}, expected one of {START_MODES}")
    return mode


def positions(df: DataFrame) -> DataFrame:
    """A ``topic, partition, offset`` list in the form that logs join with.

    It has one row per log partition. Spark measures it when the job runs and sends it to
    the log where it is small, as it always should be.
    """
    return df.select(
        F.col("topic").alias("_topic"),
        F.col("partition").cast("int").alias("_partition"),
        F.col("offset").cast("long").alias("_from"),
    )


def end_positions(df: DataFrame) -> DataFrame:
    """Next offset of every partition of ``df``: what a reader that starts now would begin with."""
    return df.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("offset"))


def _from_positions(df: DataFrame, at: DataFrame, reset: str | None) -> DataFrame:
    """Rows at or after the position of their partition; ``reset`` covers partitions without one."""
    at = positions(at)
    same = (df["topic"] == at["_topic"]) & (df["partition"] == at["_partition"])
    if reset == "earliest":
        joined = df.join(at, same, "left").where(F.col("offset") >= F.coalesce("_from", F.lit(0)))
    else:
        joined = df.join(at, same & (df["offset"] >= at["_from"]))
    return joined.select(*[df[c] for c in df.columns])


def scan_log(
    df: DataFrame,
    start: str | None = None,
    topics: Sequence[str] | str | None = None,
    at: DataFrame | str | None = None,
    committed: DataFrame | None = None,
    offsets: Mapping[int, int] | DataFrame | None = None,
    reset: str = "earliest",
) -> DataFrame:
    """Messages of some topics from a start position on.

    ``at`` is the end positions at job start for ``latest-offset`` or a time for
    ``timestamp``; ``committed`` is the next offset per partition of the group, where
    ``reset`` says what a partition without one does; ``offsets`` maps a partition
    (or topic and partition, as a frame) to its first offset.
    """
    mode = start_mode(start)
    if topics:
        names = [t.strip() for t in topics.split(",")] if isinstance(topics, str) else list(topics)
        df = df.where(F.col("topic").isin(*names))
    if mode == "earliest-offset":
        return df
    if mode == "latest-offset":
        if at is None:
            raise ValueError("latest-offset needs the end positions at job start")
        # A partition that appears after the start is read from its beginning.
        return _from_positions(df, at, "earliest")
    if mode == "group-offsets":
        if committed is None:
            raise ValueError("group-offsets needs the committed offsets")
        return _from_positions(df, committed, reset)
    if mode == "timestamp":
        if at is None:
            raise ValueError("timestamp needs a start time")
        if df.isStreaming:
            raise ValueError("find the positions on the table form of the log and start at these offsets")
        since = F.lit(at).cast(df.schema["timestamp"].dataType)
        first = df.where(F.col("timestamp") >= since).groupBy("topic", "partition").agg(F.min("offset").alias("offset"))
        return _from_positions(df, first, None)
    if offsets is None:
        raise ValueError("specific-offsets needs an offset per partition")
    if isinstance(offsets, DataFrame):
        return _from_positions(df, offsets, "earliest")
    pairs = [F.lit(v) for pair in offsets.items() for v in pair]
    first = F.try_element_at(F.create_map(*pairs), F.col("partition"))
    return df.where(F.col("offset") >= F.coalesce(first, F.lit(0)))


def topic_list(df: DataFrame) -> DataFrame:
    """Topics in the log, without internal ones."""
    return df.where(~F.col("topic").startswith(INTERNAL_PREFIX)).select("topic").distinct()


def reader_options(
    servers: str,
    topics: Sequence[str] | str,
    start: str | None = None,
    group: str | None = None,
    at_millis: int | None = None,
    offsets: Mapping[str, Mapping[int, int]] | None = None,
    committed: Mapping[str, Mapping[int, int]] | None = None,
) -> dict[str, str]:
    """Options of Spark's Kafka reader for a start mode.

    Spark keeps its own offsets in the checkpoint; ``group-offsets`` therefore needs the
    committed offsets once, for the first start.
    """
    names = topics if isinstance(topics, str) else ",".join(topics)
    options = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(t.strip() for t in names.split(","))}
    if group:
        options["kafka.group.id"] = group
    mode = start_mode(start)
    if mode == "earliest-offset":
        options["startingOffsets"] = "earliest"
    elif mode == "latest-offset":
        options["startingOffsets"] = "latest"
    elif mode == "timestamp":
        if at_millis is None:
            raise ValueError("timestamp needs a start time in milliseconds")
        options["startingTimestamp"] = str(at_millis)
    else:
        given = committed if mode == "group-offsets" else offsets
        if given is None:
            raise ValueError(f"{mode} needs an offset per topic and partition")
        options["startingOffsets"] = json.dumps({t: {str(p): o for p, o in ps.items()} for t, ps in given.items()})
    return options


def read_log(spark: SparkSession, servers: str, topics: Sequence[str] | str, start: str | None = None, **choice) -> DataFrame:
    """Stream from a live broker; needs Spark's Kafka package on the class path."""
    return spark.readStream.format("kafka").options(**reader_options(servers, topics, start, **choice)).load()
