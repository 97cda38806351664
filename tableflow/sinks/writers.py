"""Append, file, bucket and print targets."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = "_bucket"

# Formats of the file target, and the default number of hash buckets.
FILE_FORMATS = ("csv", "json", "parquet")
DEFAULT_BUCKETS = 10


def sink_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a directory of CSV (with header), JSON or Parquet files."""
    if fmt not in FILE_FORMATS:
        raise ValueError(f"file format {fmt!r}, expected one of {FILE_FORMATS}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def sink_append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append to an unkeyed target."""
    sink_files(df, path, fmt, mode="append")


def sink_print(df: DataFrame) -> DataFrame:
    """Every row, printed to the log of the task that has it when the result is used."""

    def show(batches):
        for batch in batches:
            for row in batch.to_pylist():
                print(row, file=sys.stderr)
            yield batch

    return df.mapInArrow(show, df.schema)


def bucketed(df: DataFrame, keys: Sequence[str] = (), n: int = DEFAULT_BUCKETS) -> DataFrame:
    """Rows with the number of their hash bucket; without a key the first column decides."""
    chosen = list(keys) or df.columns[:1]
    return df.withColumn(BUCKET, F.pmod(F.hash(*chosen), F.lit(n)))


def sink_hash_buckets(df: DataFrame, path: str, keys: Sequence[str] = (), n: int = DEFAULT_BUCKETS) -> None:
    """Write one folder per hash bucket of the key.

    The rows are drawn together per bucket; adaptive execution splits a bucket that a hot
    key makes too large over several tasks, which then write a file each.
    """
    placed = bucketed(df, keys, n).hint("rebalance", F.col(BUCKET))
    placed.write.mode("append").partitionBy(BUCKET).parquet(path)
