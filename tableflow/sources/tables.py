"""Relational tables over JDBC, generated rows, and files as streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.sinks.files import Files
from tableflow.sources.decode import Schema, as_schema

# Fixed value: length of a generated text.
TEXT_LENGTH = 100


def key_ranges(key: str, splits: Sequence[object]) -> list[str]:
    """WHERE clauses that cut a table into ranges of its key: every row, null keys too, falls in one."""

    def literal(value: object) -> str:
        return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"

    bounds = [literal(s) for s in splits]
    if not bounds:
        return ["1 = 1"]
    middle = [f"{key} > {a} AND {key} <= {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [f"{key} <= {bounds[0]} OR {key} IS NULL", *middle, f"{key} > {bounds[-1]}"]


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    splits: Sequence[object] = (),
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A table over JDBC, read by several tasks when a key is given.

    With ``splits`` (cut points of the key, e.g. from an index histogram) each range is
    one task, so uneven keys still give even reads. With ``partitions`` alone the span
    between the lowest and highest key is cut evenly.
    """
    if key and splits:
        return spark.read.jdbc(url, table, predicates=key_ranges(key, splits), properties=dict(options))
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and partitions > 1:
        ends = reader.load().agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        if ends["lo"] is not None:
            reader = reader.options(
                partitionColumn=key, lowerBound=str(ends["lo"]), upperBound=str(ends["hi"]), numPartitions=partitions
            )
    return reader.load()


def stream_table(spark: SparkSession, path: str, schema: T.StructType | None = None, **options: object) -> DataFrame:
    """A parquet table, one file or a folder, as a stream of its files."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).options(**options)
    if Files(spark).is_file(path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def stream_slices(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream over folders below ``path`` that are added one by one."""
    Files(spark).make_dirs(path)
    return spark.readStream.schema(schema).parquet(f"{path}/*")


def _generated(field: T.StructField, position: Column, seed: int) -> Column:
    """A value that depends on row number, column and seed only."""
    h = F.xxhash64(position, F.lit(field.name), F.lit(seed))
    kind = field.dataType
    if isinstance(kind, T.StringType):
        blocks = [F.sha2(F.concat_ws("-", h.cast("string"), F.lit(i)), 256) for i in range(TEXT_LENGTH // 64 + 1)]
        return F.substring(F.concat(*blocks), 1, TEXT_LENGTH)
    if isinstance(kind, T.BooleanType):
        return h % 2 == 0
    if isinstance(kind, T.IntegerType):
        return F.pmod(h, F.lit(2**31)).cast("int")
    if isinstance(kind, T.LongType):
        return h
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.pmod(h, F.lit(2**31)) / F.lit(float(2**31))).cast(kind)
    if isinstance(kind, T.DecimalType):
        return (F.pmod(h, F.lit(10 ** min(kind.precision - kind.scale, 9)))).cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_seconds(F.pmod(h, F.lit(2**31))).cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.pmod(h, F.lit(20000)).cast("int"))
    raise ValueError(f"no generator for {kind.simpleString()}")


def _filled(rows: DataFrame, number: str, schema: Schema, seed: int, sequences: Mapping[str, int]) -> DataFrame:
    fields = as_schema(schema).fields
    return rows.select(
        *[
            (
                (F.col(number) + sequences[f.name]).cast(f.dataType)
                if f.name in sequences
                else _generated(f, F.col(number), seed)
            ).alias(f.name)
            for f in fields
        ]
    )


def datagen(
    spark: SparkSession,
    schema: Schema,
    rows: int,
    seed: int = 0,
    sequences: Mapping[str, int] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``rows`` made-up rows of a schema; ``sequences`` names columns that count up from a start."""
    return _filled(spark.range(0, rows, 1, partitions), "id", schema, seed, sequences or {})


def datagen_stream(
    spark: SparkSession,
    schema: Schema,
    rows_per_second: int = 1,
    seed: int = 0,
    sequences: Mapping[str, int] | None = None,
) -> DataFrame:
    """The same rows as an endless stream at a given rate."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return _filled(ticks, "value", schema, seed, sequences or {})
