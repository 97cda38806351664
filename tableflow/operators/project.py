"""Projections: picked columns, renames, column lists and casts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.types import fitted, source_spark_type

REASON = "_reason"


def map_fields(df: DataFrame, mappings: Sequence[Mapping[str, str]] | None = None) -> DataFrame:
    """Pick and rename by ``[{"source": ..., "target": ...}]``; without a list keep all columns."""
    if not mappings:
        return df
    return df.select(*[F.col(f"`{m['source']}`").alias(m["target"]) for m in mappings])


def insert_columns(df: DataFrame, target: T.StructType, columns: Sequence[str]) -> DataFrame:
    """Rows for an INSERT with a column list: matched by position, other target columns are null."""
    if len(columns) != len(df.columns):
        raise ValueError(f"{len(columns)} columns listed, {len(df.columns)} selected")
    unknown = set(columns) - set(target.names)
    if unknown:
        raise ValueError(f"not in the target: {sorted(unknown)}")
    listed = df.toDF(*columns)
    return listed.select(
        *[
            (F.col(f"`{f.name}`") if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        ]
    )


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by position, each value cast to the type of the sink column."""
    named = df.toDF(*schema.names)
    return named.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def cast_from_source(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """A raw text table in engine types, by the source's type names; a bad value is null."""
    return df.select(
        *[F.col(f"`{c}`").try_cast(source_spark_type(t)).alias(c) for c, t in types.items()]
    )


def cast_failures(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """One row: how many values of each column its type cannot hold."""
    return df.agg(
        *[
            F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(source_spark_type(t)).isNull()).alias(c)
            for c, t in types.items()
        ]
    )


def fit_rows(df: DataFrame, fields: Sequence[Mapping[str, object]]) -> DataFrame:
    """Rows in the target's types, with the first reason a row does not fit (null if it does)."""
    values: list[Column] = []
    reasons: list[Column] = []
    for field in fields:
        value, reason = fitted(field)
        values.append(value)
        reasons.append(reason)
    return df.select(*values, F.coalesce(*reasons).alias(REASON))


def conform_to_sink(df: DataFrame, fields: Sequence[Mapping[str, object]]) -> tuple[DataFrame, DataFrame]:
    """Split rows into those that fit the target's types and those that do not (as read, with a reason)."""
    reasons = [fitted(field)[1] for field in fields]
    marked = df.withColumn(REASON, F.coalesce(*reasons))
    good = marked.where(F.col(REASON).isNull()).select(*[fitted(field)[0] for field in fields])
    return good, marked.where(F.col(REASON).isNotNull())


def text_preview(df: DataFrame, column: str, length: int = 500) -> DataFrame:
    """Listing form of a long text: its first characters and ``...``, with its full size in bytes."""
    text = F.col(f"`{column}`")
    short = F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)
    return df.select(*[c for c in df.columns if c != column], short.alias("preview"), F.octet_length(text).alias("size"))
