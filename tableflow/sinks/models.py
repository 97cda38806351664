"""Key models of warehouse tables: unique, aggregate and duplicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.keyed import latest_per
from tableflow.sinks.keyed_table import KeyedTable

# Aggregates a value column of an aggregate table can carry. Each can be
# applied again to its own results.
FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def load_unique(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One row per key, the newest by ``seq``."""
    return latest_per(df, keys, seq)


def load_aggregate(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    folds: Mapping[str, str],
    batch_id: int | None = None,
    buckets: int | None = None,
) -> KeyedTable:
    """Fold a slice of rows into the aggregate table at ``path``.

    Every column that is not a key needs its fold. A slice is added once per batch id:
    a repeated id starts again from the state before it.
    """
    values = [c for c in df.columns if c not in keys]
    if set(values) != set(folds):
        raise ValueError(f"one fold per value column: {sorted(set(values) ^ set(folds))}")
    unknown = set(folds.values()) - set(FOLDS)
    if unknown:
        raise ValueError(f"folds {sorted(unknown)}, expected {sorted(FOLDS)}")

    def fold(frame: DataFrame, by: list[str]) -> DataFrame:
        return frame.groupBy(*by).agg(*[FOLDS[folds[v]](v).alias(v) for v in values])

    types = {f.name: f.dataType for f in fold(df, list(keys)).schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in [*keys, *values]])
    table = KeyedTable.create(df.sparkSession, path, schema, keys, buckets)
    table.merge(df, fold, batch_id)
    return table


def load_duplicate(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append all rows, sorted by key inside each file.

    The sort stays within the tasks that hold the rows: no shuffle, and a hot key is
    not drawn together.
    """
    df.sortWithinPartitions(*keys).write.mode("append").parquet(path)
