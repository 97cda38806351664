"""Keyed targets: last write per key wins, deletes remove."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.operators.keyed import latest_per
from tableflow.sinks.keyed_table import KeyedTable, Places
from tableflow.sources.changes import DELETE

SEQ = "_seq"
GONE = "_gone"


def newest(frame: DataFrame, keys: list[str]) -> DataFrame:
    return latest_per(frame, keys, [SEQ])


def sink_upsert(
    batch: DataFrame,
    path: str,
    keys: Sequence[str],
    seq: Sequence[str],
    op: str | None = None,
    batch_id: int | None = None,
    buckets: int | None = None,
    folded: bool = False,
    touched: Places | None = None,
    horizon: Sequence[object] | None = None,
) -> KeyedTable:
    """Merge a batch into the keyed target at ``path``.

    ``seq`` orders the writes of a key, across batches too: a row that comes late loses
    against the newer one it meets. A delete stays as a marker for the same reason.
    Merging a batch twice changes nothing. ``folded`` and ``touched`` as in
    ``KeyedTable.merge``.

    ``horizon``, values of ``seq``, promises that no write from before it is still to come: markers of
    deletes from before it leave the buckets that the batch writes.
    """
    values = [c for c in batch.columns if c != op]
    gone = F.lit(False) if op is None else F.col(op).eqNullSafe(DELETE)
    rows = batch.select(*values, F.struct(*seq).alias(SEQ), gone.alias(GONE))
    # Nullability differs between batches; the stored schema takes none for granted.
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    table = KeyedTable.create(batch.sparkSession, path, schema, keys, buckets)
    kept = None
    if horizon is not None:
        kinds = schema[SEQ].dataType.fields
        given = zip(kinds, horizon, strict=True)
        kept = ~F.col(GONE) | (F.col(SEQ) >= F.struct(*[F.lit(v).cast(k.dataType).alias(k.name) for k, v in given]))
    table.merge(rows, newest, batch_id, folded, touched, kept)
    return table


def read_upserted(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The live rows of a keyed target."""
    return KeyedTable(spark, path).read(before).where(~F.col(GONE)).drop(SEQ, GONE)
