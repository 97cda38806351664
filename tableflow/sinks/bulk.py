"""Labelled bulk loads with a tolerated share of rejected rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.functions.types import target_type
from tableflow.operators.project import REASON, fit_rows
from tableflow.sinks.files import Files

# Fixed value: share of rows a load may reject.
MAX_REJECT = 0.1
OK = "_ok"


class LoadRejected(Exception):
    """More rows of a load did not fit the target than tolerated."""


def load_label(prefix: str, table: str, batch_id: int) -> str:
    """Name of a load: the same for every try of a batch."""
    return f"{prefix}_{table}_{batch_id}"


def bulk_load(
    batch: DataFrame,
    batch_id: int,
    path: str,
    fields: Sequence[Mapping[str, object]],
    label_prefix: str = "load",
    max_reject: float = MAX_REJECT,
) -> dict[str, object]:
    """Load a micro-batch into the table at ``path``, once per label.

    The batch is cast and written in one pass, good and rejected rows apart, and both
    are counted from the file footers. Only then the label is published: readers follow
    published labels, so a failed or repeated try leaves no row behind.
    """
    spark = batch.sparkSession
    files = Files(spark)
    root = path.rstrip("/")
    label = load_label(label_prefix, root.rsplit("/", 1)[-1], batch_id)
    ledger = f"{root}/_loads/{label}.json"
    if files.exists(ledger):
        return {**json.loads(files.read(ledger)), "status": "already loaded"}

    folder = f"data/{label}-{uuid.uuid4().hex}"
    checked = fit_rows(batch, fields).withColumn(OK, F.col(REASON).isNull())
    checked.write.partitionBy(OK).parquet(f"{root}/{folder}")
    counts = {}
    for flag in ("true", "false"):
        part = f"{root}/{folder}/{OK}={flag}"
        counts[flag] = spark.read.schema(_stored(fields)).parquet(part).count() if files.exists(part) else 0
    loaded, rejected = counts["true"], counts["false"]
    total = loaded + rejected
    if total and rejected / total > max_reject:
        files.delete(f"{root}/{folder}")
        raise LoadRejected(f"{label}: {rejected} of {total} rows rejected, tolerated share {max_reject}")
    record = {"label": label, "folder": folder, "loaded": loaded, "rejected": rejected, "status": "loaded"}
    if not files.publish(ledger, json.dumps(record)):
        raise RuntimeError(f"{ledger} could not be published: another load has this label")
    return record


def _stored(fields: Sequence[Mapping[str, object]]) -> T.StructType:
    columns = [T.StructField(str(f["name"]), target_type(f)) for f in fields]
    return T.StructType([*columns, T.StructField(REASON, T.StringType())])


def _parts(spark: SparkSession, path: str, flag: str, schema: T.StructType) -> DataFrame:
    files = Files(spark)
    root = path.rstrip("/")
    folders = [json.loads(files.read(f"{root}/_loads/{name}"))["folder"] for name in files.names(f"{root}/_loads")]
    parts = [f"{root}/{folder}/{OK}={flag}" for folder in folders]
    parts = [part for part in parts if files.exists(part)]
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*parts)


def read_loaded(spark: SparkSession, path: str, fields: Sequence[Mapping[str, object]]) -> DataFrame:
    """Rows of all published loads."""
    return _parts(spark, path, "true", _stored(fields)).drop(REASON)


def read_rejected(spark: SparkSession, path: str, fields: Sequence[Mapping[str, object]]) -> DataFrame:
    """Rejected rows of all published loads, with their reason."""
    return _parts(spark, path, "false", _stored(fields))
