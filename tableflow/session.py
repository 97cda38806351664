"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED_DIR = "spark.checkpoint.dir"

# What the operators count on, in any session.
SQL_SETTINGS = {
    # Watermarks need instants; naive times are read as UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits oversized sort-merge partitions, so one hot join key does not sit in one task,
    # also where that costs another shuffle further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Splits the hot bucket of a rebalanced write.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Merges the sessions of a key inside each map task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

# Join and window state larger than the heap of an executor.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Counting the rows of a store costs a read before each write; progress then has no ``numRowsTotal``.
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def apply_settings(spark: SparkSession) -> None:
    """Bring a session that was made elsewhere to the settings the operators count on."""
    for key, value in {**SQL_SETTINGS, **STATE_SETTINGS}.items():
        spark.conf.set(key, value)


def build_session(app: str = "tableflow", master: str | None = None, **options: object) -> SparkSession:
    """A session with the settings the operators are designed for; ``options`` win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **STATE_SETTINGS, **options}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster that
    folder would exist on one machine only.
    """
    base = spark.conf.get(SHARED_DIR, None)
    if base:
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {SHARED_DIR} to a folder all executors can reach")
    base = tempfile.mkdtemp(prefix="tableflow-")
    spark.conf.set("tableflow.local.dir", base)
    return base


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    base = spark.conf.get("tableflow.local.dir", None) or shared_dir(spark)
    return f"{base.rstrip('/')}/tableflow/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, eager: bool = True):
    """``checkpoint()`` into the shared folder; survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(work_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager)
