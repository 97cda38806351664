"""Records of streaming runs, written as they start, go on and end."""

from __future__ import annotations

import json
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tableflow.operators.keyed import lineage
from tableflow.sinks.files import Files

STARTED, PROGRESS, ENDED = "started", "progress", "ended"
EVENTS = "kind string, run_id string, job_id string, name string, at string, batch long, input_rows long, error string"

# How long the end of a log waits for events that are under way.
PATIENCE_MILLIS = 60_000


class _Listener(StreamingQueryListener):
    def __init__(self, log: RunLog):
        self.log = log

    def onQueryStarted(self, event) -> None:
        self.log.write(STARTED, event.runId, event.id, name=event.name, at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.log.write(PROGRESS, p.runId, p.id, name=p.name, at=p.timestamp, batch=p.batchId, input_rows=p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.log.write(ENDED, event.runId, event.id, error=event.exception)


class RunLog:
    """Writes a record for each event of the session's queries, for as long as the ``with`` block lasts.

    A record is one small file below ``path``, so that several drivers can share a log. A query that is resumed from its
    checkpoint keeps its job id and is a run of its own, whose parent is the run before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files, self.n = spark, path, Files(spark), 0
        self.listener = _Listener(self)

    def write(self, kind: str, run_id, job_id, **values: object) -> None:
        self.n += 1
        record = {"kind": kind, "run_id": str(run_id), "job_id": str(job_id), **values}
        self.files.publish(f"{self.path}/{run_id}-{self.n:012d}.json", json.dumps(record) + "\n")

    def __enter__(self) -> RunLog:
        self.files.make_dirs(self.path)
        self.spark.streams.addListener(self.listener)
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        # Events are handed on by another thread.
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(PATIENCE_MILLIS)
        self.spark.streams.removeListener(self.listener)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run: its job, name, ``state``, start, batches and rows that sinks have read, error, and ``parent`` run.

    A run is RUNNING until its end is recorded, then FAILED if it ended with an error, else FINISHED.
    """
    events = spark.read.schema(EVENTS).json(path)
    is_kind = {k: F.col("kind") == k for k in (STARTED, PROGRESS, ENDED)}
    ended = F.max(F.when(is_kind[ENDED], 1).otherwise(0)) == 1
    per_run = events.groupBy("run_id", "job_id").agg(
        F.max("name").alias("name"),
        F.min(F.when(is_kind[STARTED], F.to_timestamp("at"))).alias("started"),
        F.when(ended, F.when(F.max("error").isNotNull(), "FAILED").otherwise("FINISHED")).otherwise("RUNNING").alias("state"),
        F.count_distinct(F.when(is_kind[PROGRESS] & (F.col("input_rows") > 0), F.col("batch"))).alias("batches"),
        F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"),
        F.max("error").alias("error"),
    )
    before = Window.partitionBy("job_id").orderBy("started", "run_id")
    return per_run.withColumn("parent", F.lag("run_id").over(before))


def chains(spark: SparkSession, path: str) -> DataFrame:
    """``id, root, depth`` of every run: the first run of its job, and how often it was resumed since."""
    return lineage(runs(spark, path), "run_id", "parent")
