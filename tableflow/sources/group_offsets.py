"""Offsets that a reader group has committed: a ledger of the next offset per topic and partition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableflow.sinks.files import Files
from tableflow.sources.logs import end_positions
from tableflow.streaming.runner import drain, start

POSITIONS = "topic string, partition int, offset long"


class GroupOffsets:
    """What a group has read, in a folder that all jobs of the group share.

    Each job writes one small file per batch, in a folder of its own: a batch that runs again replaces its
    entry, and jobs of a group that run side by side don't touch each other's. The furthest offset of a partition counts.
    """

    def __init__(self, spark: SparkSession, path: str, group: str):
        if not group or "/" in group:
            raise ValueError(f"group {group!r} cannot name a folder")
        self.spark, self.path = spark, f"{path}/group={group}"

    def commit(self, batch: DataFrame, job: str, batch_id: int) -> None:
        """The messages of a batch are done with."""
        read = end_positions(batch).select("topic", F.col("partition").cast("int"), F.col("offset").cast("long"))
        read.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/job={job}/batch={batch_id}")

    def committed(self) -> DataFrame:
        """The next offset of every partition that the group has read from; none before its first batch."""
        Files(self.spark).make_dirs(self.path)
        entries = self.spark.read.schema(POSITIONS).option("recursiveFileLookup", "true").parquet(self.path)
        return entries.groupBy("topic", "partition").agg(F.max("offset").alias("offset"))

    def run(
        self,
        messages: DataFrame,
        job: str,
        checkpoint: str,
        each_batch: Callable[[DataFrame, int], None],
        every: str | None = None,
    ) -> StreamingQuery:
        """Run a stream of messages into ``each_batch`` and commit each batch after it.

        A job that ends between the two runs the batch again under its id when it is resumed. ``job`` names the
        folder of its commits: the same after a restart, another for another job.
        """

        def write(batch: DataFrame, batch_id: int) -> None:
            each_batch(batch, batch_id)
            self.commit(batch, job, batch_id)

        run = start if every else drain
        return run(messages, checkpoint, each_batch=write, **({"every": every} if every else {}))
