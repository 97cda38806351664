"""Starting, resuming and restoring streaming queries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tableflow.sinks.files import Files

EachBatch = Callable[[DataFrame, int], None]


def start(
    stream: DataFrame,
    checkpoint: str,
    path: str | None = None,
    each_batch: EachBatch | None = None,
    mode: str = "append",
    every: str | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Run a stream into files at ``path`` or into ``each_batch(frame, batch_id)``.

    The checkpoint holds positions and state per micro-batch and the file target keeps
    its own log, so files are exactly once; ``each_batch`` must give the same result
    for the same batch id. ``every`` is the trigger interval; without it the query
    takes what is there and ends: in one batch, unless the source has ``maxFilesPerTrigger`` or
    ``maxBytesPerTrigger``.
    """
    if (path is None) == (each_batch is None):
        raise ValueError("give either a path or each_batch")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if name:
        writer = writer.queryName(name)
    if each_batch:
        return writer.foreachBatch(each_batch).start()
    return writer.format("parquet").option("path", path).start()


def drain(stream: DataFrame, checkpoint: str, **target) -> StreamingQuery:
    """Run over everything that is there and wait for the end."""
    query = start(stream, checkpoint, **target)
    query.awaitTermination()
    return query


def batch_folders(path: str) -> EachBatch:
    """Files in one folder per batch; a batch that runs again replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_output(spark: SparkSession, path: str, stream: DataFrame) -> DataFrame:
    """What a query has written to its file target, in the stream's schema."""
    Files(spark).make_dirs(path)
    return spark.read.schema(stream.schema).parquet(path)


def has_state(spark: SparkSession, checkpoint: str) -> bool:
    return Files(spark).exists(f"{checkpoint}/metadata")


def resume(stream: DataFrame, checkpoint: str, **target) -> StreamingQuery:
    """Go on from the newest state of this checkpoint; an unknown checkpoint is an error."""
    if not has_state(stream.sparkSession, checkpoint):
        raise ValueError(f"nothing to resume at {checkpoint}")
    return drain(stream, checkpoint, **target)


def save_state(spark: SparkSession, checkpoint: str, saved: str) -> None:
    """Copy the state of a stopped query."""
    query_id = json.loads(Files(spark).read(f"{checkpoint}/metadata"))["id"]
    if spark.streams.get(query_id) is not None:
        raise ValueError("stop the query before its state is copied")
    Files(spark).copy_tree(checkpoint, saved)


def restore(stream: DataFrame, saved: str, checkpoint: str, each_batch: EachBatch, mode: str = "append") -> StreamingQuery:
    """Start a new run from a saved state; the saved copy stays as it is.

    The file target of a stream keeps a log of its own that only fits the run it was
    written by, so a restored run writes through ``each_batch`` (``batch_folders``).
    """
    spark = stream.sparkSession
    if not has_state(spark, saved):
        raise ValueError(f"no saved state at {saved}")
    if has_state(spark, checkpoint):
        raise ValueError(f"{checkpoint} already holds a run")
    Files(spark).copy_tree(saved, checkpoint)
    return drain(stream, checkpoint, each_batch=each_batch, mode=mode)


def dropped_late(query: StreamingQuery) -> int:
    """Pieces of input that came behind the watermark, over the progress the query still holds."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
