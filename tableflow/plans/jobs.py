"""Jobs: forms, statement sets, table synchronisation and custom SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableflow.operators.aggregates import Aggs, aggregate
from tableflow.operators.project import map_fields
from tableflow.sinks.bulk import bulk_load
from tableflow.sinks.jdbc import sink_jdbc
from tableflow.sinks.models import load_unique
from tableflow.sinks.upsert import read_upserted, sink_upsert
from tableflow.sources.changes import cdc_decode
from tableflow.sources.decode import decode
from tableflow.sources.logs import read_log, scan_log
from tableflow.sources.tables import stream_table
from tableflow.streaming.changelog import tagged, untagged
from tableflow.streaming.runner import drain, start
from tableflow.streaming.signed import as_changes, grouped, signed

Sink = Callable[[dict[str, DataFrame], int], None]


def _launch(stream: DataFrame, checkpoint: str, every: str | None, **target) -> StreamingQuery:
    """With a trigger interval a job goes on until it is stopped; without one it takes what is there and ends."""
    return start(stream, checkpoint, every=every, **target) if every else drain(stream, checkpoint, **target)


def run_statement_set(
    sources: Mapping[str, DataFrame], sinks: Mapping[str, Sink], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Several INSERTs as one job: every source is read once per batch, for all sinks. ``every`` as in ``run_job``.

    A sink gets the batch as ``{source: frame}`` with its batch id. Sinks that need more
    than the batch, such as joins, keep a snapshot of their own (``ChangelogJoin``).
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            parts = {name: untagged(batch, name) for name in sources}
            for sink in sinks.values():
                sink(parts, batch_id)
        finally:
            batch.unpersist()

    return _launch(tagged(dict(sources)), checkpoint, every, each_batch=each_batch)


def sync_tables(
    spark: SparkSession,
    tables: Sequence[str | Mapping[str, object]],
    source: Mapping[str, object],
    sink: Mapping[str, object],
) -> dict[str, StreamingQuery]:
    """Copy tables with one common source and sink setting, one query each, side by side.

    ``source`` names the folder of the tables and reader options; ``sink`` the target and
    checkpoint folders, and with ``every`` the trigger interval at which the queries go on until
    they are stopped. A table given as ``{"name", "keys", "seq"}`` is kept by key.
    """
    every = sink.get("every")
    running = {}
    for entry in tables:
        spec = {"name": entry} if isinstance(entry, str) else dict(entry)
        name = spec["name"]
        options = {k: v for k, v in source.items() if k not in ("path", "suffix")}
        stream = stream_table(spark, f"{source['path']}/{name}{source.get('suffix', '')}", **options)
        target, checkpoint = f"{sink['path']}/{name}", f"{sink['checkpoint']}/{name}"
        if spec.get("keys"):

            def each_batch(batch: DataFrame, batch_id: int, spec=spec, target=target) -> None:
                sink_upsert(batch, target, spec["keys"], spec["seq"], spec.get("op"), batch_id, spec.get("buckets"))

            running[name] = start(stream, checkpoint, each_batch=each_batch, every=every)
        else:
            running[name] = start(stream, checkpoint, path=target, every=every)
    if not every:
        for query in running.values():
            query.awaitTermination()
    return running


def _write(target: Mapping[str, object], rows: DataFrame, batch_id: int) -> None:
    kind = target.get("type", "files")
    if kind == "upsert":
        sink_upsert(
            rows, target["path"], target["keys"], target["seq"], target.get("op"), batch_id, target.get("buckets")
        )
    elif kind == "bulk":
        bulk_load(rows, batch_id, target["path"], target["fields"], target.get("label_prefix", "load"))
    elif kind == "jdbc":
        keys, options = target.get("keys"), target.get("options", {})
        newest = load_unique(rows, keys, target["seq"]) if keys else rows
        sink_jdbc(newest, target["url"], target["table"], keys, target.get("op"), target.get("fields"), **options)
    else:
        raise ValueError(f"target type {kind!r}, expected files, upsert, bulk or jdbc")


# What a change carries beside its row.
CHANGE = ("op", "ts_ms")


def _changes(messages: DataFrame, spec: Mapping[str, object]) -> DataFrame:
    """Mapped rows of change envelopes with their operation, source time and position."""
    position = list(spec.get("position", ()))
    rows = cdc_decode(messages, spec["schema"], position=position)
    beside = [{"source": c, "target": c} for c in (*CHANGE, *position)]
    return map_fields(rows, [*spec["mappings"], *beside] if spec.get("mappings") else None)


# What orders the writes of a feed's rows.
FEED_SEQ = ["_batch", "_step"]


def _run_grouped(rows: DataFrame, spec: Mapping[str, object]) -> StreamingQuery:
    """Groups over a change feed into the form's target, which is keyed by the columns of ``by``."""
    target, group = spec["target"], spec["aggregate"]
    feed = grouped(signed(rows, target["keys"], target["seq"], CHANGE[0]), group["by"], group["aggs"])
    into = {**target, "keys": list(group["by"]), "seq": FEED_SEQ, "op": "op"}

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        _write(into, as_changes(batch, into["keys"], batch_id), batch_id)

    return _launch(feed, spec["checkpoint"], spec.get("every"), each_batch=each_batch)


def run_job(spark: SparkSession, spec: Mapping[str, object], messages: DataFrame | None = None) -> StreamingQuery:
    """Run a form: log, schema, field mapping and target, as one query.

    ``messages`` stands in for the live broker named by ``spec["servers"]``. The target is
    ``{"type": "files" | "upsert" | "bulk" | "jdbc", ...}``. ``group`` is the reader's group id.

    ``source: "changes"`` reads change envelopes instead of plain rows. Its target is keyed: updates
    replace and deletes remove rows; ``seq`` is the source time and the fields of ``position``
    unless the target says otherwise. With ``aggregate: {"by", "aggs"}`` the target keeps these groups up to date.

    With ``every`` (a trigger interval) the job goes on until it is stopped, and this returns the running query.
    """
    given = dict(spec.get("start", {}))
    if messages is None:
        if spec.get("group"):
            given["group"] = spec["group"]
        messages = read_log(spark, spec["servers"], spec["topics"], spec.get("start_mode"), **given)
    else:
        messages = scan_log(messages, spec.get("start_mode"), spec.get("topics"), **given)
    checkpoint, every, target = spec["checkpoint"], spec.get("every"), spec["target"]
    if spec.get("source", "log") == "changes":
        if target.get("type") not in ("upsert", "jdbc"):
            raise ValueError("a change feed needs a keyed target: upsert or jdbc")
        target = {"op": CHANGE[0], "seq": [CHANGE[1], *spec.get("position", ())], **target}
        rows = _changes(messages, spec)
        if spec.get("aggregate"):
            return _run_grouped(rows, {**spec, "target": target})
    else:
        rows = decode(messages, spec.get("schema"), spec.get("format", "json"))
        rows = map_fields(rows, spec.get("mappings"))
    if target.get("type", "files") == "files":
        return _launch(rows, checkpoint, every, path=target["path"])
    return _launch(rows, checkpoint, every, each_batch=lambda batch, batch_id: _write(target, batch, batch_id))


def job_groups(spark: SparkSession, spec: Mapping[str, object]) -> DataFrame:
    """The groups that a change form with ``aggregate`` keeps in an upsert target."""
    return read_upserted(spark, spec["target"]["path"]).drop(*FEED_SEQ)


def aggregate_to_sink(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    aggs: Aggs,
    checkpoint: str | None = None,
    buckets: int | None = None,
    **filters,
) -> None:
    """GROUP BY into a keyed target: the group columns are its key, the aliases its columns.

    A stream goes through its running aggregate, which gives out the groups a batch changed.
    """
    grouped = aggregate(df, by, aggs, **filters)

    def write(rows: DataFrame, batch_id: int) -> None:
        stamped = rows.withColumn("_batch", F.lit(batch_id).cast("long"))
        sink_upsert(stamped, path, by, ["_batch"], batch_id=batch_id, buckets=buckets)

    if df.isStreaming:
        drain(grouped, checkpoint, each_batch=write, mode="update")
    else:
        write(grouped, 0)


def run_sql(
    spark: SparkSession,
    statements: Sequence[str | tuple[str, str]],
    sources: Mapping[str, DataFrame] | None = None,
    sinks: Mapping[str, Callable[[DataFrame, int], None]] | None = None,
    checkpoint: str | None = None,
) -> list[DataFrame]:
    """Run statements in order over named sources; returns the rows of each SELECT.

    A statement ``(sink, query)`` feeds the query into a named sink; over streaming
    sources that is a query of its own with its state below ``checkpoint``. A plain
    statement goes to Spark as it is, INSERTs into catalog tables included.
    """
    for name, frame in (sources or {}).items():
        frame.createOrReplaceTempView(name)
    results = []
    for number, statement in enumerate(statements):
        if isinstance(statement, str):
            out = spark.sql(statement)
            if out.columns:
                results.append(out)
            continue
        sink, query = statement
        rows = spark.sql(query)
        if rows.isStreaming:
            drain(rows, f"{checkpoint}/{number}-{sink}", each_batch=sinks[sink])
        else:
            sinks[sink](rows, 0)
    return results

