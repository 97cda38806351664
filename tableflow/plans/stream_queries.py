"""Streams: running aggregates, windows, joins, deduplication and recovery."""

from __future__ import annotations

import contextlib

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tableflow.operators.aggregates import aggregate
from tableflow.operators.windows import hop, session, tumble, window_agg
from tableflow.plans.batch_queries import SESSIONS, WINDOW_AGGS
from tableflow.plans.inputs import halves, heartbeat, naive, table, zoned
from tableflow.plans.jobs import aggregate_to_sink
from tableflow.plans.registry import query
from tableflow.session import work_dir
from tableflow.sinks.keyed_table import buckets_for
from tableflow.sinks.upsert import read_upserted, sink_upsert
from tableflow.sources.tables import stream_slices, stream_table
from tableflow.streaming.joins import dedup, stream_join
from tableflow.streaming.run_log import RunLog, chains, runs
from tableflow.streaming.runner import batch_folders, drain, read_output, restore, resume, save_state
from tableflow.streaming.signed import grouped, plain, settled

# Tasks that share the rows of a hot join key.
SALT = 4

TOTALS = {"n": ("count", "*"), "s": ("sum", "value")}
TOTALS_SQL = "select user_id, count(*) n, round(sum(value), 2) s from events group by 1"


def _events(spark, sf):
    return stream_table(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


def _totals(spark, path):
    return read_upserted(spark, path).select("user_id", "n", F.round("s", 2).alias("s"))


@query("stream_agg", TOTALS_SQL)
def running(spark, sf):
    base = work_dir(spark, "stream-agg")
    buckets = buckets_for(table(spark, sf, "events"))
    aggregate_to_sink(_events(spark, sf), f"{base}/out", ["user_id"], TOTALS, f"{base}/checkpoint", buckets)
    return _totals(spark, f"{base}/out")


# Windows


def _windows(spark, sf, name, spec, by):
    base = work_dir(spark, name)
    out = window_agg(zoned(_events(spark, sf), "ts"), "ts", spec, by, WINDOW_AGGS, watermark="1 hour")
    drain(out, f"{base}/checkpoint", path=f"{base}/out")
    closed = naive(read_output(spark, f"{base}/out", out), "window_start", "window_end")
    return closed.withColumn("mean", F.round("mean", 8))


CLOSED = "select * from ({}) where window_end <= (select max(ts) - interval 1 hour from events)"
TUMBLE = (
    "select time_bucket(interval 1 hour, ts) window_start, time_bucket(interval 1 hour, ts) + interval 1 hour window_end,"
    " event_type, count(*) n, round(avg(value), 8) mean, max(value) top from events group by 1, 2, 3"
)
HOP = (
    "select ws window_start, ws + interval 2 hour window_end, event_type, count(*) n, round(avg(value), 8) mean,"
    " max(value) top from (select time_bucket(interval 1 hour, ts) - to_hours(k) ws, event_type, value"
    " from events, (select unnest([0, 1]) k)) group by 1, 2, 3"
)


@query("stream_tumble", CLOSED.format(TUMBLE))
def stream_tumble(spark, sf):
    return _windows(spark, sf, "tumble", tumble("1 hour"), ["event_type"])


@query("stream_hop", CLOSED.format(HOP))
def stream_hop(spark, sf):
    return _windows(spark, sf, "hop", hop("2 hours", "1 hour"), ["event_type"])


@query("stream_session", CLOSED.format(SESSIONS.format(gap="30 minute")))
def stream_session(spark, sf):
    return _windows(spark, sf, "session", session("30 minutes"), ["user_id"])


@query("late_data", CLOSED.format(TUMBLE))
def late_data(spark, sf):
    """All errors are sent again when their windows are closed: nothing changes."""
    base = work_dir(spark, "late")
    events = table(spark, sf, "events")
    again = stream_slices(spark, f"{base}/again", events.schema)
    rows = zoned(_events(spark, sf).unionByName(again), "ts")
    out = window_agg(rows, "ts", tumble("1 hour"), ["event_type"], WINDOW_AGGS, watermark="1 hour")
    drain(out, f"{base}/checkpoint", path=f"{base}/out")
    events.where("event_type = 'error'").write.parquet(f"{base}/again/part=0")
    resume(out, f"{base}/checkpoint", path=f"{base}/out")
    closed = naive(read_output(spark, f"{base}/out", out), "window_start", "window_end")
    return closed.withColumn("mean", F.round("mean", 8))


# Joins


@query("stream_join_inner", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def stream_inner(spark, sf):
    base = work_dir(spark, "stream-inner")
    out = stream_join(
        stream_table(spark, f"{sf}/orders.parquet"),
        stream_table(spark, f"{sf}/customer.parquet"),
        [("o_custkey", "c_custkey")],
        "inner",
        ["o_orderkey"],
        ["c_name"],
        salt=SALT,
    )
    drain(out, f"{base}/checkpoint", path=f"{base}/out")
    return read_output(spark, f"{base}/out", out)


TTL = (
    "select l_orderkey, l_linenumber, l_partkey, l_shipdate, o_orderkey, o_orderdate from lineitem {} join orders"
    " on l_orderkey = o_orderkey and o_orderdate between l_shipdate - interval 168 hour and l_shipdate + interval 168 hour"
)
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]


def _shipments(spark, sf, how, beat):
    """Shipped lines and their orders, at most a week apart either way."""
    sides = []
    for name, time, key in (("lineitem", "l_shipdate", "l_orderkey"), ("orders", "o_orderdate", "o_orderkey")):
        df = table(spark, sf, name)
        stream = stream_table(spark, f"{sf}/{name}.parquet", df.schema)
        if beat:
            stream = stream.unionByName(heartbeat(spark, df, time, key))
        sides.append(zoned(stream, time))
    return stream_join(
        *sides,
        [("l_orderkey", "o_orderkey")],
        how,
        LINE_COLUMNS,
        ["o_orderkey", "o_orderdate"],
        times=("l_shipdate", "o_orderdate"),
        ttl="168 hours",
        salt=SALT,
    )


@query("stream_join_ttl", TTL.format(""))
def stream_ttl(spark, sf):
    base = work_dir(spark, "stream-ttl")
    out = _shipments(spark, sf, "inner", beat=False)
    drain(out, f"{base}/checkpoint", path=f"{base}/out")
    return naive(read_output(spark, f"{base}/out", out), "l_shipdate", "o_orderdate")


@query("stream_join_outer", TTL.format("left"))
def stream_outer(spark, sf):
    base = work_dir(spark, "stream-outer")
    out = _shipments(spark, sf, "left", beat=True)
    drain(out, f"{base}/checkpoint", path=f"{base}/out")
    rows = read_output(spark, f"{base}/out", out).where("l_orderkey >= 0")
    return naive(rows, "l_shipdate", "o_orderdate")


# State and recovery


@query(
    "state_ttl",
    "with gaps as (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 12 hour starts from events),"
    " lives as (select *, sum(coalesce(starts, false)::int) over (partition by user_id order by ts, event_id) life from gaps),"
    " sums as (select user_id, life, count(*) n, max(event_id) last_id, round(sum(value), 6) s, min(value) lo, max(value) hi, max(ts) last_ts"
    " from lives group by 1, 2)"
    " select user_id, n, last_id, s, lo, hi from sums where last_ts > (select max(ts) from events) - interval 12 hour",
)
def state_ttl(spark, sf):
    """Totals per user that are forgotten, and start again, after twelve hours without an event."""
    events = _events(spark, sf)
    base = work_dir(spark, "state-ttl")
    stream = stream_slices(spark, f"{base}/in", events.schema)
    aggs = {"n": ("count", "*"), "last_id": ("max", "event_id"), "s": ("sum", "value"), "lo": ("min", "value"), "hi": ("max", "value")}
    rows = plain(zoned(stream, "ts").select("user_id", "event_id", "value", "ts"))
    out = grouped(rows, ["user_id"], aggs, time="ts", lifetime=12)
    for i, part in enumerate(halves(table(spark, sf, "events"), "ts")):
        part.write.parquet(f"{base}/in/part={i}")
        drain(out, f"{base}/checkpoint", path=f"{base}/out")
    return settled(read_output(spark, f"{base}/out", out)).withColumn("s", F.round("s", 6))


def _upsert_totals(path, buckets):
    def write(rows, batch_id):
        stamped = rows.withColumn("_batch", F.lit(batch_id).cast("long"))
        sink_upsert(stamped, path, ["user_id"], ["_batch"], batch_id=batch_id, buckets=buckets)

    return write


class _Interrupted(Exception):
    pass


@query("exactly_once", TOTALS_SQL)
def exactly_once(spark, sf):
    """A batch that fails after its sink has committed is run again and counts once."""
    base = work_dir(spark, "exactly-once")
    totals = aggregate(_events(spark, sf), ["user_id"], TOTALS)
    write = _upsert_totals(f"{base}/out", buckets_for(table(spark, sf, "events")))

    def write_and_fail(rows, batch_id):
        write(rows, batch_id)
        raise _Interrupted(f"batch {batch_id}")

    try:
        drain(totals, f"{base}/checkpoint", each_batch=write_and_fail, mode="update")
    except Exception as error:
        if "_Interrupted" not in str(error):
            raise
    resume(totals, f"{base}/checkpoint", each_batch=write, mode="update")
    return _totals(spark, f"{base}/out")


def _two_runs(spark, sf, name):
    """Base folder, running totals and the two halves of their input."""
    base = work_dir(spark, name)
    events = table(spark, sf, "events")
    totals = aggregate(stream_slices(spark, f"{base}/in", events.schema), ["user_id"], TOTALS)
    first, second = halves(events, "ts")
    return base, totals, first, second


@query("resume", TOTALS_SQL)
def resumed(spark, sf):
    base, totals, first, second = _two_runs(spark, sf, "resume")
    write = _upsert_totals(f"{base}/out", buckets_for(table(spark, sf, "events")))
    first.write.parquet(f"{base}/in/part=0")
    drain(totals, f"{base}/checkpoint", each_batch=write, mode="update")
    second.write.parquet(f"{base}/in/part=1")
    resume(totals, f"{base}/checkpoint", each_batch=write, mode="update")
    return _totals(spark, f"{base}/out")


@query("restore_from_copy", TOTALS_SQL)
def restored(spark, sf):
    base, totals, first, second = _two_runs(spark, sf, "restore")
    write = _upsert_totals(f"{base}/out", buckets_for(table(spark, sf, "events")))
    first.write.parquet(f"{base}/in/part=0")
    drain(totals, f"{base}/checkpoint", each_batch=write, mode="update")
    save_state(spark, f"{base}/checkpoint", f"{base}/saved")
    second.write.parquet(f"{base}/in/part=1")
    restore(totals, f"{base}/saved", f"{base}/checkpoint-2", each_batch=write, mode="update")
    return _totals(spark, f"{base}/out")


@query("dedup_stream", "select event_id, user_id from events")
def deduplicated(spark, sf):
    base = work_dir(spark, "dedup")
    twice = zoned(_events(spark, sf).unionByName(_events(spark, sf)), "ts")
    out = dedup(twice, ["event_id"], "ts", "2 hours").select("event_id", "user_id")
    drain(out, f"{base}/checkpoint", path=f"{base}/out")
    return read_output(spark, f"{base}/out", out)


@query(
    "run_records",
    "select 1 run, 'FAILED' state, 0::bigint batches, 0::bigint n, null::int parent, 1 root, 0 depth"
    " union all select 2, 'FINISHED', 1, count(*), 1, 1, 1 from events",
)
def run_records(spark, sf):
    """A job that fails and is resumed, as its log has it, with the chain that the log gives."""
    base = work_dir(spark, "run-records")

    def fails(rows, batch_id):
        raise _Interrupted

    with RunLog(spark, f"{base}/log"):
        for target in (fails, batch_folders(f"{base}/out")):
            with contextlib.suppress(StreamingQueryException):
                drain(_events(spark, sf), f"{base}/checkpoint", each_batch=target, name="events")
    found = runs(spark, f"{base}/log").join(chains(spark, f"{base}/log").withColumnRenamed("id", "run_id"), "run_id")
    number = found.select("run_id", F.row_number().over(Window.partitionBy("job_id").orderBy("started")).alias("run"))
    named = [
        number.select(F.col("run_id").alias(c), F.col("run").alias(f"{c}_run")) for c in ("run_id", "parent", "root")
    ]
    for names in named:
        found = found.join(names, names.columns[0], "left")
    return found.select(
        F.col("run_id_run").alias("run"),
        "state",
        "batches",
        F.col("input_rows").alias("n"),
        F.col("parent_run").alias("parent"),
        F.col("root_run").alias("root"),
        F.col("depth").cast("int").alias("depth"),
    )
