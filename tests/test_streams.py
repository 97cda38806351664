import json
import time

import pytest
from tests.conftest import SF, rows
from pyspark.sql import functions as F

from tableflow.operators.aggregates import aggregate
from tableflow.operators.windows import hop, session, tumble, window_agg
from tableflow.plans.inputs import table, zoned
from tableflow.plans.jobs import job_groups, run_job, run_sql, sync_tables
from tableflow.sinks.files import Files
from tableflow.sinks.upsert import read_upserted, sink_upsert
from tableflow.sources.tables import datagen_stream, stream_slices, stream_table
from tableflow.streaming.joins import dedup, stream_join, ttl_interval
from tableflow.streaming.run_log import RunLog, chains, runs
from tableflow.streaming.runner import batch_folders, drain, dropped_late, read_output, restore, resume, save_state

EVENT = "id long, k string, ts timestamp"


def event(i, k, text):
    return (i, k, f"2024-01-01 {text}")


def frame(spark, data):
    return spark.createDataFrame(data, "id long, k string, t string").selectExpr("id", "k", "cast(t as timestamp) ts")


class Feed:
    """A stream that gets one folder at a time."""

    def __init__(self, spark, folder, name, schema):
        self.path, self.n = f"{folder}/{name}", 0
        self.stream = stream_slices(spark, self.path, schema)

    def add(self, df):
        df.write.parquet(f"{self.path}/part={self.n}")
        self.n += 1


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_running_totals_equal_the_table_for_any_cut(spark, folder, parts):
    events = table(spark, SF, "events")
    feed = Feed(spark, folder, "in", events.schema)
    totals = aggregate(feed.stream, ["user_id"], {"n": ("count", "*"), "hi": ("max", "value")})

    def write(batch, i):
        sink_upsert(batch.withColumn("_b", F.lit(i)), f"{folder}/out", ["user_id"], ["_b"], batch_id=i, buckets=2)

    for i in range(parts):
        feed.add(events.where(F.pmod("event_id", F.lit(parts)) == i))
        drain(totals, f"{folder}/cp", each_batch=write, mode="update")
    want = aggregate(events, ["user_id"], {"n": ("count", "*"), "hi": ("max", "value")})
    assert rows(read_upserted(spark, f"{folder}/out").drop("_b")) == rows(want)


@pytest.mark.parametrize("spec", [tumble("1 hour"), hop("2 hours", "1 hour"), session("30 minutes")])
def test_closed_windows_equal_the_table(spark, folder, spec):
    events = zoned(table(spark, SF, "events"), "ts")
    feed = Feed(spark, folder, "in", events.schema)
    aggs = {"n": ("count", "*"), "hi": ("max", "value")}
    out = window_agg(feed.stream, "ts", spec, ["event_type"], aggs, watermark="1 hour")
    # Parts follow each other in time, so no row is late.
    for low, high in ((0, 300), (300, 700), (700, 1000)):
        feed.add(events.where(f"event_id >= {low} and event_id < {high}"))
        drain(out, f"{folder}/cp", path=f"{folder}/out")
    last = events.agg(F.max("ts")).first()[0]
    closed = window_agg(events, "ts", spec, ["event_type"], aggs)
    closed = closed.where(F.col("window_end") <= F.lit(last) - F.expr("interval 1 hour"))
    assert rows(read_output(spark, f"{folder}/out", out)) == rows(closed)


def test_late_rows_are_dropped_and_counted(spark, folder):
    feed = Feed(spark, folder, "in", EVENT)
    out = window_agg(feed.stream, "ts", tumble("1 hour"), [], {"n": ("count", "*")}, watermark="1 hour")
    counts = []
    for data in ([event(1, "a", "00:10:00")], [event(2, "a", "03:00:00")], [event(3, "a", "00:20:00")], [event(4, "a", "09:00:00")]):
        feed.add(frame(spark, data))
        counts.append(dropped_late(drain(out, f"{folder}/cp", path=f"{folder}/out")))
    assert counts == [0, 0, 1, 0]
    got = [(r["window_start"].hour, r["n"]) for r in read_output(spark, f"{folder}/out", out).collect()]
    assert sorted(got) == [(0, 1), (3, 1)]


def test_a_window_stream_needs_a_watermark(spark, folder):
    with pytest.raises(ValueError):
        window_agg(Feed(spark, folder, "in", EVENT).stream, "ts", tumble("1 hour"), [], {"n": ("count", "*")})


def sessions_by_hand(data, gap):
    out = []
    for k in {k for k, _ in data}:
        times = sorted(t for key, t in data if key == k)
        run = [times[0]]
        for t in times[1:]:
            if t - run[-1] > gap:
                out.append((k, run[0], run[-1] + gap, len(run)))
                run = []
            run.append(t)
        out.append((k, run[0], run[-1] + gap, len(run)))
    return sorted(out, key=repr)


def test_table_sessions_against_a_loop(spark):
    import random

    pick = random.Random(3)
    data = [(k, pick.randrange(0, 5000)) for k in "abc" for _ in range(80)] + [("edge", t) for t in (0, 60, 120, 181)]
    df = spark.createDataFrame(data, "k string, t long").selectExpr("k", "timestamp_seconds(t) ts")
    out = window_agg(df, "ts", session("60 seconds"), ["k"], {"n": ("count", "*")})
    got = out.selectExpr("k", "unix_seconds(window_start)", "unix_seconds(window_end)", "n")
    assert rows(got) == sessions_by_hand(data, 60)


LEFT = [event(1, "a", "00:00:00"), event(2, "b", "01:00:00"), event(3, "c", "02:00:00")]
RIGHT = [event(11, "a", "00:30:00"), event(12, "b", "03:30:00"), event(13, "d", "02:00:00")]
BEAT = [event(-1, "zz", "23:00:00")]


@pytest.mark.parametrize(
    "how, salt", [("inner", 3), ("left", 1), ("left", 3), ("right", 1), ("full", 1)]
)
def test_outer_stream_joins(spark, folder, how, salt):
    left, right = (Feed(spark, folder, n, EVENT) for n in ("l", "r"))
    out = stream_join(left.stream, right.stream, [("k", "k")], how, ["id"], ["id"], times=("ts", "ts"), within="1 hour", salt=salt)
    out = out.toDF("l", "r")
    for l, r in ((LEFT, RIGHT), (BEAT, BEAT)):
        left.add(frame(spark, l))
        right.add(frame(spark, r))
        drain(out, f"{folder}/cp", path=f"{folder}/out")
    want = [(1, 11)]
    if how in ("left", "full"):
        want += [(2, None), (3, None)]
    if how in ("right", "full"):
        want += [(None, 12), (None, 13)]
    got = read_output(spark, f"{folder}/out", out).where("coalesce(l, r) > 0")
    assert rows(got) == sorted(want, key=repr)


def test_a_key_that_becomes_hot_keeps_all_its_matches(spark, folder):
    """The salt is part of the state: it must not depend on which keys are hot."""
    left, right = (Feed(spark, folder, n, EVENT) for n in ("l", "r"))
    out = stream_join(left.stream, right.stream, [("k", "k")], "inner", ["id"], ["id"], salt=4).toDF("l", "r")
    right.add(frame(spark, [event(100, "a", "00:00:00"), event(101, "b", "00:00:00")]))
    left.add(frame(spark, [event(0, "a", "00:00:00")]))
    drain(out, f"{folder}/cp", path=f"{folder}/out")
    left.add(frame(spark, [event(i, "b", "00:00:00") for i in range(1, 21)]))
    resume(out, f"{folder}/cp", path=f"{folder}/out")
    assert sorted(rows(read_output(spark, f"{folder}/out", out))) == [(0, 100)] + [(i, 101) for i in range(1, 21)]


def test_writes_to_join_state_do_not_count_its_rows(spark, folder):
    left, right = (Feed(spark, folder, n, EVENT) for n in ("l", "r"))
    out = stream_join(left.stream, right.stream, [("k", "k")], "inner", ["id"], ["id"]).toDF("l", "r")
    left.add(frame(spark, LEFT))
    right.add(frame(spark, RIGHT))
    state = drain(out, f"{folder}/cp", path=f"{folder}/out").lastProgress["stateOperators"][0]
    assert (state["numRowsUpdated"], state["numRowsTotal"]) == (6, 0)
    assert rows(read_output(spark, f"{folder}/out", out)) == [(1, 11), (2, 12)]


def test_ttl_bounds_both_ways_and_its_range(spark, folder):
    left, right = (Feed(spark, folder, n, EVENT) for n in ("l", "r"))
    left.add(frame(spark, [event(1, "a", "12:00:00")]))
    right.add(frame(spark, [event(2, "a", "11:00:00"), event(3, "a", "13:00:00"), event(4, "a", "13:00:01")]))
    out = stream_join(left.stream, right.stream, [("k", "k")], "inner", ["id"], ["id"], times=("ts", "ts"), ttl=ttl_interval(1))
    drain(out.toDF("l", "r"), f"{folder}/cp", path=f"{folder}/out")
    assert rows(read_output(spark, f"{folder}/out", out.toDF("l", "r"))) == [(1, 2), (1, 3)]
    assert ttl_interval() == "12 hours"
    for wrong in (0, 169):
        with pytest.raises(ValueError):
            ttl_interval(wrong)
        with pytest.raises(ValueError):
            stream_join(left.stream, right.stream, [("k", "k")], times=("ts", "ts"), ttl=wrong)


def test_stream_join_arguments(spark, folder):
    left, right = (Feed(spark, folder, n, EVENT).stream for n in ("l", "r"))
    for bad in ({"how": "left"}, {"how": "cross"}, {"ttl": "1 hour", "within": "1 hour"}):
        with pytest.raises(ValueError):
            stream_join(left, right, [("k", "k")], **bad)


def test_replayed_rows_arrive_once(spark, folder):
    feed = Feed(spark, folder, "in", EVENT)
    out = dedup(feed.stream, ["id"], "ts", "2 hours")
    first = [event(1, "a", "00:00:00"), event(2, "a", "00:10:00")]
    for data in (first, first + [event(3, "a", "00:20:00")]):
        feed.add(frame(spark, data))
        drain(out, f"{folder}/cp", path=f"{folder}/out")
    assert sorted(r["id"] for r in read_output(spark, f"{folder}/out", out).collect()) == [1, 2, 3]


def test_restored_state_knows_what_it_saw(spark, folder):
    feed = Feed(spark, folder, "in", EVENT)
    out = dedup(feed.stream, ["id"], "ts", "2 hours")
    feed.add(frame(spark, [event(1, "a", "00:00:00")]))
    drain(out, f"{folder}/cp", each_batch=batch_folders(f"{folder}/out"))
    save_state(spark, f"{folder}/cp", f"{folder}/saved")
    feed.add(frame(spark, [event(1, "a", "00:00:00"), event(2, "a", "00:05:00")]))
    target = batch_folders(f"{folder}/out2")
    restore(out, f"{folder}/saved", f"{folder}/cp2", target)
    assert [r["id"] for r in spark.read.parquet(f"{folder}/out2").collect()] == [2]
    with pytest.raises(ValueError):
        restore(out, f"{folder}/saved", f"{folder}/cp2", target)
    with pytest.raises(ValueError):
        resume(out, f"{folder}/nowhere", each_batch=target)


def test_datagen_stream_runs(spark, folder):
    out = datagen_stream(spark, "id bigint, name string", rows_per_second=50, sequences={"id": 0})
    query = out.writeStream.format("memory").queryName("generated").start()
    end = time.time() + 30
    while not spark.table("generated").count() and time.time() < end:
        time.sleep(0.5)
    query.stop()
    ids = sorted(r["id"] for r in spark.table("generated").collect())
    assert ids and ids == list(range(len(ids)))


@pytest.mark.parametrize("kind", ["upsert", "bulk"])
def test_job_targets(spark, folder, kind):
    messages = spark.createDataFrame([('{"id": 1, "v": 2}',), ('{"id": 1, "v": 3}',)], "value string")
    messages.selectExpr("value", "'t' topic", "0 partition", "0L offset").write.parquet(f"{folder}/in/part=0")
    stream = stream_slices(spark, f"{folder}/in", "value string, topic string, partition int, offset long")
    fields = [{"name": "id", "type": "INT"}, {"name": "v", "type": "INT"}]
    target = {"type": kind, "path": f"{folder}/out", "keys": ["id"], "seq": ["v"], "fields": fields}
    spec = {"topics": "t", "start_mode": "earliest", "schema": fields, "target": target, "checkpoint": f"{folder}/cp"}
    run_job(spark, spec, stream)
    if kind == "upsert":
        assert rows(read_upserted(spark, f"{folder}/out")) == [(1, 3)]
    else:
        from tableflow.sinks.bulk import read_loaded

        assert read_loaded(spark, f"{folder}/out", fields).count() == 2


def test_sql_over_a_stream(spark, folder):
    source = stream_table(spark, f"{SF}/nation.parquet")
    got = []
    run_sql(
        spark,
        [("target", "select n_name from nations where n_regionkey = 1")],
        {"nations": source},
        {"target": lambda batch, i: got.extend(r["n_name"] for r in batch.collect())},
        f"{folder}/cp",
    )
    assert sorted(got) == sorted(r["n_name"] for r in table(spark, SF, "nation").where("n_regionkey = 1").collect())


def test_sync_picks_up_only_what_is_new(spark, folder):
    spark.range(3).write.parquet(f"{folder}/src/t")
    for extra in (0, 5):
        if extra:
            spark.range(10, 10 + extra).write.mode("append").parquet(f"{folder}/src/t")
        sync_tables(spark, ["t"], {"path": f"{folder}/src"}, {"path": f"{folder}/dst", "checkpoint": f"{folder}/cp"})
    assert spark.read.parquet(f"{folder}/dst/t").count() == 8


def wait_for(look, seconds=60):
    end = time.time() + seconds
    while not look() and time.time() < end:
        time.sleep(0.2)
    return look()


def envelopes(*changes):
    """Envelopes of ``(op, id, v, position)``, all of one millisecond."""
    out = []
    for op, key, v, pos in changes:
        image = {"id": key, "v": v}
        body = {"op": op, "before": image if op == "d" else None, "after": None if op == "d" else image}
        out.append((json.dumps(body | {"ts_ms": 8, "source": {"ts_ms": 7, "pos": pos}}),))
    return out


def test_a_continuous_change_form_picks_up_later_files(spark, folder):
    def add(part, *changes):
        spark.createDataFrame(envelopes(*changes), "value string").coalesce(1).write.parquet(f"{folder}/in/part={part}")

    add(0, ("c", 1, 10, 2), ("c", 1, 5, 1), ("c", 2, 20, 3))
    stream = stream_slices(spark, f"{folder}/in", "value string")
    spec = {
        "source": "changes",
        "start_mode": "earliest-offset",
        "schema": "id int, v int",
        "position": ["pos"],
        "mappings": [{"source": "id", "target": "key"}, {"source": "v", "target": "v"}],
        "target": {"type": "upsert", "path": f"{folder}/out", "keys": ["key"]},
        "checkpoint": f"{folder}/cp",
        "every": "1 second",
    }
    query = run_job(spark, spec, stream)
    try:
        held = lambda: rows(read_upserted(spark, f"{folder}/out").select("key", "v"))
        made = lambda: Files(spark).names(f"{folder}/out/_commits")
        assert wait_for(made) and held() == [(1, 10), (2, 20)]
        add(1, ("d", 2, 20, 5), ("u", 1, 11, 4))
        assert wait_for(lambda: len(made()) > 1) and held() == [(1, 11)]
        assert query.isActive
    finally:
        query.stop()
    assert query.exception() is None and not query.isActive


def test_a_change_form_keeps_groups(spark, folder):
    spark.createDataFrame(
        envelopes(("c", 1, 10, 1), ("c", 2, 10, 2), ("u", 2, 30, 3), ("c", 3, 30, 4), ("d", 1, 10, 5)), "value string"
    ).write.parquet(f"{folder}/in/part=0")
    spec = {
        "source": "changes",
        "start_mode": "earliest-offset",
        "schema": "id int, v int",
        "position": ["pos"],
        "target": {"type": "upsert", "path": f"{folder}/out", "keys": ["id"]},
        "aggregate": {"by": ["v"], "aggs": {"n": ("count", "*")}},
        "checkpoint": f"{folder}/cp",
    }
    run_job(spark, spec, stream_slices(spark, f"{folder}/in", "value string"))
    assert rows(job_groups(spark, spec)) == [(30, 2)]
    with pytest.raises(ValueError, match="keyed target"):
        run_job(spark, spec | {"target": {"type": "files", "path": "x"}}, stream_slices(spark, f"{folder}/in", "value string"))


def test_a_form_passes_its_group(spark, monkeypatch):
    from tableflow.plans import jobs

    got = {}

    def log(session, servers, topics, start, **choice):
        got.update(choice)
        raise LookupError

    monkeypatch.setattr(jobs, "read_log", log)
    with pytest.raises(LookupError):
        run_job(spark, {"servers": "s", "topics": "t", "group": "g", "target": {}, "checkpoint": "c"})
    assert got == {"group": "g"}


def test_continuous_sync_goes_on(spark, folder):
    spark.range(3).write.parquet(f"{folder}/src/t")
    sink = {"path": f"{folder}/dst", "checkpoint": f"{folder}/cp", "every": "1 second"}
    query = sync_tables(spark, ["t"], {"path": f"{folder}/src"}, sink)["t"]
    try:
        count = lambda: spark.read.schema("id long").parquet(f"{folder}/dst/t").count()
        assert wait_for(lambda: Files(spark).exists(f"{folder}/dst/t/_spark_metadata") and count() == 3)
        spark.range(10, 15).write.mode("append").parquet(f"{folder}/src/t")
        assert wait_for(lambda: count() == 8)
    finally:
        query.stop()


def test_runs_are_recorded_as_they_start_go_on_and_end(spark, folder):
    feed = Feed(spark, folder, "in", "k int")
    feed.add(spark.createDataFrame([(1,), (2,)], "k int").coalesce(1))

    def fails(batch, batch_id):
        raise RuntimeError("no room")

    def reads(batch, batch_id):
        batch.collect()

    def run(target, name="copy"):
        drain(feed.stream, f"{folder}/checkpoint-{name}", each_batch=target, name=name)

    with RunLog(spark, f"{folder}/log"):
        with pytest.raises(Exception, match="no room"):
            run(fails)
        run(reads)
        feed.add(spark.createDataFrame([(3,)], "k int").coalesce(1))
        run(reads)
        run(reads, "other")
    run(reads, "unseen")
    found = runs(spark, f"{folder}/log").orderBy("started").collect()
    assert [(r["name"], r["state"], r["batches"], r["input_rows"]) for r in found] == [
        ("copy", "FAILED", 0, 0), ("copy", "FINISHED", 1, 2), ("copy", "FINISHED", 1, 1), ("other", "FINISHED", 1, 3)
    ]
    assert "no room" in found[0]["error"] and found[1]["error"] is None
    ids = [r["run_id"] for r in found]
    assert [r["parent"] for r in found] == [None, ids[0], ids[1], None] and len({r["job_id"] for r in found}) == 2
    depths = {r["id"]: (r["root"], r["depth"]) for r in chains(spark, f"{folder}/log").collect()}
    assert depths == {ids[0]: (ids[0], 0), ids[1]: (ids[0], 1), ids[2]: (ids[0], 2), ids[3]: (ids[3], 0)}
