import pytest
from tests.conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableflow.operators.changelog import changelog_agg, changelog_join
from tableflow.session import work_dir
from tableflow.sources.changes import cdc_decode, cdc_incremental_snapshot, cdc_initial, chunk_of, key_splits
from tableflow.sinks.keyed_table import KeyedTable
from tableflow.streaming.changelog import MERGED, ChangelogJoin, _Snapshot

SLOW = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
CHANGE = st.tuples(st.integers(0, 4), st.sampled_from("uuud"), st.sampled_from([None, "x", "y"]), st.sampled_from([None, 1, 2, 7]))
BATCHES = st.lists(st.lists(CHANGE, max_size=8), min_size=1, max_size=3)
SCHEMA = "k int, op string, g string, v int, seq int"


def numbered(batches):
    seq = 0
    out = []
    for batch in batches:
        part = []
        for change in batch:
            part.append((*change, seq))
            seq += 1
        out.append(part)
    return out


def alive(changes):
    model = {}
    for k, op, g, v, seq in sorted(changes, key=lambda c: c[-1]):
        model[k] = (k, g, v) if op == "u" else None
    return {k: row for k, row in model.items() if row}


AGGS = {
    "n": ("count", "*"),
    "nv": ("count", "v"),
    "s": ("sum", "v"),
    "a": ("avg", "v"),
    "lo": ("min", "v"),
    "hi": ("max", "v"),
}


def grouped(model):
    out = []
    for g in {row[1] for row in model.values()}:
        vs = [row[2] for row in model.values() if row[1] == g]
        some = [v for v in vs if v is not None]
        stats = (sum(some), sum(some) / len(some), min(some), max(some)) if some else (None,) * 4
        out.append((g, len(vs), len(some), *stats))
    return sorted(out, key=repr)


@SLOW
@given(batches=BATCHES)
def test_aggregate_over_the_rows_a_feed_leaves(spark, batches):
    seen = [change for part in numbered(batches) for change in part]
    table = changelog_agg(spark.createDataFrame(seen, SCHEMA), ["k"], ["seq"], ["g"], AGGS)
    assert rows(table) == grouped(alive(seen))


@SLOW
@given(
    batches=st.lists(st.tuples(st.lists(CHANGE, max_size=5), st.lists(CHANGE, max_size=5)), min_size=1, max_size=3),
    how=st.sampled_from(["inner", "left", "right", "full"]),
)
def test_join_follows_every_batch(spark, batches, how):
    """Left rows point to right keys through ``v``, so many may share one partner."""
    lefts = numbered([b[0] for b in batches])
    rights = numbered([b[1] for b in batches])
    target = ChangelogJoin(work_dir(spark, "join"), [("v", "k")], how, ["k"], ["k"], ["seq"], ["seq"], buckets=2)
    seen_left, seen_right = [], []
    for i, (left, right) in enumerate(zip(lefts, rights, strict=True)):
        seen_left += left
        seen_right += right
        for _ in range(1 + i % 2):
            target.apply({"l": spark.createDataFrame(left, SCHEMA), "r": spark.createDataFrame(right, SCHEMA)}, i)
    l, r = alive(seen_left), alive(seen_right)
    want = [(a[0], b[0]) for a in l.values() for b in r.values() if a[2] is not None and a[2] == b[0]]
    if how in ("left", "full"):
        want += [(a[0], None) for a in l.values() if a[2] not in r]
    if how in ("right", "full"):
        want += [(None, b[0]) for b in r.values() if b[0] not in {a[2] for a in l.values()}]
    got = rows(target.result(spark).select("l_k", "r_k"))
    assert got == sorted(want, key=repr)
    frames = [spark.createDataFrame(seen, SCHEMA) for seen in (seen_left, seen_right)]
    table = changelog_join(*frames, [("v", "k")], how, ["k"], ["k"], ["seq"], ["seq"], ["k"], ["k"])
    assert rows(table) == sorted(want, key=repr)


@SLOW
@given(changes=st.lists(CHANGE, max_size=20), held=st.sets(st.integers(0, 4)))
def test_initial_snapshot_loses_against_changes(spark, changes, held):
    (changes,) = numbered([changes])
    snapshot = spark.createDataFrame([(k, "s", 0) for k in held], "k int, g string, v int")
    feed = spark.createDataFrame(changes, SCHEMA)
    model = {k: (k, "s", 0) for k in held}
    for k, op, g, v, seq in changes:
        model[k] = (k, g, v) if op == "u" else None
    want = sorted((row for row in model.values() if row), key=repr)
    assert rows(cdc_initial(snapshot, feed, ["k"], ["seq"])) == want
    # Chunks read at different moments, each holding the changes up to its mark.
    splits, marks = [1, 3], {0: (2,), 1: (9,), 2: (5,)}
    at = {k: marks[(k > 1) + (k > 3)][0] for k in range(5)}
    read = {k: (k, "s", 0) for k in held}
    for k, op, g, v, seq in changes:
        if seq <= at[k]:
            read[k] = (k, g, v) if op == "u" else None
    chunked = spark.createDataFrame([row for row in read.values() if row], "k int, g string, v int")
    assert rows(cdc_incremental_snapshot(chunked, feed, ["k"], ["seq"], splits, marks)) == want


def test_chunks_by_halving(spark):
    splits = list(range(0, 3000, 3))
    got = spark.range(-5, 3010).select("id", chunk_of(F.col("id"), splits).alias("c")).collect()
    assert all(r["c"] == sum(s < r["id"] for s in splits) for r in got)


def test_splits_are_bounded(spark):
    df = spark.range(1000)
    assert len(key_splits(df, "id", 4)) == 3 and key_splits(df, "id", 1) == []
    assert key_splits(df.where("id < 0"), "id", 4) == []


def test_envelopes_in_both_forms(spark):
    plain = '{"op": "u", "before": {"id": 1}, "after": {"id": 1, "n": "x"}, "ts_ms": 5}'
    wrapped = '{"schema": {}, "payload": {"op": "d", "before": {"id": 2, "n": "y"}, "after": null, "ts_ms": 6}}'
    log = spark.createDataFrame([(plain,), (wrapped,), (None,), ("{}",), ("broken",)], "value string")
    assert rows(cdc_decode(log, "id int, n string")) == [("d", 6, 2, "y"), ("u", 5, 1, "x")]


def test_join_kind_is_checked(spark):
    with pytest.raises(ValueError):
        ChangelogJoin("x", [("a", "a")], "cross", ["a"], ["a"], ["s"], ["s"])


def test_a_null_operation_writes(spark):
    feed = spark.createDataFrame([(1, 5, 1, None), (2, 6, 1, "d"), (3, 7, 1, "c")], "k int, v int, seq int, op string")
    empty = spark.createDataFrame([], "k int, v int, seq int")
    assert rows(cdc_initial(empty, feed, ["k"], ["seq"]).select("k", "v")) == [(1, 5), (3, 7)]


def test_source_time_position_and_truncate(spark):
    body = '{"op": "%s", "before": null, "after": {"id": 1}, "ts_ms": 9, "source": {"ts_ms": 4, "lsn": 77}}'
    feed = spark.createDataFrame([(body % "u",), (body % "m",)], "value string")
    got = cdc_decode(feed, "id int", position=["lsn"]).collect()
    assert [(r["op"], r["ts_ms"], r["lsn"], r["id"]) for r in got] == [("u", 4, 77, 1)]
    with pytest.raises(Exception, match="truncates"):
        cdc_decode(spark.createDataFrame([(body % "t",)], "value string"), "id int").collect()


@pytest.fixture
def reads(monkeypatch):
    """Reads of keyed tables: folder name, whether as of before a batch, and buckets asked for."""
    seen, read = [], KeyedTable.read

    def noted(table, before=None, buckets=None):
        seen.append((table.path.rsplit("/", 1)[-1], before, None if buckets is None else buckets.numbers))
        return read(table, before, buckets)

    monkeypatch.setattr(KeyedTable, "read", noted)
    return seen


def _feed(spark, *changes):
    return spark.createDataFrame(list(changes), SCHEMA)


def test_a_changed_row_touches_its_buckets_and_result_rows_only(spark, reads):
    """The left side is joined by a column that is not its key, and most left rows share one value."""
    lefts = [(k, "u", "g", 3 if k > 9 else k, 1) for k in range(60)]
    rights = [(k, "u", "h", k, 1) for k in range(8)]
    path = work_dir(spark, "narrow")
    target = ChangelogJoin(path, [("v", "k")], "full", ["k"], ["k"], ["seq"], ["seq"], buckets=64, salt=2, spread=2)
    target.apply({"l": _feed(spark, *lefts), "r": _feed(spark, *rights)}, 0)
    reads.clear()
    target.apply({"l": _feed(spark, (30, "u", "g", 4, 2)), "r": _feed(spark)}, 1)
    assert all(b is not None for _, _, b in reads)
    assert max(len(b) for name, _, b in reads if name in ("left", "right")) <= 2
    assert max(len(b) for name, _, b in reads if name == "left-by") <= 4
    out = KeyedTable(spark, target.out).read()
    assert rows(out.where("_batch = 1").select("l_k", "r_k")) == [(30, 4)] and out.where("_gone").count() == 0
    # The last right row goes, then comes back: its left row is alone in between.
    target.apply({"l": _feed(spark), "r": _feed(spark, (7, "d", None, None, 2))}, 2)
    found = target.result(spark).where("l_v = 7").select("l_k", "r_k")
    assert rows(found) == [(7, None)]
    target.apply({"l": _feed(spark), "r": _feed(spark, (7, "u", "x", 7, 3))}, 3)
    assert rows(target.result(spark).where("l_v = 7").select("l_k", "r_k")) == [(7, 7)]
    model = {k: (3 if k > 9 else k) for k in range(60)} | {30: 4}
    want = [(k, v if v < 8 else None) for k, v in model.items()]
    assert rows(target.result(spark).select("l_k", "r_k")) == sorted(want, key=repr)


def test_rows_are_placed_by_columns_of_the_key(spark):
    schema = "a int, b int"
    with pytest.raises(ValueError, match="columns of the key"):
        KeyedTable.create(spark, work_dir(spark, "placed"), spark.createDataFrame([], schema).schema, ["a"], 2, ["b"])


def test_small_frames_of_a_join_are_kept_in_few_partitions(spark, monkeypatch):
    """Each kept frame is read several times, so its number of partitions is a number of tasks several times."""
    seen, take, partitions = [], _Snapshot.take, spark.conf.get("spark.sql.shuffle.partitions")

    def noted(side, folded, batch_id):
        seen.append(folded.rdd.getNumPartitions())
        return take(side, folded, batch_id)

    monkeypatch.setattr(_Snapshot, "take", noted)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        target = ChangelogJoin(work_dir(spark, "few"), [("v", "k")], "full", ["k"], ["k"], ["seq"], ["seq"], buckets=2)
        kept_before = spark.conf.get(MERGED)
        target.apply({"l": _feed(spark, *[(k, "u", "g", k, 1) for k in range(30)]), "r": _feed(spark)}, 0)
        target.apply({"l": _feed(spark), "r": _feed(spark, (7, "u", "h", 7, 1))}, 1)
        assert spark.conf.get(MERGED) == kept_before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert len(seen) == 4 and max(seen) == 1
    found = target.result(spark).select("l_k", "r_k")
    assert rows(found) == sorted([(k, 7 if k == 7 else None) for k in range(30)], key=repr)


def test_an_empty_table_is_known_to_be_empty(spark):
    """The first batch joins what it brings with nothing."""
    feed = _feed(spark, (1, "u", "g", 3, 1))
    empty = KeyedTable.create(spark, work_dir(spark, "empty"), feed.schema, ["k"], 2).read()
    assert empty.dtypes == feed.dtypes and empty.count() == 0
    plan = feed.join(empty.select(F.col("k").alias("other")), F.col("k").eqNullSafe(F.col("other")), "left")
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString() and rows(plan) == [(1, "u", "g", 3, 1, None)]
