import pytest
from tests.conftest import rows

from tableflow.sources.group_offsets import GroupOffsets
from tableflow.sources.logs import end_positions, reader_options, scan_log, start_mode, topic_list
from tableflow.sources.tables import datagen, key_ranges, stream_slices

DATA = [("a", 0, i, i * 10) for i in range(6)] + [("a", 1, i, i * 10) for i in range(4)] + [("__x", 0, 0, 5)]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(DATA, "topic string, partition int, offset long, timestamp long").selectExpr(
        "'' key", "'' value", "topic", "partition", "offset", "timestamp_seconds(timestamp) timestamp"
    )


def offsets(df):
    return sorted((r["topic"], r["partition"], r["offset"]) for r in df.collect())


def test_modes_and_short_names():
    assert start_mode(None) == "latest-offset" and start_mode("earliest") == "earliest-offset"
    with pytest.raises(ValueError):
        start_mode("yesterday")


def test_latest_reads_new_partitions_from_their_beginning(log):
    at = end_positions(log.where("offset < 3 and partition = 0"))
    got = offsets(scan_log(log, at=at))
    assert ("a", 0, 2) not in got and ("a", 0, 3) in got and ("a", 1, 0) in got
    with pytest.raises(ValueError):
        scan_log(log, "latest")


def test_group_offsets_and_reset(log):
    committed = end_positions(log.where("topic = 'a' and partition = 0 and offset < 2"))
    early = offsets(scan_log(log, "group-offsets", topics="a", committed=committed))
    assert early == [("a", 0, i) for i in range(2, 6)] + [("a", 1, i) for i in range(4)]
    late = offsets(scan_log(log, "group-offsets", topics=["a"], committed=committed, reset="latest"))
    assert late == [("a", 0, i) for i in range(2, 6)]


def test_timestamp_starts_at_an_offset_not_at_each_time(spark):
    # Times need not rise with offsets: what follows the first match is read, too.
    log = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 50), ("a", 0, 2, 3), ("a", 1, 0, 2)], "topic string, partition int, offset long, t long")
    log = log.selectExpr("topic", "partition", "offset", "timestamp_seconds(t) timestamp")
    assert offsets(scan_log(log, "timestamp", at="1970-01-01 00:00:40")) == [("a", 0, 1), ("a", 0, 2)]


def test_specific_offsets(spark, log):
    assert offsets(scan_log(log, "specific-offsets", topics="a", offsets={0: 4, 1: 3})) == [("a", 0, 4), ("a", 0, 5), ("a", 1, 3)]
    listed = spark.createDataFrame([("a", 0, 5)], "topic string, partition int, offset long")
    assert offsets(scan_log(log, "specific-offsets", topics="a", offsets=listed)) == [("a", 0, 5)] + [("a", 1, i) for i in range(4)]


def test_positions_join_without_shuffling_the_log(log):
    out = scan_log(log, at=end_positions(log))
    execution = out._jdf.queryExecution()
    out.collect()
    assert "BroadcastHashJoin" in execution.executedPlan().toString()


def test_internal_topics_are_hidden(log):
    assert rows(topic_list(log)) == [("a",)]


def test_reader_options():
    base = {"kafka.bootstrap.servers": "h:1", "subscribe": "a,b"}
    assert reader_options("h:1", "a, b", "earliest") == base | {"startingOffsets": "earliest"}
    assert reader_options("h:1", ["a", "b"]) == base | {"startingOffsets": "latest"}
    assert reader_options("h:1", "a,b", "timestamp", at_millis=5) == base | {"startingTimestamp": "5"}
    got = reader_options("h:1", "a,b", "specific-offsets", offsets={"a": {0: 7}})
    assert got["startingOffsets"] == '{"a": {"0": 7}}'
    got = reader_options("h:1", "a,b", "group-offsets", group="g", committed={"a": {0: 1}})
    assert got["kafka.group.id"] == "g"
    with pytest.raises(ValueError):
        reader_options("h:1", "a", "timestamp")


def test_key_ranges_cover_each_row_once(spark):
    df = spark.createDataFrame([(i,) for i in [None, -3, 0, 1, 5, 5, 6, 99]], "k int")
    for splits in ([], [5], [0, 5, 6]):
        parts = [df.where(clause).count() for clause in key_ranges("k", splits)]
        assert sum(parts) == 8 and len(parts) == len(splits) + 1
    assert key_ranges("k", ["a'b"])[1] == "k > 'a''b'"


def test_datagen_repeats_for_a_seed(spark):
    schema = "id bigint, s string, i int, d double, b boolean, t timestamp_ntz, x date, p decimal(8,2)"
    a, b = (datagen(spark, schema, 50, seed=1, sequences={"id": 10}, partitions=n) for n in (2, 5))
    assert rows(a) == rows(b)
    assert sorted(r["id"] for r in a.collect()) == list(range(10, 60))
    assert rows(a.drop("id")) != rows(datagen(spark, schema, 50, seed=2).drop("id"))
    assert not [r for r in a.collect() if None in r or len(r["s"]) != 100]


def test_a_group_goes_on_where_it_committed(spark, log, folder):
    ledger = GroupOffsets(spark, f"{folder}/offsets", "g")
    assert ledger.committed().count() == 0
    stream, seen = stream_slices(spark, f"{folder}/in", log.schema), []

    def job(name, start=None, fails=False):
        def take(batch, batch_id):
            seen.append((name, batch_id, offsets(batch)))
            if fails:
                raise RuntimeError("stopped before the commit")

        rows_from = stream if start is None else scan_log(stream, "group-offsets", committed=start)
        return ledger.run(rows_from, name, f"{folder}/checkpoint-{name}", take)

    log.where("offset < 2").coalesce(1).write.parquet(f"{folder}/in/part=0")
    job("one")
    assert offsets(ledger.committed()) == [("__x", 0, 1), ("a", 0, 2), ("a", 1, 2)]
    log.where("offset between 2 and 3 and partition = 0").coalesce(1).write.parquet(f"{folder}/in/part=1")
    with pytest.raises(Exception, match="stopped"):
        job("one", fails=True)
    assert ("a", 0, 2) in offsets(ledger.committed())
    # The batch runs again under its id, then counts once.
    job("one")
    assert [s[1] for s in seen] == [0, 1, 1] and seen[1][2] == seen[2][2]
    assert offsets(ledger.committed()) == [("__x", 0, 1), ("a", 0, 4), ("a", 1, 2)]
    # Another job of the group, and one of another group.
    log.where("offset > 3 or partition = 1 and offset > 1").coalesce(1).write.parquet(f"{folder}/in/part=2")
    job("two", ledger.committed())
    assert seen[-1][2] == [("a", 0, 4), ("a", 0, 5), ("a", 1, 2), ("a", 1, 3)]
    ledger.commit(log.where("offset < 1"), "two", 0)
    assert ("a", 0, 4) in offsets(ledger.committed())
    assert GroupOffsets(spark, f"{folder}/offsets", "other").committed().count() == 0
    with pytest.raises(ValueError, match="group"):
        GroupOffsets(spark, folder, "a/b")
