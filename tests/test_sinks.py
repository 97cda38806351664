import json
import random

import pytest
from tests.conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableflow.sinks import jdbc, keyed_table
from tableflow.sinks.bulk import LoadRejected, bulk_load, read_loaded, read_rejected
from tableflow.sinks.catalog import column_types, create_statement
from tableflow.sinks.files import Files
from tableflow.sinks.keyed_table import FEWEST, KeyedTable, buckets_for
from tableflow.sinks.models import load_aggregate
from tableflow.sinks.upsert import read_upserted, sink_upsert
from tableflow.sinks.writers import BUCKET, bucketed, sink_hash_buckets
from tableflow.session import work_dir

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
CHANGES = st.lists(st.tuples(st.integers(0, 5), st.sampled_from("ud"), st.integers(0, 9)), min_size=1, max_size=25)


def feed(spark, changes):
    data = [(k, v, op, seq) for seq, (k, op, v) in enumerate(changes)]
    return data, spark.createDataFrame(data, "k int, v int, op string, seq int")


@SLOW
@given(changes=CHANGES, seed=st.integers(0, 99), batches=st.integers(1, 3))
def test_upsert_equals_a_dict_in_any_order(spark, changes, seed, batches):
    data, _ = feed(spark, changes)
    model = {}
    for k, v, op, seq in data:
        model[k] = (k, v, seq) if op == "u" else None
    random.Random(seed).shuffle(data)
    path = work_dir(spark, "model")
    for i in range(batches):
        part = spark.createDataFrame(data[i::batches] or [], "k int, v int, op string, seq int")
        sink_upsert(part, path, ["k"], ["seq"], "op", batch_id=i, buckets=3)
    if KeyedTable(spark, path).last_batch() >= 0:
        assert rows(read_upserted(spark, path)) == sorted((r for r in model.values() if r), key=repr)


def test_untouched_buckets_are_not_written_again(spark, folder):
    df = spark.range(100).selectExpr("cast(id as int) k", "0 v", "0 seq")
    table = sink_upsert(df, f"{folder}/t", ["k"], ["seq"], buckets=10)
    before = table._commit(None)["held"]
    sink_upsert(df.where("k = 7").withColumn("v", F.lit(1)).withColumn("seq", F.lit(1)), f"{folder}/t", ["k"], ["seq"])
    after = table._commit(None)["held"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert len(table.read().inputFiles()) == len(after)
    assert read_upserted(spark, f"{folder}/t").where("v = 1").count() == 1
    assert read_upserted(spark, f"{folder}/t").count() == 100


def test_replayed_batch_starts_from_the_state_before_it(spark, folder):
    folds = {"n": "sum"}
    rows_of = lambda n: spark.createDataFrame([("a", n)], "k string, n long")
    load_aggregate(rows_of(1), f"{folder}/t", ["k"], folds, 0)
    for _ in range(3):
        table = load_aggregate(rows_of(10), f"{folder}/t", ["k"], folds, 1)
    assert rows(table.read()) == [("a", 11)]
    with pytest.raises(ValueError, match="comes after"):
        load_aggregate(rows_of(5), f"{folder}/t", ["k"], folds, 0)


def test_vacuum_keeps_what_commits_use(spark, folder):
    df = spark.range(20).selectExpr("cast(id as int) k", "id seq")
    for i in range(4):
        table = sink_upsert(df.where(f"k % 4 = {i}"), f"{folder}/t", ["k"], ["seq"], buckets=2)
    being_written = [f"{folder}/t/data/commit={i:020d}-x" for i in (3, 4)]
    for path in being_written:
        table.files.make_dirs(path)
    assert table.vacuum(keep=1) == 3
    assert all(table.files.exists(path) for path in being_written)
    assert read_upserted(spark, f"{folder}/t").count() == 20


def test_old_commits_go_by_themselves(spark, folder, monkeypatch):
    monkeypatch.setattr(keyed_table, "KEPT_COMMITS", 2)
    for i in range(6):
        table = sink_upsert(spark.createDataFrame([(1, i)], "k int, seq int"), f"{folder}/t", ["k"], ["seq"], buckets=1)
    assert len(table.files.names(f"{folder}/t/_commits")) <= 4
    assert rows(read_upserted(spark, f"{folder}/t")) == [(1, 5)]


def test_key_is_checked(spark, folder):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, seq int")
    sink_upsert(df, f"{folder}/t", ["a"], ["seq"])
    with pytest.raises(ValueError, match="keyed by"):
        sink_upsert(df, f"{folder}/t", ["b"], ["seq"])
    with pytest.raises(ValueError, match="not in the schema"):
        KeyedTable.create(spark, f"{folder}/u", df.schema, ["z"])


def test_bucket_count_follows_the_rows(spark, folder, monkeypatch):
    assert buckets_for(spark.range(1000)) == FEWEST
    assert buckets_for(spark.createDataFrame([(1,)], "k int")) == FEWEST
    assert buckets_for(spark.range(10**9)) == 500
    monkeypatch.setattr(keyed_table, "BUCKET_ROWS", 10)
    table = sink_upsert(spark.range(200).selectExpr("id k", "0 seq"), f"{folder}/t", ["k"], ["seq"])
    assert table._commit(None)["buckets"] == 20


def test_buckets_are_split_when_they_grow(spark, folder, monkeypatch):
    """Rows, deletes and replays stay right over splits."""
    monkeypatch.setattr(keyed_table, "BUCKET_BYTES", 2000)
    first = spark.range(600).selectExpr("id k", "'u' op", "0 v", "0 seq")
    table = sink_upsert(first, f"{folder}/t", ["k"], ["seq"], "op", 0, buckets=2)
    before = table._commit(None)
    change = spark.range(500, 700).selectExpr("id k", "if(id % 2 = 0, 'd', 'u') op", "1 v", "1 seq")
    for _ in range(2):
        sink_upsert(change, f"{folder}/t", ["k"], ["seq"], "op", 1)
        after = table._commit(None)
        assert before["buckets"] == 2 and after["buckets"] > 2 and set(after["written"]) != set(before["written"])
        want = [(k, 0, 0) for k in range(500)] + [(k, 1, 1) for k in range(501, 700, 2)]
        assert rows(read_upserted(spark, f"{folder}/t")) == sorted(want, key=repr)
    assert read_upserted(spark, f"{folder}/t", before=1).count() == 600
    again = spark.createDataFrame([(3,)], "k long")
    assert rows(table.read(buckets=table.buckets_of(again)).where("k = 3").select("k", "v")) == [(3, 0)]
    # Places found now are right for the fewer buckets of before.
    assert table.read(before=1, buckets=table.buckets_of(again)).where("k = 3").count() == 1


def test_markers_of_old_deletes_go(spark, folder):
    frame = lambda *data: spark.createDataFrame(data, "k int, op string, seq int")
    put = lambda df, **more: sink_upsert(df, f"{folder}/t", ["k"], ["seq"], "op", buckets=1, **more)
    put(frame((1, "u", 1), (2, "u", 1), (3, "u", 1)))
    put(frame((1, "d", 2), (2, "d", 9)))
    table = put(frame((3, "d", 4)), horizon=[5])
    # The delete of 3 takes effect though it is older than the horizon; the marker of 2 is newer and stays.
    assert rows(table.read().select("k")) == [(2,)] and not rows(read_upserted(spark, f"{folder}/t"))
    table = put(frame((4, "d", 1)), horizon=[50])
    assert table.read().count() == 0
    put(frame((5, "u", 60)))
    assert rows(read_upserted(spark, f"{folder}/t")) == [(5, 60)]


def test_aggregate_model_needs_a_fold_per_value(spark, folder):
    df = spark.createDataFrame([("a", 1)], "k string, n long")
    with pytest.raises(ValueError):
        load_aggregate(df, f"{folder}/t", ["k"], {})
    with pytest.raises(ValueError):
        load_aggregate(df, f"{folder}/t", ["k"], {"n": "avg"})


FIELDS = [{"name": "id", "type": "INT", "primaryKey": True}, {"name": "v", "type": "INT"}]


def batch(spark, good, bad):
    data = [(i, "1") for i in range(good)] + [(i, "x") for i in range(bad)]
    return spark.createDataFrame(data, "id int, v string")


def test_reject_share_edge(spark, folder):
    record = bulk_load(batch(spark, 9, 1), 0, f"{folder}/t", FIELDS)
    assert (record["loaded"], record["rejected"], record["label"]) == (9, 1, "load_t_0")
    assert read_loaded(spark, f"{folder}/t", FIELDS).count() == 9
    assert rows(read_rejected(spark, f"{folder}/t", FIELDS)) == [(0, None, "v does not fit INT")]
    with pytest.raises(LoadRejected):
        bulk_load(batch(spark, 8, 1), 1, f"{folder}/t", FIELDS)
    assert read_loaded(spark, f"{folder}/t", FIELDS).count() == 9


def test_a_label_loads_once(spark, folder):
    bulk_load(batch(spark, 5, 0), 0, f"{folder}/t", FIELDS)
    assert bulk_load(batch(spark, 5, 0), 0, f"{folder}/t", FIELDS)["status"] == "already loaded"
    bulk_load(batch(spark, 5, 0), 1, f"{folder}/t", FIELDS)
    bulk_load(batch(spark, 0, 0), 2, f"{folder}/t", FIELDS)
    assert read_loaded(spark, f"{folder}/t", FIELDS).count() == 10


def test_a_failed_load_may_be_repaired_under_its_label(spark, folder):
    with pytest.raises(LoadRejected):
        bulk_load(batch(spark, 1, 1), 0, f"{folder}/t", FIELDS)
    assert bulk_load(batch(spark, 2, 0), 0, f"{folder}/t", FIELDS)["loaded"] == 2


def test_buckets_follow_the_key_or_the_first_column(spark, folder):
    df = spark.createDataFrame([(i % 5, i) for i in range(50)], "a int, b int")
    assert bucketed(df).select("a", BUCKET).distinct().count() == 5
    assert bucketed(df, ["b"], 7).agg(F.max(BUCKET)).first()[0] <= 6
    sink_hash_buckets(df, f"{folder}/b", ["a"], 4)
    assert spark.read.parquet(f"{folder}/b").count() == 50


def test_create_statement():
    text = create_statement("t", [*FIELDS, {"name": "s", "type": "STRING"}], buckets=3)
    assert "`s` VARCHAR(255)" in text and "CLUSTERED BY (`id`) INTO 3 BUCKETS" in text and "'tableflow.keys' = 'id'" in text
    assert "CLUSTERED BY (`v`)" in create_statement("t", [{"name": "v", "type": "INT"}], "DUPLICATE")
    with pytest.raises(ValueError):
        create_statement("t", FIELDS, "AGGREGATE")
    assert "tableflow.fold.v" in create_statement("t", FIELDS, "AGGREGATE", folds={"v": "sum"})
    for wrong in ([], FIELDS):
        with pytest.raises(ValueError):
            create_statement("t", wrong, "OTHER")


def test_merge_statements():
    args = ("t", "t_staging", ["id", "order"], ["id"])
    assert jdbc.merge_statement("mysql", *args).endswith("ON DUPLICATE KEY UPDATE `order` = VALUES(`order`)")
    assert jdbc.merge_statement("postgresql", *args).endswith('ON CONFLICT ("id") DO UPDATE SET "order" = EXCLUDED."order"')
    assert jdbc.merge_statement("sqlserver", *args).endswith(";")
    oracle = jdbc.merge_statement("oracle", *args)
    assert oracle.startswith('MERGE INTO t t USING t_staging s ON (t."id" = s."id")') and not oracle.endswith(";")
    assert "DO NOTHING" in jdbc.merge_statement("postgresql", "t", "s", ["id"], ["id"])
    assert jdbc.delete_statement("sqlserver", "t", "r", ["a", "b"]).endswith("WHERE r.[a] = t.[a] AND r.[b] = t.[b])")


def test_target_column_types():
    fields = [{"name": "s", "type": "STRING"}, {"name": "d", "type": "DECIMAL", "precision": 8, "scale": 2}]
    assert column_types(fields) == "`s` VARCHAR(255), `d` decimal(8,2)"


def test_retries_stop():
    calls = []

    def fail():
        calls.append(1)
        raise OSError("gone")

    with pytest.raises(OSError):
        jdbc.retried(fail, 2, pause=0)
    assert len(calls) == 3


def test_publish_and_listing(spark, folder):
    files = Files(spark)
    assert files.publish(f"{folder}/a/b.json", json.dumps({"x": "é"}))
    assert json.loads(files.read(f"{folder}/a/b.json")) == {"x": "é"}
    assert files.names(f"{folder}/a") == ["b.json"] and files.names(f"{folder}/none") == []
