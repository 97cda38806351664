import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from tableflow.operators.keyed import (
    first_filled,
    latest_per,
    lineage,
    live_rows,
    merge_nonnull,
    newest_entry,
    page,
    prune_by_name,
    reconcile,
    sort_time,
    with_elapsed,
    with_latest_child,
)


def test_latest_per_takes_nulls_lowest_and_breaks_ties_by_the_row(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", None, "w")], "k string, t int, v string")
    assert rows(latest_per(df, ["k"], ["t"])) == [("a", 1, "z"), ("b", None, "w")]


def test_latest_per_keeps_maps_and_column_order(spark):
    df = spark.createDataFrame([("a", 1, {"x": 1}), ("a", 2, {"x": 2})], "k string, t int, m map<string,int>")
    out = latest_per(df, ["k"], ["t"])
    assert out.columns == ["k", "t", "m"] and out.first()["m"] == {"x": 2}


def test_name_falls_through_null_and_empty(spark):
    df = spark.createDataFrame([(None, "", 7), ("", "b", 8), ("a", "b", 9)], "x string, y string, id int")
    assert rows(df.select(first_filled("x", "y", "id"))) == [("7",), ("a",), ("b",)]


def test_sort_time_skips_null_and_zero(spark):
    df = spark.createDataFrame([(None, None), (0, 3), (9, 3)], "e long, s long")
    assert [r[0] for r in df.select(sort_time("e", "s")).collect()] == [0, 3, 9]


def test_children_of_parents_without_any(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1, 10, "old"), (1, 20, "new")], "parent int, t int, path string")
    out = with_latest_child(parent, child, ("id", "parent"), ["t"], "path")
    assert rows(out) == [(1, "new", 2), (2, None, 0)]


def test_prune_by_name_spans_ids_and_shares_the_unknown_bucket(spark):
    child = spark.createDataFrame([(1, 5, "a"), (2, 7, "b"), (8, 1, "c"), (9, 2, "d")], "job int, t int, path string")
    parent = spark.createDataFrame([(1, "sync"), (2, "sync")], "id int, name string")
    assert rows(prune_by_name(child, parent, ("job", "id"), "name", ["t", "job"])) == [
        ("sync", 2, 7, "b"),
        ("unknown", 9, 2, "d"),
    ]


def test_newest_entry_skips_rows_without_path(spark):
    kind = "id int, history array<struct<id:int, path:string, external:string>>"
    data = [
        (1, [(1, "p1", None), (3, None, "e3"), (2, "p2", None)]),
        (2, [(4, "p4", "e4"), (9, "", None)]),
        (3, []),
        (4, None),
    ]
    out = newest_entry(spark.createDataFrame(data, kind).withColumnRenamed("id", "job"), "history", ["job"], ["path", "external"])
    assert rows(out) == [(1, 3, "e3")]


def test_reconcile(spark):
    recorded = spark.createDataFrame(
        [(1, "RUNNING", None), (2, "RUNNING", 5), (3, "FINISHED", 6), (4, "CREATED", 0)], "id int, state string, start long"
    )
    observed = spark.createDataFrame([(1, "RUNNING", 11), (4, "CREATED", 12), (3, "FAILED", 1)], "id int, status string, start long")
    assert rows(reconcile(recorded, observed, "id")) == [
        (1, "RUNNING", 11),
        (2, "FAILED", 5),
        (3, "FAILED", 6),
        (4, "CREATED", 12),
    ]


def test_elapsed_needs_a_start(spark):
    df = spark.createDataFrame(
        [("RUNNING", 100, None), ("RUNNING", 0, 7), ("RUNNING", None, 8), ("FAILED", 100, 9)], "state string, start long, duration long"
    )
    assert [r["duration"] for r in with_elapsed(df, 150).collect()] == [50, 7, 8, 9]


def test_live_rows_put_missing_starts_last(spark):
    observed = spark.createDataFrame([(1, "RUNNING", None), (2, "RUNNING", 5), (3, "FAILED", 9), (4, "RUNNING", 8)], "id int, s string, t int")
    recorded = spark.createDataFrame([(2, "two")], "job int, name string")
    out = live_rows(observed, recorded, ("id", "job"), "s", "t")
    assert [(r["id"], r["name"]) for r in out.collect()] == [(4, None), (2, "two"), (1, None)]


def test_page_counts_before_it_cuts(spark):
    out = page(spark.range(25), [F.col("id").desc()], 20, 10)
    assert [tuple(r) for r in out.collect()] == [(i, 25) for i in (4, 3, 2, 1, 0)]


@pytest.mark.parametrize("offset, limit", [(0, 7), (93, 15), (490, 20), (500, 5), (0, 600)])
def test_a_page_far_back_equals_a_slice(spark, offset, limit):
    df = spark.range(500).selectExpr("id", "id % 7 g").repartition(5)
    got = page(df, [F.col("g").desc(), F.col("id")], offset, limit).collect()
    want = sorted(((i % 7, i) for i in range(500)), key=lambda x: (-x[0], x[1]))[offset : offset + limit]
    assert [(r["g"], r["id"], r["total"]) for r in got] == [(g, i, 500) for g, i in want]


def test_lineage_against_walking(spark):
    parents = {1: None, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: None, 8: 7, 9: 99, 10: 8, 11: 8}
    df = spark.createDataFrame(list(parents.items()), "id int, parent int")

    def walk(i):
        depth = 0
        while parents.get(parents[i], "none") != "none":
            i, depth = parents[i], depth + 1
        return i, depth

    assert rows(lineage(df, "id", "parent")) == sorted(((i, *walk(i)) for i in parents), key=repr)


def test_lineage_refuses_a_cycle(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int")
    with pytest.raises(ValueError, match="cycle"):
        lineage(df, "id", "parent").collect()


def test_merge_nonnull(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, s string, n int")
    new = spark.createDataFrame([(1, "", 9), (2, "c", None), (3, None, 3)], "id int, s string, n int")
    assert rows(merge_nonnull(old, new, ["id"])) == [(1, "a", 9), (2, "c", 2), (3, None, 3)]
