"""Hard negatives: rows of another label that score almost as high as an anchor's positives.

Rows are scored against blocks of anchors. Every task keeps, per anchor, only what can still count: its first
positives, and then, once the positives of all tasks are known, the first negatives below each of them. The scores
that are left are packed into keys (anchor, descending score, kind, id), dealt out by anchor and sorted in the
shuffle; an iterator over the sorted keys opens a window at each positive and gives out the negatives that
fall into open windows. It holds a few open windows, never the rows of an anchor.

Anchors are taken in rounds of bounded size (``ROUND_VALUES`` components), each sent to all executors; a round
reads the rows twice. Anchors are a share of the rows, so rounds grow with the table; nothing else is broadcast.

* Rows with a null id, label or vector, or a null component, take no part. A vector is scored
  against anchors of its own length only (an empty one scores 0 against empty ones).
* Rows that share an id are rows of their own, as positives or negatives; an anchor's partners have
  other ids as positives. Of several anchors with one id, the least by label, then vector, stands.
* Equal scores go by id. Scores beyond 64 bits count as the largest (or smallest) long.
* A positive with a negative score has no negatives (its window is empty); one with score 0 takes those with 0.
* Other columns are not read. Without rows or anchors the result is empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.store import stored

POSITIVES = 5
NEGATIVES = 3
# A negative's score, in percent of the positive's.
LOW = 50
HIGH = 95

# Components of the anchors of one round (8 bytes each on an executor), and scores worked on at a time.
ROUND_VALUES = 1 << 21
TILE = 1 << 21
# Scores that one task should make, and keys that one task should sort.
TASK_SCORES = 1 << 26
TASK_KEYS = 1 << 20

KEY = struct.Struct(">QQBQ")
BIAS = 1 << 63
TOP = BIAS - 1
POSITIVE, NEGATIVE = 0, 1

NONE = np.iinfo(np.int64).min
CANDIDATES = "anchor long, score long, kind int, id long"
RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


class Anchors(NamedTuple):
    """Anchors with vectors of one length, in order of id; ``low`` and ``high`` bound the windows of their positives."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray


def matrix(column: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of some rows, which are of one length, as a matrix of longs."""
    values = column.take(pa.array(rows)).flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), dim)


def by_length(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, ids, labels and vectors of rows (``id``, ``label``, ``vector``), for each length of a vector."""
    column = table.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    ids, labels = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "label"))
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield int(dim), ids[rows], labels[rows], matrix(column, rows, int(dim))


def products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact inner products as longs: by floats or longs where they hold them, else by Python's numbers."""
    dim = one.shape[1]
    # Of the smallest long, abs() is itself.
    most = max(dim, 1) * max(int(one.max(initial=0)), -int(one.min(initial=0))) * max(int(other.max(initial=0)), -int(other.min(initial=0)))
    if most < 1 << 53:
        return (one.astype(np.float64) @ other.astype(np.float64).T).astype(np.int64)
    if most < TOP:
        return one @ other.T
    exact = one.astype(object) @ other.astype(object).T
    return np.clip(exact, NONE + 1, TOP).astype(np.int64)


def tiles(batch: pa.RecordBatch, blocks: dict[int, Anchors]) -> Iterator[tuple]:
    """Anchors' length, their ids, labels and scores against some rows (in order of id) with these ids and labels."""
    for dim, ids, labels, vectors in by_length(batch):
        if dim in blocks:
            step = max(1, TILE // len(blocks[dim].ids))
            for at in range(0, len(ids), step):
                part = slice(at, at + step)
                yield dim, ids[part], labels[part], products(vectors[part], blocks[dim].vectors)


class Best:
    """The first ``k`` (score, id) of each line, in descending order of score, then by id."""

    def __init__(self, lines: int, k: int) -> None:
        self.score = np.full((lines, k), NONE)
        self.id = np.zeros((lines, k), np.int64)

    def add(self, lines: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` is one column per line, one row per id; ids rise; ``NONE`` is no score. Overwrites ``scores``."""
        k = self.score.shape[1]
        at = np.arange(len(lines))
        found, found_id = [self.score[lines]], [self.id[lines]]
        for _ in range(min(k, len(ids))):
            row = scores.argmax(axis=0)  # the first, and so the smallest id
            found.append(scores[row, at][:, None])
            found_id.append(ids[row][:, None])
            scores[row, at] = NONE
        score, id_ = np.concatenate(found, axis=1), np.concatenate(found_id, axis=1)
        # -NONE is NONE: put last by a key of its own.
        order = np.lexsort((id_, -score, score == NONE), axis=1)[:, :k]
        self.score[lines] = np.take_along_axis(score, order, axis=1)
        self.id[lines] = np.take_along_axis(id_, order, axis=1)


def candidates(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.RecordBatch:
    kinds = np.full(len(ids), kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, score, kinds, ids)], ["anchor", "score", "kind", "id"])


def first_positives(rows: DataFrame, blocks, positives: int) -> DataFrame:
    """Each task's first rows of the anchor's label, per anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = blocks.value
        best = {dim: Best(len(a.ids), positives) for dim, a in known.items()}
        for batch in batches:
            for dim, ids, labels, scores in tiles(batch, known):
                of = known[dim]
                for label in np.unique(labels):
                    row, line = np.flatnonzero(labels == label), np.flatnonzero(of.labels == label)
                    if len(line):
                        own = scores[np.ix_(row, line)]
                        own[ids[row][:, None] == of.ids[line]] = NONE
                        best[dim].add(line, own, ids[row])
        for dim, b in best.items():
            line, k = np.nonzero(b.score != NONE)
            yield candidates(known[dim].ids[line], b.score[line, k], POSITIVE, b.id[line, k])

    return rows.mapInArrow(run, CANDIDATES)


def first_negatives(rows: DataFrame, blocks, positives: int, negatives: int) -> DataFrame:
    """Each task's first rows of another label in the window of each positive, per anchor; once, also if in several windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = blocks.value
        best = {dim: [Best(len(a.ids), negatives) for _ in range(positives)] for dim, a in known.items()}
        for batch in batches:
            for dim, ids, labels, scores in tiles(batch, known):
                of = known[dim]
                other = labels[:, None] != of.labels
                for k, b in enumerate(best[dim]):
                    fits = other & (scores >= of.low[:, k]) & (scores <= of.high[:, k])
                    line = np.flatnonzero(fits.any(axis=0))
                    if len(line):
                        b.add(line, np.where(fits[:, line], scores[:, line], NONE), ids)
        for dim, windows in best.items():
            found = []
            for k, b in enumerate(windows):
                line, at = np.nonzero(b.score != NONE)
                found.append(pd.DataFrame({"window": k, "anchor": known[dim].ids[line], "score": b.score[line, at], "id": b.id[line, at]}))
            # Rows that share an id count as often as the window with the most of them has them.
            same = ["anchor", "score", "id"]
            n = pd.concat(found).groupby(["window", *same]).size().groupby(same).max().reset_index(name="n")
            n = n.loc[n.index.repeat(n["n"])]
            yield candidates(n["anchor"].to_numpy(np.int64), n["score"].to_numpy(np.int64), NEGATIVE, n["id"].to_numpy(np.int64))

    return rows.mapInArrow(run, CANDIDATES)


def packed(anchor: int, score: int, kind: int, id_: int) -> bytes:
    """A key whose order as bytes is that of anchor, descending score, positives before negatives, id."""
    return KEY.pack(anchor + BIAS, TOP - score, kind, id_ + BIAS)


def in_windows(keys: Iterator[tuple[bytes, None]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Result rows from sorted keys. Scores fall from key to key, so a window that a score has fallen below is done."""
    at, seen, windows = None, 0, []
    for key, _ in keys:
        anchor, down, kind, id_ = KEY.unpack(key)
        score, id_ = TOP - down, id_ - BIAS
        if anchor != at:
            at, seen, windows = anchor, 0, []
        if kind == POSITIVE:
            if seen < positives:
                seen += 1
                windows.append([id_, score, 0])
            continue
        windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]
        for w in windows:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor - BIAS, w[0], w[2], id_, w[1], score


def mine(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """Up to ``negatives`` rows for each anchor and each of its first ``positives`` rows of its label.

    ``vector`` is an array of longs; ``is_anchor`` a condition on the columns of ``rows``.
    """
    spark = rows.sparkSession
    takes_part = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    known = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & takes_part).select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<long>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    chosen = known.where("is_anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    chosen = stored(chosen.select("id", "row.*"), "anchors")
    counts = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vector") + 1).alias("values")).first()
    if not counts["n"]:
        return spark.createDataFrame([], RESULT)
    rounds = -(-counts["values"] // ROUND_VALUES)
    known = known.select("id", "label", "vector")
    needed = -(-known.count() * counts["n"] // (rounds * TASK_SCORES))
    if needed > known.rdd.getNumPartitions():
        known = stored(known.repartition(needed), "vectors")
    found = []
    for number in range(rounds):
        block = chosen.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == number).toArrow()
        blocks = {dim: Anchors(ids, labels, vectors, None, None) for dim, ids, labels, vectors in by_length(block)}
        shared = spark.sparkContext.broadcast(blocks)
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        place = F.row_number().over(order)
        first = first_positives(known, shared, positives).withColumn("place", place).where(F.col("place") <= positives)
        first = stored(first, "positives")
        own = first.toArrow()
        for dim, a in blocks.items():
            score, place = np.zeros((len(a.ids), positives)).astype(object), own.column("place").to_numpy() - 1
            has = np.zeros((len(a.ids), positives), bool)
            mine_ = np.isin(own.column("anchor").to_numpy(), a.ids)
            line = np.searchsorted(a.ids, own.column("anchor").to_numpy()[mine_])
            score[line, place[mine_]] = own.column("score").to_numpy()[mine_].astype(object)
            has[line, place[mine_]] = True
            # No score is in the window of a positive that is not there, or is below 0.
            bounds = (-(-low * score // 100), high * score // 100)
            least, most = (np.clip(np.where(has & (score >= 0), x, none), NONE, TOP).astype(np.int64) for x, none in zip(bounds, (1, 0)))
            blocks[dim] = a._replace(low=least, high=most)
        windows = spark.sparkContext.broadcast(blocks)
        below = first_negatives(known, windows, positives, negatives)
        found.append(stored(first.drop("place").unionByName(below), "candidates"))
        shared.unpersist()
        windows.unpersist()
    keys = found[0]
    for more in found[1:]:
        keys = keys.unionByName(more)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // TASK_KEYS))
    dealt = keys.rdd.map(lambda r: (packed(*r), None)).repartitionAndSortWithinPartitions(parts, lambda k: zlib.crc32(k[:8]))
    streamed = dealt.mapPartitions(lambda part: in_windows(part, positives, negatives, low, high))
    return spark.createDataFrame(streamed, RESULT)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector is, or if a component is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))
