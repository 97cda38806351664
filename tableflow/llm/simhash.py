"""Near-duplicates by SimHash, joined along a binary trie of the fingerprints.

A fingerprint has a bit set where over half of the hashes of the text's word shingles have it.
Equal fingerprints are one node of the join, so copies cost nothing there. The join goes down the
trie of all fingerprints two nodes at a time, adds up the bits in which their paths differ and
leaves a pair as soon as the budget is exceeded. Its upper levels decide which parts of the
trie meet in a task; below them each task goes on in numpy. A part that holds too many fingerprints
is cut further down, where they differ, so no prefix makes a large task.

Null and empty texts have the fingerprint zero, which is linked like any other. Repeated rows are
members of one component. A component is named by its smallest id, nulls aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableflow.llm import spans
from tableflow.llm.graph import components
from tableflow.llm.store import stored

SHINGLE = 3
SEED = 42
MAX_BITS = 2

# Fingerprints of a part of the trie that are joined in one task, and parts at which they grow instead.
PART = 4096
PARTS = 1 << 16

# Node pairs that a task holds at a time, and products of node sizes that are compared directly.
FRONT = 1 << 17
DIRECT = 32


def simhashes(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text."""
    buf, offsets = spans.buffers(texts)
    buf = spans.LOWER[buf]
    starts, ends, first = spans.words(buf, offsets)
    flat, begin, end = spans.joined(buf, starts, ends)
    n_words = np.diff(first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(n_shingles)))
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], n_shingles)
    to = np.minimum(at + shingle, np.repeat(first[1:], n_shingles)) - 1
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hashed(flat[a:b], seed) for a, b in zip(begin[at].tolist(), end[to].tolist())), np.uint64, len(at)
    )
    out = np.zeros(len(n_words), np.uint64)
    used = np.flatnonzero(n_shingles)
    if len(used):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[used], axis=0, dtype=np.int32)
        majority = np.packbits(2 * ones > n_shingles[used, None], axis=1, bitorder="little")
        out[used] = majority.view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``key`` and ``print`` (the fingerprint as a signed long) per row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.chunked(batches, text):
            found = simhashes(part.column(text), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_pydict({key: part.column(key), "print": pa.array(found)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, print long")


def high_mask(depth: np.ndarray) -> np.ndarray:
    """The ``depth`` highest bits."""
    depth = np.asarray(depth, np.uint64)
    return np.where(depth == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(64) - np.maximum(depth, np.uint64(1))))


def descend(a: np.ndarray, b: np.ndarray, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of ``a`` and ``b`` that differ in ``budget`` bits at most.

    Both are sorted and without repeats; a trie node is a range of them. ``same``: both are one array, and each
    pair comes once, without pairs of an element with itself.
    """
    whole = [np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0)]
    stack = [(0, whole)] if len(a) and len(b) else []
    while stack:
        depth, (i0, i1, j0, j1, diff) = stack.pop()
        if len(i0) > FRONT:
            for at in range(0, len(i0), FRONT):
                stack.append((depth, [x[at : at + FRONT] for x in (i0, i1, j0, j1, diff)]))
            continue
        width = j1 - j0
        product = (i1 - i0) * width
        direct = product <= DIRECT
        if direct.any():
            count = product[direct]
            of = np.repeat(np.arange(len(count)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = i0[direct][of] + k // width[direct][of], j0[direct][of] + k % width[direct][of]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            i0, i1, j0, j1, diff = (x[~direct] for x in (i0, i1, j0, j1, diff))
        if not len(i0):
            continue
        bit, mask = np.uint64(1 << (63 - depth)), high_mask(depth)
        im = np.searchsorted(a, (a[i0] & mask) | bit)
        jm = np.searchsorted(b, (b[j0] & mask) | bit)
        sides = [(i0, im, j0, jm, diff), (im, i1, jm, j1, diff)]
        more = diff < budget
        sides.append(tuple(x[more] for x in (i0, im, jm, j1, diff + 1)))
        if same:
            more = more & (i0 != j0)
        sides.append(tuple(x[more] for x in (im, i1, j0, jm, diff + 1)))
        nodes = [np.concatenate(x) for x in zip(*sides)]
        full = (nodes[0] < nodes[1]) & (nodes[2] < nodes[3])
        if full.any():
            stack.append((depth + 1, [x[full] for x in nodes]))


def spanning(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes reaches over the links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, one, root[other])
        np.minimum.at(low, other, root[one])
        np.minimum.at(low, root, low)
        low = low[low]
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def linked(a: np.ndarray, b: np.ndarray, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what all close pairs of ``a`` and ``b`` hold together, one per node at most."""
    nodes = a if same else np.concatenate((a, b))
    shift = 0 if same else len(a)
    root = np.arange(len(nodes))
    ones, others, held = [], [], 0

    def merge() -> np.ndarray:
        at = np.arange(len(nodes))
        return spanning(len(nodes), np.concatenate([at, *ones]), np.concatenate([root, *others]))

    for i, j in descend(a, b, budget, same):
        ones.append(i)
        others.append(j + shift)
        held += len(i)
        if held > 1 << 20:
            root, ones, others, held = merge(), [], [], 0
    root = merge()
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def parts(prints: DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The upper trie: depth and prefix of its leaves, in order, and the pairs of leaves that may hold links.

    The driver gets one row per leaf, about as many as the number of fingerprints over ``PART``, and ``PARTS``
    leaves with some children each at most.
    """
    n = prints.count()
    size = max(PART, n // PARTS)
    depth = max(0, math.ceil(math.log2(max(1, n / size))))
    above, below, todo, leaves = 0, depth or 4, [0], []
    while todo:
        cell = _prefix(F.col("print"), below)
        rows = prints
        if above:
            heads = prints.sparkSession.createDataFrame([(p,) for p in todo], "head long")
            rows = prints.join(F.broadcast(heads), _prefix(F.col("print"), above) == F.col("head"), "left_semi")
        found = rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
        todo = [r.cell for r in found if r.n > 2 * size and below < 64]
        leaves += [(below, r.cell) for r in found if r.n <= 2 * size or below == 64]
        above, below = below, min(64, below + 4)
    leaves = sorted((p & (2**64 - 1), d) for d, p in leaves)
    prefix, depths = np.array([p for p, _ in leaves], np.uint64), np.array([d for _, d in leaves], np.uint64)
    return depths, prefix, _close_leaves(depths, prefix, budget)


def _prefix(value: Column, depth: int) -> Column:
    mask = (~0 << (64 - depth)) if depth else 0
    return value.bitwiseAND(F.lit(mask).cast("long"))


def _close_leaves(depths: np.ndarray, prefix: np.ndarray, budget: int) -> np.ndarray:
    """Pairs of leaves (the first not after the second) whose paths differ in ``budget`` bits at most."""
    out = []
    for i in range(len(prefix)):
        common = high_mask(np.minimum(depths[i], depths[i:]))
        near = np.bitwise_count((prefix[i] ^ prefix[i:]) & common) <= budget
        j = np.flatnonzero(near) + i
        out.append(np.stack((np.full(len(j), i), j), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def links(prints: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """Links (``a``, ``b``) that join all distinct fingerprints within ``budget`` bits, one per node and task at most."""
    depths, prefix, pairs = parts(prints, budget)
    both = np.concatenate((pairs, pairs[pairs[:, 0] != pairs[:, 1]][:, ::-1]))
    number = np.concatenate((np.arange(len(pairs)), np.flatnonzero(pairs[:, 0] != pairs[:, 1])))
    order = np.argsort(both[:, 0], kind="stable")
    partner, number = both[order, 1], number[order]
    first = np.searchsorted(both[order, 0], np.arange(len(prefix) + 1))
    shared = prints.sparkSession.sparkContext.broadcast((depths, prefix, partner, number, first))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depths, prefix, partner, number, first = shared.value
        for batch in batches:
            for at in range(0, len(batch), 4096):
                value = batch.column("print").slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                leaf = np.searchsorted(prefix, value, "right") - 1
                count = first[leaf + 1] - first[leaf]
                of = np.repeat(np.arange(len(value)), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[leaf][of]
                other = partner[k]
                near = np.bitwise_count((value[of] ^ prefix[other]) & high_mask(depths[other])) <= budget
                of, k, other = of[near], k[near], other[near]
                yield pa.RecordBatch.from_pydict(
                    {
                        "pair": pa.array(number[k]),
                        "side": pa.array(np.sign(other - leaf[of]).astype(np.int32)),
                        "print": pa.array(value[of].view(np.int64)),
                    }
                )

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        value, side = rows["print"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        if (side == 0).all():
            value = np.sort(value)
            one, other = linked(value, value, budget, True)
        else:
            one, other = linked(np.sort(value[side > 0]), np.sort(value[side < 0]), budget, False)
        return pd.DataFrame({"a": one.view(np.int64), "b": other.view(np.int64)})

    dealt = prints.select("print").mapInArrow(deal, "pair long, side int, print long")
    return dealt.groupBy("pair").applyInPandas(join, "a long, b long")


def grouped(prints: DataFrame, key: str = "doc_id", budget: int = MAX_BITS) -> DataFrame:
    """``prints`` (``key`` and ``print``) with ``component_id``: the smallest id reachable over links."""
    nodes = stored(prints.groupBy("print").agg(F.min(key).alias("first_id")), "prints")
    roots = components(links(nodes, budget))
    members = nodes.join(roots, nodes["print"] == roots["node"]).select("print", "root", "first_id")
    smallest = members.groupBy("root").agg(F.min("first_id").alias("least_id"))
    classes = members.join(smallest, "root").select(F.col("print").alias("node"), "least_id")
    named = nodes.join(classes, nodes["print"] == classes["node"], "left").select(
        F.col("print").alias("node"), F.coalesce("least_id", "first_id").alias("component_id")
    )
    return prints.join(named, prints["print"] == named["node"]).select(key, "print", "component_id")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = MAX_BITS) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` per row."""
    prints = stored(fingerprints(docs, key, text), "simhash")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return grouped(prints, key, budget).select(key, hexed, "component_id")


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each row whole as ``row``, its text as ``body``, and ``mark``: id (null last) and a hash over the columns, which order the rows."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    mark = F.struct(F.col(f"`{key}`").isNull().alias("no_id"), F.col(f"`{key}`").alias("id"), F.xxhash64(*hashed).alias("hash"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col(f"`{text}`").alias("body"), mark.alias("mark"))


def kept_rows(rows: DataFrame, first: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``marked`` documents whose mark is in ``first``, one of those alike; ``marks`` has the mark of every row."""
    chosen = stored(marks.join(first, "mark", "left_semi").groupBy("mark").agg(F.count(F.lit(1)).alias("alike")), "chosen")
    columns = [F.col(f"row.`{f.name}`") for f in rows.schema["row"].dataType.fields]
    once = rows.join(chosen.where("alike = 1").select("mark"), "mark", "left_semi").select(*columns)
    # Rows alike in every column share a mark; the first of them is kept.
    again = rows.join(chosen.where("alike > 1").select("mark"), "mark", "left_semi")
    return once.union(again.groupBy("mark").agg(F.first("row").alias("row")).select(*columns))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = MAX_BITS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest id.

    Of rows with that id, or if all ids are null, the one with the smallest hash over its columns stays. Columns named
    like those used here are kept as they are.
    """
    rows = marked(docs, key, text)
    prints = stored(fingerprints(rows, "mark", "body"), "simhash")
    groups = grouped(prints, "mark", budget)
    first = groups.where("mark = component_id").select("mark").distinct()
    return kept_rows(rows, first, prints.select("mark"))
