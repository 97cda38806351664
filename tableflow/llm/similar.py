"""Near copies: SimHash tries find candidate pairs, exact word shingles decide.

Every text has a fingerprint of 128 bits from its five-word shingles. Texts that share 0.8 of them differ in some 15
bits of 128, too many for one trie. So the same fingerprint is read in several orders of its bits: each order has
a trie of its first ``KEY`` bits, joined with itself down from the root within ``KEY_BUDGET`` bits, and pairs that pass
stay within ``BUDGET`` bits over all 128. Similarity of each pair that matters is then taken from the
two sets of shingles, and only pairs of 0.8 or more are links.

A task gives back no more links than hold its texts together a few times over, nearest first (forests). Where one of them turns out not to
be similar, the task looks again without it, with more forests a round, until every candidate pair either
lies within one component or was compared. So a group of thousands of near copies costs a few comparisons a text and order, and no
candidate is lost. Texts with one key, however many, are cut into blocks, and pairs of blocks meet in a task.

Shingles are sets of 64-bit hashes of lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``. A text of fewer words is one shingle, a
null or empty one has none; texts without words are alike and like no other. Equal word sequences are one node,
whatever their number. Repeated rows and null ids are members like any other. An empty table gives no rows. Columns keep
their names, types and values, also where they are named like columns used here.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm import spans
from tableflow.llm.graph import components
from tableflow.llm.simhash import descend, high_mask, kept_rows, marked
from tableflow.llm.store import stored

SHINGLE = 5
SIMILARITY = 0.8

# Orders of the fingerprint's bits, bits of a key and how many of them may differ, and how many of all bits.
ORDERS = 12
KEY = 20
KEY_BUDGET = 1
BUDGET = 24

# Texts of a leaf of the tries, and leaves at which they grow instead.
PART = 1 << 16
PARTS = 1 << 16

# Forests of links that a task gives back in the first round, and how many times as many in each further one.
FORESTS = 4
MORE = 8

# Entries of all forests of a task together, beyond which it has no more than ``FORESTS``.
ROOM = 1 << 24

# Pairs that a task looks at together.
PAIRS = 1 << 18

WORDS = 2
SEEDS = (spans.BASE, spans.INVERSE)


def shingle_hashes(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes of the shingles of all texts, the bounds of each text in them, and a hash of each word sequence."""
    buf, offsets = spans.buffers(texts)
    buf = spans.LOWER[buf]
    starts, ends, first = spans.words(buf, offsets)
    words = spans.span_hashes(buf, starts, ends)
    hashes, inside = spans.windows(words, first, shingle)
    n_words = np.diff(first)
    short = np.flatnonzero((n_words > 0) & (n_words < shingle))
    at = np.flatnonzero(inside)
    whole = np.array([_sequence(words[first[k] : first[k + 1]]) for k in short], np.uint64)
    place = np.concatenate((at, first[short]))
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], first)
    flat, begin, end = spans.joined(buf, starts, ends)
    digest = xxhash.xxh64_intdigest
    bodies = [digest(flat[begin[a] : end[b - 1]]) if b > a else 0 for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return np.concatenate((hashes[at], whole))[order], bounds, bodies


def _sequence(words: np.ndarray) -> np.uint64:
    out = np.uint64(len(words))
    for word in words:
        out = spans.mix(np.array([out], np.uint64) * spans.BASE + word)[0]
    return out


def wide_prints(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The words of the fingerprint of each text: bits that over half of its shingle hashes have."""
    counts = np.diff(bounds)
    used = np.flatnonzero(counts)
    out = []
    for seed in SEEDS:
        mixed = spans.mix(hashes ^ seed)
        found = np.zeros(len(counts), np.uint64)
        if len(used):
            for bit in range(64):
                ones = np.add.reduceat(((mixed >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), bounds[used])
                found[used] |= (2 * ones > counts[used]).astype(np.uint64) << np.uint64(bit)
        out.append(found)
    return out


def similarities(one: pa.Array, other: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Shared shingles over all shingles of each pair of texts."""
    (a, of_a, _), (b, of_b, _) = shingle_hashes(one, shingle), shingle_hashes(other, shingle)
    out = np.ones(len(one))
    for k in range(len(one)):
        x, y = np.unique(a[of_a[k] : of_a[k + 1]]), np.unique(b[of_b[k] : of_b[k + 1]])
        shared = len(np.intersect1d(x, y, assume_unique=True))
        if len(x) or len(y):
            out[k] = shared / (len(x) + len(y) - shared)
    return out


@functools.lru_cache(maxsize=4)
def bit_orders(orders: int, key: int) -> np.ndarray:
    """Which bits of the fingerprint make up the key of each order: a fixed draw."""
    draw = np.random.Generator(np.random.PCG64(7))
    return np.stack([draw.permutation(64 * WORDS)[:key] for _ in range(orders)])


def met_before(apart: list[np.ndarray], order: int, orders: int, key: int, key_budget: int) -> np.ndarray:
    """Whether texts whose fingerprints are that far apart (bits set where they differ) meet in an order before this one."""
    out = np.zeros(len(apart[0]), bool)
    for bits in bit_orders(orders, key)[:order].tolist():
        masks = [np.uint64(sum(1 << bit % 64 for bit in bits if bit // 64 == word)) for word in range(WORDS)]
        out |= sum(np.bitwise_count(x & m).astype(np.int16) for x, m in zip(apart, masks, strict=True)) <= key_budget
    return out


def paths(prints: list[np.ndarray], nodes: np.ndarray, order: int, orders: int, key: int) -> np.ndarray:
    """The way of each text down the trie of an order: its key, then a hash of the node that cuts texts of one key into blocks."""
    out = spans.mix(nodes.astype(np.uint64) + np.uint64(1)) >> np.uint64(key)
    for k, bit in enumerate(bit_orders(orders, key)[order].tolist()):
        word, at = divmod(bit, 64)
        out |= ((prints[word] >> np.uint64(at)) & np.uint64(1)) << np.uint64(63 - k)
    return out


def _read(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    prints = [batch.column(f"w{i}").to_numpy(zero_copy_only=False).view(np.uint64) for i in range(WORDS)]
    return prints, batch.column("node").to_numpy(zero_copy_only=False)


def leaves(nodes: DataFrame, orders: int, key: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Depth and prefix of the leaves of each order's trie, in order; tasks count, the driver gets one row per cell."""
    size = max(PART, orders * nodes.count() // PARTS)
    open_cells = {order: np.zeros(1, np.uint64) for order in range(orders)}
    above, below, found = 0, 3, [[] for _ in range(orders)]
    while open_cells:

        def tally(batches: Iterable[pa.RecordBatch], above=above, below=below, heads=open_cells) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prints, node = _read(batch)
                for order, todo in heads.items():
                    path = paths(prints, node, order, orders, key)
                    path = path[np.isin(path & high_mask(above), todo)]
                    cells, n = np.unique(path & high_mask(below), return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"bits": pa.array(np.full(len(cells), order, np.int32)), "cell": pa.array(cells.view(np.int64)), "n": pa.array(n)}
                    )

        counted = nodes.select("w0", "w1", "node").mapInArrow(tally, "bits int, cell long, n long")
        rows = counted.groupBy("bits", "cell").agg(F.sum("n").alias("n")).collect()
        todo: dict[int, list[int]] = {}
        for r in rows:
            cell = r.cell & (2**64 - 1)
            if r.n > 2 * size and below < 64:
                todo.setdefault(r.bits, []).append(cell)
            else:
                found[r.bits].append((cell, below))
        open_cells = {order: np.array(cells, np.uint64) for order, cells in todo.items()}
        above, below = below, min(64, below + 3)
    out = []
    for cells in found:
        cells.sort()
        out.append((np.array([d for _, d in cells], np.uint64), np.array([p for p, _ in cells], np.uint64)))
    return out


def near_leaves(depths: np.ndarray, prefix: np.ndarray, key: int, budget: int) -> np.ndarray:
    """Pairs of leaves (the first not after the second) whose keys differ in ``budget`` bits at most as far as both go."""
    out = [np.zeros((0, 2), np.int64)]
    for i in range(len(prefix)):
        common = high_mask(np.minimum(np.minimum(depths[i], depths[i:]), np.uint64(key)))
        j = np.flatnonzero(np.bitwise_count((prefix[i] ^ prefix[i:]) & common) <= budget) + i
        out.append(np.stack((np.full(len(j), i), j), axis=1))
    return np.concatenate(out)


def deal(nodes: DataFrame, orders: int, key: int, budget: int) -> DataFrame:
    """``pair``, ``side``, ``bits`` (the order) and the columns of ``nodes``: each text in every pair of leaves it may have partners in."""
    plans, start = [], 0
    for depths, prefix in leaves(nodes, orders, key):
        pairs = near_leaves(depths, prefix, key, budget)
        mirrored = pairs[:, 0] != pairs[:, 1]
        both = np.concatenate((pairs, pairs[mirrored][:, ::-1]))
        number = np.concatenate((np.arange(len(pairs)), np.flatnonzero(mirrored))) + start
        by = np.argsort(both[:, 0], kind="stable")
        first = np.searchsorted(both[by, 0], np.arange(len(prefix) + 1))
        plans.append((depths, prefix, both[by, 1], number[by], first))
        start += len(pairs)
    shared = nodes.sparkSession.sparkContext.broadcast(plans)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                prints, node = _read(part)
                for order, (depths, prefix, partner, number, first) in enumerate(shared.value):
                    path = paths(prints, node, order, orders, key)
                    leaf = np.searchsorted(prefix, path, "right") - 1
                    count = first[leaf + 1] - first[leaf]
                    of = np.repeat(np.arange(len(path)), count)
                    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[leaf][of]
                    other = partner[k]
                    common = high_mask(np.minimum(depths[other], np.uint64(key)))
                    near = np.bitwise_count((path[of] ^ prefix[other]) & common) <= budget
                    of, k, other = of[near], k[near], other[near]
                    columns = {
                        "pair": pa.array(number[k].astype(np.int32)),
                        "side": pa.array(np.sign(other - leaf[of]).astype(np.int8)),
                        "bits": pa.array(np.full(len(of), order, np.int8)),
                    }
                    columns |= {f"w{i}": pa.array(prints[i][of].view(np.int64)) for i in range(WORDS)}
                    yield pa.RecordBatch.from_pydict(columns | {"node": pa.array(node[of])})

    return nodes.select("w0", "w1", "node").mapInArrow(run, "pair int, side byte, bits byte, w0 long, w1 long, node long")


def candidates(one: np.ndarray, other: np.ndarray, key: int, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs whose keys differ in ``budget`` bits at most, some ``PAIRS`` at a time. Both sides are sorted by key.

    ``same``: both are one array and each pair comes once.
    """
    keys_a, start_a, n_a = np.unique(one, return_index=True, return_counts=True)
    keys_b, start_b, n_b = np.unique(other, return_index=True, return_counts=True)
    top = np.uint64(64 - key)

    def spread(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # A row per element of the first side, with its run of partners.
        of = np.repeat(np.arange(len(i)), n_a[i])
        x = np.arange(len(of)) - np.repeat(np.cumsum(n_a[i]) - n_a[i], n_a[i]) + start_a[i][of]
        begin, end = start_b[j][of], (start_b[j] + n_b[j])[of]
        if same:
            begin = np.where(i[of] == j[of], x + 1, begin)
        width = end - begin
        cut = np.searchsorted(np.cumsum(width), np.arange(0, width.sum() + PAIRS, PAIRS), "right")
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(x)]))):
            if a < b:
                n = width[a:b]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(x[a:b], n), k + np.repeat(begin[a:b], n)

    if same:
        every = np.arange(len(keys_a))
        yield from spread(every, every)
    for i, j in descend(keys_a << top, keys_b << top, budget, same):
        yield from spread(i, j)


def grow(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions of links that hold together what all do, none in a circle; the first of several goes in. Changes ``root``."""
    taken, live = [], np.arange(len(i))
    while True:
        a, b = root[i[live]], root[j[live]]
        open_ = a != b
        live, a, b = live[open_], a[open_], b[open_]
        if not len(live):
            return np.concatenate(taken) if taken else np.zeros(0, np.int64)
        high, first = np.unique(np.maximum(a, b), return_index=True)
        taken.append(live[first])
        root[high] = np.minimum(a, b)[first]
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root[:] = above


def forests(rows: pd.DataFrame, key: int, key_budget: int, budget: int, orders: int, number: int) -> pd.DataFrame:
    """Links of a task: ``number`` forests over the near pairs of different groups that were not compared yet."""
    pair = rows["pair"].iloc[0]
    seen, rows = rows[rows["side"] == 2], rows[rows["side"] != 2]
    if not len(rows):
        return pd.DataFrame({"pair": [], "a": [], "b": []}).astype({"pair": np.int32, "a": np.int64, "b": np.int64})
    prints = [rows[f"w{i}"].to_numpy().view(np.uint64) for i in range(WORDS)]
    node, side = rows["node"].to_numpy(), rows["side"].to_numpy()
    order = int(rows["bits"].iloc[0])
    path = paths(prints, node, order, orders, key) >> np.uint64(64 - key)
    by = np.lexsort((node, path, side))
    prints, node, side, path = [p[by] for p in prints], node[by], side[by], path[by]
    same = bool((side == 0).all())
    half = 0 if same else int(np.searchsorted(side, 1))
    _, group = np.unique(rows["root"].to_numpy()[by], return_inverse=True)
    start = np.zeros(group.max() + 1, np.int64)
    start[group[::-1]] = np.arange(len(group))[::-1]
    # A forest is made when a link is left for it.
    bare, roots = start[group].astype(np.int32), []
    number = min(number, max(FORESTS, ROOM // len(node)))
    ids, places = np.unique(node, return_index=True)
    compared = np.zeros(0, np.int64)
    if len(seen):
        a, b = (places[np.searchsorted(ids, seen[c].to_numpy())] for c in ("w0", "w1"))
        compared = np.minimum(a, b) * len(node) + np.maximum(a, b)
    ones, others = [], []
    for i, j in candidates(path if same else path[:half], path if same else path[half:], key, key_budget, same):
        j = j + half
        last = roots[-1] if len(roots) == number else bare
        open_ = last[i] != last[j]
        i, j = i[open_], j[open_]
        apart = [p[i] ^ p[j] for p in prints]
        bits = sum(np.bitwise_count(x).astype(np.int16) for x in apart)
        # A pair belongs to the first order it meets in: no other task looks at it.
        near = np.flatnonzero(bits <= budget)
        near = near[~met_before([x[near] for x in apart], order, orders, key, key_budget)]
        i, j, bits = i[near], j[near], bits[near]
        if len(compared):
            new = ~np.isin(np.minimum(i, j) * len(node) + np.maximum(i, j), compared)
            i, j, bits = i[new], j[new], bits[new]
        by = np.argsort(bits, kind="stable")
        i, j = i[by], j[by]
        for k in range(number):
            if not len(i):
                break
            if k == len(roots):
                roots.append(bare.copy())
            at = grow(roots[k], i, j)
            ones.append(node[i[at]])
            others.append(node[j[at]])
            i, j = np.delete(i, at), np.delete(j, at)
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (ones, others))
    return pd.DataFrame({"pair": np.full(len(a), pair, np.int32), "a": np.minimum(a, b), "b": np.maximum(a, b)})


def compare(links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``links`` (``a``, ``b``) with ``alike``, from the whole texts (``node``, ``body``) of both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in spans.chunked(spans.chunked([batch], "one"), "other"):
                alike = similarities(part.column("one"), part.column("other"), shingle) >= similarity
                yield pa.RecordBatch.from_pydict({"a": part.column("a"), "b": part.column("b"), "alike": pa.array(alike)})

    one = texts.select(F.col("node").alias("a"), F.col("body").alias("one"))
    other = texts.select(F.col("node").alias("b"), F.col("body").alias("other"))
    both = links.join(one, "a").join(other, "b").select("a", "b", "one", "other")
    return both.mapInArrow(run, "a long, b long, alike boolean")


def linked(
    nodes: DataFrame,
    texts: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    orders: int = ORDERS,
    key_bits: int = KEY,
    key_budget: int = KEY_BUDGET,
    budget: int = BUDGET,
) -> DataFrame:
    """Components of similar texts: ``node`` and ``root`` for each text with a link.

    ``nodes``: ``node``, ``w0``, ``w1``, ``mark``, one row per different text. ``texts``: ``mark`` and ``body``.
    """
    dealt = stored(deal(nodes, orders, key_bits, key_budget), "dealt")
    none = dealt.sparkSession.createDataFrame([], "a long, b long, alike boolean")
    tested, seen, roots, number = none, None, None, FORESTS
    todo = dealt
    while True:
        rows = todo.withColumn("root", F.col("node"))
        if roots is not None:
            rows = todo.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select(rows.columns)
            # Pairs compared in vain, for the tasks that found them.
            rows = rows.union(seen.select("pair", F.lit(2).cast("byte"), F.lit(0).cast("byte"), "a", "b", F.lit(0), F.lit(0)))
        # Written at once, so that the function sees the number of this round.
        found = rows.groupBy("pair").applyInPandas(
            lambda rows: forests(rows, key_bits, key_budget, budget, orders, number), "pair int, a long, b long"
        )
        found = stored(found, "found")
        if roots is not None and found.isEmpty():
            return roots
        new = stored(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "links")
        used = new.select(F.col("a").alias("node")).union(new.select("b")).distinct().join(nodes.select("node", "mark"), "node")
        bodies = texts.join(used, "mark").groupBy("node").agg(F.first("body").alias("body"))
        fresh = stored(compare(new, stored(bodies, "bodies"), shingle, similarity), "fresh")
        tested = stored(tested.union(fresh), "tested")
        if roots is None or not fresh.where("alike").isEmpty():
            # What earlier rounds hold together stays so: a row per text stands for all their links.
            links = fresh.where("alike").select("a", "b")
            roots = stored(components(links if roots is None else links.union(roots.select("node", "root"))), "roots")
        vain = stored(found.join(tested.where("not alike"), ["a", "b"], "left_semi").select("pair", "a", "b"), "vain")
        if vain.isEmpty():
            return roots
        again = vain.select("pair").distinct()
        seen = vain if seen is None else stored(seen.union(vain), "seen")
        todo = dealt.join(again, "pair", "left_semi")
        seen = seen.join(again, "pair", "left_semi")
        number *= MORE


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, **options
) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``: that with the smallest id, as in ``simhash.keep_first``."""
    rows = marked(docs, key, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.chunked(batches, "body"):
            hashes, bounds, bodies = shingle_hashes(part.column("body"), shingle)
            columns = {f"w{i}": pa.array(x.view(np.int64)) for i, x in enumerate(wide_prints(hashes, bounds))}
            whole = np.array(bodies, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"mark": part.column("mark"), **columns, "whole": pa.array(whole)})

    kind = rows.schema["mark"].dataType.simpleString()
    prints = stored(rows.select("mark", "body").mapInArrow(run, f"mark {kind}, w0 long, w1 long, whole long"), "prints")
    ways = ["w0", "w1", "whole"]
    nodes = prints.groupBy(*ways).agg(F.min("mark").alias("mark")).withColumn("node", F.monotonically_increasing_id())
    nodes = stored(nodes, "nodes")
    roots = linked(nodes, rows.select("mark", "body"), shingle, similarity, **options)
    grouped = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "mark")
    first = grouped.groupBy("root").agg(F.min("mark").alias("mark")).select("mark")
    return kept_rows(rows, first, prints.select("mark"))
