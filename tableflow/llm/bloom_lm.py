"""Scoring texts with a bigram model whose counts lie in a log-frequency Bloom filter that is broadcast.

An n-gram seen ``c`` times is put into the filter under the levels 1 to 1 + floor(log2 c); a reader probes level after
level until one is missing. Counts of words and bigrams are summed by Spark, rows in proportion to the text; they become filters per
shard (a range of hashes), each as large as its own n-grams need, and nothing else is kept of the bigrams. All are in,
also those seen once.

The filters are broadcast in rounds of at most about ``ROUND_BYTES``, one for half a gigabyte of text. The model grows with the corpus, and so does
the number of rounds; each n-gram of a text is probed in one round, but every round reads the hashed texts again.

A batch of about ``FLUSH`` tokens asks for each of its different words once, so a word that is everywhere weighs no more than any
other. Beside the model's score stands an exact unigram score; the exact counts of a round's words go with its filters.

The bigram part takes the least count of a bigram's level over the most of its context's, so it sums to at most one, but for
chance hits; so does the whole, with the unigram part.

Cases: a null or blank text is the end token alone. Without training texts every token is unknown and both scores are 0.
Rows with one id are texts of their own; an empty table gives no rows. A null ``train`` counts as no. Of other columns none is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableflow.llm import spans
from tableflow.llm.store import stored

# Bits of the filter per entry and level, and bits that an entry sets.
BITS_PER_ENTRY = 8
PROBES = 3
BLOCK = 512
LEVELS = 64

# Weight of the bigram estimate where the word before is known.
PAIR_WEIGHT = 0.3

# Tokens of training for each shard, about, and bytes of filters that are broadcast at a time.
SHARD_TOKENS = 1 << 20
ROUND_BYTES = 48 << 20
# Tokens that a task counts before it passes the counts on.
COUNTED = 3 << 20
# Tokens of a batch of texts, and n-grams probed at a time.
FLUSH = 1 << 20
PROBE = 1 << 18

END = np.uint64(0x5851F42D4C957F2C)
# The lowest bit of a hash tells bigrams from words.
PAIR = np.uint64(1)


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, highest bytes together: sorted hashes and small counts shrink well in this order."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end after each text, and where each text begins."""
    buf, offsets = spans.buffers(texts)
    buf = spans.LOWER[buf]
    starts, ends, first = spans.words(buf, offsets)
    bounds = first + np.arange(len(first))
    out = np.full(bounds[-1], END)
    inside = np.ones(bounds[-1], bool)
    inside[bounds[1:] - 1] = False
    out[inside] = spans.span_hashes(buf, starts, ends) & ~PAIR
    return out, bounds


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token and the hash of both. Before a text's first token stands the end of another."""
    before = np.concatenate(([END], words[:-1])) if len(words) else words
    return before, spans.mix(before * spans.BASE + words) | PAIR


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Number of the shard of each hash; shards are ranges of hashes in order."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.frexp(counts.astype(np.float64))[1]


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for none."""
    return np.where(level > 0, (3 * 2.0 ** (level - 1) - 1) / 2, 0.0)


def bits_of(hashes: np.ndarray, level: int, blocks: np.ndarray, first: np.ndarray | int = 0) -> np.ndarray:
    """Bits of an entry at a level: in one of so many blocks from ``first`` on, so that a probe touches one cache line.

    The block comes from the low bits of the hash, since the high ones tell the shard.
    """
    block = (((hashes & np.uint64(0xFFFFFFFF)) * blocks.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + first
    spread = spans.mix(hashes + np.uint64(level * int(spans.INVERSE) % (1 << 64)))
    slots = [(spread >> np.uint64(9 * k)) & np.uint64(BLOCK - 1) for k in range(PROBES)]
    return block[:, None] * BLOCK + np.stack(slots, axis=1).astype(np.int64)


def shard_filter(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """The bits of the n-grams of one shard and their levels."""
    level = levels(counts)
    blocks = np.array([max(1, -(-int(level.sum()) * BITS_PER_ENTRY // BLOCK))])
    bits = np.zeros(int(blocks[0]) * BLOCK // 8, np.uint8)
    for n in range(1, int(level.max(initial=0)) + 1):
        held = hashes[level >= n]
        for at in range(0, len(held), PROBE):
            bit = bits_of(held[at : at + PROBE], n, blocks).ravel()
            np.bitwise_or.at(bits, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
    return bits.tobytes()


class Filters:
    """The filters of the shards from ``begin`` on, one after another, and their words with exact counts.

    A shard without n-grams has no filter.
    """

    def __init__(self, shards: int, begin: int, end: int, found: dict[int, bytes], words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts
        self.shards, self.begin, self.end = shards, begin, end
        parts = [found.get(s, b"") for s in range(begin, end)]
        self.blocks = np.array([len(x) * 8 // BLOCK for x in parts], np.int64)
        self.first = np.cumsum(self.blocks) - self.blocks
        # A byte more, for the probes of a shard that has none.
        self.bits = np.frombuffer(b"".join(parts) + bytes(BLOCK // 8), np.uint8)

    def mine(self, hashes: np.ndarray) -> np.ndarray:
        shard = shard_of(hashes, self.shards)
        return (shard >= self.begin) & (shard < self.end)

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """The highest level up to which all levels of an n-gram of these shards are found."""
        out = np.zeros(len(hashes), np.uint8)
        for begin in range(0, len(hashes), PROBE):
            part = hashes[begin : begin + PROBE]
            shard = shard_of(part, self.shards) - self.begin
            alive = np.flatnonzero(self.blocks[shard] > 0)
            for level in range(1, LEVELS + 1):
                at = bits_of(part[alive], level, self.blocks[shard[alive]], self.first[shard[alive]])
                alive = alive[((self.bits[at >> 3] >> (at & 7)) & 1).all(axis=1)]
                if not len(alive):
                    break
                out[begin + alive] = level
        return out


    def exact(self, hashes: np.ndarray) -> np.ndarray:
        """Exact counts of words of these shards; 0 for others."""
        if not len(self.words):
            return np.zeros(len(hashes), np.uint64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.counts[at], np.uint64(0))


@dataclass
class Totals:
    """Tokens and different tokens of training, and what turns levels into probabilities."""

    tokens: int
    different: int
    unknown: float
    mass: float

    def log_chances(self, words: np.ndarray, word_level: np.ndarray, pair_level: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token after the one before it.

        ``words`` says which of the words' levels belongs to each token; ``pair_level`` is of it and the one before.
        """
        count = middle(word_level)
        alone = np.where(count > 0, (1 - self.unknown) * count / max(self.mass, 1.0), self.unknown)[words]
        # Before a text's first token stands the end of another, which is any text's last token.
        context = (2.0 ** word_level.astype(np.float64) - 1)[np.concatenate((words[-1:], words[:-1]))]
        joint = np.where(pair_level > 0, 2.0 ** (pair_level.astype(np.float64) - 1), 0.0)
        follow = np.minimum(joint / np.maximum(context, 1.0), 1.0)
        return np.log10(np.where(context > 0, PAIR_WEIGHT * follow + (1 - PAIR_WEIGHT) * alone, alone))


def body(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: its different words, which of them each token is, where texts begin, which are for training."""
    kinds = {"words": "<u8", "tokens": "<u4", "bounds": "<u8"}
    words, of, bounds = (unplaned(row[c], k) for c, k in kinds.items())
    return words, of, bounds.astype(np.int64), np.frombuffer(row["training"], np.uint8).astype(bool)


BODY = ("batch", "words", "tokens", "bounds", "training")


def hashed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A row per text (``key``, ``train``, ``batch``, ``place``, ``n_tokens``), and a row per batch of texts (``BODY``)."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, train boolean, batch long, place int, n_tokens long, words binary, tokens binary, bounds binary, training binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        n_texts, n_tokens, kinds = 0, 0, None

        def whole(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            empty = {f.name: pa.nulls(n, f.type) for f in kinds}
            return pa.RecordBatch.from_pydict(empty | columns, kinds)

        def flush() -> pa.RecordBatch:
            words, of = np.unique(np.concatenate([w for w, *_ in held]), return_inverse=True)
            bounds = np.concatenate(([0], np.cumsum(np.concatenate([n for _, n, _ in held]))))
            data = {"words": planes(words), "tokens": planes(of.astype(np.uint32)), "bounds": planes(bounds.astype(np.uint64))}
            data["training"] = np.concatenate([x for *_, x in held]).astype(np.uint8).tobytes()
            return whole({"batch": pa.array([number])} | {c: pa.array([x], pa.binary()) for c, x in data.items()}, 1)

        for chunk in spans.chunked(batches, text):
            if kinds is None:
                first = [(key, chunk.schema.field(key).type), ("train", pa.bool_()), ("batch", pa.int64()), ("place", pa.int32()), ("n_tokens", pa.int64())]
                kinds = pa.schema([*first, *[(c, pa.binary()) for c in BODY[1:]]])
            words, bounds = tokens(chunk.column(text))
            doc = {
                key: chunk.column(key),
                "train": chunk.column("train"),
                "batch": pa.array(np.full(len(chunk), number)),
                "place": pa.array(np.arange(n_texts, n_texts + len(chunk)), pa.int32()),
                "n_tokens": pa.array(np.diff(bounds)),
            }
            yield whole(doc, len(chunk))
            held.append((words, np.diff(bounds), chunk.column("train").to_numpy(zero_copy_only=False).astype(bool)))
            n_texts += len(chunk)
            n_tokens += len(words)
            if n_tokens >= FLUSH:
                yield flush()
                held, n_texts, n_tokens = [], 0, 0
                number += 1
        if held:
            yield flush()

    return stored(rows.mapInArrow(run, schema), "hashed-texts")


def summed(bodies: DataFrame, shards: int) -> DataFrame:
    """``shard``, ``hash`` and ``n`` of all different n-grams of training; a shard lies in one partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos, held = [], [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            for gathered in (ones, twos):
                values, n = np.unique(np.concatenate(gathered), return_counts=True)
                gathered.clear()
                for at in range(0, len(values), PROBE):
                    h = values[at : at + PROBE]
                    columns = [shard_of(h, shards).astype(np.int32), h.view(np.int64), n[at : at + PROBE]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "hash", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                words, of, bounds, training = body(row)
                learnt = np.repeat(training, np.diff(bounds))
                ones.append(words[of[learnt]])
                twos.append(pairs(words[of])[1][learnt])
                held += len(ones[-1])
                if held >= COUNTED:
                    yield from dealt()
                    held = 0
        if held:
            yield from dealt()

    parts = max(shards, int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = bodies.mapInArrow(run, "shard int, hash long, n long").repartition(parts, "shard")
    return rows.groupBy("shard", "hash").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> DataFrame:
    """A row per shard: its filter, its words in ascending order with their counts, and its words per level (``entries``, ``mass``).

    Each task holds the n-grams of a few shards, which are bounded by ``SHARD_TOKENS``.
    """
    schema = "shard int, bits binary, words binary, counts binary, entries array<long>, mass array<long>"
    longs = pa.list_(pa.int64())
    kinds = pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("bits", "words", "counts")], ("entries", longs), ("mass", longs)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "hash", "n")) for b in batches]
        if not held:
            return
        shard, hashes, n = (np.concatenate(x) for x in zip(*held))
        del held
        hashes, n = hashes.view(np.uint64), n.astype(np.uint64)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            words = own[hashes[own] & PAIR == 0]
            words = words[np.argsort(hashes[words])]
            level = levels(n[words])
            row = {
                "shard": [s],
                "bits": [shard_filter(hashes[own], n[own])],
                "words": [hashes[words].tobytes()],
                "counts": [n[words].tobytes()],
                "entries": [np.bincount(level, minlength=LEVELS + 1)],
                "mass": [np.bincount(level, weights=n[words], minlength=LEVELS + 1).astype(np.int64)],
            }
            yield pa.RecordBatch.from_pydict(row, kinds)

    return stored(counts.mapInArrow(run, schema), "shard-filters")


def totals(known: DataFrame) -> Totals:
    """Sums over all shards; the driver gets a row per level."""
    each = F.posexplode(F.arrays_zip("entries", "mass")).alias("level", "of")
    sums = known.select(each).groupBy("level").agg(F.sum("of.entries").alias("n"), F.sum("of.mass").alias("mass"))
    entries, mass = np.zeros(LEVELS + 1, np.int64), np.zeros(LEVELS + 1, np.int64)
    for row in sums.collect():
        entries[row.level], mass[row.level] = row.n, row.mass
    total = int(mass.sum())
    # The words seen once stand for the words never seen.
    unknown = min(0.5, max(int(mass[1]), 1) / (total + 1)) if total else 1.0
    return Totals(total, int(entries.sum()), unknown, float((middle(np.arange(LEVELS + 1)) * entries)[1:].sum()))


def rounds(known: DataFrame, shards: int) -> Iterator[Filters]:
    """The filters in rounds of about ``ROUND_BYTES``; shards are about equal, so a round is a run of them."""
    held = known.select("shard", "bits", "words", "counts")
    size = held.agg(F.sum((F.octet_length("bits") + F.octet_length("words") + F.octet_length("counts")).cast("long"))).first()[0] or 0
    count = max(1, min(shards, -(-size // ROUND_BYTES)))
    for number in range(count):
        begin, end = number * shards // count, (number + 1) * shards // count
        yield gathered(held.where(F.col("shard").between(begin, end - 1)), shards, begin, end)


def gathered(held: DataFrame, shards: int, begin: int, end: int) -> Filters:
    """One round on the driver, shard by shard."""
    rows = {row["shard"]: (bytes(row["bits"]), bytes(row["words"]), bytes(row["counts"])) for row in held.toLocalIterator()}
    words, counts = (np.frombuffer(b"".join(rows[s][i] for s in sorted(rows)), "<u8") for i in (1, 2))
    return Filters(shards, begin, end, {s: bits for s, (bits, *_) in rows.items()}, words, counts)


def probed(bodies: DataFrame, shared) -> DataFrame:
    """What the round's shards know of each batch, in order: ``counts`` and levels of its words (``ones``), levels of its token pairs (``twos``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        kinds = pa.schema([("batch", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), *[(c, pa.binary()) for c in ("counts", "ones", "twos")]])
        for batch in batches:
            for row in batch.to_pylist():
                words, of, _, _ = body(row)
                both = pairs(words[of])[1]
                ones, twos = (h[filters.mine(h)] for h in (words, both))
                found = [planes(filters.exact(ones)), filters.level(ones).tobytes(), filters.level(twos).tobytes()]
                data = [row["batch"], filters.begin, filters.end, *found]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(data, kinds)], schema=kinds)

    return stored(bodies.mapInArrow(run, "batch long, begin int, end int, counts binary, ones binary, twos binary"), "levels")


def scored(texts: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Both scores of every text, learnt from those where ``train`` holds.

    Returns ``key``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.
    """
    rows = texts.select(F.col(key), F.col(text), F.coalesce(train, F.lit(False)).alias("train"))
    both = hashed(rows, key, text)
    docs = both.where("words is null").select(key, "train", "batch", "place", "n_tokens")
    bodies = both.where("words is not null").select(*BODY)
    learnt = docs.where("train").agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-learnt // SHARD_TOKENS))
    known = model(summed(bodies, shards))
    sums = totals(known)
    found = None
    for filters in rounds(known, shards):
        shared = texts.sparkSession.sparkContext.broadcast(filters)
        part = probed(bodies, shared)
        shared.destroy()
        # The next round is gathered when this one has left the driver.
        del shared, filters
        found = part if found is None else found.union(part)

    def score(facts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        """Both scores of the texts of one batch."""
        words, of, bounds, _ = body(own.iloc[0])
        pair = pairs(words[of])[1]
        count, ones, twos = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint8), np.zeros(len(of), np.uint8)
        word_shard, pair_shard = shard_of(words, shards), shard_of(pair, shards)
        for row in facts.itertuples():
            mine = (word_shard >= row.begin) & (word_shard < row.end)
            count[mine] = unplaned(row.counts, "<u8")
            ones[mine] = np.frombuffer(row.ones, np.uint8)
            twos[(pair_shard >= row.begin) & (pair_shard < row.end)] = np.frombuffer(row.twos, np.uint8)
        chances = sums.log_chances(of, ones, twos)
        begin = bounds[:-1]
        return pd.DataFrame(
            {
                "batch": own["batch"].iloc[0],
                "place": np.arange(len(begin), dtype=np.int32),
                "n_known": np.add.reduceat((count > 0)[of].astype(np.int64), begin),
                "logs": np.add.reduceat(np.log10(count.astype(np.float64) + 0.5)[of], begin),
                "score": np.add.reduceat(chances, begin),
            }
        )

    done = found.groupBy("batch").cogroup(bodies.groupBy("batch")).applyInPandas(
        score, "batch long, place int, n_known long, logs double, score double"
    )
    base = float(np.log10(sums.tokens + 0.5 * (sums.different + 1)))
    return docs.join(done, ["batch", "place"]).select(
        key,
        "train",
        "n_tokens",
        "n_known",
        F.lit(sums.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        "score",
    )
