"""Bottom-k sketches of documents: the ``k`` smallest hashes of a text's word shingles.

A sketch with fewer than ``k`` hashes holds them all, so estimates from two such are exact. Sketches
of parts merge into the sketch of the whole. A text with fewer words than a shingle has one shingle, all its
words; null, empty and blank texts have the empty sketch. Two empty sketches are alike (1), an empty and a filled
one are not (0). Repeated rows have equal sketches; an empty table gives no rows.

As text a sketch is the base64 form of its hashes, ascending, eight bytes each, highest byte first.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm import spans

K = 128
SHINGLE = 5

# Groups whose sketches a task merges at a time before it passes them on.
GROUPS = 1 << 12


def bottom_k(texts: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text, ascending."""
    buf, offsets = spans.buffers(texts)
    starts, ends, first = spans.words(buf, offsets)
    hashes = spans.span_hashes(buf, starts, ends)
    windows, _ = spans.windows(hashes, first, shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            out.append(_smallest(windows[a : b - shingle + 1], k))
        else:
            few = hashes[a:b]
            out.append(spans.windows(few, np.array([0, b - a]), b - a)[0] if b > a else few)
    return out


def _smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest distinct hashes. Repeats can push others out of a first cut, so it grows until enough are left."""
    cut = 2 * k
    while cut < len(hashes):
        found = np.unique(np.partition(hashes, cut)[:cut])
        if len(found) >= k:
            return found[:k]
        cut *= 4
    return np.unique(hashes)[:k]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of all texts together."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))[:k]


def distinct_shingles(sketch: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles behind a sketch."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / (float(sketch[k - 1]) / 2.0**64)


def resemblance(one: np.ndarray, other: np.ndarray, k: int = K) -> float:
    """Share of the shingles of both texts that is in each (Jaccard)."""
    union = np.union1d(one, other)
    if not len(union):
        return 1.0
    if len(one) >= k or len(other) >= k:
        union = union[:k]
    both = np.intersect1d(one, other, assume_unique=True)
    return int(np.searchsorted(both, union[-1], "right")) / len(union)


def containment(one: np.ndarray, other: np.ndarray, k: int = K) -> float:
    """Share of the shingles of the first text that the other has too."""
    if not len(one):
        return 1.0
    shared = resemblance(one, other, k) * distinct_shingles(merge((one, other), k), k)
    return min(1.0, shared / distinct_shingles(one, k))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """``key`` and ``fingerprint`` per row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.chunked(batches, text):
            found = [encode(s) for s in bottom_k(part.column(text), k)]
            yield pa.RecordBatch.from_pydict({key: part.column(key), "fingerprint": pa.array(found, pa.string())})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint string")


def merged(prints: DataFrame, by: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch per value of ``by``, over all its rows.

    Each task merges what it reads, so a group comes to its last task as a few sketches per task,
    however many rows it has.
    """
    kind = prints.schema[by].dataType.simpleString()
    schema = f"`{by}` {kind}, `{column}` string"

    def within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            keys = pa.array(list(held), prints_type)
            return pa.RecordBatch.from_pydict({by: keys, column: pa.array([encode(s) for s in held.values()])})

        prints_type = None
        for batch in batches:
            prints_type = batch.column(by).type
            for value, text in zip(batch.column(by).to_pylist(), batch.column(column).to_pylist()):
                held[value] = merge((held.get(value, np.zeros(0, np.uint64)), decode(text or "")), k)
                if len(held) >= GROUPS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: rows[by].iloc[:1], column: [encode(merge(map(decode, rows[column]), k))]})

    return prints.select(by, column).mapInArrow(within, schema).groupBy(by).applyInPandas(across, schema)


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in parts of descending ``key``, with the row that follows the last of each part.

    Returns ``key``, ``text``, ``part`` and ``guest`` (true for the row that belongs to the next part), each part in
    one partition and in order. The row after the last is the first. Rows with one id are in the order of
    their texts; rows without an id come last. Texts are moved once: a row at the head of a part, and
    no other, goes to two of them.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts + 1)]
    found = docs.agg(F.percentile_approx(key, shares, 100 * parts).alias("cuts")).first()
    cuts = sorted(set(found.cuts or []), reverse=True)
    top, heads = (cuts[0], cuts[1:]) if cuts else (None, [])
    ids = F.array(*[F.lit(c) for c in heads]) if heads else F.array().cast("array<long>")
    # Ids that begin a part are in the list, so this is the number of the part.
    part = F.when(F.col(key).isNull(), F.lit(len(heads))).otherwise(
        F.size(F.filter(ids, lambda c: c >= F.col(key)))
    ).cast("int")
    first = F.array_position(ids, F.col(key)).cast("int")
    guest_of = F.when(F.col(key).eqNullSafe(F.lit(top)), F.lit(len(heads))).when(first > 0, first - 1).cast("int")
    own = F.struct(part.alias("part"), F.lit(False).alias("guest"))
    other = F.struct(guest_of.alias("part"), F.lit(True).alias("guest"))
    places = F.filter(F.array(own, other), lambda p: p["part"].isNotNull())
    rows = docs.select(F.col(key), F.col(text), F.explode(places).alias("place"))
    rows = rows.select(key, text, "place.part", "place.guest").repartitionById(len(heads) + 1, F.col("part"))
    return rows.sortWithinPartitions("part", "guest", F.col(key).desc_nulls_last(), F.col(text).asc_nulls_first())


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness.

    The edited form has the last half of the characters replaced by the first as many of the next text in
    descending order of ``key``.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for chunk in spans.chunked(batches, text):
            table = pa.Table.from_batches([chunk] if held is None else [held, chunk]).combine_chunks()
            rows = table.to_batches()[0]
            parts, guests = rows.column("part").to_pylist(), rows.column("guest").to_pylist()
            texts = [t or "" for t in rows.column(text).to_pylist()]
            # The last row waits for its successor; only the first guest of a part is one.
            held = rows.slice(len(rows) - 1)
            at = [i for i in range(len(rows) - 1) if not guests[i] and parts[i] == parts[i + 1]]
            if not at:
                continue
            edited = []
            for i in at:
                half = len(texts[i]) // 2
                edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
            own = bottom_k(rows.column(text), k)
            new = bottom_k(pa.array(edited, pa.large_string()), k)
            yield pa.RecordBatch.from_pydict(
                {
                    key: rows.column(key).take(pa.array(at)),
                    "n_chars": pa.array([len(texts[i]) for i in at], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    "fingerprint": pa.array([encode(own[i]) for i in at]),
                    "edited_fingerprint": pa.array([encode(s) for s in new]),
                    "near_edited": pa.array([resemblance(own[i], s, k) for i, s in zip(at, new)]),
                    "near_next": pa.array([resemblance(own[i], own[i + 1], k) for i in at]),
                }
            )

    return beside_next(docs.select(key, text), key, text).mapInArrow(run, schema)
