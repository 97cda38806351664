"""Packing documents into fixed-length token sequences along a Hilbert curve.

Each document becomes its token ids and an end id. A hashed vector of its tokens, projected to few
dimensions, gives it a place on a Hilbert curve; documents are range-sorted by that place, and each part
of the sort fills one sequence after the other with neighbours along the curve, cutting documents where a
sequence is full. Only the last sequence of a part is padded. A place shared by any number of documents
is told apart by the id and the tokens, so that copies do not meet in one part.

A null or empty text is the end id alone. Rows with one id are documents of their own; an empty table
gives no rows. Texts are turned into tokens whole and once; the tokens are kept as a table, since the range sort
reads its input twice.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm import spans
from tableflow.llm.curve import hilbert_numbers
from tableflow.llm.store import stored

# The vocabulary of byte_bpe_50k.json as ranks; both give the same ids.
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 0
LENGTH = 1024

# Bytes of an id on its way to the sequences, which hold four.
WIDTH = 2

DIMENSIONS = 4
BITS = 12


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def signs(ids: np.ndarray) -> np.ndarray:
    """A random sign per id and dimension."""
    bits = spans.mix((ids.astype(np.uint64) + np.uint64(1)) * spans.BASE)
    return np.stack([((bits >> np.uint64(d)) & np.uint64(1)).astype(np.int8) * 2 - 1 for d in range(DIMENSIONS)], axis=1)


def places(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Place on the curve of each document: the direction of its projected vector on a grid."""
    sums = np.add.reduceat(signs(ids), bounds[:-1], axis=0, dtype=np.float64)
    length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
    unit = sums / np.where(length > 0, length, 1.0)
    grid = np.clip((unit + 1.0) * (1 << (BITS - 1)), 0, (1 << BITS) - 1)
    return hilbert_numbers(grid.astype(np.int64), BITS)


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key``, ``place`` on the curve, and ``ids`` (little-endian unsigned, ``WIDTH`` bytes each, the end id last)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    if tokenizer(path).n_vocab > 1 << (8 * WIDTH):
        raise ValueError(f"{path} has ids of more than {WIDTH} bytes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(path)
        end = np.array([END], np.uint32)
        for part in spans.chunked(batches, text):
            found = []
            for t in part.column(text).to_pylist():
                found.append(np.concatenate((encoding.encode_to_numpy(t or "", disallowed_special=()), end)))
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            yield pa.RecordBatch.from_pydict(
                {
                    key: part.column(key),
                    "place": pa.array(places(np.concatenate(found), bounds)),
                    "ids": pa.array([x.astype(f"<u{WIDTH}").tobytes() for x in found], pa.binary()),
                }
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, place long, ids binary")


def packed(tokens: DataFrame, key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """Pieces of documents: ``start`` in the document, ``ids`` (little-endian unsigned 32 bit each), ``doc_tokens``, and ``sequence_id`` and ``offset`` where they lie.

    Sequence ids hold the number of the part of the sort and the number in it.
    """
    parts = max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["place", key, "tie"]
    tied = tokens.withColumn("tie", F.crc32("ids"))
    rows = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie", "place")
    kind = tokens.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            row, start, ids, size, sequence, offset = [], [], [], [], [], []
            for number, data in enumerate(batch.column("ids").to_pylist()):
                data = np.frombuffer(data, f"<u{WIDTH}").astype("<u4")
                n, done = len(data), 0
                while done < n:
                    place = at % length
                    take = min(n - done, length - place)
                    row.append(number)
                    start.append(done)
                    ids.append(data[done : done + take].tobytes())
                    size.append(n)
                    sequence.append(base + at // length)
                    offset.append(place)
                    at += take
                    done += take
            yield pa.RecordBatch.from_pydict(
                {
                    key: batch.column(key).take(pa.array(row, pa.int64())),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.binary()),
                    "doc_tokens": pa.array(size, pa.int64()),
                    "sequence_id": pa.array(sequence, pa.int64()),
                    "offset": pa.array(offset, pa.int64()),
                }
            )

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Documents as pieces of sequences."""
    return packed(stored(tokenised(docs, key, text), "tokens"), key, length)


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per sequence: its ids without padding, and how much padding it takes."""
    bodies = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(bodies.alias("bodies"), F.sum("length").alias("n_ids"))
    ids = F.aggregate("bodies", F.lit(b""), lambda a, b: F.concat(a, b["ids"]))
    return whole.select("sequence_id", ids.alias("ids"), "n_ids", (F.lit(length) - F.col("n_ids")).alias("padding"))
