"""Language identification with character language models.

One interpolated Kneser-Ney model per language, over the letters of a word between word marks. All models share
sorted arrays of n-gram hashes; a row holds the probability of the n-gram in each language. A text gets the language with
the lowest cross-entropy per character. Calibration, on labelled texts that the models have not seen, gives the
score its temperature and each language the cross-entropy beyond which a text is rejected.

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected. Ties go to the first
language in order of code points. Without labelled texts every text is ``und`` and none with letters is
rejected. Labels that are null are not used. Repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm import spans
from tableflow.llm.store import stored

ORDER = 5
# Different labelled texts per language, at most: so many train, so many calibrate.
TRAIN = 400
CALIBRATE = 200
UNKNOWN = "und"

# Rejected is what lies this far above the usual cross-entropy of its language, in bits and deviations. Texts in two
# languages lie about a bit above it and stay.
SLACK_BITS = 1.5
DEVIATIONS = 6.0

MARK = np.uint32(0x110000)
STEPS = spans.mix(np.arange(11, 11 + ORDER + 1, dtype=np.uint64) * spans.BASE) | np.uint64(1)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_words(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, and start, end and first number of their letter runs."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in lower], dtype=np.int64)))
    return points, *spans.runs(letters()[points], offsets)


def word_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = spans.powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return spans.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def marked(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words as one array with a mark around each, the place in its word of each element, and where each word begins."""
    lengths = ends - starts
    bounds = np.concatenate(([0], np.cumsum(lengths + 2)))
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths + 2)
    inside = (place > 0) & (place <= np.repeat(lengths, lengths + 2))
    out = np.full(bounds[-1], MARK, np.uint32)
    out[inside] = points[(np.repeat(starts - 1, lengths + 2) + place)[inside]]
    return out, place, bounds


def grams(symbols: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: the places that have a whole n-gram behind them, its hash, and the hash of its context."""
    values = spans.mix((symbols.astype(np.uint64) + np.uint64(1)) * spans.BASE)
    gram = values * STEPS[0]
    context = np.zeros(len(values), np.uint64)
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(place >= max(1, n - 1))
        yield n, at, spans.mix(gram[at] + np.uint64(n)), spans.mix(context[at] + np.uint64(n))
        following = gram.copy()
        following[n:] += values[:-n] * STEPS[n] if n < len(values) else 0
        context = np.concatenate((np.zeros(1, np.uint64), gram[:-1]))
        gram = following


@dataclass
class Models:
    """All languages' models. ``keys`` and ``contexts`` are sorted, per order; a column per language."""

    names: list[str]
    uniform: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    chances: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    drift: np.ndarray | None = None

    def bits(self, symbols: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Cost of each symbol in each language; 0 for the mark before a word."""
        chance = np.repeat(self.uniform[None, :], len(symbols), axis=0)
        for (n, at, gram, context), keys, found, heads, weight in zip(
            grams(symbols, place), self.keys, self.chances, self.contexts, self.weights
        ):
            row = np.minimum(np.searchsorted(heads, context), len(heads) - 1)
            lower = chance[at] * np.where((heads[row] == context)[:, None], weight[row], 1.0)
            row = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            seen = found[row]
            chance[at] = np.where((keys[row] == gram)[:, None] & (seen > 0), seen, lower)
        cost = -np.log2(chance)
        cost[place == 0] = 0
        return cost


def _one(words: list[str], counts: np.ndarray) -> list[tuple]:
    """Per order: hashes, probabilities, contexts and their weights of one language's model."""
    points, starts, ends, _ = letter_words(words)
    symbols, place, bounds = marked(points, starts, ends)
    weight = np.repeat(counts.astype(np.float64), ends - starts + 2)
    orders = list(grams(symbols, place))
    out, below = [], None
    size = len(np.unique(symbols)) + 1
    for n, at, gram, context in orders:
        keys, first, back = np.unique(gram, return_index=True, return_inverse=True)
        adjusted = np.bincount(back, weights=weight[at])
        if n < ORDER:
            # Not at the beginning of a word: the number of different symbols before it.
            longer = orders[n]
            whole, whole_first = np.unique(longer[2], return_index=True)
            tail = np.searchsorted(keys, gram[np.searchsorted(at, longer[1][whole_first])])
            before = np.bincount(tail, minlength=len(keys)).astype(np.float64)
            head = place[at[first]] == n - 1
            adjusted = np.where(head & (n > 1), adjusted, before)
        heads, head_of = np.unique(context[first], return_inverse=True)
        total, kinds = np.bincount(head_of, weights=adjusted), np.bincount(head_of)
        once, twice = np.sum(adjusted == 1), np.sum(adjusted == 2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        free = discount * kinds / total
        lower = np.full(len(keys), 1.0 / size) if below is None else below[1][np.searchsorted(below[0], orders[n - 2][2][np.searchsorted(orders[n - 2][1], at[first])])]
        chance = np.maximum(adjusted - discount, 0) / total[head_of] + free[head_of] * lower
        below = (keys, chance)
        out.append((keys, chance, heads, free))
    return out, size


def fit(names: list[str], words: list[list[str]], counts: list[np.ndarray]) -> Models:
    """Models from the word counts of each language."""
    each = [_one(w, c) for w, c in zip(words, counts)]
    models = Models(names, np.array([1.0 / size for _, size in each]))
    for n in range(ORDER):
        keys = np.unique(np.concatenate([m[n][0] for m, _ in each]))
        heads = np.unique(np.concatenate([m[n][2] for m, _ in each]))
        chance = np.zeros((len(keys), len(names)), np.float32)
        weight = np.ones((len(heads), len(names)), np.float32)
        for column, (m, _) in enumerate(each):
            chance[np.searchsorted(keys, m[n][0]), column] = m[n][1]
            weight[np.searchsorted(heads, m[n][2]), column] = m[n][3]
        models.keys.append(keys)
        models.chances.append(chance)
        models.contexts.append(heads)
        models.weights.append(weight)
    return models


def entropies(models: Models, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Characters (word ends included) and bits per character in each language, per text.

    Each different word of the batch is scored once.
    """
    points, starts, ends, first = letter_words(texts)
    _, at, back = np.unique(word_keys(points, starts, ends), return_index=True, return_inverse=True)
    symbols, place, bounds = marked(points, starts[at], ends[at])
    costs = np.zeros((len(at), len(models.names)))
    # Some words at a time: a row of the models' table for each of their letters is held.
    cuts = np.unique(np.concatenate((np.searchsorted(bounds, np.arange(0, len(symbols), 1 << 16)), [len(at)])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        bits = models.bits(symbols[bounds[a] : bounds[b]], place[bounds[a] : bounds[b]])
        costs[a:b] = np.add.reduceat(bits, bounds[a:b] - bounds[a], axis=0)
    size = spans.per_text(ends - starts + 1, first)
    total = np.stack([spans.per_text(costs[back, k], first) for k in range(len(models.names))], axis=1)
    return size, total / np.maximum(size, 1)[:, None]


def calibrate(models: Models, truth: np.ndarray, size: np.ndarray, bits: np.ndarray) -> None:
    """Temperature of the score, and usual cross-entropy and deviations of each language."""
    used = size > 0
    truth, size, bits = truth[used], size[used], bits[used]
    width = len(models.names)
    models.mean, models.spread, models.drift = np.full(width, np.inf), np.zeros(width), np.zeros(width)
    for k in range(width):
        own = truth == k
        if own.any():
            h, n = bits[own, k], size[own]
            models.mean[k] = np.average(h, weights=n)
            models.spread[k] = np.sqrt(np.mean((h - models.mean[k]) ** 2 * n))
            models.drift[k] = np.sqrt(np.average((h - models.mean[k]) ** 2, weights=n))
    if len(truth):
        losses = [(-np.log(np.maximum(_chances(bits, t)[np.arange(len(truth)), truth], 1e-12)).mean(), t) for t in 2.0 ** np.arange(-2, 7)]
        models.temperature = min(losses)[1]


def _chances(bits: np.ndarray, temperature: float) -> np.ndarray:
    odds = np.exp(-temperature * (bits - bits.min(axis=1, keepdims=True)))
    return odds / odds.sum(axis=1, keepdims=True)


def decide(models: Models, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    if not models.names:
        size = np.diff(letter_words(texts)[3])
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), size == 0
    size, bits = entropies(models, texts)
    best = bits.argmin(axis=1)
    score = np.where(size > 0, _chances(bits, models.temperature).max(axis=1), 0.0)
    usual = np.maximum(models.drift[best], models.spread[best] / np.sqrt(np.maximum(size, 1)))
    limit = models.mean[best] + SLACK_BITS + DEVIATIONS * usual
    rejected = (size == 0) | (bits[np.arange(len(best)), best] > limit)
    return [models.names[b] if n else UNKNOWN for b, n in zip(best, size)], score, rejected


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` different texts of each label that have the smallest hashes: ``label``, ``body``, and their ``place`` and number ``n``.

    Copies count as one text and texts without a letter as none. Hashes up to a few times the share of the sample are
    looked at only, so that one task gets few, and copies are combined inside the map tasks.
    """
    drawn = rows.where(F.rlike("body", F.lit(r"\p{L}"))).withColumn("draw", F.xxhash64("body"))
    kinds = drawn.groupBy("label").agg(F.approx_count_distinct("draw").alias("n")).collect()
    bounds = [(r.label, int(-(2**63) + min(1.0, 4 * most / max(1, r.n)) * (2**64 - 1025))) for r in kinds]
    table = rows.sparkSession.createDataFrame(bounds, "label string, bound long")
    near = drawn.join(F.broadcast(table), "label").where("draw <= bound").select("label", "draw").distinct()
    own = Window.partitionBy("label")
    first = near.withColumn("place", F.row_number().over(own.orderBy("draw"))).where(F.col("place") <= most)
    chosen = first.withColumn("n", F.count(F.lit(1)).over(own))
    found = drawn.join(F.broadcast(chosen), ["label", "draw"]).groupBy("label", "draw", "place", "n").agg(F.min("body").alias("body"))
    return stored(found.select("label", "body", "place", "n"), "sample")


def learn(docs: DataFrame, text: str = "text", label: str = "lang", train: int = TRAIN, calibration: int = CALIBRATE) -> Models:
    """Models from labelled texts: at most ``train`` and ``calibration`` different ones per language, chosen by the hash of the text.

    The sample is the only part of the corpus that the models come from, so their size does not grow with it;
    the driver gets its word counts. Every language with a letter in its texts is learnt; of few texts, the same share trains.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("body"))
    sample = sampled(rows, train + calibration)
    low = F.greatest(F.lit(1), F.floor(F.col("n") * train / (train + calibration)))
    sample = sample.withColumn("trains", F.col("place") <= low)
    names = sorted((r.label for r in sample.select("label").distinct().collect()), key=lambda name: name.encode())
    if not names:
        return Models([], np.zeros(0))
    words = F.explode(F.expr(r"regexp_extract_all(lower(body), '(\\p{L}+)', 1)"))
    counted = sample.where("trains").select("label", words.alias("word")).groupBy("label", "word").count().toPandas()
    counted = counted.sort_values(["label", "word"])
    trained = [name for name in names if (counted["label"] == name).any()]
    parts = [counted[counted["label"] == name] for name in trained]
    models = fit(trained, [p["word"].tolist() for p in parts], [p["count"].to_numpy() for p in parts]) if trained else Models([], np.zeros(0))
    if not trained:
        return models
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.chunked(batches, "body"):
            size, bits = entropies(shared.value, part.column("body").to_pylist())
            yield pa.RecordBatch.from_pydict({"label": part.column("label"), "size": pa.array(size), "bits": pa.array(bits.tolist())})

    held = sample.where("not trains").select("label", "body").mapInArrow(run, "label string, size long, bits array<double>").toPandas()
    held = held[held["label"].isin(trained)].sort_values(["label", "size"])
    truth = np.array([trained.index(x) for x in held["label"]], np.int64)
    bits = np.array(held["bits"].tolist(), np.float64).reshape(len(held), len(trained))
    calibrate(models, truth, held["size"].to_numpy(), bits)
    return models


def predicted(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` and ``rejected`` per row."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.chunked(batches, text):
            names, score, rejected = decide(shared.value, part.column(text).to_pylist())
            found = {"lang_pred": pa.array(names), "score": pa.array(score), "rejected": pa.array(rejected)}
            yield pa.RecordBatch.from_pydict({key: part.column(key)} | found)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in spans.chunked(batches, text):
            rejected = decide(shared.value, part.column(text).to_pylist())[2]
            yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
