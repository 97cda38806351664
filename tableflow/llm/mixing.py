"""Mixing sources to target weights: tokens per source, a repetition rate each, and copies of whole documents.

Size of a document is its number of words (null: 0). Rows of one source share a rate, a null
source is a source of its own, last in order. A source without words has the target 0 and rate
0. Repeated rows are documents of their own with the same draw, since the draw depends on the
id alone; a null id draws like an id of its own. An empty table gives no rows. Columns of the input that
are named like the added ones are replaced in ``planned`` and untouched in ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"

# The weights of the sources in order, again and again.
WEIGHTS = (3, 1, 2)
# All targets together, as a share of all sizes, and each at most, as a multiple of its source's size.
BUDGET = 1.5
MOST = 2

# Rows of the table of sources up to which it is sent to every executor.
BROADCAST_ROWS = 100_000

PLAN = ("size", "source_size", "target", "copies")


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: str, seed: str) -> Column:
    """A number in [0, 1) from the id, the same in every run."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """Target per source. In: ``source_key`` and ``source_size``, one row per source.

    Sources are filled to a common level (target over weight); those that the level would
    put above their bound stop there, which lifts the level of the others. In the order of
    bound over weight, the level is the first (and highest) that the next source's bound doesn't exceed.
    """
    ordered = Window.orderBy(F.col("source_key").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1)
    everything = Window.partitionBy()
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source_key").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    left = by_bound.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        sizes.withColumn("weight", pick)
        .withColumn("bound", F.col("source_size") * F.lit(float(most)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(left))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level"))).over(everything))
    )
    share = F.col("level") * F.col("weight")
    return filled.select("source_key", "source_size", F.when(share < F.col("bound"), share).otherwise(F.col("bound")).alias("target"))


def planned(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with size, size and target of the source, and how many copies the mix takes.

    Only the table of sources is aggregated; the documents are shuffled only if there are too
    many sources for a broadcast.
    """
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in PLAN]).alias("row"),
        n_words(text).alias("size"),
        draw(key, seed).alias("draw"),
        F.col(f"`{source}`").alias("of"),
    )
    sizes = packed.groupBy(F.col("of").alias("source_key")).agg(F.sum("size").alias("source_size"))
    rates = cut_lineage(targets(sizes, weights, budget, most))
    if rates.count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    joined = packed.join(rates, F.col("of").eqNullSafe(F.col("source_key")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (F.col("draw") < rate - whole).cast("long")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in PLAN]
    return joined.select(*kept, "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as the mix takes it, with the columns of ``docs``."""
    kept = [F.col(f"kept.`{c}`") for c in docs.columns]
    used = {options.get(name, name) for name in ("text", "source")} | {options.get("key", "doc_id")}
    packed = docs.select(*[F.col(f"`{c}`") for c in used], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept whole"))
    rows = planned(packed, **options).select(F.col("kept whole").alias("kept"), "copies").where("copies > 0")
    rows = rows.select("kept", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(*kept)
