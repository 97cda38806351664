"""Sharding along a Hilbert curve through several metadata columns.

Rows close in all columns lie in the same shard, so that files of a shard have narrow ranges
in every column and a filter on any of them skips most files. Shards are cut at equal numbers
of rows. Rows of one grid cell are told apart by further columns, so a cell with any share of all rows
is cut like the rest.

A null is a value of its own, before the others. Equal rows keep any order among themselves,
one row each. An empty table gives no rows. Columns named like the added ones (curve, shard, slot) are replaced in the
result, though they may serve as categories, sizes or ties; all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableflow.llm.curve import hilbert_index
from tableflow.session import cut_lineage

# Values of a column up to which their table is sent to every executor.
BROADCAST_ROWS = 100_000

ADDED = ("curve", "shard", "slot")


def _ranked(df: DataFrame, column: str, axis: str, bits: int) -> DataFrame:
    """``df`` with the place of the column's value, counted in rows, on a scale of 2**bits steps.

    The values are counted first, so their table has one row per value.
    """
    counts = df.groupBy(F.col(column).alias("axis_value")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.col("axis_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("n").over(before), F.lit(0)) / F.sum("n").over(Window.partitionBy())
    steps = cut_lineage(counts.select("axis_value", F.floor(place * (1 << bits)).alias(axis)))
    if steps.count() <= BROADCAST_ROWS:
        steps = F.broadcast(steps)
    return df.join(steps, F.col(column).eqNullSafe(F.col("axis_value")), "left").drop("axis_value")


def scaled(number: Column, bits: int) -> Column:
    """A size on a logarithmic scale of 2**bits steps that ends at 2**40."""
    steps = 1 << bits
    step = F.floor(F.log2(F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)) + 1.0) * (steps / 40.0))
    return F.least(step, F.lit(steps - 1)).cast("long")


def sharded(
    df: DataFrame,
    shards: int,
    categories: list[str],
    sizes: list[str],
    ties: list[str],
    bits: int = 6,
) -> DataFrame:
    """``df`` with ``curve`` (Hilbert index), ``shard`` and ``slot`` (place in the shard, from 0).

    ``categories`` are columns with few values, ``sizes`` are numbers, ``ties`` order the rows of a grid cell and
    should tell all rows apart. One range shuffle; ranks come from the counts of the sorted parts.
    """
    axes = [f"axis_{i}" for i in range(len(categories) + len(sizes))]
    inputs = [*categories, *sizes, *ties]
    # The row in one struct, so that its names meet none of those used here.
    placed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ADDED]).alias("row"),
        *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(inputs)],
    )
    for i, axis in enumerate(axes):
        if i < len(categories):
            placed = _ranked(placed, f"in_{i}", axis, bits)
        else:
            placed = placed.withColumn(axis, scaled(F.col(f"in_{i}"), bits))
    ties = [f"in_{i}" for i in range(len(axes), len(inputs))]
    placed = placed.select("row", *ties, hilbert_index([F.col(a) for a in axes], bits).alias("curve"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["curve", *ties]
    # The ids below hold the number of the part and the place in it; the parts must not change between their uses.
    fixed = cut_lineage(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    numbered = fixed.withColumn("row_at", F.monotonically_increasing_id())
    part = F.shiftright("row_at", 33)
    counts = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("n").over(Window.partitionBy()).alias("rows_in_all"),
    )
    # One row per part of the shuffle, whatever the input.
    rank = F.col("rows_before") + F.col("row_at").bitwiseAND((1 << 33) - 1)
    ranked = numbered.join(F.broadcast(offsets), part == F.col("part")).withColumn("rank_in_all", rank)
    shard = F.expr(f"(rank_in_all * {shards}) div rows_in_all")
    first = F.expr(f"(shard * rows_in_all + {shards - 1}) div {shards}")
    kept = [F.col(f"row.`{c}`") for c in df.columns if c not in ADDED]
    return ranked.withColumn("shard", shard).select(
        *kept, "curve", F.col("shard").cast("int").alias("shard"), (F.col("rank_in_all") - first).alias("slot")
    )
