"""Aggregates over tumbling, sliding and session windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableflow.operators.aggregates import Aggs, expressions, merged, partial


@dataclass(frozen=True)
class Spec:
    kind: str
    size: str
    slide: str | None = None


def tumble(size: str) -> Spec:
    return Spec("tumble", size)


def hop(size: str, slide: str) -> Spec:
    return Spec("hop", size, slide)


def session(gap: str) -> Spec:
    return Spec("session", gap)


def window_agg(
    df: DataFrame,
    time: str,
    spec: Spec,
    by: Sequence[str],
    aggs: Aggs,
    watermark: str | None = None,
) -> DataFrame:
    """One row per window and group: ``window_start, window_end, by..., aggs...``.

    On a stream ``watermark`` is how late a row may come; rows behind it are dropped
    and a window is given out once the watermark has passed its end. The time column
    of a stream must be ``timestamp``.
    """
    if df.isStreaming:
        if watermark is None:
            raise ValueError("windows over a stream need a watermark")
        df = df.withWatermark(time, watermark)
    if spec.kind == "session":
        if not df.isStreaming:
            return _sessions(df, time, spec.size, by, aggs)
        window = F.session_window(time, spec.size)
    else:
        window = F.window(time, spec.size, spec.slide)
    out = df.groupBy(window.alias("_w"), *by).agg(*expressions(aggs))
    picked = [F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")]
    return out.select(*picked, *by, *aggs)


def _sessions(df: DataFrame, time: str, gap: str, by: Sequence[str], aggs: Aggs) -> DataFrame:
    """Sessions of a table, without sorting the raw rows of a group in one task.

    Rows of a group that fall into the same cell of the time axis, one gap wide, are
    less than a gap apart and so belong to one session. They are aggregated per cell
    first, which Spark combines before the shuffle. What is then put in order per group
    is its cells, at most one per gap of the time covered, however many rows it has.
    """
    cells = df.groupBy(*by, F.window(time, gap).alias("_cell")).agg(
        F.min(time).alias("_first"), F.max(time).alias("_last"), *partial(aggs)
    )
    span = F.expr(f"interval {gap}")
    in_order = Window.partitionBy(*by).orderBy("_first")
    previous = F.lag("_last").over(in_order)
    starts = F.when(previous.isNull() | (F.col("_first") > previous + span), 1).otherwise(0)
    numbered = cells.withColumn("_start", starts).withColumn(
        "_session", F.sum("_start").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    # The window has already put each group in one partition; this adds no shuffle.
    out = numbered.groupBy(*by, "_session").agg(
        F.min("_first").alias("window_start"), (F.max("_last") + span).alias("window_end"), *merged(aggs)
    )
    return out.select("window_start", "window_end", *by, *aggs)
