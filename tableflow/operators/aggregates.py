"""Grouped aggregates, and their split into partial and merged form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Aggs = Mapping[str, tuple[str, str]]

# The aggregate functions of a job form.
FUNCTIONS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def check(aggs: Aggs) -> None:
    if not aggs:
        raise ValueError("no aggregate given")
    for alias, (name, column) in aggs.items():
        if not alias:
            raise ValueError("every aggregate needs an alias")
        if name not in FUNCTIONS:
            raise ValueError(f"aggregate {name!r}, expected one of {sorted(FUNCTIONS)}")
        if column == "*" and name != "count":
            raise ValueError(f"{name}(*) is not defined")


def expressions(aggs: Aggs) -> list[Column]:
    check(aggs)
    return [
        FUNCTIONS[name](F.lit(1) if column == "*" else F.col(f"`{column}`")).alias(alias)
        for alias, (name, column) in aggs.items()
    ]


def aggregate(
    df: DataFrame,
    by: Sequence[str | Column],
    aggs: Aggs,
    where: str | Column | None = None,
    having: str | Column | None = None,
) -> DataFrame:
    """``SELECT by, aggs FROM df WHERE where GROUP BY by HAVING having``, on a table or a stream.

    ``aggs`` maps an alias to ``(function, column)``; ``("count", "*")`` counts rows.
    """
    rows = df if where is None else df.where(where)
    out = rows.groupBy(*by).agg(*expressions(aggs))
    return out if having is None else out.where(having)


# The two-step form, for results that are built up from pre-aggregated pieces.


def partial(aggs: Aggs) -> list[Column]:
    """Columns of a piece: an average is kept as its sum and count."""
    check(aggs)
    out = []
    for alias, (name, column) in aggs.items():
        value = F.lit(1) if column == "*" else F.col(f"`{column}`")
        if name == "avg":
            out += [F.sum(value).alias(f"{alias}__sum"), F.count(value).alias(f"{alias}__n")]
        else:
            out.append(FUNCTIONS[name](value).alias(alias))
    return out


def merged(aggs: Aggs) -> list[Column]:
    """Aggregates over pieces that give the aggregates over all their rows."""
    out = []
    for alias, (name, _) in aggs.items():
        if name == "avg":
            total, n = F.sum(f"{alias}__sum"), F.sum(f"{alias}__n")
            out.append(F.when(n > 0, total / n).alias(alias))
        elif name in ("count", "sum"):
            out.append(F.sum(alias).alias(alias))
        else:
            out.append(FUNCTIONS[name](alias).alias(alias))
    return out
