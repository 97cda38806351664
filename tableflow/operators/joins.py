"""Equi-joins of two or more tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pairs = Sequence[tuple[str, str]]
SALT = "_salt"
# Rows of a key from which on it is spread over tasks.
HOT = 10_000

# The join kinds of a job form.
KINDS = ("inner", "left", "right", "full")


def check_kind(how: str) -> None:
    if how not in KINDS:
        raise ValueError(f"join kind {how!r}, expected one of {KINDS}")


def condition(on: Pairs) -> Column:
    """Equality of picked left and right columns; frames carry the aliases ``l`` and ``r``."""
    parts = [F.col(f"l.`{left}`") == F.col(f"r.`{right}`") for left, right in on]
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def salted(left: DataFrame, right: DataFrame, on: Pairs, salt: int) -> tuple[DataFrame, DataFrame, list]:
    """Spread every key of ``left`` over ``salt`` tasks and repeat its ``right`` rows for each of them.

    The salt is a hash of the row, so a task that runs again yields the same rows, and it
    depends on no other row, so the state of a stream fits whatever comes later.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salt))
    every = F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))
    return left.withColumn(SALT, part), right.withColumn(SALT, F.explode(every)), [*on, (SALT, SALT)]


def salted_hot(
    left: DataFrame, right: DataFrame, on: Pairs, salt: int, hot: int = HOT
) -> tuple[DataFrame, DataFrame, list]:
    """As ``salted`` on tables, but only keys of ``left`` with ``hot`` rows or more are spread and only their ``right`` rows repeated.

    These keys are at most one in ``hot`` rows, so they are broadcast. Left rows without a key meet nothing and are spread as well.
    """
    keys = [F.col(f"`{a}`") for a, _ in on]
    names = [f"{SALT}_{i}" for i in range(len(on))]
    known = reduce(lambda a, b: a & b, [k.isNotNull() for k in keys])
    many = left.where(known).groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias(SALT))
    many = F.broadcast(many.where(F.col(SALT) >= hot).select(*names, F.lit(True).alias(f"{SALT}_hot")))

    def marked(side: DataFrame, at: int) -> DataFrame:
        match = reduce(lambda a, b: a & b, [F.col(f"s.`{pair[at]}`") == F.col(n) for pair, n in zip(on, names)])
        return side.alias("s").join(many, match, "left").select("s.*", F.coalesce(f"{SALT}_hot", F.lit(False)).alias(f"{SALT}_hot"))

    is_hot, none = F.col(f"{SALT}_hot"), F.lit(0).cast("long")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salt))
    every = F.sequence(none, F.lit(salt - 1).cast("long"))
    spread = marked(left, 0).withColumn(SALT, F.when(is_hot | ~known, part).otherwise(none)).drop(f"{SALT}_hot")
    copies = marked(right, 1).withColumn(SALT, F.explode(F.when(is_hot, every).otherwise(F.array(none)))).drop(f"{SALT}_hot")
    return spread, copies, [*on, (SALT, SALT)]


def join(
    left: DataFrame,
    right: DataFrame,
    on: Pairs,
    how: str = "inner",
    left_columns: Sequence[str] | None = None,
    right_columns: Sequence[str] | None = None,
    salt: int = 1,
    unique: bool = False,
) -> DataFrame:
    """Join on picked columns and keep the picked columns of each side.

    The side with many rows per key goes left. Adaptive execution splits a hot key of the
    left side in inner and left joins, but not in right and full joins: these are run as
    an inner or left join and the right rows without partner. ``salt`` spreads left keys
    with many rows over that many tasks by hand, where adaptive execution is off, at the price of
    a count of the left keys and as many copies of the right rows of these keys. ``unique`` says a key has one left row at most,
    so that there is nothing to split.
    """
    check_kind(how)
    left_columns = list(left.columns if left_columns is None else left_columns)
    right_columns = list(right.columns if right_columns is None else right_columns)
    left = left.select(*dict.fromkeys([*left_columns, *[a for a, _ in on]]))
    right = right.select(*dict.fromkeys([*right_columns, *[b for _, b in on]]))
    picked = [F.col(f"l.`{c}`") for c in left_columns] + [F.col(f"r.`{c}`") for c in right_columns]
    if unique:
        return left.alias("l").join(right.alias("r"), condition(on), how).select(*picked)
    spread, copies, keys = (left, right, on) if salt <= 1 else salted_hot(left, right, on, salt)
    kind = "inner" if how in ("inner", "right") else "left"
    matched = spread.alias("l").join(copies.alias("r"), condition(keys), kind).select(*picked)
    if how in ("inner", "left"):
        return matched
    present = left.select(*[a for a, _ in on]).distinct()
    lonely = right.alias("r").join(present.alias("l"), condition(on), "left_anti")
    nulls = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left_columns]
    return matched.union(lonely.select(*nulls, *[F.col(f"`{c}`") for c in right_columns]))


def join_all(first: DataFrame, joins: Sequence[tuple[DataFrame, Pairs, str]]) -> DataFrame:
    """Chain joins onto ``first``; left column names refer to the columns gathered so far."""
    out = first
    for right, on, how in joins:
        out = join(out, right, on, how)
    return out
