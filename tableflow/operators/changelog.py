"""Aggregates and joins over change feeds, on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tableflow.operators.aggregates import Aggs, aggregate
from tableflow.operators.joins import Pairs, join
from tableflow.sources.changes import live


def changelog_agg(
    changes: DataFrame, keys: Sequence[str], seq: Sequence[str], by: Sequence[str], aggs: Aggs, op: str = "op"
) -> DataFrame:
    """Aggregate over the rows a change feed leaves behind."""
    return aggregate(live(changes, keys, seq, op), by, aggs)


def changelog_join(
    left: DataFrame,
    right: DataFrame,
    on: Pairs,
    how: str,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    left_seq: Sequence[str],
    right_seq: Sequence[str],
    left_columns: Sequence[str] | None = None,
    right_columns: Sequence[str] | None = None,
    op: str = "op",
) -> DataFrame:
    """Join of the rows two change feeds leave behind."""
    rows = live(left, left_keys, left_seq, op), live(right, right_keys, right_seq, op)
    unique = set(left_keys) <= {a for a, _ in on}
    return join(*rows, on, how, left_columns, right_columns, unique=unique)
