"""Hilbert index of points on a grid, as a column and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _bit(value: Column, mask: Column) -> Column:
    return value.bitwiseAND(mask) != 0


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place of a grid point on the Hilbert curve through all points with ``bits`` bits per axis.

    ``axes`` are longs from 0 to 2**bits - 1. The curve is walked down one bit and axis per
    step: each step reflects or swaps the lower bits of the first axis. Null where an axis is null.
    """
    n = len(axes)
    zero = F.lit(0).cast("long")
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)])

    def turned(point: Column, step: Column) -> Column:
        mask = F.element_at(masks, (F.floor(step / n) + 1).cast("int"))
        below, axis = mask - 1, (step % n).cast("int")
        here, head = F.element_at(point, axis + 1), F.element_at(point, 1)
        swap = F.when(_bit(here, mask), zero).otherwise(head.bitwiseXOR(here).bitwiseAND(below))
        flip = F.when(_bit(here, mask), below).otherwise(swap)
        return F.transform(
            point,
            lambda v, i: v.bitwiseXOR(F.when(i == 0, flip).otherwise(F.when(i == axis, swap).otherwise(zero))),
        )

    steps = F.sequence(F.lit(0), F.lit(n * bits - 1))
    point = F.aggregate(steps, F.array(*[a.cast("long") for a in axes]), turned)

    # Gray code: each axis with all before it, then the bits that the last axis sets.
    def gray(values: Column) -> Column:
        return F.transform(
            values, lambda _, i: F.aggregate(F.slice(values, F.lit(1), i + 1), zero, lambda a, v: a.bitwiseXOR(v))
        )

    def fixed(values: Column) -> Column:
        last = F.element_at(values, n)
        turn = F.aggregate(masks, zero, lambda a, m: F.when(_bit(last, m), a.bitwiseXOR(m - 1)).otherwise(a))
        return F.transform(values, lambda v: v.bitwiseXOR(turn))

    # One bit of each axis after the other, from the highest on.
    def woven(values: Column) -> Column:
        return F.aggregate(
            F.flatten(F.transform(masks, lambda m: F.transform(values, lambda v: F.when(_bit(v, m), 1).otherwise(0)))),
            zero,
            lambda a, b: a * 2 + b,
        )

    def chain(value: Column, *steps) -> Column:
        """Each step on the result of the one before, which is worked out once."""
        for step in steps:
            value = F.element_at(F.transform(F.array(value), step), 1)
        return value

    nothing = F.greatest(*[a.isNull().cast("int") for a in axes]) == 1 if n > 1 else axes[0].isNull()
    return F.when(nothing, F.lit(None).cast("long")).otherwise(chain(point, gray, fixed, woven))


def hilbert_numbers(points: np.ndarray, bits: int) -> np.ndarray:
    """The same index for an array with one grid point per row."""
    axes = [column.astype(np.int64) for column in points.T]
    n = len(axes)
    for b in range(bits - 1, -1, -1):
        mask, below = 1 << b, (1 << b) - 1
        for i in range(n):
            here = (axes[i] & mask) != 0
            swap = np.where(here, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = axes[0] ^ np.where(here, below, swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, n):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] & (1 << b), (1 << b) - 1, 0)
    out = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            out = (out << 1) | (((axis ^ turn) >> b) & 1)
    return out
