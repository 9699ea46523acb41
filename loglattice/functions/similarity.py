"""Sequence similarity of two array columns, inside code-generated expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays.

    The dynamic programme keeps one row: a fold over ``a`` whose state is the row of best
    lengths against every prefix of ``b``.
    """
    start = F.transform(F.concat(F.array(F.lit(0)), F.transform(b, lambda _: F.lit(0))), lambda z: z)

    def next_row(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda done, j: F.concat(
                done,
                F.array(
                    F.when(F.element_at(b, j) == x, F.element_at(row, j) + 1).otherwise(
                        F.greatest(F.element_at(done, -1), F.element_at(row, j + 1))
                    )
                ),
            ),
        )

    best = F.element_at(F.aggregate(a, start, next_row), -1)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(best)


def lcs_similarity(a: Column, b: Column) -> Column:
    """LCS length over the geometric mean of the lengths; null for an empty sequence."""
    area = F.size(a).cast("double") * F.size(b).cast("double")
    return F.try_divide(lcs_length(a, b).cast("double"), F.sqrt(area))


def ngrams(a: Column, n: int, pad: int = -1) -> Column:
    """The n-wide grams of ``a`` padded with n - 1 copies of ``pad`` on both sides."""
    side = F.array_repeat(F.lit(pad), n - 1)
    padded = F.concat(side, a, side) if n > 1 else a
    starts = F.sequence(F.lit(1), F.size(a) + F.lit(n - 1))
    return F.when(F.size(a) > 0, F.transform(starts, lambda i: F.slice(padded, i, F.lit(n))))
