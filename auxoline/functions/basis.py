"""Cubic B-spline basis with one interior knot, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGREE = 3


def bspline(x: Column, lo: Column, mid: Column, hi: Column) -> list[Column]:
    """The four columns left after dropping the first basis function (no intercept).

    Defined on [lo, hi]; null outside it.
    """
    knots = [lo] * (DEGREE + 1) + [mid] + [hi] * (DEGREE + 1)
    inside = x.between(lo, hi)

    def lerp(top: Column, bottom: Column, f: Column) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0)) * f

    last = len(knots) - DEGREE - 2  # last span that is not empty
    level = []
    for i in range(len(knots) - 1):
        upper = (x <= knots[i + 1]) if i == last else (x < knots[i + 1])
        level.append(F.when((x >= knots[i]) & upper & (knots[i] < knots[i + 1]), 1.0).otherwise(0.0))
    for d in range(1, DEGREE + 1):
        level = [
            lerp(x - knots[i], knots[i + d] - knots[i], level[i])
            + lerp(knots[i + d + 1] - x, knots[i + d + 1] - knots[i + 1], level[i + 1])
            for i in range(len(level) - 1)
        ]
    return [F.when(inside, b) for b in level[1:]]
