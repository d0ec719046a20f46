"""Measures of axis-parallel boxes (x1, y1, x2, y2) as columns: they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corners(p: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(p: str = "") -> Column:
    x1, y1, x2, y2 = corners(p)
    return (x2 - x1) * (y2 - y1)


def centre(p: str = "") -> tuple[Column, Column]:
    x1, y1, x2, y2 = corners(p)
    return (x1 + x2) / 2, (y1 + y2) / 2


def shared(a: str, b: str) -> Column:
    """Area of the intersection."""
    ax1, ay1, ax2, ay2 = corners(a)
    bx1, by1, bx2, by2 = corners(b)
    zero = F.lit(0.0)
    return F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), zero) * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), zero)


def apart(a: str, b: str) -> tuple[Column, Column]:
    """Distance along either axis; 0 where the boxes overlap."""
    ax1, ay1, ax2, ay2 = corners(a)
    bx1, by1, bx2, by2 = corners(b)
    return F.greatest(bx1 - ax2, ax1 - bx2, F.lit(0.0)), F.greatest(by1 - ay2, ay1 - by2, F.lit(0.0))


def distance(a: str, b: str) -> Column:
    dx, dy = apart(a, b)
    return F.sqrt(dx * dx + dy * dy)


def centre_distance(a: str, b: str) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def with_hausdorff(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Pairs with the largest distance of a corner of either box to the other's outline.

    A corner's distance splits by axis, so the two offsets and two depths of each axis are worked out once, for all corners;
    a corner within the box is as far as the nearest side, any other as far as its offsets make it.
    """
    zero, parts = F.lit(0.0), {}
    for p, q in ((a, b), (b, a)):
        for axis in "xy":
            low, high = F.col(f"{q}{axis}1"), F.col(f"{q}{axis}2")
            for i in "12":
                v = F.col(f"{p}{axis}{i}")
                parts[f"_{p}{axis}{i}_out"] = F.greatest(low - v, v - high, zero)
                parts[f"_{p}{axis}{i}_in"] = F.least(v - low, high - v)
    corners = [(f"_{p}x{i}", f"_{p}y{j}") for p in (a, b) for i in "12" for j in "12"]
    out = lambda c: F.col(f"{c}_out")
    beyond = F.sqrt(F.greatest(*[out(x) * out(x) + out(y) * out(y) for x, y in corners]))
    within = F.greatest(*[F.when((out(x) == 0) & (out(y) == 0), F.least(f"{x}_in", f"{y}_in")).otherwise(zero) for x, y in corners])
    return pairs.withColumns(parts).withColumn(name, F.greatest(beyond, within)).drop(*parts)
