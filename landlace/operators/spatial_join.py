"""Spatial joins as equi-joins on grid cells.

A distance join left to the optimiser is a nested loop. Here both sides are dealt to the cells they touch and joined on the
cell, which is a hash or sort-merge join that Spark can split where a cell is crowded. A pair that shares several
cells is kept in one of them alone, the cell of a reference point, so nothing has to be made distinct.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlace.functions import boxes
from landlace.workers import settled

CELL = 64.0


def _cells(x1: Column, y1: Column, x2: Column, y2: Column, cell: float) -> Column:
    side = lambda a, z: F.sequence(F.floor(a / cell), F.floor(z / cell))
    return F.explode(F.flatten(F.transform(side(x1, x2), lambda i: F.transform(side(y1, y2), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def join_boxes(a: DataFrame, b: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """All pairs of boxes at most `radius` apart. Both sides have x1, y1, x2, y2; columns come out as a_* and b_*.

    Neither side is broadcast, whatever its estimate: that is by the bytes of compressed files, and knows nothing of the copies for cells.
    """
    cell = cell or max(CELL, 2 * radius + 4)
    a = a.select(*[F.col(c).alias(f"a_{c.removeprefix('a_')}") for c in a.columns])
    b = b.select(*[F.col(c).alias(f"b_{c.removeprefix('b_')}") for c in b.columns])
    ax1, ay1, ax2, ay2 = boxes.corners("a_")
    bx1, by1, bx2, by2 = boxes.corners("b_")
    a = a.withColumn("cell", _cells(ax1 - radius, ay1 - radius, ax2 + radius, ay2 + radius, cell))
    b = b.withColumn("cell", _cells(bx1, by1, bx2, by2, cell))
    dx, dy = boxes.apart("a_", "b_")
    home = (F.col("cell.i") == F.floor(F.greatest(ax1 - radius, bx1) / cell)) & (F.col("cell.j") == F.floor(F.greatest(ay1 - radius, by1) / cell))
    near = (dx * dx + dy * dy) <= radius * radius
    return a.join(b.hint("merge"), "cell").where(home & near).drop("cell")


def self_join_boxes(a: DataFrame, key: str, radius: float) -> DataFrame:
    """Pairs of one layer at most `radius` apart, each once, the smaller key as a."""
    return join_boxes(a.withColumnRenamed(key, "key"), a.withColumnRenamed(key, "key"), radius).where("a_key < b_key")


def as_boxes(points: DataFrame, x: str, y: str) -> DataFrame:
    """Points as boxes without extent."""
    return points.withColumns({"x1": F.col(x), "y1": F.col(y), "x2": F.col(x), "y2": F.col(y)})


def within(points: DataFrame, point_key: str, to: DataFrame, to_key: str, radius: float, strict: bool = False) -> DataFrame:
    """Pairs of points within the radius (strict: closer): a_key, a_x, a_y, b_key, b_x, b_y and whatever else the sides have, dist."""
    pairs = join_boxes(as_boxes(points.withColumnRenamed(point_key, "key"), "x", "y"), as_boxes(to.withColumnRenamed(to_key, "key"), "x", "y"), radius, cell=max(1.0, float(math.ceil(radius))))
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    pairs = pairs.withColumn("dist", F.sqrt(dx * dx + dy * dy))
    return pairs.where(F.col("dist") < radius) if strict else pairs


def nearest(points: DataFrame, point_key: str, to: DataFrame, to_key: str, radius: float, k: int = 1, strict: bool = False) -> DataFrame:
    """The k nearest of `to` for each point within the radius: a_<point>, b_<to>, dist, place. Both sides have x and y.

    A radius bounds the search, so this stays an equi-join on cells; ties go to the smaller key of `to`.
    """
    pairs = within(points, point_key, to, to_key, radius, strict)
    place = F.row_number().over(Window.partitionBy("a_key").orderBy("dist", "b_key"))
    return pairs.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def nearest_growing(points: DataFrame, point_key: str, to: DataFrame, to_key: str, radius: float, k: int, first: float) -> DataFrame:
    """As nearest with a strict radius, for a k that a much smaller circle mostly holds: points that find k within `first` are done,
    as all nearer ones lie there too, and only the others look further."""
    points, to = settled(points), settled(to)
    near = settled(nearest(points, point_key, to, to_key, first, k).where(F.col("dist") < radius))
    full = near.where(F.col("place") == k).select("a_key")
    rest = points.join(full.hint("merge"), points[point_key] == full["a_key"], "left_anti")
    return near.join(full.hint("merge"), "a_key", "left_semi").unionByName(nearest(rest, point_key, to, to_key, radius, k, strict=True))


def nearest_summed(points: DataFrame, point_key: str, to: DataFrame, to_key: str, radius: float, k: int, first: float, sums: dict[str, Column]) -> DataFrame:
    """One row for each point that has any of `to` closer than the radius: a_<point>, n of its k nearest, and the sums of those. Searched as
    nearest_growing does, but what the first circle leaves is written as a row a point, not a row a neighbour. Both sides are read twice."""
    summed = lambda df, reach: nearest(df, point_key, to, to_key, reach, k, strict=True).groupBy("a_key").agg(F.count("*").alias("n"), *[v.alias(c) for c, v in sums.items()])
    full = settled(summed(points, min(first, radius)).where(F.col("n") == k))
    rest = points.join(full.select("a_key").hint("merge"), points[point_key] == full["a_key"], "left_anti")
    return full.unionByName(summed(rest, radius))


def mutual_nearest(a: DataFrame, a_key: str, b: DataFrame, b_key: str, max_d: float) -> DataFrame:
    """Pairs that are each other's nearest, closer than max_d. A nearer rival would lie within max_d too, so the bound loses nothing;
    one join serves both directions."""
    place = lambda of, to: F.row_number().over(Window.partitionBy(of).orderBy("dist", to))
    pairs = within(a, a_key, b, b_key, max_d, strict=True).select("a_key", "b_key", "dist", "a_x", "a_y", "b_x", "b_y")
    both = pairs.withColumn("forth", place("a_key", "b_key")).withColumn("back", place("b_key", "a_key")).where("forth = 1 and back = 1")
    return both.select(F.col("a_key").alias(a_key), F.col("b_key").alias(b_key), "dist", "a_x", "a_y", "b_x", "b_y")


def cover(a: DataFrame, a_key: str, b: DataFrame) -> DataFrame:
    """Share of each box of `a` that boxes of `b`, which don't overlap one another, cover."""
    own = a.withColumnRenamed(a_key, "key")
    pairs = join_boxes(own, b.withColumn("key", F.lit(0)), 0.0).withColumn("inter", boxes.shared("a_", "b_"))
    by = pairs.groupBy("a_key").agg(F.sum("inter").alias("covered"))
    whole = a.select(F.col(a_key), boxes.area().alias("area"))
    return whole.join(by.hint("merge"), whole[a_key] == by["a_key"], "left").select(a_key, (F.coalesce("covered", F.lit(0.0)) / F.col("area")).alias("share"))
