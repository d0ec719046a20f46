"""Co-registration: a local shift field that moves one layer onto another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlace.functions import boxes
from landlace.operators import polygons
from landlace.operators.spatial_join import mutual_nearest, nearest_summed
from landlace.workers import settled


def centres(layer: DataFrame, key: str) -> DataFrame:
    """Centroids of the polygons where the layer has them (geom), else centres of its boxes."""
    if "geom" in layer.columns:
        return layer.select(key, polygons.centroid(F.col("geom")).alias("c")).select(key, "c.x", "c.y")
    x, y = boxes.centre()
    return layer.select(key, x.alias("x"), y.alias("y"))


def median(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def anchors(a: DataFrame, b: DataFrame, max_d: float = 15.0) -> DataFrame:
    """Mutual nearest centres closer than max_d, with the offset of b from a."""
    return _matched(_placed(a, "a_id"), _placed(b, "b_id"), max_d)


def _placed(layer: DataFrame, key: str) -> DataFrame:
    """Its centres; centroids of polygons are worked out once, in as many tasks as shuffles have."""
    return settled(centres(layer.repartition(key), key)) if "geom" in layer.columns else centres(layer, key)


def _matched(a: DataFrame, b: DataFrame, max_d: float) -> DataFrame:
    pairs = mutual_nearest(a, "a_id", b, "b_id", max_d)
    return pairs.select("a_id", "b_id", "dist", (F.col("b_x") - F.col("a_x")).alias("dx"), (F.col("b_y") - F.col("a_y")).alias("dy"), "a_x", "a_y")


def global_shift(found: DataFrame) -> DataFrame:
    """One row: number of anchors and median offset."""
    return found.agg(F.count("*").alias("anchors"), median("dx").alias("gx"), median("dy").alias("gy"))


def local_shift(b: DataFrame, found: DataFrame, k: int = 25, radius: float = 250.0, least: int = 5) -> DataFrame:
    """(b_id, sx, sy): median offset of the k nearest anchors of each shape, or the global one where fewer than `least` are in reach.

    b: b_id, x, y of the shapes as moved so far.
    """
    return _own_shift(settled(b.select("b_id", "x", "y")), settled(found), k, radius, least)


def _own_shift(b: DataFrame, found: DataFrame, k: int, radius: float, least: int) -> DataFrame:
    """local_shift of tables that may be read several times."""
    to = found.select("a_id", F.col("a_x").alias("x"), F.col("a_y").alias("y"), "dx", "dy")
    own = nearest_summed(b, "b_id", to, "a_id", radius, k, radius * 0.4, {"mx": median("b_dx"), "my": median("b_dy")})
    whole = F.broadcast(global_shift(found))  # one row
    joined = b.select("b_id").join(own.hint("merge"), F.col("b_id") == F.col("a_key"), "left").crossJoin(whole)
    enough = F.coalesce("n", F.lit(0)) >= least
    return joined.select("b_id", F.coalesce("n", F.lit(0)).alias("n_anchors"), F.when(enough, F.col("mx")).otherwise(F.col("gx")).alias("sx"), F.when(enough, F.col("my")).otherwise(F.col("gy")).alias("sy"))


def moved(b: DataFrame, shift: DataFrame) -> DataFrame:
    """The layer with each shape taken back by its own shift."""
    if "geom" in b.columns:
        move = lambda ring: F.transform(ring, lambda p: F.struct((p["x"] - F.coalesce("sx", F.lit(0.0))).alias("x"), (p["y"] - F.coalesce("sy", F.lit(0.0))).alias("y")))
        return b.join(shift.select("b_id", "sx", "sy").hint("merge"), "b_id", "left").withColumn("geom", F.transform("geom", move)).drop("sx", "sy")
    back = {f"{c}{i}": F.col(f"{c}{i}") - F.coalesce(f"s{c}", F.lit(0.0)) for c in "xy" for i in "12"}
    return b.join(shift.select("b_id", "sx", "sy").hint("merge"), "b_id", "left").withColumns(back).drop("sx", "sy")


def estimate(a: DataFrame, b: DataFrame, max_d: float = 15.0, iou_min: float = 0.4, k: int = 25, radius: float = 250.0, rounds: int = 2, least: int = 10, folder: str | None = None) -> DataFrame:
    """(b_id, sx, sy) after `rounds` rounds: rough anchors give a global shift, anchors that overlap well the local ones.

    Each round's moved layer, anchors and shift are written tables; with fewer than `least` anchors the shift stays as it is (zero at first).
    """
    at_a, raw = _placed(a, "a_id"), _placed(b, "b_id")
    one = global_shift(_matched(at_a, raw, max_d)).first()
    zero = F.lit(0.0)
    if one["anchors"] < least:
        return b.select("b_id", zero.alias("sx"), zero.alias("sy"))
    shift = b.select("b_id", F.lit(one["gx"]).alias("sx"), F.lit(one["gy"]).alias("sy"))
    if "geom" in b.columns:
        start = b.join(raw.select("b_id", F.col("x").alias("raw_x"), F.col("y").alias("raw_y")).hint("merge"), "b_id", "left")
    else:
        start = b.withColumns(dict(zip(("raw_x", "raw_y"), boxes.centre(), strict=True)))
    for _ in range(rounds):
        now = settled(moved(start, shift))
        at = _placed(now, "b_id")
        pairs = _matched(at_a, at, max_d).select("a_id", "b_id", "a_x", "a_y")  # dealt by b_id, so the moved layer comes first
        if "geom" in a.columns:
            both = pairs.join(now.select("b_id", F.col("geom").alias("gb"), "raw_x", "raw_y").hint("merge"), "b_id").join(a.select("a_id", F.col("geom").alias("ga")).hint("merge"), "a_id").withColumns({"aa": polygons.area(F.col("ga")), "ab": polygons.area(F.col("gb"))})
            inter, area_a, area_b = polygons.shared(F.col("ga"), F.col("gb")), F.col("aa"), F.col("ab")
        else:
            sides = lambda df, k, *more: df.select(f"{k}_id", *[F.col(c).alias(f"{k}_{c}") for c in ("x1", "y1", "x2", "y2")], *more)
            both = pairs.join(sides(now, "b", "raw_x", "raw_y").hint("merge"), "b_id").join(sides(a, "a").hint("merge"), "a_id")
            inter, area_a, area_b = boxes.shared("a_", "b_"), boxes.area("a_"), boxes.area("b_")
        both = both.withColumn("inter", inter)
        good = both.where(F.col("inter") / (area_a + area_b - F.col("inter")) >= iou_min)
        found = settled(good.select("a_id", "b_id", "a_x", "a_y", (F.col("raw_x") - F.col("a_x")).alias("dx"), (F.col("raw_y") - F.col("a_y")).alias("dy")))
        if found.count() < least:
            break
        shift = settled(_own_shift(at, found, k, radius, 5).select("b_id", "sx", "sy"))
    return shift


def report(a: DataFrame, b: DataFrame, shift: DataFrame, max_d: float = 15.0) -> DataFrame:
    """One row: shift magnitudes, and the anchors' median offset before and after."""
    size = shift.agg(*[f(F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))).alias(n) for f, n in ((F.min, "shift_min"), (median, "shift_median"), (F.max, "shift_max"))])
    found = anchors(a, moved(b, shift), max_d).select("b_id", F.col("dist").alias("after"), "dx", "dy").join(shift.hint("merge"), "b_id")
    before = F.sqrt((F.col("dx") + F.col("sx")) * (F.col("dx") + F.col("sx")) + (F.col("dy") + F.col("sy")) * (F.col("dy") + F.col("sy")))
    return size.crossJoin(found.agg(F.count("*").alias("anchors"), median(before).alias("offset_before"), median("after").alias("offset_after")))
