"""One-to-many relations between two layers, and their description."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landlace.functions import boxes
from landlace.operators.spatial_join import join_boxes
from landlace.workers import settled

SHARE, RATIO = 0.6, 1.8


def part_of(small: DataFrame, small_key: str, big: DataFrame, big_key: str, linked: DataFrame | None = None) -> DataFrame:
    """(small, big, share) for shapes that lie mostly in one much larger shape; the largest share wins, then the smaller key.

    linked: keys of `small` that have a link already and are left out before the join.
    """
    if linked is not None:
        small = small.join(linked.select(small_key).hint("merge"), small_key, "left_anti")
    pairs = join_boxes(small.withColumnRenamed(small_key, "key"), big.withColumnRenamed(big_key, "key"), 0.0)
    share = boxes.shared("a_", "b_") / boxes.area("a_")
    ok = pairs.withColumn("share", share).where((F.col("share") >= SHARE) & (boxes.area("b_") >= RATIO * boxes.area("a_")))
    best = F.min_by(F.struct("b_key", "share"), F.struct(-F.col("share"), F.col("b_key")))
    return ok.groupBy("a_key").agg(best.alias("best")).select(F.col("a_key").alias(small_key), F.col("best.b_key").alias(big_key), "best.share")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Accepted pairs whose parcels have no other accepted one, on either side."""
    acc = pairs.where("bucket = 'accept'")
    n = lambda c: F.count("*").over(Window.partitionBy(c))
    return acc.withColumn("na", n("a_id")).withColumn("nb", n("b_id")).where("na = 1 and nb = 1").drop("na", "nb")


def covering(parts: DataFrame, big_key: str, least: int = 2) -> DataFrame:
    """Large shapes that take in several small ones."""
    return parts.groupBy(big_key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def describe(pairs: DataFrame, a: DataFrame, b: DataFrame, part_of: Callable = part_of) -> DataFrame:
    """One row on a pair of layers: links, counterparts, relations, offsets. pairs: a_id, b_id, bucket, centroid_dist, iou, area_ratio.

    The pairs and the relations each are joined once and then read several times from a checkpoint. part_of: polygons.part_of for
    layers of polygons.
    """
    pairs = settled(pairs.select("a_id", "b_id", "bucket", "centroid_dist", "iou", "area_ratio"))
    hit = pairs.where("bucket <> 'reject'")
    a_hit, b_hit = hit.select("a_id").distinct(), hit.select("b_id").distinct()
    a_in_b, b_in_a = settled(part_of(a, "a_id", b, "b_id", a_hit)), settled(part_of(b, "b_id", a, "a_id", b_hit))
    a_any = a_hit.union(a_in_b.select("a_id")).union(b_in_a.select("a_id")).distinct()
    b_any = b_hit.union(b_in_a.select("b_id")).union(a_in_b.select("b_id")).distinct()
    one = one_to_one(pairs).agg(
        F.count("*").alias("one_to_one"), F.percentile("centroid_dist", F.lit(0.5)).alias("median_offset_m"), F.percentile("centroid_dist", F.lit(0.9)).alias("p90_offset_m"),
        F.percentile("iou", F.lit(0.5)).alias("median_iou"), F.percentile("area_ratio", F.lit(0.5)).alias("median_area_ratio"),
    )
    links = pairs.agg(F.count("*").alias("candidates"), F.count_if(F.col("bucket") == "accept").alias("auto_links"), F.count_if(F.col("bucket") == "review").alias("review_links"))
    counted = {
        "n_a": a, "n_b": b, "a_any": a_any, "b_any": b_any, "a_inside_larger_b": a_in_b, "b_inside_larger_a": b_in_a,
        "b_polygons_covering_several_a": covering(a_in_b, "b_id"), "a_polygons_covering_several_b": covering(b_in_a, "a_id"),
    }
    rows = reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counted.items()])
    out = links.crossJoin(one).crossJoin(rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counted]))  # one row each
    share = lambda n, d: F.col(n) / F.greatest(F.col(d), F.lit(1))
    return out.withColumns({"a_with_counterpart": share("a_any", "n_a"), "b_with_counterpart": share("b_any", "n_b"), "a_only": F.col("n_a") - F.col("a_any"), "b_only": F.col("n_b") - F.col("b_any")}).drop("a_any", "b_any")


#: Which status of a shape counts when it has several, by screen.
PRECEDENCE = {
    "synthetic": ("review", "auto", "unmatched"), "review_screen": ("auto", "review", "unmatched"),
    "real": ("matched", "uncertain", "part_of_larger", "covers_several", "unmatched"), "upload": ("matched", "review", "part_of_larger", "covers_several", "unmatched"),
}


def status(shapes: DataFrame, key: str, found: DataFrame, screen: str) -> DataFrame:
    """(key, status): the first of the screen's order among what was found (key, status); unmatched if nothing was."""
    order = PRECEDENCE[screen]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    best = found.groupBy(key).agg(F.min_by("status", rank).alias("status"))
    return shapes.select(key).join(best, key, "left").select(key, F.coalesce("status", F.lit("unmatched")).alias("status"))


def consensus(found: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """How many shapes are seen by 1, 2, ... sources; found: (key, source) for what each other source sees."""
    seen = found.select(key, "source").distinct().groupBy(key).agg(F.count("*").alias("others"))
    return shapes.select(key).join(seen.hint("merge"), key, "left").select((F.coalesce("others", F.lit(0)) + 1).alias("n_sources")).groupBy("n_sources").agg(F.count("*").alias("n"))
