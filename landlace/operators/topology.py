"""Topology of one layer: overlaps, near misses, slivers, and the repair of overlaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.functions import boxes
from landlace.operators.spatial_join import self_join_boxes

OVERLAP, SLIVER, THIN, GAP = 0.5, 2.0, 0.08, 0.3


def overlaps(layer: DataFrame, key: str = "id", least: float = OVERLAP) -> DataFrame:
    """Pairs (i < j) of one layer that share more than `least`."""
    pairs = self_join_boxes(layer, key, 0.0).withColumn("overlap", boxes.shared("a_", "b_"))
    return pairs.where(F.col("overlap") > least).select(F.col("a_key").alias("i"), F.col("b_key").alias("j"), "overlap")


def near_misses(layer: DataFrame, key: str = "id", most: float = GAP) -> DataFrame:
    """Pairs (i < j) that don't touch but are at most `most` apart."""
    pairs = self_join_boxes(layer, key, most).withColumn("gap", boxes.distance("a_", "b_"))
    return pairs.where((F.col("gap") > 0) & (F.col("gap") <= most)).select(F.col("a_key").alias("i"), F.col("b_key").alias("j"), "gap")


def slivers(layer: DataFrame, key: str = "id") -> DataFrame:
    """Area, compactness (1 for a circle) and whether a shape is a sliver."""
    x1, y1, x2, y2 = boxes.corners("")
    p = 2 * (x2 - x1) + 2 * (y2 - y1)
    own = layer.select(key, boxes.area().alias("area"), F.when(p > 0, 4 * math.pi * boxes.area() / (p * p)).otherwise(F.lit(0.0)).alias("compactness"))
    return own.withColumn("sliver", (F.col("area") > 0) & ((F.col("area") < SLIVER) | (F.col("compactness") < THIN)))


def report(layer: DataFrame, key: str = "id") -> DataFrame:
    """One row of counts."""
    # one join serves both: pairs that overlap are among those at most GAP apart
    pairs = self_join_boxes(layer, key, GAP).select(boxes.shared("a_", "b_").alias("overlap"), boxes.distance("a_", "b_").alias("gap"))
    over, near = F.col("overlap") > OVERLAP, (F.col("gap") > 0) & (F.col("gap") <= GAP)
    a = pairs.agg(F.count_if(over).alias("overlaps"), F.coalesce(F.sum(F.when(over, F.col("overlap"))), F.lit(0.0)).alias("overlap_area_m2"), F.count_if(near).alias("near_miss_gaps"))
    c = slivers(layer, key).agg(F.count("*").alias("parcels"), F.count_if("sliver").alias("slivers"))
    return a.crossJoin(c)
