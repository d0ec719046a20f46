"""Road reserves from map tags, and shapes that stand in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlace.functions import boxes
from landlace.operators.spatial_join import join_boxes

#: Half widths in metres by class of road.
HALF_WIDTH = {"motorway": 12.0, "trunk": 10.0, "primary": 8.0, "secondary": 6.5, "tertiary": 5.5, "unclassified": 4.0, "residential": 3.5, "living_street": 3.0, "service": 2.5, "pedestrian": 2.5, "footway": 1.0, "path": 1.0, "cycleway": 1.0, "steps": 1.0}
NOT_ROADS = ("footway", "path", "steps", "cycleway", "corridor", "bus_stop", "platform")


def half_width(width: Column, lanes: Column, highway: Column) -> Column:
    """Half of the width if that makes 0.5 to 30 metres, else 1.75 metres for each lane (1 at least), else by class, else 3."""
    first = F.element_at(F.split(F.trim(F.replace(width, F.lit("m"), F.lit(" "))), "\\s+"), 1).try_cast("double") / 2
    by_lanes = F.element_at(F.split(lanes, ";"), 1).try_cast("double") * 3.5 / 2
    known = F.create_map(*[F.lit(x) for kv in HALF_WIDTH.items() for x in kv])
    return F.coalesce(F.when(first.between(0.5, 30), first), F.greatest(F.lit(1.0), by_lanes) + by_lanes * 0, known[highway], F.lit(3.0))


def encroaching(shapes: DataFrame, key: str, reserve: DataFrame, least: float = 5.0, share: float = 0.10) -> DataFrame:
    """Shapes that stand in the reserve (boxes that don't overlap one another) with more than `least` m2 and `share` of their area."""
    pairs = join_boxes(shapes.withColumnRenamed(key, "key"), reserve.withColumn("key", F.lit(0)), 0.0)
    by = pairs.groupBy("a_key", boxes.area("a_").alias("area")).agg(F.sum(boxes.shared("a_", "b_")).alias("overlap"))
    return by.where((F.col("overlap") > least) & (F.col("overlap") / F.col("area") > share)).select(F.col("a_key").alias(key), F.round("overlap", 1).alias("overlap_m2"), F.round(F.col("overlap") / F.col("area"), 3).alias("share"))


def confirmed(flags: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Flags with whether another source's flagged shape meets them."""
    hit = join_boxes(flags.withColumnRenamed(key, "key"), others.withColumn("key", F.lit(0)), 0.0).select(F.col("a_key").alias(key)).distinct().withColumn("confirmed", F.lit(True))
    return flags.join(hit, key, "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
