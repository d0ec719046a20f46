"""Connected components by passing on the least name and jumping to a name's own name, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.workers import settled


def least_of_component(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, part): the least id of each node's component. nodes: id; pairs: x, y.

    Every round hooks a node's name to its neighbours' and then replaces it by that name's own name, so rounds grow with the logarithm
    of a component's extent for most shapes. It runs until no name changes, however many rounds that takes; each
    round ends in a written table.
    """
    edges = settled(pairs.select("x", "y").union(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    label = settled(nodes.select("id", F.col("id").alias("part")))
    while True:
        near = edges.join(label, edges["y"] == label["id"]).groupBy("x").agg(F.min("part").alias("low"))
        lower = label.join(near, label["id"] == near["x"], "left").select("id", F.least("part", F.coalesce("low", "part")).alias("part"))
        name = lower.select(F.col("id").alias("part"), F.col("part").alias("own"))
        new = settled(lower.join(name, "part").select("id", F.col("own").alias("part")))
        if new.join(label.withColumnRenamed("part", "old"), "id").where("part <> old").isEmpty():
            return new
        label = new
