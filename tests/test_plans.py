"""Plans stay the ones that scale: no nested loops for pairs, only needed columns read, filters at the scan, one sort a side."""

import re

import pytest
from pyspark.sql import functions as F

from landlace.operators import features
from landlace.operators.spatial_join import join_boxes, nearest
from landlace.plans import record_queries, registry, spatial_queries  # noqa: F401
from landlace.plans.fixtures import part


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["candidate_pairs", "pair_features", "overlap_pairs", "near_miss_pairs", "part_of", "mutual_nn", "knn_anchors", "point_in_parcel", "cover_share", "empty_space"])
def test_no_nested_loops(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_scans_read_what_they_need(spark, sf):
    text = plan(features.candidates(part(spark, sf, "layer_a"), part(spark, sf, "layer_b")).select("a_id", "b_id"))
    assert set(re.findall(r"ReadSchema: (\S+)", text)) == {"struct<p_partkey:bigint>"}
    text = plan(registry.QUERIES["login_lockout"](spark, sf))
    assert "props" not in text and "PushedFilters: [IsNotNull(event_type)" in text or "PushedFilters: [" in text


def test_one_sort_for_each_side(spark, sf):
    a, b = part(spark, sf, "layer_a"), part(spark, sf, "layer_b")
    pairs = features.measured(features.candidates(a, b)).select("a_id", "b_id", "centroid_dist")
    text = plan(features.placed(pairs))
    by_side = [len(re.findall(rf"hashpartitioning\({s}#", text)) for s in ("a_id", "b_id")]
    assert by_side == [1, 1]


def test_pairs_come_once(spark):
    """A pair that shares many cells is kept in one of them."""
    big = spark.createDataFrame([(1, 0.0, 0.0, 900.0, 900.0), (2, 100.0, 100.0, 800.0, 120.0)], "key long, x1 double, y1 double, x2 double, y2 double")
    assert join_boxes(big, big, 30.0).count() == 4


def test_crowded_cells(spark):
    """A third of all points in one place: the join is on cells and leaves the split to Spark."""
    pts = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 10.0).alias("x"), F.lit(1.0).alias("y"))
    got = nearest(pts.withColumnRenamed("key", "p"), "p", pts.where("key < 30").withColumnRenamed("key", "q"), "q", 4.0, k=2)
    assert got.groupBy("a_key").count().where("count > 2").isEmpty() and got.count() > 1900
