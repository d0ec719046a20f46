"""What larger tables bring: layers that no estimate may broadcast, zones of mixed pixels, places over the pole."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from landlace.functions import projection
from landlace.operators import raster
from landlace.plans import polygon_queries, registry, spatial_queries  # noqa: F401


def test_round_trip_over_the_pole(spark):
    lats = [0.0, 12.5, 89.9999, 89.99999, 90.0, 90.00001, 90.005, 106.1, 170.0, -89.99999, -90.005, -106.1]
    df = spark.createDataFrame([(79.1, v) for v in lats] + [(81.0, v) for v in lats], "lon double, lat double")
    e, n = projection.utm(F.col("lon"), F.col("lat"), 44)
    df = df.withColumns({"e": e, "n": n})
    lon, lat = projection.from_utm(F.col("e"), F.col("n"), 44)
    rows = df.select("lat", lon.alias("x"), lat.alias("y"), projection.apart((lon, lat), (F.col("lon"), F.col("lat"))).alias("off")).collect()
    assert all(r.off < 1e-4 and abs(r.x) <= 180 and abs(r.y) <= 90 for r in rows)
    assert all(abs(r.y - (180 - r.lat)) < 1e-9 and r.x < -90 for r in rows if r.lat in (106.1, 170.0))


def test_zones_of_mixed_pixels(spark):
    """Means that have no end as decimals; medians between two values, at the decimals' scale and as doubles."""
    rows = "values (0, 0, 0.75, 0.0625, 6.0, 3.0), (0, 1, 0.0625, 0.0625, 3.0, 6.5), (0, 2, 0.0625, 0.8125, 3.0, 3.0), (1, 0, 0.0625, 0.0625, 3.0, 3.0), (1, 1, 0.0625, 0.0625, 6.2, 6.5) as t(r, q, p0, p1, h0, h1)"
    pixels = spark.sql(f"select * from {rows}")
    got = {r.zone: r for r in raster.zonal(pixels, pixels.selectExpr("r as zone", "r", "q")).collect()}
    assert (got[0].n, got[0].mean_p0, got[0].mean_p1, got[0].h0, got[0].h1) == (3, 0.875 / 3, 0.9375 / 3, 3.0, 3.0)
    assert (got[1].n, got[1].h0, got[1].h1) == (2, 4.6, 4.7)
    doubles = pixels.select("r", "q", *[F.col(c).cast("double").alias(c) for c in ("p0", "p1", "h0", "h1")])
    assert raster.zonal(doubles, doubles.selectExpr("r as zone", "r", "q")).where("zone = 1").first().h1 == 4.75


@pytest.mark.parametrize("name", ["centroid_anchors", "consensus_counts", "global_shift", "knn_anchors", "local_shift", "mutual_nn", "polygon_features", "polygon_part_of", "road_encroachment", "shift_field", "turned_pairs", "union_cover"])
def test_no_layer_is_broadcast(spark, sf, name, monkeypatch):
    """Not in the query's plan, nor in those of the tables it writes; only a row is."""
    plans, write = [], DataFrameWriter.parquet
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plans.append(plan(self._df)), write(self, *a, **b))[1])
    plans.append(plan(registry.QUERIES[name](spark, sf)))
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
