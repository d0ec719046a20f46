"""Generators keep their promises; whole runs beat plain overlap."""

import json

import pytest
from pyspark.sql import functions as F

from landlace.functions import kernel
from landlace.operators import generate, harmonise, learn, polygons
from landlace.plans import lifecycle
from landlace.sources import layers
from landlace.workers import settled


@pytest.fixture(scope="module")
def layer(spark):
    s = layers.synthetic(spark, 400, seed=3)
    return settled(s.select(F.substring("id", 2, 9).cast("long").alias("a_id"), "owner", "geom"))


@pytest.fixture(scope="module")
def trial(layer):
    t = generate.trial(layer, 5)
    return generate.Trial(settled(t.a), settled(t.b), settled(t.truth))


def test_trial_invariants(trial, layer):
    a = {r["a_id"]: r["error_type"] for r in trial.a.collect()}
    b = {r["b_id"]: r["error_type"] for r in trial.b.collect()}
    truth = [(r["a_id"], r["b_id"]) for r in trial.truth.collect()]
    assert len(a) == layer.count() and len(truth) == len(set(truth))
    by_a, by_b = {}, {}
    for x, y in truth:
        assert x in a and y in b
        by_a.setdefault(x, []).append(y)
        by_b.setdefault(y, []).append(x)
    assert all(x not in by_a for x, k in a.items() if k == "missing")
    assert all(len(by_a[x]) == 2 for x, k in a.items() if k == "split")
    assert all(len(by_b[y]) == 2 for y, k in b.items() if k == "merge") and "merge" in b.values()
    assert all(y not in by_b for y, k in b.items() if k == "spurious") and "spurious" in b.values()
    assert set(a.values()) >= {"clean", "offset", "scale", "split", "missing"}


def test_trial_repeats(trial, layer):
    again = generate.trial(layer, 5)
    assert sorted(map(str, again.truth.collect())) == sorted(map(str, trial.truth.collect()))
    assert generate.trial(layer, 6).truth.exceptAll(trial.truth).count() > 0
    changed = trial.b.join(trial.truth, "b_id").join(layer.select("a_id", F.col("owner").alias("o")), "a_id").where("owner <> o").count()
    assert 0.15 < changed / trial.b.count() < 0.55


def test_split_keeps_area(trial, layer):
    halves = trial.b.where("error_type = 'split'").join(trial.truth.select("a_id", "b_id"), "b_id").groupBy("a_id").agg(F.sum(polygons.area(F.col("geom"))).alias("half"))
    for r in halves.join(layer.select("a_id", polygons.area(F.col("geom")).alias("whole")), "a_id").collect():
        assert r["half"] == pytest.approx(r["whole"], rel=1e-6)


def test_defects(layer):
    bad = generate.defects(layer, "a_id", 0.3)
    share = bad.agg(F.avg(F.col("defect").cast("int"))).first()[0]
    assert 0.2 < share < 0.4
    for r in bad.limit(80).collect():
        assert r["defect"] or kernel.valid(polygons.rings(r["geom"]))


def test_registers(trial):
    uses = settled(generate.land_use(trial.a))
    revenue = settled(generate.revenue_register(trial, uses, conflicts=0.1))
    tax = settled(generate.tax_register(trial.a, uses, conflicts=0.1))
    assert revenue.count() == trial.b.count() and revenue.where("classfn is null or extent <= 0").isEmpty()
    one = trial.truth.join(trial.a.where("error_type = 'clean'").select("a_id", polygons.area(F.col("geom")).alias("m2")), "a_id").join(revenue.where("not bad_area"), "b_id")
    unit = harmonise.area_unit(one, "extent", "m2").first()
    assert unit["unit"] == "cent" and unit["relative_error"] < 0.02
    env = polygons.enveloped(uses)
    points = harmonise.join_points(tax, "tax_id", env.select("a_id", "x1", "y1", "x2", "y2"), "a_id").join(tax, "tax_id")
    assert points.where("a_id = a_true").count() > 0.9 * tax.count()
    links = trial.truth.where("error_type <> 'merge'").select("a_id", "b_id").withColumn("p", F.lit(0.9))
    rec = harmonise.harmonise(env, links, revenue, points)
    assert rec.count() == trial.a.count()
    found = rec.select(F.col("parcel_id").alias("a_id"), F.explode(F.split("conflicts", ";")).alias("type")).where("type = 'land_use'").select("a_id")
    made = links.join(revenue.where("bad_land_use"), "b_id").select("a_id").union(points.where("bad_land_use").select("a_id")).distinct()
    assert made.join(found, "a_id", "left_semi").count() > 0.8 * made.count()


def test_later_date(layer):
    now, truth = generate.later(layer)
    kinds = {r["change"]: r["count"] for r in truth.groupBy("change").count().collect()}
    assert set(kinds) == {"demolished", "altered", "unchanged", "new"} and kinds["new"] == 20
    assert now.count() == truth.where("later_id is not null").count()


def test_benchmark_beats_overlap(spark, layer):
    m, out = lifecycle.benchmark(layer.where("a_id < 260"), rounds=8, target=0.95)
    got = {r["method"]: r for r in out.collect()}
    assert got["classifier"]["auto_f1"] > got["overlap"]["auto_f1"]
    assert got["classifier"]["auto_precision"] > 0.85
    geometry = learn.Matcher(m.trees, m.columns, m.cal_x, m.cal_y, m.t_low, m.t_high)
    assert set(geometry.columns) >= {"name_sort", "name_set", "iou"}


def test_upload(spark, tmp_path):
    base = layers.synthetic(spark, 120, seed=9)
    rings = base.select(F.transform(F.element_at("geom", 1), lambda p: F.array(p["x"], p["y"])).alias("r")).collect()
    for name, dx in (("a", 0.0), ("b", 3.0)):
        doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:32644"}}, "features": [
            {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[x + dx, y] for x, y in [*r["r"], r["r"][0]]]]}} for r in rings]}
        (tmp_path / f"{name}.geojson").write_text(json.dumps(doc))
    t = generate.trial(base.select(F.substring("id", 2, 9).cast("long").alias("a_id"), "owner", "geom"), 2)
    rows = lifecycle.training(generate.Trial(settled(t.a), settled(t.b), settled(t.truth)))
    m = learn.fit(rows, rows, rounds=4, depth=3, target=0.95)
    found, a, b = lifecycle.upload(spark, str(tmp_path / "a.geojson"), str(tmp_path / "b.geojson"), m)
    assert found.shift.agg(F.median("sx")).first()[0] == pytest.approx(3, abs=0.5)
    assert a.where("status = 'matched'").count() >= 0.9 * 120 and b.count() == 120
    assert found.description.first()["auto_links"] >= 0.9 * 120
