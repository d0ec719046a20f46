"""Unit cases and properties of the operators."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landlace.functions import kernel, names, projection, strings
from landlace.operators import audit, changes, coreg, estimates, features, learn, polygons, raster, schema_match, topology
from landlace.plans.fixtures import part


def box(x1, y1, x2, y2):
    return [np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], float)]


def ell(x, y, w, d, turn):
    p = np.array([(0, 0), (w, 0), (w, d * 0.55), (w * 0.55, d * 0.55), (w * 0.55, d), (0, d)], float)
    c, s = math.cos(turn), math.sin(turn)
    return [p @ np.array([[c, s], [-s, c]]) + [x, y]]


shape = st.builds(ell, st.floats(350000, 350012), st.floats(1445000, 1445012), st.floats(6, 20), st.floats(6, 20), st.floats(0, 6.2))


@settings(max_examples=60, deadline=None)
@given(shape, shape)
def test_fan_and_slab_overlap_agree(p, q):
    fan, slab = kernel.shared(p, q), kernel.total(kernel.intersection(p, q))
    assert fan == pytest.approx(slab, abs=1e-4)
    assert fan == pytest.approx(kernel.shared(q, p), abs=1e-6)
    assert fan <= min(kernel.area(p), kernel.area(q)) + 1e-6
    assert kernel.total(kernel.difference(p, q)) == pytest.approx(kernel.area(p) - fan, abs=1e-4)
    assert kernel.total(kernel.union(p, q)) == pytest.approx(kernel.area(p) + kernel.area(q) - fan, abs=1e-4)
    x, y = kernel.representative(p)
    assert kernel.inside(x, y, p)


def test_holes():
    ring = [*box(0, 0, 10, 10), *box(2, 2, 8, 8)]
    assert kernel.area(ring) == 64
    assert kernel.shared(ring, box(0, 0, 5, 10)) == pytest.approx(32)
    assert not kernel.inside(5, 5, ring)


def test_validity_and_distance():
    bow = [np.array([(30, 0), (40, 10), (40, 0), (30, 10)], float)]
    assert not kernel.valid(bow) and kernel.valid(box(0, 0, 1, 1))
    assert kernel.total(kernel.made_valid(bow)) == pytest.approx(50)
    assert kernel.distance(box(0, 0, 1, 1), box(2, 0, 3, 1)) == 1
    assert kernel.distance(box(0, 0, 2, 2), box(1, 1, 3, 3)) == 0
    assert kernel.hausdorff(box(0, 0, 10, 10), box(1, 1, 9, 9)) == pytest.approx(math.sqrt(2))


def layer(spark, rows, extra="pr double"):
    return spark.createDataFrame([(k, float(p), [[{"x": float(u), "y": float(v)} for u, v in r]]) for k, p, r in rows], f"id long, {extra}, geom {polygons.GEOM}")


def test_repair(spark):
    rows = [(0, 1, box(0, 0, 10, 10)[0]), (1, 0.5, box(8, 0, 18, 10)[0]), (2, 0.5, [(30, 0), (40, 10), (40, 0), (30, 10)])]
    got = {r["id"]: kernel.area(polygons.rings(r["geom"])) for r in polygons.repair(layer(spark, rows), "id", "pr").collect()}
    assert got[0] == pytest.approx(100) and got[1] == pytest.approx(80) and got[2] == pytest.approx(50)


def as_polygons(df, key):
    corners = ((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y1")), (F.col("x2"), F.col("y2")), (F.col("x1"), F.col("y2")))
    return df.select(key, F.array(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])).alias("geom"))


def test_polygon_features_equal_box_features(spark, sf):
    a, b = part(spark, sf, "layer_a").where("a_id < 60"), part(spark, sf, "layer_b").where("b_id < 120")
    order = ["a_id", "b_id"]
    x = polygons.pair_features(as_polygons(a, "a_id"), as_polygons(b, "b_id")).toPandas().sort_values(order).reset_index(drop=True)
    y = features.pair_features(a, b).toPandas().sort_values(order).reset_index(drop=True)[x.columns]
    assert len(x) == len(y) and float((x - y).abs().max().max()) < 1e-6


def test_topology_counts(spark):
    rows = [(0, 0.0, 0.0, 10.0, 10.0), (1, 8.0, 0.0, 18.0, 10.0), (2, 18.25, 0.0, 28.0, 10.0)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    r = topology.report(df).first()
    assert (r["overlaps"], r["overlap_area_m2"], r["near_miss_gaps"], r["parcels"]) == (1, 20.0, 1, 3)


def test_known_shift(spark, sf):
    a = part(spark, sf, "layer_a")
    b = a.select(F.col("a_id").alias("b_id"), (F.col("x1") + 3).alias("x1"), (F.col("y1") - 2).alias("y1"), (F.col("x2") + 3).alias("x2"), (F.col("y2") - 2).alias("y2"))
    shift = coreg.estimate(a, b)
    r = shift.agg(F.median("sx").alias("x"), F.median("sy").alias("y")).first()
    assert abs(r["x"] - 3) < 0.2 and abs(r["y"] + 2) < 0.2
    assert coreg.report(a, b, shift).first()["offset_after"] < 0.3


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


@given(st.text("abcd ", max_size=30), st.text("abcd ", max_size=30))
def test_lcs(a, b):
    assert names.lcs(a, b) == lcs_table(a, b)


def test_owner_similarity(spark):
    same = [("Krishnan Iyer", "K. Iyer"), ("Krishnan Iyer", "Iyer, Krishnan"), ("Janaki Reddy", "JanakiR eddy")]
    other = [("Abdul Khan", "Abdul Sheikh"), ("Abdul Sheikh", "Meenakshi Sheikh")]
    assert all(names.owner_similarity(*p) >= 0.8 for p in same) and all(names.owner_similarity(*p) < 0.8 for p in other)
    df = spark.createDataFrame([*same, (None, "x"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(strings.owner_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [names.owner_similarity(*p) for p in same] + [0.0, 0.0]


def sequential(pairs, least):
    e, l, out = set(), set(), []
    for p, a, b in sorted(pairs, key=lambda r: (-r[0], r[1], r[2])):
        if p >= least and a not in e and b not in l:
            e.add(a), l.add(b), out.append((a, b))
    return sorted(out)


def test_greedy_equals_a_sequential_pass(spark):
    r = random.Random(5)
    pairs = list({(a, b): (r.randint(0, 10) / 10, a, b) for a, b in ((r.randint(0, 25), r.randint(100, 125)) for _ in range(150))}.values())
    df = spark.createDataFrame(pairs, "p double, earlier_id long, later_id long")
    got = changes.greedy(df.where("p >= 0.2"), "earlier_id", "later_id")
    assert sorted((x["earlier_id"], x["later_id"]) for x in got.collect()) == sequential(pairs, 0.2)


def test_change_kinds(spark):
    pairs = spark.createDataFrame([(1, 11, 0.9, 0.95, 10.0, 10.0), (2, 12, 0.8, 0.6, 10.0, 6.0), (3, 13, 0.2, 0.9, 10.0, 9.0)], "earlier_id long, later_id long, p double, area_ratio double, area_e double, area_l double")
    ids = lambda v, n: spark.createDataFrame([(x,) for x in v], f"{n} long")
    got = {(r["earlier_id"], r["later_id"]): r["change"] for r in changes.classify(pairs, ids([1, 2, 3], "earlier_id"), ids([11, 12, 13], "later_id"), 0.5).collect()}
    assert got == {(1, 11): "unchanged", (2, 12): "altered", (3, None): "demolished", (None, 13): "new"}


def test_weighted_accuracy(spark):
    sample = spark.createDataFrame([("a", 0, 0.95), ("b", 0, 0.95), ("c", 1, 0.1), ("d", 1, 0.95)], "pair_id string, stratum int, p double")
    strata = spark.createDataFrame([(0, 100, 2), (1, 900, 2)], "stratum int, population long, sampled long")
    labels = spark.createDataFrame([("a", "same", 1), ("b", "different", 2), ("b", "same", 5), ("c", "different", 3), ("d", "same", 4)], "pair_id string, label string, seq long")
    r = estimates.weighted(estimates.checked(sample, labels, strata), {"m": F.col("p") >= 0.9}).first()
    assert r["precision"] == 1 and r["recall"] == 1 and r["n_predicted"] == 3
    low, high = spark.range(1).select(*[c.alias(n) for c, n in zip(estimates.wilson(F.lit(45), F.lit(50)), "ab", strict=True)]).first()
    assert low < 0.9 < high


def test_chain(spark):
    log = spark.createDataFrame([("x", i, f"body{i}") for i in range(3)], "chain string, seq long, body string")
    chain = audit.chain_build(log, "chain", "seq", "body")
    assert audit.chain_check(chain, "chain", "seq", "body").first()["first_bad"] is None
    bad = chain.withColumn("body", F.when(F.col("seq") == 1, "other").otherwise(F.col("body")))
    assert audit.chain_check(bad, "chain", "seq", "body").first()["first_bad"] == 1
    assert audit.canonical({"b": None, "a": "é"}) == '{"a":"\\u00e9","b":null}'


def test_decisions(spark):
    log = spark.createDataFrame([("p", "accept", i) for i in range(5)] + [("q", "accept", 9)], "pair string, decision string, seq long")
    rows = [("q", "accept", "officer", "", True), ("q", "reject", "officer", "x", True), ("q", "reject", "supervisor", " ", True), ("q", "reject", "supervisor", "x", True), ("p", "reject", "supervisor", "x", True), ("z", "accept", "officer", "", False), ("n", "accept", "officer", "", True), ("n", "accept", "auditor", "", True)]
    df = spark.createDataFrame(rows, "pair string, decision string, role string, reason string, known boolean")
    got = {(r["pair"], r["decision"], r["role"], r["reason"]): r["status"] for r in audit.judged(df, log).collect()}
    assert [got[r[:4]] for r in rows] == [200, 403, 400, 201, 409, 404, 201, 403]


def flood(cells):
    left, parts = set(cells), []
    while left:
        stack, own = [left.pop()], set()
        while stack:
            c = stack.pop()
            own.add(c)
            for d in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                n = (c[0] + d[0], c[1] + d[1])
                if n in left:
                    left.remove(n)
                    stack.append(n)
        parts.append(len(own))
    return sorted(parts)


def test_raster_components(spark):
    r = random.Random(3)
    cells = {(i, j) for i in range(18) for j in range(18) if r.random() < 0.55}
    mask = spark.createDataFrame([("new", i, j) for i, j in cells], "change string, r int, q int")
    got = raster.components(mask).groupBy("part").count().collect()
    assert sorted(x["count"] for x in got) == flood(cells)


def test_schema_assignment():
    r = random.Random(1)
    from itertools import permutations

    cols, fields = [f"c{i}" for i in range(4)], ["f0", "f1", "f2"]
    s = {(c, f): r.random() for c in cols for f in fields}
    best = max(sum(s[c, f] for c, f in zip(p, fields, strict=True)) for p in permutations(cols, 3))
    got = schema_match.assign(s, cols, fields)
    assert sum(s[c, f] for c, f in got.items()) == pytest.approx(best)


def test_schema(spark):
    rows = [(f"P-{i}", f"{n} Rao", 2.5 + i * 0.37, "Residential" if i % 2 else "Commercial", f"{i}/{i % 5}A") for i, n in enumerate(["Asha", "Bina", "Chand", "Devi"] * 25)]
    rows = [(a, f"{b} {chr(65 + i % 26)}{chr(97 + i // 26)}", c, d, e) for i, (a, b, c, d, e) in enumerate(rows)]
    df = spark.createDataFrame(rows, "Patta_No string, Pattadar_Name string, Extent double, Classfn string, SF_No string")
    got = {x["column"]: x["field"] for x in schema_match.match(df)}
    assert got == {"Patta_No": "parcel_ref", "Pattadar_Name": "owner_name", "Extent": "area", "Classfn": "land_use", "SF_No": "survey_no"}


def test_projections(spark):
    df = spark.createDataFrame([(80.25, 13.05), (78.0, 28.0), (83.9, 8.1)], "lon double, lat double")
    e, n = projection.utm(F.col("lon"), F.col("lat"), projection.zone_of(F.col("lon")))
    lon, lat = projection.from_utm(F.col("e"), F.col("n"), projection.zone_of(F.col("lon")))
    for r in df.withColumns({"e": e, "n": n}).select((lon - F.col("lon")).alias("a"), (lat - F.col("lat")).alias("b")).collect():
        assert abs(r["a"]) < 1e-9 and abs(r["b"]) < 1e-9
    x, y = projection.lambert(F.col("lon"), F.col("lat"))
    lon, lat = projection.from_lambert(F.col("x"), F.col("y"))
    for r in df.withColumns({"x": x, "y": y}).select((lon - F.col("lon")).alias("a"), (lat - F.col("lat")).alias("b")).collect():
        assert abs(r["a"]) < 1e-9 and abs(r["b"]) < 1e-9
    # on the central meridian the easting is the false one, and the northing the meridian's arc by the scale
    e, n = projection.utm(F.lit(81.0), F.lit(0.0), 44)
    assert tuple(df.select(e, n).first()) == (500000.0, 0.0)


def tile_name(lat, lon, z):
    s = math.sin(math.radians(lat))
    x, y = int((lon + 180) / 360 * 2**z), int((0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * 2**z)
    return np.base_repr(int(f"{y:0{z}b}", 4) * 2 + int(f"{x:0{z}b}", 4), 4).rjust(z, "0")


def test_quadkey(spark):
    places = [(13.05, 80.25), (-33.9, 151.2), (51.5, -0.1), (0.1, 0.1)]
    df = spark.createDataFrame(places, "lat double, lon double").select(projection.quadkey(F.col("lat"), F.col("lon"), 9).alias("q"))
    assert [r["q"] for r in df.collect()] == [tile_name(*p, 9) for p in places]


def test_contributions_add_up():
    # a tree of two levels over two features: values of the game are what the leaves say
    leaves = [(1.0, [(0, -np.inf, 0.5, 0.4)]), (2.0, [(0, 0.5, np.inf, 0.6), (1, -np.inf, 0.5, 0.5)]), (5.0, [(0, 0.5, np.inf, 0.6), (1, 0.5, np.inf, 0.5)])]
    x = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])
    mean = 0.4 * 1 + 0.6 * 0.5 * 2 + 0.6 * 0.5 * 5
    assert learn.shapley(x, leaves).sum(1) + mean == pytest.approx([1.0, 2.0, 5.0])


def test_matcher(spark, sf, tmp_path):
    from landlace.plans import record_queries

    rows = record_queries._training(*(part(spark, sf, p) for p in ("layer_a", "layer_b", "truth"))).cache()
    m = learn.fit(rows.where("fold < 2"), rows.where("fold = 2"), rounds=5, depth=3, target=0.95)
    m.save(str(tmp_path / "m"))
    back = learn.Matcher.load(spark, str(tmp_path / "m"))
    test = rows.where("fold = 3")
    a, b = learn.score(test, m), learn.score(test, back)
    assert a.select("p").orderBy("p").collect() == b.select("p").orderBy("p").collect()
    got = a.agg(F.avg((F.col("p") >= 0.5).cast("int") * F.col("label")).alias("tp"), F.avg("label").alias("t"), F.avg((F.col("iou") >= 0.5).cast("int") * F.col("label")).alias("base")).first()
    assert got["tp"] >= got["base"]
    one = learn.contributions(test.where("iou > 0"), m, top=12).select("contrib", *m.columns).limit(20).toPandas()
    whole = learn.leaves(m)
    mean = sum(v * np.prod([s for *_, s in p]) for v, p in whole)
    for contrib, x in zip(one["contrib"], one[list(m.columns)].to_numpy(float), strict=True):
        exact = sum(v for v, p in whole if all(low < x[f] <= high for f, low, high, _ in p))
        assert sum(c["value"] for c in contrib) + mean == pytest.approx(exact, abs=1e-6)
