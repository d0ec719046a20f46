"""Polygons, loops that run to their end, and sources, against plain versions."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landlace.functions import kernel
from landlace.operators import changes, coreg, harmonise, polygons, raster
from landlace.operators.components import least_of_component
from landlace.sources import delivery, geojson
from landlace.workers import ship

GEOM = "geom array<array<struct<x: double, y: double>>>"


def poly(*rings):
    return [[(float(x), float(y)) for x, y in r] for r in rings]


def box(x1, y1, x2, y2):
    return poly([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])


def test_greedy_follows_a_long_chain(spark):
    """Scores that rise along a chain give one link a round: the pass over what is left gives all of them."""
    pairs = spark.createDataFrame([(i, i + d, 2 * i + d + 0.0) for i in range(450) for d in (0, 1)], "a long, b long, p double")
    rows = sorted(map(tuple, pairs.collect()), key=lambda r: (-r[2], r[0], r[1]))
    seen_a, seen_b, want = set(), set(), set()
    for a, b, p in rows:
        if a not in seen_a and b not in seen_b:
            seen_a.add(a), seen_b.add(b), want.add((a, b, p))
    assert set(map(tuple, changes.greedy(pairs, "a", "b").collect())) == want and len(want) == 450
    few = pairs.where("a < 8")
    assert set(map(tuple, changes.greedy(few, "a", "b", few=2).collect())) == set(map(tuple, changes.greedy(few, "a", "b").collect()))
    assert changes.greedy(pairs.limit(0), "a", "b").count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(1200))
    random.Random(1).shuffle(order)
    pairs = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "x long, y long")
    out = least_of_component(spark.range(1202).withColumnRenamed("id", "id"), pairs)
    assert out.groupBy("part").count().orderBy("part").collect() == [(0, 1200), (1200, 1), (1201, 1)]


def test_raster_parts_wind(spark):
    """A snake of pixels longer than any number of rounds once allowed is one part."""
    rows = [("new", r, q) for r in range(0, 160, 2) for q in range(6)] + [("new", r, 5 if r % 4 == 1 else 0) for r in range(1, 159, 2)]
    out = raster.components(spark.createDataFrame(rows, "change string, r int, q int"))
    assert out.select("part").distinct().count() == 1 and out.count() == len(rows)


def test_points_and_outlines_in_columns(spark):
    ship(spark)
    shape = poly([(0, 0), (9, 1), (8, 8), (4, 3), (1, 9)], [(2, 2), (3, 2), (3, 3), (2, 3)])
    own = polygons.rings(shape)
    rng = np.random.default_rng(4)
    points = [(float(x), float(y)) for x, y in rng.uniform(-2, 11, (300, 2))]
    df = spark.createDataFrame([(shape, x, y) for x, y in points], f"{GEOM}, x double, y double")
    got = df.select(polygons.inside(F.col("geom"), F.col("x"), F.col("y")), polygons.to_outline(F.col("geom"), F.col("x"), F.col("y")), polygons.perimeter(F.col("geom")), polygons.centroid(F.col("geom")).alias("c")).collect()
    a, b = kernel._sides(own)
    for (x, y), r in zip(points, got, strict=True):
        assert r[0] == kernel.inside(x, y, own)
        assert np.isclose(r[1], kernel._to_segments(np.array([[x, y]]), a, b)[0])
        assert np.isclose(r[2], kernel.perimeter(own)) and np.allclose(tuple(r["c"]), kernel.centroid(own))


def test_road_reserve_with_a_bend(spark):
    ship(spark)
    roads = spark.createDataFrame([(1, [(0.0, 0.0), (40.0, 0.0), (40.0, 30.0)], 5.0), (2, [], 5.0)], "id long, line array<struct<x: double, y: double>>, half double")
    strips = polygons.reserve(roads, "id", "half")
    whole = spark.createDataFrame([(1, box(-20, -20, 80, 60))], f"k long, {GEOM}")
    got = polygons.cover(whole, "k", strips).first()["covered"]
    disc = 32 / 2 * 25 * np.sin(2 * np.pi / 32)  # the corner's disc; three of its quarters lie beyond or within the strips
    assert np.isclose(got, 40 * 10 + 30 * 10 - 25 + disc / 4, atol=0.2)


def test_union_counts_once(spark):
    ship(spark)
    r = random.Random(2)
    boxes = [(r.randrange(20), r.randrange(20), r.randrange(1, 9), r.randrange(1, 9)) for _ in range(14)]
    cells = {(x, y) for a, b, w, h in boxes for x in range(a, a + w) for y in range(b, b + h)}
    df = spark.createDataFrame([("g", box(a, b, a + w, b + h)) for a, b, w, h in boxes], f"g string, {GEOM}")
    assert np.isclose(polygons.union(df, "g").agg(F.sum(polygons.area(F.col("geom")))).first()[0], len(cells))


def test_shift_of_turned_shapes(spark):
    """Triangles, whose centroids aren't the centres of their envelopes, moved by a known offset and turned a little."""
    r = random.Random(3)
    a, b = [], []
    for k in range(60):
        x, y = 40 * (k % 10) + r.random() * 5, 40 * (k // 10) + r.random() * 5
        tri = [np.array([[x, y], [x + 22, y + r.random() * 8], [x + 4, y + 18]])]
        a.append((k, poly(*[t.tolist() for t in tri])))
        b.append((1000 + k, poly(*[t.tolist() for t in kernel.turned(tri, 0.1, 1.0, (3.0, -2.0))])))
    shift = coreg.estimate(spark.createDataFrame(a, f"a_id long, {GEOM}"), spark.createDataFrame(b, f"b_id long, {GEOM}")).collect()
    assert len(shift) == 60 and all(abs(s["sx"] - 3) < 0.05 and abs(s["sy"] + 2) < 0.05 for s in shift)


def test_read_back(spark):
    ship(spark)
    layer = spark.createDataFrame([(1, box(0, 0, 4, 4)), (2, box(9, 9, 12, 12))], f"k long, {GEOM}")
    back = spark.createDataFrame([(1, box(0, 0, 4, 4)), (2, box(9, 9, 12, 12.5))], f"k long, {GEOM}")
    assert tuple(polygons.read_back(layer, "k", back).first()) == (2, 0.5)


def test_conflict_scores_by_kind(spark):
    found = spark.createDataFrame([(1, "owner"), (2, "owner"), (1, "area")], "parcel_id long, type string")
    truth = spark.createDataFrame([(1, "owner"), (3, "owner"), (4, "owner")], "parcel_id long, type string")
    got = {r["type"]: tuple(r)[1:] for r in harmonise.conflict_scores(found, truth).collect()}
    assert got == {"owner": (3, 2, 1, 0.5, 1 / 3), "area": (0, 1, 0, 0.0, 1.0), "land_use": (0, 0, 0, 1.0, 1.0)}


def test_logs_documents_and_fetched_ways(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text("".join(json.dumps({"seq": i, "who": f"u{i}"}) + "\n\n" for i in range(20)))
    rows = delivery.read_jsonl(spark, str(log), "seq long, who string").orderBy("line").collect()
    assert [r["seq"] for r in rows] == list(range(20))
    with log.open("a") as f:
        f.write("{broken\n")
    with pytest.raises(Exception):  # noqa: B017
        delivery.read_jsonl(spark, str(log), "seq long, who string").collect()
    delivery.write_document(spark.createDataFrame([(2, "b"), (1, "a")], "k long, v string"), "rows", str(tmp_path / "doc"), order="k")
    doc = delivery.read_document(spark, str(tmp_path / "doc"), "rows array<struct<k: long, v: string>>").first()
    assert [tuple(r) for r in doc["rows"]] == [(1, "a"), (2, "b")]
    ways = [(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]), (3, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])]
    out = delivery.closed_once(spark.createDataFrame(ways, "id long, line array<struct<x: double, y: double>>")).collect()
    assert [(r["id"], len(r["geom"][0])) for r in out] == [(1, 3)]


def test_tile_index_and_lines_in_a_box(spark, tmp_path):
    index = tmp_path / "links.csv"
    from landlace.functions.projection import quadkey

    key = spark.range(1).select(quadkey(F.lit(13.05), F.lit(80.21), 9).alias("k")).first()["k"]
    index.write_text(f"Location,QuadKey,Url\nIndia,{key.lstrip('0')},a\nIndia,{'3' * 9},b\nChad,{key},c\n")
    assert [r["Url"] for r in delivery.read_tile_index(spark, str(index), "India", (80.2, 13.0, 80.22, 13.1)).collect()] == ["a"]
    ring = lambda x: [[x, 1], [x + 1, 1], [x + 1, 2], [x, 1]]
    features = [("Polygon", [ring(0)]), ("Polygon", [ring(50)]), ("MultiPolygon", [[ring(50)], [ring(0)]]), ("Polygon", [ring(50), ring(0)]), ("Point", [0.5, 1.5])]
    with gzip.open(tmp_path / "f.geojsonl.gz", "wt") as f:
        for kind, c in features:
            f.write(json.dumps({"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": {}}) + "\n")
    got = geojson.read_lines(spark, str(tmp_path / "f.geojsonl.gz"), (-1, 0, 5, 5)).collect()
    assert sorted(r["kind"] for r in got) == ["MultiPolygon", "Polygon", "Polygon"]


def test_roles():
    from landlace.operators import audit

    assert set(audit.ROLES) == {"officer", "supervisor", "auditor", "admin"} and audit.ROLES["auditor"] == ("export",)


def test_chain_with_a_null_body(spark):
    from landlace.operators import audit

    log = spark.createDataFrame([("c", 1, "x"), ("c", 2, None), ("c", 3, "z")], "chain string, seq long, body string")
    built = audit.chain_build(log, "chain", "seq", "body")
    assert audit.chain_check(built, "chain", "seq", "body").first()["first_bad"] is None


def test_proposals_of_one_batch_see_one_another(spark):
    from landlace.operators import audit

    log = spark.createDataFrame([("q", "accept", 1)], "pair string, decision string, seq long")
    rows = [("p", "accept", "officer", "", True), ("p", "reject", "officer", "x", True), ("p", "accept", "officer", "", True), ("p", "reject", "supervisor", "x", True), ("p", "reject", "supervisor", "x", True), ("q", "reject", "supervisor", " ", True),
            *[("q", d, "supervisor", "x", True) for d in ("reject", "accept", "reject", "accept", "reject")], ("r", "accept", "officer", None, False), ("r", "accept", "auditor", None, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, pair string, decision string, role string, reason string, known boolean").repartition(3)
    got = [r["status"] for r in audit.judged_in_turn(df, log, "n").orderBy("n").collect()]
    assert got == [201, 403, 200, 201, 200, 400, 201, 201, 201, 201, 409, 404, 403]
