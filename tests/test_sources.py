"""Readers and writers, on files made here."""

import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from landlace.functions import kernel
from landlace.operators import polygons
from landlace.sources import delivery, files, geojson, layers

SQUARE = [(80.0, 13.0), (80.0002, 13.0), (80.0002, 13.0002), (80.0, 13.0002), (80.0, 13.0)]


@pytest.fixture
def collection(tmp_path):
    many = [[[[x + 0.001, y] for x, y in SQUARE]], [[[x + 0.002, y] for x, y in SQUARE]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}},
        {"type": "Feature", "properties": {"n": 2}, "geometry": {"type": "MultiPolygon", "coordinates": many}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [80, 13]}},
        {"type": "Feature", "properties": {}, "geometry": None},
    ]}
    p = tmp_path / "a.geojson"
    p.write_text(json.dumps(doc))
    return str(p)


def test_geojson_layer(spark, collection):
    rows = layers.load(spark, collection, "A").collect()
    assert sorted(r["id"] for r in rows) == ["A00000", "A00001", "A00002"]
    assert all(400 < r["area"] < 600 for r in rows) and all(350000 < r["x1"] < 450000 for r in rows)


def test_layer_errors(spark, tmp_path):
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    with pytest.raises(files.LayerError, match="no polygons"):
        layers.load(spark, str(tmp_path / "p.geojson"), "A")
    for name, size in (("a.exe", 5), ("a.gpkg", 0), ("a.zip", 10**9)):
        with pytest.raises(files.LayerError):
            files.upload(name, size)


def test_lines_with_box(spark, tmp_path):
    import gzip

    lines = [json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[x + d, y] for x, y in SQUARE]]}}) for d in (0, 1)]
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        f.write("\n".join([lines[0], "", lines[1]]))
    assert geojson.read_lines(spark, str(tmp_path / "t.json.gz")).count() == 2
    assert geojson.read_lines(spark, str(tmp_path / "t.json.gz"), (79.9, 12.9, 80.1, 13.1)).count() == 1


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    base = sqlite3.connect(path)
    base.execute("create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id int, z int, m int)")
    base.execute("insert into gpkg_geometry_columns values ('plots', 'geom', 'POLYGON', 32644, 0, 0)")
    base.execute("create table plots (fid integer primary key, geom blob, name text)")
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    base.execute("insert into plots (geom, name) values (?, 'one')", (b"GP\0\1" + struct.pack("<i", 32644) + files.wkb([square]),))
    base.commit()
    base.close()
    r = layers.load(spark, path, "B").first()
    assert r["area"] == pytest.approx(100) and r["id"] == "B00000"
    assert json.loads(layers.features(spark, path).first()["properties"])["name"] == "one"


def shapefile(path, rings, names=("a.shp", "a.dbf")):
    body = b""
    for i, r in enumerate(rings):
        xs, ys = [p[0] for p in r], [p[1] for p in r]
        rec = struct.pack("<i4d2ii", 5, min(xs), min(ys), max(xs), max(ys), 1, len(r), 0) + b"".join(struct.pack("<2d", *p) for p in r)
        body += struct.pack(">2i", i + 1, len(rec) // 2) + rec
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    field = b"NO".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    rows = b"".join(b" " + str(i).rjust(4).encode() for i in range(len(rings)))
    dbf = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(rings), 32 + 32 + 1, 5) + field + b"\r" + rows
    with zipfile.ZipFile(path, "w") as z:
        for n, b in zip(names, (head + body, dbf), strict=True):
            z.writestr(n, b)
        z.writestr("a.prj", 'PROJCS["x",AUTHORITY["EPSG","32644"]]')


def test_shapefile(spark, tmp_path):
    clockwise = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
    shapefile(tmp_path / "a.zip", [clockwise, [(x + 20, y) for x, y in clockwise]])
    rows = layers.features(spark, str(tmp_path / "a.zip")).collect()
    assert [json.loads(r["properties"])["NO"] for r in rows] == [0, 1] and rows[0]["srid"] == 32644
    assert kernel.area(polygons.rings(rows[1]["geom"])) == 100
    shapefile(tmp_path / "b.zip", [clockwise], ("../a.shp", "a.dbf"))
    with pytest.raises(files.LayerError, match="unsafe"):
        list(files.shp_rows(str(tmp_path / "b.zip")))


def test_synthetic_layer(spark):
    a, b = (layers.synthetic(spark, 90, seed=s).orderBy("id").collect() for s in (7, 7))
    assert a == b and len(a) == 90
    areas = [kernel.area(polygons.rings(r["geom"])) for r in a]
    assert all(70 < x < 490 for x in areas) and {len(r["geom"][0]) for r in a} == {4, 6}
    assert all(kernel.valid(polygons.rings(r["geom"])) for r in a)


def test_delivery(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None)], "id long, name string, note string")
    assert delivery.csv_lines(df, ["id", "name", "note", "more"]).first()["line"] == '1,"a ""b"", c",,'
    f = df.select(geojson.feature(F.expr("array(array(array(1.00000004D, 2D)))"), F.struct("id")).alias("feature"))
    assert json.loads(geojson.collection(f).first()["json"])["features"][0]["geometry"]["coordinates"] == [[[1.0, 2.0]]]
    assert delivery.markdown({"m": {"x": 0.5}}, {"x": "Share"}).splitlines()[-1] == "| Share | 50.0% |"


def test_policy():
    text = "seed: 7\n\nml:   # numbers\n  target: 0.99\n  parts: [0.5, 0.2]\n  bands: {high: 85, low: x}\nlast: yes"
    assert delivery.policy(text) == {"seed": 7, "ml": {"target": 0.99, "parts": [0.5, 0.2], "bands": {"high": 85, "low": "x"}}, "last": "yes"}
