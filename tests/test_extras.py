"""Rasters from files, confirmation by current maps, labels, users, credentials."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landlace.functions import credentials
from landlace.operators import audit, raster
from landlace.sources import geotiff


def write_tiff(path, data, deflate, rows=3):
    """Strips of interleaved 32-bit reals, little end first."""
    h, w, bands = data.shape
    strips = [data[i : i + rows].astype("<f4").tobytes() for i in range(0, h, rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    at, starts = 8, []
    for s in strips:
        starts.append(at)
        at += len(s)
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [32] * bands), (259, 3, [8 if deflate else 1]), (273, 4, starts), (277, 3, [bands]), (278, 3, [rows]), (279, 4, [len(s) for s in strips]),
            (284, 3, [1]), (339, 3, [3] * bands), (33550, 12, [4.0, 4.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 100.0, 200.0, 0.0])]
    head, extra = b"", b""
    after = at + 2 + 12 * len(tags) + 4
    for tag, kind, v in tags:
        raw = struct.pack(f"<{len(v)}{geotiff.SIZES[kind]}", *v)
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, len(v), after + len(extra))
            extra += raw
    path.write_bytes(b"II" + struct.pack("<HI", 42, at) + b"".join(strips) + struct.pack("<H", len(tags)) + head + b"\0" * 4 + extra)


@pytest.mark.parametrize("deflate", [False, True])
def test_geotiff(spark, tmp_path, deflate):
    data = np.random.default_rng(1).random((7, 5, 2)).astype("f4")
    write_tiff(tmp_path / "a.tif", data, deflate)
    write_tiff(tmp_path / "b.tif", data + 1, deflate)
    spark.dataSource.register(geotiff.GeoTiff)
    df = spark.read.format("landlace_tiff").load(str(tmp_path / "a.tif"))
    got = {(r["r"], r["q"], r["band"]): (r["value"], r["x"], r["y"]) for r in df.collect()}
    assert len(got) == 70 and got[0, 0, 0][1:] == (102.0, 198.0)
    assert all(v[0] == pytest.approx(float(data[k])) for k, v in got.items())
    both = geotiff.years(spark, str(tmp_path / "a.tif"), str(tmp_path / "b.tif"))
    assert both.count() == 35 and both.where("abs(p1 - p0 - 1) > 1e-6 or abs(h1 - h0 - 1) > 1e-6").isEmpty()


def test_change_with_maps(spark):
    """A block that was there drifts up, another appears: one new cluster, confirmed by one map and missing in the other."""
    rows = []
    for r in range(100):
        for q in range(100):
            old, new = 10 <= r < 20 and 10 <= q < 20, 50 <= r < 60 and 50 <= q < 60
            rows.append((r, q, 0.8 if old else 0.05, 0.85 if old or new else 0.05, 6.0, 6.0))
    pixels = spark.createDataFrame(rows, "r int, q int, p0 double, p1 double, h0 double, h1 double")
    assert raster.drift(pixels).first()["drift"] == pytest.approx(0.05)
    parts = raster.components(raster.opened(raster.masks(pixels)))
    maps = pixels.where("r >= 50 and r < 60 and q >= 50 and q < 58").select(F.lit("Microsoft").alias("source"), "r", "q").union(pixels.where("r < 20").select(F.lit("OSM"), "r", "q"))
    flags = raster.flagged(parts, maps)
    r = flags.first()
    assert flags.count() == 1 and r["change"] == "new" and r["n"] == 100 and r["confirmed"] and r["missing_in_reference"] and r["cover"]["Microsoft"] == 0.8
    zones = pixels.select(F.lit(1).alias("zone"), "r", "q").where("r >= 10 and r < 20 and q >= 10 and q < 20")
    stats = raster.zonal(pixels, zones)
    s = raster.summary(flags, raster.taller(stats)).first()
    assert (s["new"], s["new_confirmed"], s["demolished"], s["taller"]) == (1, 1, 0, 0)
    assert raster.height_noise(stats).first()[0] == 0


def test_labels(spark):
    sample = spark.createDataFrame([("a", 1), ("b", 2)], "pair_id string, place int")
    rows = [("a", "same", 5.0), ("a", "same", 1.0), ("b", "what", 9.0), ("z", "same", 9.0), ("b", "unsure", None)]
    got = [r["status"] for r in audit.labels_judged(spark.createDataFrame(rows, "pair_id string, label string, secs double"), sample).orderBy("pair_id", "label", "secs").collect()]
    assert sorted(got) == [201, 404, 422, 429, 429]
    done = spark.createDataFrame([("a", "x", "same")], "pair_id string, labeller string, label string")
    assert audit.next_unlabelled(sample, done, "x", "place").first()["pair_id"] == "b"
    assert audit.next_unlabelled(sample, done, "y", "place").first()["pair_id"] == "a"


def test_users(spark):
    users = spark.createDataFrame([("ann", "admin", True), ("bob", "officer", True)], "username string, role string, active boolean")
    more = audit.users_with(users, spark.createDataFrame([(" Ann ", "auditor", True), ("Cy", "auditor", True)], "username string, role string, active boolean"))
    assert {r["username"]: r["role"] for r in more.collect()} == {"ann": "admin", "bob": "officer", "cy": "auditor"}
    changed = audit.users_changed(users, spark.createDataFrame([("ann", None, False), ("bob", "supervisor", False)], "username string, role string, active boolean"), by="ann")
    assert {tuple(r) for r in changed.collect()} == {("ann", "admin", True), ("bob", "supervisor", False)}
    assert audit.allowed(changed, "decide").count() == 1


def test_credentials():
    stored = credentials.hashed("secret", rounds=10)
    assert credentials.matches("secret", stored) and not credentials.matches("other", stored) and not credentials.matches("x", "junk")
    t = credentials.token("ann", b"key", now=0)
    assert credentials.user_of(t, b"key", now=10) == "ann" and credentials.user_of(t, b"key", now=10**9) is None
    assert credentials.user_of(t, b"other", now=10) is None and credentials.user_of("junk", b"key") is None
