"""Readers of GeoPackage and zipped Shapefile layers as Python data sources, and the checks an uploaded file has to pass.

    spark.dataSource.register(GeoPackage); spark.read.format("landlace_gpkg").load(path)
    spark.dataSource.register(Shapefile);  spark.read.format("landlace_shp").load(path)

Both give (ordinal, srid, geom, properties): one row for each polygon, properties as JSON text. The formats are single files
that are read from the file system; upload() bounds their size.
"""

from __future__ import annotations

import io
import json
import os
import sqlite3
import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader

GEOM = "array<array<struct<x: double, y: double>>>"
SCHEMA = f"ordinal long, srid int, geom {GEOM}, properties string"
MOST_BYTES, MOST_UNZIPPED, MOST_FEATURES = 25 * 1024 * 1024, 200 * 1024 * 1024, 20_000
KINDS = (".geojson", ".json", ".gpkg", ".zip")


class LayerError(ValueError):
    """A layer that can't be used, with a message for the person who sent it."""


def upload(name: str, size: int, features: int | None = None) -> None:
    """Raise unless a file of this name and size may be read."""
    if os.path.splitext(name)[1].lower() not in KINDS:
        raise LayerError(f"{name}: use GeoJSON, GeoPackage or a zipped Shapefile.")
    if not size:
        raise LayerError(f"{name}: the file is empty.")
    if size > MOST_BYTES:
        raise LayerError(f"{name}: larger than {MOST_BYTES // 2**20} MB.")
    if features is not None and features > MOST_FEATURES:
        raise LayerError(f"{name}: {features:,} polygons; the limit is {MOST_FEATURES:,}.")


def _rings(raw: memoryview, at: int, order: str) -> tuple[list, int]:
    (n,) = struct.unpack_from(f"{order}I", raw, at)
    at, out = at + 4, []
    for _ in range(n):
        (k,) = struct.unpack_from(f"{order}I", raw, at)
        v = struct.unpack_from(f"{order}{2 * k}d", raw, at + 4)
        out.append(list(zip(v[::2], v[1::2], strict=True)))
        at += 4 + 16 * k
    return out, at


def wkb_polygons(raw: bytes) -> list[list]:
    """Polygons of a two-dimensional WKB polygon or multipolygon; other kinds give none."""
    view = memoryview(raw)

    def read(at: int) -> tuple[list, int]:
        order = "<" if view[at] == 1 else ">"
        (kind,) = struct.unpack_from(f"{order}I", view, at + 1)
        if kind == 3:
            rings, at = _rings(view, at + 5, order)
            return [rings], at
        if kind == 6:
            (n,) = struct.unpack_from(f"{order}I", view, at + 5)
            at, out = at + 9, []
            for _ in range(n):
                own, at = read(at)
                out += own
            return out, at
        return [], len(view)

    return read(0)[0]


def wkb(poly: list) -> bytes:
    """A polygon, its rings lists of (x, y), as WKB."""
    return b"\x01" + struct.pack("<II", 3, len(poly)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in poly)


def gpkg_polygons(blob: bytes) -> tuple[int, list]:
    """(srid, polygons) of a GeoPackage geometry: a header with an optional envelope, then WKB."""
    if blob[:2] != b"GP":
        raise LayerError("a geometry is not in GeoPackage form.")
    order = "<" if blob[3] & 1 else ">"
    (srid,) = struct.unpack_from(f"{order}i", blob, 4)
    return srid, wkb_polygons(blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] :])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, rows):
        self.path, self.rows = options["path"].removeprefix("file://"), rows

    def read(self, partition) -> Iterator[tuple]:
        for i, (srid, poly, properties) in enumerate(self.rows(self.path)):
            yield i, srid, [[{"x": float(x), "y": float(y)} for x, y in r] for r in poly], json.dumps(properties, default=str)


def gpkg_rows(path: str) -> Iterator[tuple]:
    base = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        layers = base.execute("select table_name, column_name, srs_id from gpkg_geometry_columns order by table_name").fetchall()
        if not layers:
            raise LayerError("the GeoPackage has no layer.")
        table, column, srid = layers[0]
        quoted = '"' + table.replace('"', '""') + '"'
        cursor = base.execute(f"select * from {quoted}")
        names = [d[0] for d in cursor.description]
        at = names.index(column)
        for row in cursor:
            if row[at] is not None:
                for poly in gpkg_polygons(row[at])[1]:
                    yield srid, poly, {n: v for k, (n, v) in enumerate(zip(names, row, strict=True)) if k != at and not isinstance(v, bytes)}
    finally:
        base.close()


def _signed(r: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True)) / 2


def shp_polygons(record: bytes) -> list[list]:
    """Polygons of a shape record: clockwise rings are shells, the holes after each belong to it."""
    (kind,) = struct.unpack_from("<i", record)
    if kind not in (5, 15, 25):
        return []
    parts, points = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{parts}i", record, 44), points]
    v = struct.unpack_from(f"<{2 * points}d", record, 44 + 4 * parts)
    xy = list(zip(v[::2], v[1::2], strict=True))
    out: list[list] = []
    for a, z in zip(starts[:-1], starts[1:], strict=True):
        ring = xy[a:z]
        if _signed(ring) <= 0 or not out:
            out.append([ring])
        else:
            out[-1].append(ring)
    return out


def dbf_rows(raw: bytes) -> list[dict]:
    n, head, size = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 32
    while raw[at] != 13:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(raw[at + 11]), raw[at + 16]))
        at += 32
    out = []
    for i in range(n):
        row, at = {}, head + i * size + 1
        for name, kind, width in fields:
            text = raw[at : at + width].decode("utf-8", "replace").strip()
            at += width
            try:
                row[name] = (float(text) if "." in text else int(text)) if kind in "NF" and text else text or None
            except ValueError:
                row[name] = None
        out.append(row)
    return out


def shp_rows(path: str) -> Iterator[tuple]:
    """The one layer of a zip, read without unpacking it to disk."""
    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        if any(n.startswith("/") or ".." in n.split("/") for n in names):
            raise LayerError("the zip contains unsafe paths.")
        if sum(z.getinfo(n).file_size for n in names) > MOST_UNZIPPED:
            raise LayerError("the zip expands to more than 200 MB.")
        shapes = [n for n in names if n.lower().endswith(".shp")]
        if len(shapes) != 1:
            raise LayerError("a zipped Shapefile holds exactly one .shp.")
        stem = shapes[0][:-4].lower()
        table = next((n for n in names if n.lower() == f"{stem}.dbf"), None)
        system = next((z.read(n).decode("latin-1") for n in names if n.lower() == f"{stem}.prj"), "")
        srid = 4326 if not system or system.startswith("GEOGCS") else int("".join(c for c in system.rpartition('AUTHORITY["EPSG","')[2].split('"')[0] if c.isdigit()) or 0)
        rows = dbf_rows(z.read(table)) if table else []
        raw = z.read(shapes[0])
    stream, i = io.BytesIO(raw[100:]), 0
    while head := stream.read(8):
        (_, words) = struct.unpack(">2i", head)
        for poly in shp_polygons(stream.read(2 * words)):
            yield srid, poly, rows[i] if i < len(rows) else {}
        i += 1


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landlace_gpkg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, gpkg_rows)


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landlace_shp"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, shp_rows)
