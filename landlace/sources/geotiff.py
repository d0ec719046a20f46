"""Rasters in GeoTIFF as pixel tables: strips or tiles, plain or deflated, whole or real samples, north up.

    spark.dataSource.register(GeoTiff); spark.read.format("landlace_tiff").load(path)

gives (band, r, q, x, y, value): one row for each sample, x and y at the pixel's centre. Each block of the file is a partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: bytes of a field's type, and numpy's name for a kind of sample.
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
SAMPLES = {1: "u", 2: "i", 3: "f"}


def fields(path: str) -> tuple[str, dict[int, tuple]]:
    """Byte order and fields of the first directory."""
    with open(path, "rb") as f:
        order = {b"II": "<", b"MM": ">"}[f.read(2)]
        magic, at = struct.unpack(f"{order}HI", f.read(6))
        if magic != 42:
            raise ValueError("not a TIFF of 32-bit offsets")
        f.seek(at)
        (n,) = struct.unpack(f"{order}H", f.read(2))
        entries = [f.read(12) for _ in range(n)]
        out = {}
        for e in entries:
            tag, kind, count = struct.unpack_from(f"{order}HHI", e)
            if kind not in SIZES:
                continue
            form = f"{order}{count}{SIZES[kind]}"
            size = struct.calcsize(form)
            if size <= 4:
                raw = e[8 : 8 + size]
            else:
                f.seek(struct.unpack_from(f"{order}I", e, 8)[0])
                raw = f.read(size)
            out[tag] = struct.unpack(form, raw)
    return order, out


class _Block(InputPartition):
    def __init__(self, i: int):
        super().__init__(i)
        self.i = i


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")
        self.order, self.f = fields(self.path)
        one = lambda tag, default: self.f.get(tag, (default,))[0]
        self.width, self.height, self.bands = one(256, 0), one(257, 0), one(277, 1)
        self.tiled, self.planar = 324 in self.f, one(284, 1) == 2
        self.block = (one(323, 0), one(322, 0)) if self.tiled else (min(one(278, self.height), self.height), self.width)
        self.starts, self.sizes = self.f[324 if self.tiled else 273], self.f[325 if self.tiled else 279]
        self.packing, self.predictor = one(259, 1), one(317, 1)
        if self.packing not in (1, 8, 32946) or self.predictor != 1:
            raise ValueError("only plain or deflated samples without a predictor are read")
        self.kind = np.dtype(f"{self.order}{SAMPLES[one(339, 1)]}{one(258, 8) // 8}")
        self.scale, self.tie = self.f.get(33550, (1.0, 1.0, 0.0)), self.f.get(33922, (0.0,) * 6)

    def partitions(self):
        return [_Block(i) for i in range(len(self.starts))]

    def read(self, partition) -> Iterator[tuple]:
        i, (h, w) = partition.i, self.block
        across = -(-self.width // w)
        down = -(-self.height // h)
        band, i = (i // (across * down), i % (across * down)) if self.planar else (0, i)
        r0, q0 = i // across * h, i % across * w
        with open(self.path, "rb") as f:
            f.seek(self.starts[partition.i])
            raw = f.read(self.sizes[partition.i])
        data = np.frombuffer(zlib.decompress(raw) if self.packing != 1 else raw, self.kind)
        data = data.reshape(-1, w, 1 if self.planar else self.bands)[: self.height - r0, : self.width - q0]
        (sx, sy, _), (ti, tj, _, tx, ty, _) = self.scale, self.tie
        for (r, q, b), v in np.ndenumerate(data):
            yield band + b, r0 + r, q0 + q, float(tx + (q0 + q + 0.5 - ti) * sx), float(ty - (r0 + r + 0.5 - tj) * sy), float(v)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landlace_tiff"

    def schema(self) -> str:
        return "band int, r int, q int, x double, y double, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def years(spark: SparkSession, early: str, late: str) -> DataFrame:
    """The pixel table (r, q, p0, p1, h0, h1) of two rasters of presence and height."""
    spark.dataSource.register(GeoTiff)
    out = None
    for i, path in enumerate((early, late)):
        one = spark.read.format("landlace_tiff").load(path).groupBy("r", "q").agg(*[F.max(F.when(F.col("band") == b, F.col("value"))).alias(f"{n}{i}") for b, n in ((0, "p"), (1, "h"))])
        out = one if out is None else out.join(one, ["r", "q"])
    return out.select("r", "q", "p0", "p1", "h0", "h1")
