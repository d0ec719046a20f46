"""Layers ready to be matched: from a file to metric polygons of sensible size with ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landlace.functions import projection
from landlace.operators.polygons import area, enveloped, made_valid
from landlace.sources import geojson
from landlace.sources.files import GeoPackage, LayerError, Shapefile, upload

UPLOAD_AREA, BENCHMARK_AREA = (8.0, 20000.0), (15.0, 2000.0)


def features(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, srid, geom, properties) of any of the formats, by its extension."""
    low = path.lower()
    if low.endswith(".gpkg") or low.endswith(".zip"):
        kind = GeoPackage if low.endswith(".gpkg") else Shapefile
        spark.dataSource.register(kind)
        return spark.read.format(kind.name()).load(path)
    return geojson.polygons(geojson.read(spark, path))


def projected(layer: DataFrame, zone: int | None = None) -> DataFrame:
    """geom in metres: degrees go to a UTM zone (the data's own unless given), metric ones stay."""
    if layer.where("srid <> 4326").isEmpty():
        ends = layer.select(F.explode(F.element_at("geom", 1)).alias("p")).agg(F.min("p.x").alias("w"), F.max("p.x").alias("e"), F.min("p.y").alias("s"), F.max("p.y").alias("n")).first()
        if ends["w"] is None:
            return layer
        if not (-180 <= ends["w"] <= 180 and -90 <= ends["s"] <= 90):
            raise LayerError("the file has no coordinate system and its coordinates are not longitude and latitude.")
        zone = zone or int(((ends["w"] + ends["e"]) / 2 + 180) // 6) + 1

        def metric(p):
            x, y = projection.utm(p["x"], p["y"], zone)
            return F.struct(x.alias("x"), y.alias("y"))

        return layer.withColumn("geom", F.transform("geom", lambda r: F.transform(r, metric))).withColumn("srid", F.lit(32600 + zone))
    return layer


def load(spark: SparkSession, path: str, prefix: str, zone: int | None = None, sizes: tuple[float, float] = UPLOAD_AREA, most: int | None = None, size: int | None = None) -> DataFrame:
    """(id, owner, geom, x1..y2): valid polygons of an area within `sizes`, numbered in the file's order."""
    if size is not None:
        upload(path, size)
    own = features(spark, path)
    n = own.count()
    if not n:
        raise LayerError(f"{path}: no polygons found.")
    if most and n > most:
        raise LayerError(f"{path}: {n:,} polygons; the limit is {most:,}.")
    parts = made_valid(projected(own, zone).withColumn("ordinal", F.monotonically_increasing_id()) if "ordinal" not in own.columns else projected(own, zone), "ordinal")
    parts = parts.withColumn("area", area(F.col("geom"))).where(F.col("area").between(*sizes))
    number = F.row_number().over(Window.orderBy("ordinal", "part")) - 1  # a file's rows: bounded by its size limit
    return enveloped(parts.withColumn("id", F.format_string(f"{prefix}%05d", number)).withColumn("owner", F.lit("")).select("id", "owner", "geom", "area"))


def sample(layer: DataFrame, n: int, seed: int = 7, key: str = "id") -> DataFrame:
    """n rows by a hash of the key: the same ones every time."""
    return layer.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def synthetic(spark: SparkSession, n: int, seed: int = 7, pitch: float = 30.0, street: float = 14.0, block: int = 10) -> DataFrame:
    """(id, owner, geom): rows of houses in turned street blocks, a quarter of them L-shaped, from hashes of their number."""
    side = int(n**0.5) + (int(n**0.5) ** 2 < n)
    draw = lambda *k: F.pmod(F.xxhash64(F.lit(seed), *k), F.lit(1 << 30)) / float(1 << 30)
    i, j = F.floor(F.col("k") / side), F.col("k") % side
    df = spark.range(n).withColumnRenamed("id", "k").withColumns({"i": i, "j": j}).withColumns({"bi": F.floor(F.col("i") / block), "bj": F.floor(F.col("j") / block)})
    df = df.withColumns({"w": 10 + 12 * draw(F.col("k"), F.lit(1)), "d": 10 + 12 * draw(F.col("k"), F.lit(2)), "turn": F.radians(50 * draw(F.col("bi"), F.col("bj"), F.lit(3)) - 25)})
    df = df.withColumns({"px": F.col("i") * pitch + F.col("bi") * street + 1 + draw(F.col("k"), F.lit(4)) * (pitch - F.col("w") - 2), "py": F.col("j") * pitch + F.col("bj") * street + 1 + draw(F.col("k"), F.lit(5)) * (pitch - F.col("d") - 2)})
    middle = lambda b: F.col(b) * (block * pitch + street) + block * pitch / 2
    df = df.withColumns({"cx": middle("bi"), "cy": middle("bj")})

    def corner(u, v):
        x, y = F.col("px") + F.col("w") * u - F.col("cx"), F.col("py") + F.col("d") * v - F.col("cy")
        c, s = F.cos("turn"), F.sin("turn")
        return F.struct((350000 + F.col("cx") + x * c - y * s).alias("x"), (1445000 + F.col("cy") + x * s + y * c).alias("y"))

    box = F.array(*[corner(u, v) for u, v in ((0, 0), (1, 0), (1, 1), (0, 1))])
    ell = F.array(*[corner(u, v) for u, v in ((0, 0), (1, 0), (1, 0.55), (0.55, 0.55), (0.55, 1), (0, 1))])
    geom = F.array(F.when(draw(F.col("k"), F.lit(6)) < 0.25, ell).otherwise(box))
    from landlace.plans.fixtures import FIRST, LAST

    pick = lambda names, salt: F.element_at(F.split(F.lit(names), ","), (1 + F.pmod(F.xxhash64(F.lit(seed), F.col("k"), F.lit(salt)), F.lit(len(names.split(","))))).cast("int"))
    return df.select(F.format_string("A%05d", F.col("k")).alias("id"), F.concat_ws(" ", pick(FIRST, 7), pick(LAST, 8)).alias("owner"), geom.alias("geom"))
