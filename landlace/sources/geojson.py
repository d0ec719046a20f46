"""GeoJSON in and out: collections, lines of features, and features as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "array<double>"
#: A polygon is an array of rings, a multipolygon one level more; properties stay a map of texts.
FEATURE = "struct<type: string, id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, srid, kind, coordinates, properties) of the features of a FeatureCollection; no stated system means 4326.

    Coordinates stay text until polygons() reads them, so one schema serves every kind of geometry.
    """
    schema = "crs struct<properties: struct<name: string>>, features array<struct<type: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    code = F.regexp_extract(F.coalesce("crs.properties.name", F.lit("")), "EPSG:+([0-9]+)$", 1).try_cast("int")
    rows = doc.select(F.coalesce(code, F.lit(4326)).alias("srid"), F.posexplode("features").alias("ordinal", "f"))
    return rows.select(F.col("ordinal").cast("long").alias("ordinal"), "srid", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def read_lines(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features one to a line, zipped or not; with a box (west, south, east, north) those of which any corner of any ring of any part lies in it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    f = lines.select(F.from_json("value", FEATURE).alias("f"))
    out = f.select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))
    if box is None:
        return out
    w, s, e, n = box
    one, many = F.from_json("coordinates", f"array<array<{POINT}>>"), F.from_json("coordinates", f"array<array<array<{POINT}>>>")
    points = F.when(F.col("kind") == "Polygon", F.flatten(one)).when(F.col("kind") == "MultiPolygon", F.flatten(F.flatten(many)))
    return out.where(F.coalesce(F.exists(points, lambda p: p[0].between(w, e) & p[1].between(s, n)), F.lit(False)))


def polygons(features: DataFrame) -> DataFrame:
    """One row for each polygon, parts of a multipolygon apart: rings as arrays of (x, y); other kinds of geometry go."""
    single = F.array(F.from_json("coordinates", f"array<array<{POINT}>>"))
    many = F.from_json("coordinates", f"array<array<array<{POINT}>>>")
    parts = F.when(F.col("kind") == "Polygon", single).when(F.col("kind") == "MultiPolygon", many)
    rings = F.transform(F.col("part"), lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return features.where(F.col("kind").isin("Polygon", "MultiPolygon")).withColumn("part", F.explode(parts)).withColumn("geom", rings).drop("coordinates", "part", "kind")


def ring_of_box(p: str = "") -> Column:
    """The outline of a box as an array of [x, y], closed."""
    x1, y1, x2, y2 = (F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2"))
    return F.array(*[F.array(x, y) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))])


def feature(rings: Column, properties: Column, digits: int = 7) -> Column:
    """A Feature as JSON text, coordinates rounded to `digits`."""
    own = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.transform(p, lambda v: F.round(v, digits))))
    geometry = F.struct(F.lit("Polygon").alias("type"), own.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def write(features: DataFrame, path: str) -> None:
    """Features (column feature) as lines, one file for each partition: a form that reads back in parallel."""
    features.select("feature").write.text(path)


def collection(features: DataFrame) -> DataFrame:
    """One row: all features as a FeatureCollection. For exports that fit one file."""
    body = F.array_join(F.collect_list("feature"), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("json"))
