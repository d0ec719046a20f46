"""The same operators for any polygons: geom is an array of rings of (x, y).

The candidate join works on envelopes in the JVM; exact measures run over Arrow batches of the pairs that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from landlace.functions import boxes, kernel
from landlace.operators.components import least_of_component
from landlace.operators.features import TINY, placed
from landlace.operators.spatial_join import join_boxes
from landlace.workers import settled, ship

GEOM = "array<array<struct<x: double, y: double>>>"


def shell(geom: Column) -> Column:
    return F.element_at(geom, 1)


def ring_area(r: Column) -> Column:
    """Unsigned area of a ring by the shoelace, from its first point, inside the JVM."""
    x0, y0 = F.element_at(r, 1)["x"], F.element_at(r, 1)["y"]
    turned = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
    terms = F.zip_with(r, turned, lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def area(geom: Column) -> Column:
    return F.aggregate(F.transform(F.slice(geom, 2, F.size(geom)), ring_area), ring_area(shell(geom)), lambda a, h: a - h)


def _turned(r: Column) -> Column:
    """The ring from its second point on: with the ring itself, its sides."""
    return F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))


def perimeter(geom: Column) -> Column:
    sides = F.flatten(F.transform(geom, lambda r: F.zip_with(r, _turned(r), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))))
    return F.aggregate(sides, F.lit(0.0), lambda a, t: a + t)


def centroid(geom: Column) -> Column:
    """A struct of x and y: of the shell less its holes."""
    ship()

    @F.arrow_udf("struct<x: double, y: double>")
    def run(g: pa.Array) -> pa.Array:
        return _table(flat(g).centroids(), ["x", "y"])

    return run(geom)


def inside(geom: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in the polygon, by the even-odd rule, inside the JVM."""

    def hit(p, q):
        right = x < p["x"] + (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) * (q["x"] - p["x"])
        return F.when(((p["y"] > y) != (q["y"] > y)) & right, 1).otherwise(0)

    hits = F.flatten(F.transform(geom, lambda r: F.zip_with(r, _turned(r), hit)))
    return F.aggregate(hits, F.lit(0), lambda a, t: a + t) % 2 == 1


def to_outline(geom: Column, x: Column, y: Column) -> Column:
    """Distance of a point to the nearest side, inside the JVM."""

    def gap(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        n = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - p["x"]) * dx + (y - p["y"]) * dy) / F.when(n > 0, n), F.lit(0.0))))
        return F.hypot(x - p["x"] - t * dx, y - p["y"] - t * dy)

    return F.array_min(F.flatten(F.transform(geom, lambda r: F.zip_with(r, _turned(r), gap))))


def enveloped(layer: DataFrame) -> DataFrame:
    """With the envelope's corners, which joins work on."""
    pick = lambda f, c: f(F.transform(shell(F.col("geom")), lambda p: p[c]))
    return layer.withColumns({"x1": pick(F.array_min, "x"), "y1": pick(F.array_min, "y"), "x2": pick(F.array_max, "x"), "y2": pick(F.array_max, "y")})


def _table(rows: list[tuple] | np.ndarray, names: list[str]) -> pa.Array:
    """Rows of numbers as an array of structs. (Rings of different lengths pass to workers as Arrow alone: pandas makes one block of them.)"""
    columns = np.array(rows, float).reshape(-1, len(names)).T
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)


def flat(a: pa.Array) -> kernel.Polygons:
    """A column of geometries, as it comes to a worker, without a Python object for each."""
    inner = a.flatten()
    points = inner.flatten()
    size = lambda x: x.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    return kernel.Polygons(np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1), size(inner), size(a))


def rings(geom) -> list[np.ndarray]:
    """A value of the geom column, as it comes to a worker, as arrays."""
    return [kernel.ring([(p["x"], p["y"]) if isinstance(p, dict) else tuple(p) for p in r]) for r in geom]


def geom_of(poly: list[np.ndarray]) -> list:
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in poly]


MEASURES = "inter double, area_a double, area_b double, dist double, centroid_dist double, hausdorff double"


def measures(a: Column, b: Column) -> Column:
    ship()

    @F.arrow_udf(f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        p, q, n = flat(x), flat(y), np.arange(len(x))
        near, far = kernel.apart_pairs(p, n, q, n)
        between = np.hypot(*(p.centroids() - q.centroids()).T)
        rows = np.stack([kernel.shared_pairs(p, n, q, n), p.areas(), q.areas(), near, between, far], 1)
        return _table(rows, [m.split()[0] for m in MEASURES.split(", ")])

    return run(a, b)


def _of_pairs(which: int) -> callable:
    """A column function of two geometries: one of the two distances of kernel.apart_pairs."""

    def make(a: Column, b: Column) -> Column:
        ship()

        @F.arrow_udf("double")
        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            n = np.arange(len(x))
            return pa.array(kernel.apart_pairs(flat(x), n, flat(y), n)[which], pa.float64())

        return run(a, b)

    return make


distance, hausdorff = _of_pairs(0), _of_pairs(1)


def shared(a: Column, b: Column) -> Column:
    """Area of the intersection, a batch of pairs at once."""
    ship()

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        n = np.arange(len(x))
        return pa.array(kernel.shared_pairs(flat(x), n, flat(y), n), pa.float64())

    return run(a, b)


def covered(groups: DataFrame) -> DataFrame:
    """(a_key, covered) for rows (a_key, g, covers): area of a polygon that any of an array of polygons covers, once where they overlap."""
    ship()
    schema = T.StructType([groups.schema["a_key"], T.StructField("covered", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            covers = b.column("covers")
            of = np.repeat(np.arange(b.num_rows), covers.value_lengths().to_numpy(zero_copy_only=False).astype(int))
            out = kernel.covered_areas(flat(b.column("g")), flat(covers.flatten()), of)
            yield pa.RecordBatch.from_arrays([b.column("a_key").cast(arrow.field(0).type), pa.array(out, pa.float64())], schema=arrow)

    return groups.select("a_key", "g", "covers").mapInArrow(run, schema)


def _joined(a: DataFrame, a_key: str, b: DataFrame, b_key: str, radius: float) -> DataFrame:
    """Pairs whose envelopes are at most `radius` apart: a_key, a_geom, b_key, b_geom."""
    own = lambda df, k: enveloped(df.select(F.col(k).alias("key"), "geom"))
    return join_boxes(own(a, a_key), own(b, b_key), radius).select("a_key", "a_geom", "b_key", "b_geom")


def part_of(small: DataFrame, small_key: str, big: DataFrame, big_key: str, linked: DataFrame | None = None) -> DataFrame:
    """(small, big, share): as relations.part_of, by the polygons themselves."""
    from landlace.operators.relations import RATIO, SHARE

    if linked is not None:
        small = small.join(linked.select(small_key).hint("merge"), small_key, "left_anti")
    pairs = _joined(small, small_key, big, big_key, 0.0).withColumns({"aa": area(F.col("a_geom")), "ab": area(F.col("b_geom"))}).where(F.col("ab") >= RATIO * F.col("aa"))
    ok = pairs.withColumn("share", F.round(shared(F.col("a_geom"), F.col("b_geom")) / F.col("aa"), 9)).where(F.col("share") >= SHARE)
    best = F.min_by(F.struct("b_key", "share"), F.struct(-F.col("share"), F.col("b_key")))
    return ok.groupBy("a_key").agg(best.alias("best")).select(F.col("a_key").alias(small_key), F.col("best.b_key").alias(big_key), "best.share")


def join_points(points: DataFrame, point_key: str, parcels: DataFrame, parcel_key: str, most: float = 3.0) -> DataFrame:
    """(point, parcel, dist): the parcel a point (px, py) lies inside, else the nearest within `most`. Ties as in harmonise.join_points."""
    at = points.select(F.col(point_key).alias("key"), "px", "py").withColumns({"x1": F.col("px"), "y1": F.col("py"), "x2": F.col("px"), "y2": F.col("py")})
    pairs = join_boxes(at, enveloped(parcels.select(F.col(parcel_key).alias("key"), "geom")), most)
    x, y, geom = F.col("a_px"), F.col("a_py"), F.col("b_geom")
    pairs = pairs.select("a_key", "b_key", inside(geom, x, y).alias("within"), F.round(to_outline(geom, x, y), 9).alias("gap"))
    pairs = pairs.withColumn("within", F.col("within") & (F.col("gap") > 0)).withColumn("dist", F.when(F.col("within"), F.lit(0.0)).otherwise(F.col("gap"))).where("within or dist <= " + str(float(most)))
    best = F.min_by(F.struct("b_key", "dist"), F.struct(~F.col("within"), "dist", F.when(F.col("within"), -F.col("b_key")).otherwise(F.col("b_key"))))
    return pairs.groupBy("a_key").agg(best.alias("best")).select(F.col("a_key").alias(point_key), F.col("best.b_key").alias(parcel_key), "best.dist")


def cover(a: DataFrame, a_key: str, b: DataFrame) -> DataFrame:
    """(a_key, area, covered): how much of each polygon of `a` the union of `b` covers; covers may overlap one another."""
    pairs = _joined(a, a_key, b.withColumn("key_", F.lit(0)), "key_", 0.0)
    by = covered(pairs.groupBy("a_key").agg(F.first("a_geom").alias("g"), F.collect_list("b_geom").alias("covers")))
    whole = a.select(F.col(a_key), area(F.col("geom")).alias("area"))
    return whole.join(by.hint("merge"), whole[a_key] == by["a_key"], "left").select(a_key, "area", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def encroaching(shapes: DataFrame, key: str, reserve: DataFrame, least: float = 5.0, share: float = 0.10) -> DataFrame:
    """Shapes of which the reserve's union takes more than `least` m2 and `share` of their area."""
    found = cover(shapes, key, reserve).where((F.col("covered") > least) & (F.col("covered") / F.col("area") > share))
    return found.select(key, F.round("covered", 1).alias("overlap_m2"), F.round(F.col("covered") / F.col("area"), 3).alias("share"))


def confirmed(flags: DataFrame, key: str, others: DataFrame) -> DataFrame:
    """Flags (key, geom, ...) with whether a polygon of another source meets them."""
    near = _joined(flags, key, others.withColumn("key_", F.lit(0)), "key_", 0.0).where(distance(F.col("a_geom"), F.col("b_geom")) <= 0)
    hit = near.select(F.col("a_key").alias(key)).distinct().withColumn("confirmed", F.lit(True))
    return flags.join(hit.hint("merge"), key, "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))


def apart_from(new: DataFrame, key: str, layer: DataFrame, keep: float = 1.5) -> DataFrame:
    """Polygons that stay more than `keep` away from every one of a layer."""
    near = _joined(new, key, layer.withColumn("key_", F.lit(0)), "key_", keep).where(distance(F.col("a_geom"), F.col("b_geom")) <= keep).select(F.col("a_key").alias(key)).distinct()
    return new.join(near.hint("merge"), key, "left_anti")


def near_box(layer: DataFrame, box: DataFrame, most: float = 5.0) -> DataFrame:
    """Polygons that meet a box (x1, y1, x2, y2; one row) grown by `most` on every side."""
    x1, y1, x2, y2 = (F.col(f"b_{c}") for c in ("x1", "y1", "x2", "y2"))
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    grown = box.select(*[(F.col(c) + d * most).alias(f"b_{c}") for c, d in (("x1", -1), ("y1", -1), ("x2", 1), ("y2", 1))])
    frame = F.array(F.array(corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2)))
    met = enveloped(layer).crossJoin(F.broadcast(grown)).where((F.col("x1") <= x2) & (F.col("x2") >= x1) & (F.col("y1") <= y2) & (F.col("y2") >= y1))  # one row
    return met.where(distance(F.col("geom"), frame) <= 0).select(*layer.columns)


def reserve(roads: DataFrame, key: str, half: str) -> DataFrame:
    """(key, piece, geom): lines (array of x, y) widened by `half` on either side with flat ends; pieces of one road may overlap."""
    ship()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(k, n, geom_of(p)) for k, line, h in zip(df[key], df["line"], df[half], strict=True) for n, p in enumerate(kernel.widened(rings([line])[0] if len(line) else np.zeros((0, 2)), h))]
            yield pd.DataFrame(rows, columns=[key, "piece", "geom"])

    return roads.select(key, "line", half).mapInPandas(run, f"{key} {roads.schema[key].dataType.simpleString()}, piece int, geom {GEOM}")


def near_misses(layer: DataFrame, key: str, most: float = 0.3) -> DataFrame:
    """Pairs (i < j) of one layer that don't touch but are at most `most` apart."""
    pairs = _joined(layer, key, layer, key, most).where("a_key < b_key").withColumn("gap", distance(F.col("a_geom"), F.col("b_geom")))
    return pairs.where((F.col("gap") > 0) & (F.col("gap") <= most)).select(F.col("a_key").alias("i"), F.col("b_key").alias("j"), "gap")


def report(layer: DataFrame, key: str) -> DataFrame:
    """One row of counts: parcels, invalid shapes, and overlaps, near misses and slivers of what the shapes are once made valid."""
    from landlace.operators.topology import GAP, OVERLAP, SLIVER, THIN

    parts = settled(made_valid(layer, key))
    met = _joined(parts, key, parts, key, GAP).where("a_key < b_key")
    both = met.select("a_key", "b_key", shared(F.col("a_geom"), F.col("b_geom")).alias("overlap"), distance(F.col("a_geom"), F.col("b_geom")).alias("gap"))
    pairs = both.groupBy("a_key", "b_key").agg(F.sum("overlap").alias("overlap"), F.min("gap").alias("gap"))
    over, near = F.col("overlap") > OVERLAP, (F.col("gap") > 0) & (F.col("gap") <= GAP)
    a = pairs.agg(F.count_if(over).alias("overlaps"), F.coalesce(F.sum(F.when(over, F.col("overlap"))), F.lit(0.0)).alias("overlap_area_m2"), F.count_if(near).alias("near_miss_gaps"))
    own = parts.groupBy(key).agg(F.sum(area(F.col("geom"))).alias("m"), F.sum(perimeter(F.col("geom"))).alias("p"), F.min("was_valid").alias("ok"))
    thin = (F.col("m") > 0) & ((F.col("m") < SLIVER) | (F.when(F.col("p") > 0, 4 * math.pi * F.col("m") / (F.col("p") * F.col("p"))).otherwise(0.0) < THIN))
    b = layer.select(key).join(own, key, "left").agg(F.count("*").alias("parcels"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("invalid"), F.count_if(thin).alias("slivers"))
    return a.crossJoin(b)  # one row each


def union(shapes: DataFrame, by: str) -> DataFrame:
    """(by, piece, geom): the union of each group's polygons as pieces that don't overlap, one polygon after the other."""
    ship()

    schema = T.StructType([shapes.schema[by], *T._parse_datatype_string(f"piece int, geom {GEOM}").fields])
    arrow = to_arrow_schema(schema)

    def run(t: pa.Table) -> pa.Table:
        done: list = []
        for g in map(rings, t.column("geom").to_pylist()):
            left = [g]
            for q in done:
                left = [piece for r in left for piece in (kernel.difference(r, q) if kernel.shared(r, q) > 1e-9 else [r])]
            done += left
        name = t.column(by)[0].as_py()
        return pa.Table.from_pylist([{by: name, "piece": n, "geom": geom_of(p)} for n, p in enumerate(done)], arrow)

    return shapes.select(by, "geom").groupBy(by).applyInArrow(run, schema)


def read_back(layer: DataFrame, key: str, back: DataFrame) -> DataFrame:
    """One row: shapes that came back, and the largest Hausdorff distance between a shape and its copy."""
    both = layer.select(key, F.col("geom").alias("g")).join(back.select(key, F.col("geom").alias("h")), key)
    return both.agg(F.count("*").alias("shapes"), F.max(hausdorff(F.col("g"), F.col("h"))).alias("max_hausdorff_m"))


def pair_features(a: DataFrame, b: DataFrame, radius: float = 30.0) -> DataFrame:
    """Candidate pairs at most `radius` apart, with all features. a: a_id, geom; b: b_id, geom."""
    pairs = join_boxes(enveloped(a.select("a_id", "geom")), enveloped(b.select("b_id", "geom")), radius).withColumn("m", measures(F.col("a_geom"), F.col("b_geom")))
    pairs = pairs.select("a_id", "b_id", "m.*").where(F.col("dist") <= radius)
    inter, aa, ab, tiny = F.col("inter"), F.col("area_a"), F.col("area_b"), F.lit(TINY)
    out = pairs.select(
        "a_id", "b_id", (inter / F.greatest(aa + ab - inter, tiny)).alias("iou"), (inter / F.greatest(aa, tiny)).alias("inter_over_a"), (inter / F.greatest(ab, tiny)).alias("inter_over_b"), "centroid_dist",
        (F.least(aa, ab) / F.greatest(aa, ab, tiny)).alias("area_ratio"), (F.col("hausdorff") / F.sqrt(F.greatest(aa, tiny))).alias("hausdorff_norm"),
    )
    return placed(out)


def made_valid(layer: DataFrame, key: str) -> DataFrame:
    """(key, part, geom, was_valid): each shape's valid polygons; repairs by the even-odd rule."""
    ship()

    schema = T.StructType([layer.schema[key], *T._parse_datatype_string(f"part int, geom {GEOM}, was_valid boolean").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, g in zip(b.column(key).to_pylist(), b.column("geom").to_pylist(), strict=True):
                own = rings(g)
                ok = kernel.valid(own)
                rows += [(k, i, geom_of(part), ok) for i, part in enumerate([own] if ok else kernel.made_valid(own) if own and len(own[0]) >= 3 else [])]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow)

    return layer.select(key, "geom").mapInArrow(run, schema)


def overlaps(layer: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Pairs (i < j) of one layer whose polygons share more than `least`."""
    own = enveloped(layer.select(F.col(key).alias("key"), "geom"))
    pairs = join_boxes(own, own, 0.0).where("a_key < b_key").where(boxes.shared("a_", "b_") > least)
    found = pairs.withColumn("m", measures(F.col("a_geom"), F.col("b_geom"))).select(F.col("a_key").alias("i"), F.col("b_key").alias("j"), F.col("m.inter").alias("overlap"))
    return found.where(F.col("overlap") > least)


def repair(layer: DataFrame, key: str, priority: str, least: float = 0.5, fragment: float = 2.0, labels: DataFrame | None = None) -> DataFrame:
    """(key, geom, action): overlaps cut away, largest first, from the shape of lower priority (equal: the later key); fragments dropped.

    Only shapes that overlap others matter to one another, so each connected group of overlaps is mended on its own, in order;
    `labels` (key, part) may give the groups, else they are found by passing on the smallest key.
    """
    ship()
    parts = made_valid(layer, key).groupBy(key).agg(F.collect_list("geom").alias("parts"), F.min("was_valid").alias("was_valid")).join(layer.select(key, priority), key)
    single = parts.select(key, F.element_at("parts", 1).alias("geom")).where(F.col("geom").isNotNull())
    pairs = settled(overlaps(single, key, least))
    if labels is None:
        labels = least_of_component(layer.select(F.col(key).alias("id")), pairs.select(F.col("i").alias("x"), F.col("j").alias("y"))).select(F.col("id").alias(key), "part")
    grouped = parts.join(labels, key).withColumn("pr", F.col(priority).cast("double")).select(key, "part", "parts", "pr", "was_valid")
    own = pairs.join(labels, F.col("i") == F.col(key)).select(F.col("part").alias("part"), "i", "j", "overlap")  # an alias: both sides of the cogroup come from the labels

    schema = T.StructType([layer.schema[key], *T._parse_datatype_string(f"piece int, geom {GEOM}, action string").fields])
    arrow = to_arrow_schema(schema)

    def mend(shapes: pa.Table, found: pa.Table) -> pa.Table:
        own = shapes.to_pylist()
        regions = {r[key]: [rings(g) for g in r["parts"]] for r in own}
        rank, action = {r[key]: r["pr"] for r in own}, {r[key]: "" if r["was_valid"] else "made valid" for r in own}
        for _, i, j in sorted((-r["overlap"], r["i"], r["j"]) for r in found.to_pylist()):
            win, lose = (i, j) if rank[i] >= rank[j] else (j, i)
            cut = regions[lose]
            for w in regions[win]:
                cut = [piece for p in cut for piece in (kernel.difference(p, w) if kernel.shared(p, w) > 1e-9 else [p])]
            if cut:
                regions[lose], action[lose] = cut, "trimmed overlap"
        rows = []
        for k, region in regions.items():
            big = [p for p in region if kernel.area(p) >= fragment] or sorted(region, key=kernel.area)[-1:]
            rows += [{key: k, "piece": n, "geom": geom_of(p), "action": action[k]} for n, p in enumerate(big)]
        return pa.Table.from_pylist(rows, arrow)

    return grouped.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(mend, schema)
