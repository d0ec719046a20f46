"""Layers with known errors, registers with known conflicts, and a later date with known change, for trials.

Draws are hashes of the seed, the row's key and the draw's name: the same on every run and any number of machines. Draws and
joins are columns; only outlines are made in numpy, over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlace.functions import kernel
from landlace.operators.harmonise import UNITS
from landlace.operators.polygons import GEOM, area, enveloped, geom_of, rings
from landlace.operators.spatial_join import join_boxes, nearest
from landlace.plans.fixtures import FIRST, LAST
from landlace.workers import settled, ship

#: Shares of the kinds of error, and how large errors are (metres, degrees, ratio of areas).
MIX = {"clean": 0.38, "offset": 0.16, "scale": 0.10, "rotate": 0.06, "split": 0.08, "merge": 0.06, "missing": 0.08}
RANGES = {"offset": (3.0, 8.0), "rotate": (5.0, 15.0), "scale_low": (0.65, 0.85), "scale_high": (1.15, 1.4)}
USES = ("Residential", "Commercial", "Mixed")
CODES = {"Residential": ("natham", "Res", "R"), "Commercial": ("Com", "shop", "business"), "Mixed": ("mix", "M", "res cum com")}


@dataclass(frozen=True)
class Trial:
    """Cadastral layer a (a_id, owner, error_type, geom), revenue layer b (b_id, ...), and the true links."""

    a: DataFrame
    b: DataFrame
    truth: DataFrame


def draw(seed: int, key: str | Column, name: str) -> Column:
    """Uniform in [0, 1)."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(F.lit(seed), key, F.lit(name)), F.lit(1 << 40)) / float(1 << 40)


def between(u: Column, low: float, high: float) -> Column:
    return low + u * (high - low)


def pick(u: Column, options) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(u * len(options)) + 1).cast("int"))


def mixed(u: Column, mix: dict[str, float]) -> Column:
    """A kind by its share; shares are brought to a total of one."""
    total, at, out = sum(mix.values()), 0.0, None
    for kind, share in mix.items():
        at += share / total
        out = F.when(u < at, kind) if out is None else out.when(u < at, kind)
    return out.otherwise(list(mix)[-1])


def person(seed: int, key: str | Column, name: str = "person") -> Column:
    return F.concat_ws(" ", pick(draw(seed, key, name + "1"), FIRST.split(",")), pick(draw(seed, key, name + "2"), LAST.split(",")))


def variant(owner: Column, seed: int, key: str | Column, name: str = "variant") -> Column:
    """The same person's name written otherwise: initial, order, case, or two letters changed about."""
    first, last, kind = F.substring_index(owner, " ", 1), F.substring_index(owner, " ", -1), draw(seed, key, name)
    at = (F.floor(draw(seed, key, name + "at") * (F.length(owner) - 3)) + 2).cast("int")
    typo = F.concat(F.substr(owner, F.lit(1), at - 1), F.substr(owner, at + 1, F.lit(1)), F.substr(owner, at, F.lit(1)), F.substr(owner, at + 2))
    own = F.when(kind < 0.2, F.concat(F.substring(first, 1, 1), F.lit(". "), last)).when(kind < 0.4, F.concat(last, F.lit(", "), first)).when(kind < 0.6, F.upper(owner)).when(kind < 0.8, F.concat_ws(" ", last, first)).otherwise(typo)
    return F.when(F.length(owner) < 5, owner).otherwise(own)


def partners(shapes: DataFrame, wanted: Column, reach: float = 40.0) -> DataFrame:
    """(i, j): shapes that want a partner with the nearest free one, no shape twice: mutually best pairs, round by round.

    shapes: key, x, y and whatever `wanted` looks at.
    """
    near = nearest(shapes.where(wanted).select("key", "x", "y"), "key", shapes.select(F.col("key").alias("other"), "x", "y"), "other", reach, k=8).where("a_key <> b_key")
    left = settled(near.select(F.least("a_key", "b_key").alias("i"), F.greatest("a_key", "b_key").alias("j"), "dist").distinct().withColumn("rank_", F.struct("dist", "i", "j")))
    out = None
    while not left.isEmpty():
        ends = left.select(F.col("i").alias("n"), "rank_").union(left.select(F.col("j").alias("n"), "rank_")).groupBy("n").agg(F.min("rank_").alias("best"))
        now = settled(left.join(ends.select(F.col("n").alias("i"), F.col("best").alias("bi")), "i").join(ends.select(F.col("n").alias("j"), F.col("best").alias("bj")), "j").where("rank_ = bi and rank_ = bj").select("i", "j"))
        used = now.select(F.col("i").alias("n")).union(now.select(F.col("j").alias("n")))
        left = settled(left.join(used.withColumnRenamed("n", "i"), "i", "left_anti").join(used.withColumnRenamed("n", "j"), "j", "left_anti").select("i", "j", "dist", "rank_"))
        out = now if out is None else out.union(now)
    return out if out is not None else left.select("i", "j")


def _pieces(df: DataFrame) -> DataFrame:
    """(a_id, piece, geom, kind) of the revenue outlines: rows have geom, other (a partner's, or null), kind, angle, factor, dx, dy."""
    ship()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            rows = []
            for r in d.itertuples():
                poly = rings(r.geom)
                if r.kind == "merge":
                    parts = [[kernel.hull(np.concatenate([poly[0], rings(r.other)[0]]))]]
                elif r.kind == "split":
                    parts = kernel.halved(poly)
                else:
                    parts = [kernel.turned(poly, r.angle, r.factor, (r.dx, r.dy))]
                rows += [(r.a_id, i, geom_of(p), r.kind) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["a_id", "piece", "geom", "kind"])

    return df.mapInPandas(run, f"a_id long, piece int, geom {GEOM}, kind string")


def trial(layer: DataFrame, seed: int = 7, mix: dict[str, float] = MIX, spurious: float = 0.05, variants: float = 0.35, ranges: dict = RANGES) -> Trial:
    """layer: a_id (number), owner, geom. A revenue layer with errors of known kinds, links that are true, and some outlines nobody has."""
    r = {**RANGES, **ranges}
    own = settled(enveloped(layer.select("a_id", "owner", "geom")).withColumn("kind", mixed(draw(seed, "a_id", "kind"), mix)))
    places = own.select(F.col("a_id").alias("key"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), "kind")
    pairs = settled(partners(places, F.col("kind") == "merge"))
    second = pairs.select(F.col("j").alias("a_id"), F.col("i").alias("into"))
    first = pairs.join(own.select(F.col("a_id").alias("j"), F.col("geom").alias("other")), "j").select(F.col("i").alias("a_id"), F.col("j").alias("with_"), "other")
    joined = own.join(first, "a_id", "left").join(second, "a_id", "left")
    kind = F.when(F.col("with_").isNotNull() | F.col("into").isNotNull(), "merge").when(F.col("kind") == "merge", "clean").otherwise(F.col("kind"))
    u = lambda name: draw(seed, "a_id", name)
    far = F.when(F.col("kind") == "offset", between(u("far"), *r["offset"])).when(F.col("kind") == "scale", between(u("far"), 0.0, 1.5)).when(F.col("kind") == "rotate", between(u("far"), 1.0, 3.0)).otherwise(u("far"))
    way = 2 * np.pi * u("way")
    ratio = F.when(F.col("kind") != "scale", 1.0).when(u("up") < 0.5, between(u("ratio"), *r["scale_low"])).otherwise(between(u("ratio"), *r["scale_high"]))
    turn = F.when(F.col("kind") == "rotate", F.radians(between(u("turn"), *r["rotate"])) * F.when(u("left") < 0.5, -1).otherwise(1)).otherwise(F.lit(0.0))
    plan = settled(joined.withColumn("kind", kind).withColumns({"angle": turn.cast("double"), "factor": F.sqrt(ratio), "dx": far * F.cos(way), "dy": far * F.sin(way)}))
    made = _pieces(plan.where("into is null and kind <> 'missing'").select("a_id", "geom", "other", "kind", "angle", "factor", "dx", "dy"))
    b = made.join(own.select("a_id", "owner"), "a_id").select((F.col("a_id") * 4 + F.col("piece")).alias("b_id"), "a_id", "owner", F.col("kind").alias("error_type"), "geom")
    b = settled(b.withColumn("owner", F.when(draw(seed, "b_id", "written") < variants, variant(F.col("owner"), seed, "b_id")).otherwise(F.col("owner"))))
    truth = b.select("a_id", "b_id", "error_type").union(plan.where("into is not null").select("a_id", (F.col("into") * 4).alias("b_id"), F.lit("merge")))
    extra = own.where(u("extra") < spurious).withColumns({"far": between(u("xfar"), 25.0, 60.0), "way": 2 * np.pi * u("xway"), "w": between(u("xw"), 8.0, 18.0), "d": between(u("xd"), 8.0, 18.0)})
    cx, cy = (F.col("x1") + F.col("x2")) / 2 + F.col("far") * F.cos("way"), (F.col("y1") + F.col("y2")) / 2 + F.col("far") * F.sin("way")
    corner = lambda i, j: F.struct((cx + i * F.col("w") / 2).alias("x"), (cy + j * F.col("d") / 2).alias("y"))
    lost = extra.select((F.col("a_id") * 4 + 3).alias("b_id"), person(seed, "a_id", "stranger").alias("owner"), F.lit("spurious").alias("error_type"), F.array(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))).alias("geom"))
    return Trial(plan.select("a_id", "owner", F.col("kind").alias("error_type"), "geom"), b.drop("a_id").unionByName(lost), truth)


def defects(layer: DataFrame, key: str, rate: float, seed: int = 7) -> DataFrame:
    """The layer with a share of outlines damaged: two corners changed about (a bow-tie) or a thin spike."""
    shell = F.element_at("geom", 1)
    at = lambda i: F.element_at(shell, i)
    rest = F.slice(F.col("geom"), 2, F.size("geom"))
    bow = F.concat(F.array(at(1), at(3), at(2)), F.slice(shell, 4, F.size(shell)))
    tip = lambda dx, dy: F.struct((at(1)["x"] + dx).alias("x"), (at(1)["y"] + dy).alias("y"))
    spike = F.concat(F.array(at(1), tip(between(draw(seed, key, "spike"), 4.0, 8.0), 0.05), tip(F.lit(0.0), 0.1)), F.slice(shell, 2, F.size(shell)))
    new = F.when(draw(seed, key, "how") < 0.6, bow).otherwise(spike)
    hit = (draw(seed, key, "defect") < rate) & (F.size(shell) >= 4)
    return layer.withColumns({"defect": hit, "geom": F.when(hit, F.concat(F.array(new), rest)).otherwise(F.col("geom"))})


def land_use(layer: DataFrame, key: str = "a_id", seed: int = 7) -> DataFrame:
    return layer.withColumn("land_use", mixed(draw(seed, key, "use"), dict(zip(USES, (0.7, 0.2, 0.1), strict=True))))


def _code(use: Column, u: Column) -> Column:
    return F.coalesce(*[F.when(use == k, pick(u, v)) for k, v in CODES.items()])


def _other_use(use: Column, u: Column) -> Column:
    return F.coalesce(*[F.when(use == k, pick(u, [x for x in USES if x != k])) for k in USES])


def revenue_register(t: Trial, uses: DataFrame, conflicts: float = 0.04, seed: int = 7) -> DataFrame:
    """Revenue records (b_id, patta_no, pattadar, extent in cents, classfn, sf_no) with flags of what was made to disagree."""
    linked = t.truth.join(t.a.select("a_id", area(F.col("geom")).alias("m2")), "a_id").groupBy("b_id").agg(F.sum("m2").alias("legal"), F.min("a_id").alias("a_id"))
    rows = t.b.select("b_id", "owner", area(F.col("geom")).alias("drawn")).join(linked, "b_id", "left").join(uses.select("a_id", "land_use"), "a_id", "left")
    u = lambda name: draw(seed, "b_id", name)
    known = F.col("a_id").isNotNull()
    flags = {f"bad_{c}": known & (u(c) < conflicts) for c in ("owner", "area", "land_use")}
    rows = rows.withColumns(flags)
    use = F.coalesce("land_use", pick(u("any"), USES))
    off = F.when(~F.col("bad_area"), 1.0).when(u("less") < 0.5, between(u("off"), 0.55, 0.75)).otherwise(between(u("off"), 1.3, 1.6))
    m2 = F.coalesce("legal", "drawn") * (1 + 0.03 * (u("survey") - 0.5)) * off
    return rows.select(
        "b_id", F.concat(F.lit("PT/"), F.col("b_id").cast("string")).alias("patta_no"), F.when(F.col("bad_owner"), person(seed, "b_id", "other")).otherwise(F.col("owner")).alias("pattadar"), F.round(m2 / UNITS["cent"], 3).alias("extent"),
        _code(F.when(F.col("bad_land_use"), _other_use(use, u("wrong"))).otherwise(use), u("code")).alias("classfn"), F.format_string("%d/%d", (1 + F.floor(u("sf") * 399)).cast("int"), (1 + F.floor(u("sub") * 19)).cast("int")).alias("sf_no"), *flags,
    )


def tax_register(a: DataFrame, uses: DataFrame, coverage: float = 0.9, conflicts: float = 0.04, seed: int = 7) -> DataFrame:
    """Tax records as points (tax_id, a_true, px, py, assessee, plinth_sqft, usage) near the middle of parcels, with flags."""
    rows = enveloped(a).join(uses.select("a_id", "land_use"), "a_id").where(draw(seed, "a_id", "taxed") < coverage)
    u = lambda name: draw(seed, "a_id", "tax" + name)
    rows = rows.withColumns({"bad_owner": u("owner") < conflicts, "bad_land_use": u("use") < conflicts})
    name = F.when(F.col("bad_owner"), person(seed, "a_id", "payer")).when(u("written") < 0.3, variant(F.col("owner"), seed, "a_id", "taxname")).otherwise(F.col("owner"))
    use = F.when(F.col("bad_land_use"), _other_use(F.col("land_use"), u("wrong"))).otherwise(F.col("land_use"))
    return rows.select(
        F.col("a_id").alias("tax_id"), F.col("a_id").alias("a_true"), ((F.col("x1") + F.col("x2")) / 2 + 3 * (u("x") - 0.5)).alias("px"), ((F.col("y1") + F.col("y2")) / 2 + 3 * (u("y") - 0.5)).alias("py"),
        name.alias("assessee"), F.round(area(F.col("geom")) / UNITS["square foot"] * (1 + 0.04 * (u("size") - 0.5))).alias("plinth_sqft"), _code(use, u("code")).alias("usage"), "bad_owner", "bad_land_use",
    )


def later(earlier: DataFrame, seed: int = 7, demolished: float = 0.04, new: float = 0.05, altered: float = 0.06) -> tuple[DataFrame, DataFrame]:
    """(layer, truth) of a later date: shapes gone, grown by a quarter to nine tenths, jittered, and new ones in open space.

    earlier: a_id (number), geom. later: later_id, geom; truth: earlier_id, later_id, change.
    """
    u = lambda name: draw(seed, "a_id", "later" + name)
    fate = F.when(u("fate") < demolished, "demolished").when(u("fate") < demolished + altered, "altered").otherwise("unchanged")
    rows = settled(enveloped(earlier.select("a_id", "geom")).withColumn("change", fate))
    first = F.element_at(F.element_at("geom", 1), 1)
    grow = F.when(F.col("change") == "altered", F.sqrt(between(u("grow"), 1.25, 1.9))).otherwise(F.lit(1.0))
    far, way = F.when(u("moved") < 0.1, between(u("far"), 1.5, 3.0)).otherwise(u("far")), 2 * np.pi * u("way")

    def place(p):
        return F.struct((first["x"] + (p["x"] - first["x"]) * grow + far * F.cos(way)).alias("x"), (first["y"] + (p["y"] - first["y"]) * grow + far * F.sin(way)).alias("y"))

    stay = rows.where("change <> 'demolished'").select((F.col("a_id") * 2).alias("later_id"), F.transform("geom", lambda ring: F.transform(ring, place)).alias("geom"))
    box = rows.agg(F.min("x1").alias("lx"), F.min("y1").alias("ly"), F.max("x2").alias("hx"), F.max("y2").alias("hy"), F.count("*").alias("n")).first()
    n = int(new * box["n"])
    tries = earlier.sparkSession.range(n * 40).withColumnsRenamed({"id": "t"})
    v = lambda name: draw(seed, "t", "new" + name)
    tries = tries.withColumns({"w": between(v("w"), 8.0, 16.0), "d": between(v("d"), 8.0, 16.0)})
    tries = tries.withColumns({"x1": box["lx"] + v("x") * (F.lit(box["hx"] - box["lx"]) - F.col("w")), "y1": box["ly"] + v("y") * (F.lit(box["hy"] - box["ly"]) - F.col("d"))}).withColumns({"x2": F.col("x1") + F.col("w"), "y2": F.col("y1") + F.col("d")})
    taken = join_boxes(tries.select(F.col("t").alias("key"), "x1", "y1", "x2", "y2"), rows.select(F.col("a_id").alias("key"), "x1", "y1", "x2", "y2"), 1.5).select(F.col("a_key").alias("t"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    free = tries.join(taken, "t", "left_anti").withColumn("place", F.row_number().over(Window.orderBy("t"))).where(F.col("place") <= n)
    fresh = free.select((F.col("t") * 2 + 1).alias("later_id"), F.array(F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))).alias("geom"))
    truth = rows.select(F.col("a_id").alias("earlier_id"), F.when(F.col("change") != "demolished", F.col("a_id") * 2).alias("later_id"), "change").union(fresh.select(F.lit(None).cast("long"), "later_id", F.lit("new")))
    return stay.union(fresh), truth
