"""One record for each parcel from several registers, with conflicts and a confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlace.functions import boxes, strings
from landlace.operators.spatial_join import as_boxes, join_boxes
from landlace.workers import settled

#: Square metres in a unit.
UNITS = {"square metre": 1.0, "square foot": 0.09290304, "square yard": 0.83612736, "cent": 40.468564, "ground": 222.967, "acre": 4046.8564, "hectare": 10000.0}


@dataclass(frozen=True)
class Rules:
    """Numbers that a department may set."""

    area_tolerance: float = 0.15
    owner_min: float = 0.80
    cadastral: float = 0.97
    revenue: float = 0.92
    bonus: float = 0.02
    clean: float = 1.0
    repaired: float = 0.9
    unresolved: float = 0.6
    penalty: float = 0.10
    floor: float = 0.60
    high: float = 85.0
    medium: float = 60.0


def area_unit(rows: DataFrame, recorded: str, surveyed: str) -> DataFrame:
    """One row: the unit whose size is nearest, in logarithms, to the median of surveyed over recorded areas."""
    ok = rows.where((F.col(recorded) > 0) & (F.col(surveyed) > 0))
    seen = ok.agg(F.percentile(F.col(surveyed) / F.col(recorded), F.lit(0.5)).alias("ratio"), F.count("*").alias("parcels_used"))
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(v).alias("size")) for u, v in UNITS.items()])
    far = lambda x: F.abs(F.ln(x["size"] / F.col("ratio")))
    best = F.array_min(F.transform(units, lambda x: F.struct(far(x).alias("far"), x["unit"].alias("unit"), x["size"].alias("size"))))
    return seen.withColumn("best", best).select(
        F.col("best.unit").alias("unit"), F.round("ratio", 4).alias("m2_per_unit_observed"), F.col("best.size").alias("m2_per_unit_expected"),
        F.round(F.abs(F.col("best.size") - F.col("ratio")) / F.col("best.size"), 4).alias("relative_error"), "parcels_used",
    )


def join_points(points: DataFrame, point_key: str, parcels: DataFrame, parcel_key: str, most: float = 3.0) -> DataFrame:
    """(point, parcel, dist): the parcel a point lies inside, else the nearest within `most`; a point on an outline isn't inside.

    Ties go to the larger parcel key inside, to the smaller one outside.
    """
    pairs = join_boxes(as_boxes(points.withColumnRenamed(point_key, "key"), "px", "py"), parcels.withColumnRenamed(parcel_key, "key"), most)
    x, y = F.col("a_px"), F.col("a_py")
    inside = (x > F.col("b_x1")) & (x < F.col("b_x2")) & (y > F.col("b_y1")) & (y < F.col("b_y2"))
    pairs = pairs.select("a_key", "b_key", inside.alias("inside"), boxes.distance("a_", "b_").alias("dist")).where(F.col("inside") | (F.col("dist") <= most))
    best = F.min_by(F.struct("b_key", "dist"), F.struct(~F.col("inside"), "dist", F.when(F.col("inside"), -F.col("b_key")).otherwise(F.col("b_key"))))
    return pairs.groupBy("a_key").agg(best.alias("best")).select(F.col("a_key").alias(point_key), F.col("best.b_key").alias(parcel_key), "best.dist")


def confidence(spatial: Column, has_revenue: Column, has_tax: Column, topology: Column, conflicts: Column, r: Rules = Rules()) -> dict[str, Column]:  # noqa: B008
    """confidence (0 to 100, half to even), band (on the unrounded score) and the factors."""
    source = F.when(has_revenue, F.lit((r.cadastral + r.revenue) / 2)).otherwise(F.lit(r.cadastral))
    source = F.when(has_tax, F.least(F.lit(1.0), source + r.bonus)).otherwise(source)
    topo = F.when(topology == "repaired", F.lit(r.repaired)).when(topology == "unresolved", F.lit(r.unresolved)).otherwise(F.lit(r.clean))
    attr = F.greatest(F.lit(r.floor), 1 - F.lit(r.penalty) * conflicts)
    score = 100 * spatial * source * topo * attr
    band = F.when(score >= r.high, "High").when(score >= r.medium, "Medium").otherwise("Low")
    return {"confidence": F.bround(score).cast("long"), "band": band, "spatial": F.round(spatial, 3), "source": F.round(source, 3), "topology": topo, "attributes": F.round(attr, 2)}


def harmonise(parcels: DataFrame, links: DataFrame, revenue: DataFrame, tax: DataFrame, topology: DataFrame | None = None, revenue_unit: str = "cent", tax_unit: str = "square foot", r: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One record for each parcel.

    parcels: a_id, x1..y2, owner, land_use; links: a_id, b_id, p (accepted ones); revenue: b_id, patta_no, pattadar, extent, classfn,
    sf_no; tax: a_id, tax_id, assessee, plinth_sqft, usage; topology: a_id, state. Joins and case expressions only.
    """
    by_p = Window.partitionBy("a_id").orderBy(F.col("p").desc(), "b_id")
    ranked = links.withColumns({"place": F.row_number().over(by_p), "n_a": F.count("*").over(Window.partitionBy("b_id"))})
    ranked = settled(ranked.select("a_id", "b_id", "p", "place", "n_a"))  # read twice below; what makes the links runs once
    lists = ranked.groupBy("a_id").agg(F.count("*").alias("n_links"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "b_id"))), lambda x: x["b_id"].cast("string")), ",").alias("revenue_ids"))
    best = ranked.where("place = 1").select("a_id", "b_id", "p", "n_a").join(lists, "a_id").join(revenue, "b_id")
    first_tax = tax.groupBy("a_id").agg(F.min_by(F.struct("assessee", "plinth_sqft", "usage", "tax_id"), "tax_id").alias("t"))
    rec = parcels.join(best, "a_id", "left").join(first_tax, "a_id", "left")
    rec = rec.join(topology, "a_id", "left") if topology is not None else rec.withColumn("state", F.lit("clean"))
    linked, has_tax = F.col("b_id").isNotNull(), F.col("t").isNotNull()
    surveyed = boxes.area()
    rec = rec.withColumns({
        "link_type": F.when(~linked, "unmatched").when((F.col("n_links") == 1) & (F.col("n_a") == 1), "1:1").when(F.col("n_links") > 1, "split").otherwise("merge"),
        "surveyed": surveyed, "lu_revenue": strings.land_use(F.col("classfn")), "lu_tax": strings.land_use(F.col("t.usage")),
        "recorded_area_m2": F.round(F.col("extent") * UNITS[revenue_unit], 1), "plinth_area_m2": F.round(F.col("t.plinth_sqft") * UNITS[tax_unit], 1),
    })
    merge = F.col("link_type") == "merge"
    rec = rec.withColumn("recorded_area_m2", F.when(F.col("link_type") == "1:1", F.col("recorded_area_m2")))
    diff = (F.col("recorded_area_m2") - F.col("surveyed")) / F.col("surveyed")
    record_owner = F.when(linked, F.col("pattadar")).otherwise(F.col("owner"))
    rec = rec.withColumns({
        "c_area": F.coalesce(F.abs(diff) > r.area_tolerance, F.lit(False)),
        "c_use_revenue": F.coalesce(linked & ~merge & (F.col("lu_revenue") != F.col("land_use")), F.lit(False)),
        "c_use_tax": F.coalesce(has_tax & (F.col("lu_tax") != F.col("land_use")), F.lit(False)),
        "c_owner_tax": F.coalesce(has_tax & (strings.owner_similarity(F.when(merge, F.col("owner")).otherwise(record_owner), F.col("t.assessee")) < r.owner_min), F.lit(False)),
        "c_owner_revenue": F.coalesce(linked & ~merge & (strings.owner_similarity(F.col("pattadar"), F.col("owner")) < r.owner_min), F.lit(False)),
    })
    kinds = F.filter(F.array(F.when(F.col("c_area"), "area"), F.when(F.col("c_use_revenue") | F.col("c_use_tax"), "land_use"), F.when(F.col("c_owner_tax") | F.col("c_owner_revenue"), "owner")), lambda x: x.isNotNull())
    rec = rec.withColumn("conflicts", kinds).withColumn("n_conflicts", F.size("conflicts").cast("long"))
    spatial = F.when(linked, F.col("p")).otherwise(F.lit(0.0))
    return rec.select(
        F.col("a_id").alias("parcel_id"), "link_type", "revenue_ids", "patta_no", record_owner.alias("owner"), F.col("sf_no").alias("survey_no"), F.round("surveyed", 1).alias("surveyed_area_m2"), "recorded_area_m2",
        F.round(100 * diff, 1).alias("area_diff_pct"), F.when(linked, F.col("lu_revenue")).otherwise(F.col("land_use")).alias("land_use"), F.col("t.tax_id").alias("assessment_no"), "plinth_area_m2",
        F.concat_ws(",", F.lit("cadastral"), F.when(linked, "revenue"), F.when(has_tax, "municipal_tax")).alias("sources"), F.array_join("conflicts", ";").alias("conflicts"), "n_conflicts",
        *[c.alias(n) for n, c in confidence(spatial, linked, has_tax, F.coalesce("state", F.lit("clean")), F.col("n_conflicts"), r).items()],
    )


def conflict_scores(found: DataFrame, truth: DataFrame, kinds: tuple[str, ...] = ("owner", "area", "land_use")) -> DataFrame:
    """(type, injected, flagged, correct, precision, recall) of conflicts (parcel_id, type) for each kind; 1 where there is nothing to divide by."""
    own = lambda df, n: df.select("parcel_id", "type").distinct().withColumn(n, F.lit(1))
    both = own(found, "f").join(own(truth, "t"), ["parcel_id", "type"], "full")
    by = both.groupBy("type").agg(F.count("t").alias("injected"), F.count("f").alias("flagged"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("correct"))
    every = found.sparkSession.createDataFrame([(k,) for k in kinds], "type string").join(by, "type", "left").fillna(0, ["injected", "flagged", "correct"])
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(1.0))
    return every.withColumns({"precision": share("correct", "flagged"), "recall": share("correct", "injected")})
