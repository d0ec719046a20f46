"""Scores, estimates, harmonised records, logs, rasters, names, schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from landlace.functions import boxes, projection, strings
from landlace.operators import audit, estimates, harmonise, matching, raster, schema_match
from landlace.plans.name_sql import names
from landlace.plans.registry import query, table_query
from landlace.plans.spatial_queries import AREA_A, AREA_B, BUCKETS, D2, INTER, IN_PARCEL, predicted
from landlace.workers import settled

# --- decisions on scored pairs ---------------------------------------------------------------------------------------


@query("layer_a", "layer_b", "truth", more=f"""{BUCKETS}, tr as (select distinct a_id, b_id from truth), s as (select (select count(*) from pred where bucket = 'accept') as acc, (select count(*) from tr) as t, (select count(*) from pred join tr using (a_id, b_id) where bucket = 'accept') as tp,
  (select count(*) from pred join tr using (a_id, b_id) where bucket <> 'reject') as tp_any, (select count(distinct a_id) from pred where bucket = 'review') as rev, (select count(*) from layer_a) as n)""",
       sql="""select n as n_parcels, t as n_true_links, tp / greatest(acc, 1) as auto_precision, tp / greatest(t, 1) as auto_recall, tp_any / greatest(t, 1) as assisted_recall, rev / greatest(n, 1) as review_load,
  2 * (tp / greatest(acc, 1)) * (tp / greatest(t, 1)) / greatest(tp / greatest(acc, 1) + tp / greatest(t, 1), 1e-9) as auto_f1, 1 - rev / greatest(n, 1) as auto_resolved_share from s""")
def confusion_metrics(a, b, truth):
    return matching.evaluation(predicted(a, b).select("a_id", "b_id", "bucket"), truth, a)


@query("layer_a", "layer_b", "truth", more=BUCKETS, sql="select error_type, count(*) as n, avg(case when bucket = 'accept' then 1 else 0 end) as auto_recall, avg(case when bucket in ('accept', 'review') then 1 else 0 end) as assisted_recall from (select distinct * from truth) t left join pred using (a_id, b_id) group by error_type")
def recall_by_type(a, b, truth):
    return matching.recall_by_type(predicted(a, b), truth)


@query("layer_a", "layer_b", "truth", more=BUCKETS, sql="""select (select avg(case when a_id in (select a_id from pred where bucket = 'accept') then 1 else 0 end) from layer_a where error_type = 'missing') as missing_false_link_rate,
  (select coalesce(avg(hit), 0) from (select b_id, max(case when bucket = 'accept' then 1 else 0 end) as hit from pred where b_id in (select b_id from truth where error_type = 'nudged') group by b_id) t) as spurious_false_link_rate""")
def false_link_rates(a, b, truth):
    return matching.false_link_rates(predicted(a, b), a, truth.where("error_type = 'nudged'").select("b_id"))


SCORED = "select quality as y, (n_chars % 64) / 64.0 as p from labels join documents using (doc_id)"


def scored(labels, documents):
    return labels.join(documents.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("y"), ((F.col("n_chars") % 64) / 64.0).alias("p"))


PD_EDGES = (0.0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0)


@table_query("labels", "documents", sql=f"with s as ({SCORED}) select greatest({' + '.join(f'(case when p > {e} then 1 else 0 end)' for e in PD_EDGES)} - 1, 0) as bin, count(*) as n, avg(p) as mean_p, avg(cast(y as double)) as share_true from s group by 1")
def calibration_pd(labels, documents):
    return matching.calibration(scored(labels, documents), PD_EDGES, right_closed=True)


EDGES = tuple(i * 0.1 for i in range(11))


@table_query("labels", "documents", sql=f"with s as ({SCORED}) select least({' + '.join(f'(case when p >= cast({e!r} as double) then 1 else 0 end)' for e in EDGES)} - 1, 9) as bin, count(*) as n, avg(p) as mean_p, avg(cast(y as double)) as share_true from s group by 1")
def calibration_edges(labels, documents):
    return matching.calibration(scored(labels, documents), EDGES, right_closed=False)


_T = f"""s as ({SCORED}), g as (select p, count(*) as n, sum(y) as t from s group by p), r as (select p, sum(n) over (order by p desc) as n, sum(t) over (order by p desc) as t from g),
  h as (select coalesce(min(p), 1.01) as t_high from r where n >= 20 and t / n >= 0.87), l as (select quantile_cont(p, 0.01) as q from s where y = 1), th as (select cast(case when q is null then 0 else least(q, 0.5, t_high) end as double) as t_low, cast(t_high as double) as t_high from h, l)"""


@table_query("labels", "documents", sql=f"with {_T} select round(t_low, 9) as t_low, t_high from th")
def choose_thresholds(labels, documents):
    return matching.thresholds(scored(labels, documents), 0.87, 0.01).withColumn("t_low", F.round("t_low", 9))


@table_query("labels", "documents", sql=f"with s as ({SCORED}) select case when p >= 0.75 then 'accept' when p < 0.25 then 'reject' else 'review' end as bucket, count(*) as n, avg(cast(y as double)) as share_true from s group by 1")
def threshold_buckets(labels, documents):
    return scored(labels, documents).groupBy(matching.bucket(F.col("p"), 0.25, 0.75).alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("share_true"))


@query("layer_a", "layer_b", more=BUCKETS, sql="select a_id, b_id, case when area_ratio >= 0.9 or iou >= 0.5 then 'accept' when area_ratio < 0.3 then 'reject' else 'review' end as bucket, case when area_ratio >= 0.9 then 'model' when iou >= 0.5 then 'overlap' else '' end as why from pred")
def combined_rule(a, b):
    own, why = matching.combined(F.col("area_ratio"), F.col("iou"), 0.3, 0.9)
    return predicted(a, b).select("a_id", "b_id", own.alias("bucket"), why.alias("why"))


_BLOCK = "blk as (select a_id, cast(floor(((x1 + x2) / 2 - (select min((x1 + x2) / 2) from layer_a)) / 150) as bigint) as bi, cast(floor(((y1 + y2) / 2 - (select min((y1 + y2) / 2) from layer_a)) / 150) as bigint) as bj from layer_a)"


@query("layer_a", more=_BLOCK, sql="select a_id, bi, bj from blk")
def spatial_blocks(a):
    x, y = boxes.centre()
    return matching.blocks(a, x, y).select("a_id", "bi", "bj")


@query("layer_a", more=f"""{_BLOCK}, u as (select distinct bi, bj, (bi * 7919 + bj * 104729) % 1009 as draw from blk), k as (select *, row_number() over (order by draw, bi, bj) as place, count(*) over () as n from u),
  ro as (select bi, bj, case when place <= least(greatest(1, round(0.5 * n)), greatest(n - 1, 1)) then 'train' when place <= greatest(1, round(0.5 * n)) + greatest(1, round(0.2 * n)) and place < n then 'calib' else 'test' end as role from k)""",
       sql="select a_id, role from blk join ro using (bi, bj)")
def fold_assignment(a):
    x, y = boxes.centre()
    return matching.roles(matching.blocks(a, x, y), (F.col("bi") * 7919 + F.col("bj") * 104729) % 1009).select("a_id", "role")


@query("layer_a", "layer_b", more=f"""{BUCKETS}, pool as (select a_id, b_id, area_ratio as p, case when area_ratio >= 0.2 and area_ratio < 0.5 then 0 when area_ratio >= 0.5 and area_ratio < 0.8 then 1 when area_ratio >= 0.8 and area_ratio < 1.01 then 2 end as stratum from pred),
  k as (select *, row_number() over (partition by stratum order by (a_id * 7919 + b_id * 104729) % 10007, a_id * 1000000 + b_id) as place from pool where stratum is not null)""", sql="select a_id, b_id, stratum, place from k where place <= case stratum when 0 then 40 when 1 then 50 else 60 end")
def stratified_sample(a, b):
    pairs = predicted(a, b).withColumn("key", F.col("a_id") * 1000000 + F.col("b_id"))
    return estimates.stratified(pairs, "area_ratio", [(0.2, 0.5, 40), (0.5, 0.8, 50), (0.8, 1.01, 60)], (F.col("a_id") * 7919 + F.col("b_id") * 104729) % 10007, "key").select("a_id", "b_id", "stratum", "place")


# --- estimates -------------------------------------------------------------------------------------------------------

_LAST = "lastl as (select pair_id, arg_max(label, seq) as label from labels_log group by pair_id), ck as (select s.*, l.label, cast(t.population as double) / t.sampled as weight from sample s join lastl l using (pair_id) join strata t using (stratum) where label in ('same', 'different'))"

@table_query("labels", sql="""with g as (select doc_id % 10 as grp, cast(sum(quality) as double) as k, cast(count(*) as double) as n from labels group by 1), w as (select *, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) as c, 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) as h from g)
  select grp, cast(k as bigint) as k, cast(n as bigint) as n, round(greatest(0.0, c - h), 9) as low, round(least(1.0, c + h), 9) as high from w""")
def wilson_interval(labels):
    g = labels.groupBy((F.col("doc_id") % 10).alias("grp")).agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = estimates.wilson(F.col("k"), F.col("n"))
    return g.select("grp", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def _rule(name: str, cond: str) -> str:
    return f"""select '{name}' as rule, sum(case when ({cond}) and label = 'same' then weight else 0 end) as tp, sum(case when ({cond}) and label <> 'same' then weight else 0 end) as fp, sum(case when not ({cond}) and label = 'same' then weight else 0 end) as fn,
  cast(count_if(({cond}) and label = 'same') as double) as k, cast(count_if({cond}) as double) as n from ck"""


@query("sample", "labels_log", "strata", more=f"{_LAST}, r as ({_rule('model', 'p >= 0.9')} union all {_rule('model_or_review', 'p >= 0.3')} union all {_rule('overlap', 'iou >= 0.5')} union all {_rule('combined', 'p >= 0.9 or iou >= 0.5')}), w as (select *, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) as c, 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) as h from r)",
       sql='select rule, round(tp / (tp + fp), 9) as "precision", round(tp / (tp + fn), 9) as recall, round(greatest(0.0, c - h), 9) as low, round(least(1.0, c + h), 9) as high, cast(n as bigint) as n_predicted from w')
def stratified_precision(sample, labels, strata):
    p, iou = F.col("p"), F.col("iou")
    out = estimates.weighted(estimates.checked(sample, labels, strata), {"model": p >= 0.9, "model_or_review": p >= 0.3, "overlap": iou >= 0.5, "combined": (p >= 0.9) | (iou >= 0.5)})
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "low", "high")})


@query("sample", "labels_log", "strata", more=f"{_LAST}, g as (select stratum, cast(count(*) as double) as n, avg(p) as mean_p, cast(count_if(label = 'same') as double) as k from ck group by stratum), w as (select *, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) as c, 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n) as h from g)",
       sql="select s.stratum, population, cast(coalesce(n, 0) as bigint) as labelled, round(mean_p, 9) as mean_p, round(k / n, 9) as share_same, round(greatest(0.0, c - h), 9) as low, round(least(1.0, c + h), 9) as high from strata s left join w using (stratum)")
def stratum_table(sample, labels, strata):
    out = estimates.by_stratum(estimates.checked(sample, labels, strata), strata)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_p", "share_same", "low", "high")})


@query("labels_log", more="l as (select pair_id, labeller, arg_max(label, seq) as label from labels_log group by 1, 2), g as (select pair_id, count(distinct label) as d from l group by 1 having count(*) >= 2)", sql="select count(*) as double_labelled, round(avg(case when d = 1 then 1 else 0 end), 9) as agreement from g")
def label_agreement(labels):
    return estimates.agreement(labels).withColumn("agreement", F.round("agreement", 9))


@query("labels_log", sql="select labeller, count(*) as n from labels_log group by 1")
def labeller_counts(labels):
    return labels.groupBy("labeller").agg(F.count("*").alias("n"))


@query("labels_log", sql="select secs as upper_median from (select secs, row_number() over (order by secs) as rn, count(*) over () as n from labels_log where secs is not null) t where rn = n // 2 + 1")
def upper_median(labels):
    return estimates.upper_median(labels, "secs")


@query("labels_log", sql="select pair_id, arg_max(label, seq) as label, max(seq) as seq from labels_log group by 1")
def latest_labels(labels):
    return estimates.latest(labels).select("pair_id", "label", "seq")


@table_query("lineitem", sql="select round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd from (select l_suppkey % 5 as seed, avg(l_quantity) as v from lineitem group by 1) t")
def seed_summary(lineitem):
    """Mean and population standard deviation over runs."""
    runs = lineitem.groupBy(F.col("l_suppkey") % 5).agg(F.avg("l_quantity").alias("v"))
    return runs.agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("sd"))


# --- registers -------------------------------------------------------------------------------------------------------

_CLEAN = "trim(regexp_replace(replace(lower({c}), '_', ' '), '[^a-z0-9 ]+', ' ', 'g'))"
_USE = lambda c: "case " + " ".join(f"when {_CLEAN.format(c=c)} = '{k}' then '{v}'" for k, v in strings.LAND_USE.items()) + " end"


_UNITS = ", ".join(f"('{u}', cast({v} as double))" for u, v in harmonise.UNITS.items())


@query("revenue", "layer_b", more=f"m as (select quantile_cont((x2 - x1) * (y2 - y1) / extent, 0.5) as ratio, count(*) as n from revenue join layer_b using (b_id) where extent > 0), u(unit, s) as (values {_UNITS}), b as (select unit, s, cast(ratio as double) as ratio, n, row_number() over (order by abs(ln(s / ratio))) as rn from u, m)",
       sql="select unit, round(ratio, 4) as m2_per_unit_observed, s as m2_per_unit_expected, round(abs(s - ratio) / s, 4) as relative_error, n as parcels_used from b where rn = 1")
def area_unit(revenue, b):
    return harmonise.area_unit(revenue.join(b.select("b_id", boxes.area().alias("surveyed")), "b_id"), "extent", "surveyed")


@query("revenue", sql=f"select b_id, classfn, {_USE('classfn')} as land_use from revenue")
def land_use_class(revenue):
    return revenue.select("b_id", "classfn", strings.land_use(F.col("classfn")).alias("land_use"))


@query("tax", sql="""select tax_id, cast(round_even(100 * sp * src * topo * attr, 0) as bigint) as confidence, case when 100 * sp * src * topo * attr >= 85 then 'High' when 100 * sp * src * topo * attr >= 60 then 'Medium' else 'Low' end as band from
  (select tax_id, (tax_id % 64) / 64.0 as sp, case when tax_id % 3 = 0 then least(1.0, (case when tax_id % 2 = 0 then (cast(0.97 as double) + 0.92) / 2 else 0.97 end) + cast(0.02 as double)) else (case when tax_id % 2 = 0 then (cast(0.97 as double) + 0.92) / 2 else 0.97 end) end as src,
   cast(case tax_id % 5 when 0 then 0.9 when 1 then 0.6 else 1.0 end as double) as topo, greatest(cast(0.6 as double), 1 - cast(0.1 as double) * (tax_id % 7)) as attr from tax) t""")
def confidence_score(tax):
    k = F.col("tax_id")
    topo = F.when(k % 5 == 0, "repaired").when(k % 5 == 1, "unresolved").otherwise("clean")
    own = harmonise.confidence((k % 64) / 64.0, k % 2 == 0, k % 3 == 0, topo, k % 7)
    return tax.select("tax_id", own["confidence"].alias("confidence"), own["band"].alias("band"))


def _records(a, b, revenue, tax):
    links = predicted(a, b).where("bucket = 'accept'").select("a_id", "b_id", F.round("iou", 6).alias("p"))
    use = F.when(F.col("a_id") % 10 < 7, "Residential").when(F.col("a_id") % 10 < 9, "Commercial").otherwise("Mixed")
    points = harmonise.join_points(tax, "tax_id", a, "a_id").join(tax.drop("a_true"), "tax_id")
    return harmonise.harmonise(a.withColumn("land_use", use), links, revenue, points)


_LINKS = "lk as (select a_id, b_id, round(iou, 6) as p, count(*) over (partition by b_id) as n_a, count(*) over (partition by a_id) as n_links, row_number() over (partition by a_id order by round(iou, 6) desc, b_id) as place from pred where bucket = 'accept')"
_RECORDS = f"""{BUCKETS}, {_LINKS}, pt as ({IN_PARCEL}), ft as (select a_id, min(tax_id) as tax_id from pt group by a_id), lists as (select a_id, string_agg(cast(b_id as varchar), ',' order by place) as revenue_ids from lk group by a_id),
  r0 as (select a.a_id, a.owner, case when a.a_id % 10 < 7 then 'Residential' when a.a_id % 10 < 9 then 'Commercial' else 'Mixed' end as own_use, (a.x2 - a.x1) * (a.y2 - a.y1) as surveyed, lk.b_id, lk.p, revenue_ids, patta_no, pattadar, extent, sf_no,
    {_USE("classfn")} as lu_revenue, ft.tax_id, assessee, plinth_sqft, {_USE("usage")} as lu_tax, case when lk.b_id is null then 'unmatched' when n_links = 1 and n_a = 1 then '1:1' when n_links > 1 then 'split' else 'merge' end as link_type
    from layer_a a left join lk on lk.a_id = a.a_id and place = 1 left join lists on lists.a_id = a.a_id left join revenue r on r.b_id = lk.b_id left join ft on ft.a_id = a.a_id left join tax on tax.tax_id = ft.tax_id),
  r1 as (select *, case when link_type = '1:1' then round(extent * 40.468564::double, 1) end as recorded, case when b_id is null then owner else pattadar end as record_owner, case when link_type = 'merge' or b_id is null then owner else pattadar end as tax_owner,
    b_id is not null and link_type <> 'merge' as sure from r0),
  {names("select tax_owner as oa, assessee as ob from r1 where tax_id is not null union all select pattadar, owner from r1 where sure")},
  r2 as (select r1.*, (recorded - surveyed) / surveyed as diff, coalesce(nt.owner_similarity < 0.8::double, false) or coalesce(sure and nr_.owner_similarity < 0.8::double, false) as c_owner from r1
    left join nm nt on tax_id is not null and nt.oa is not distinct from tax_owner and nt.ob is not distinct from assessee left join nm nr_ on nr_.oa is not distinct from pattadar and nr_.ob is not distinct from owner),
  r3 as (select *, list_filter([case when abs(diff) > 0.15::double then 'area' end, case when (sure and lu_revenue <> own_use) or (tax_id is not null and lu_tax <> own_use) then 'land_use' end, case when c_owner then 'owner' end], lambda x: x is not null) as kinds,
    coalesce(p, 0.0::double) as spatial, case when tax_id is not null then least(1.0, src + 0.02::double) else src end as source from (select *, case when b_id is not null then (0.97::double + 0.92) / 2 else 0.97::double end as src from r2) z),
  r4 as (select *, greatest(0.6::double, 1 - 0.1::double * len(kinds)) as attr from r3), rec as (select *, 100 * spatial * source * 1.0::double * attr as score from r4)"""


@query("layer_a", "layer_b", "revenue", "tax", more=_RECORDS, sql="""select a_id as parcel_id, link_type, revenue_ids, patta_no, record_owner as owner, sf_no as survey_no, round(surveyed, 1) as surveyed_area_m2, recorded as recorded_area_m2, round(100 * diff, 1) as area_diff_pct,
  case when b_id is null then own_use else lu_revenue end as land_use, tax_id as assessment_no, round(plinth_sqft * 0.09290304::double, 1) as plinth_area_m2, concat_ws(',', 'cadastral', case when b_id is not null then 'revenue' end, case when tax_id is not null then 'municipal_tax' end) as sources,
  coalesce(array_to_string(kinds, ';'), '') as conflicts, cast(len(kinds) as bigint) as n_conflicts, cast(round_even(score, 0) as bigint) as confidence, case when score >= 85 then 'High' when score >= 60 then 'Medium' else 'Low' end as band,
  cast(round(cast(spatial as decimal(12, 6)), 3) as double) as spatial, round(source, 3) as source, 1.0::double as topology, round(attr, 2) as attributes from rec""")
def harmonised(a, b, revenue, tax):
    """One record for each parcel, with conflicts and a confidence."""
    return _records(a, b, revenue, tax)


@query("layer_a", "layer_b", "revenue", more=f"{BUCKETS}, {_LINKS}", sql="""select a.a_id as parcel_id, case when lk.b_id is null then 'unmatched' when n_links = 1 and n_a = 1 then '1:1' when n_links > 1 then 'split' else 'merge' end as link_type,
  (select string_agg(cast(x.b_id as varchar), ',' order by x.place) from lk x where x.a_id = a.a_id) as revenue_ids, patta_no, case when n_links = 1 and n_a = 1 then round(extent * 40.468564::double, 1) end as recorded_area_m2,
  case when n_links = 1 and n_a = 1 then coalesce(abs((round(extent * 40.468564::double, 1) - (x2 - x1) * (y2 - y1)) / ((x2 - x1) * (y2 - y1))) > 0.15, false) else false end as area_conflict from layer_a a left join lk on lk.a_id = a.a_id and place = 1 left join revenue r on r.b_id = lk.b_id""")
def harmonised_links(a, b, revenue):
    """The part of the record that needs no name similarity."""
    from pyspark.sql import types as T

    empty = a.sparkSession.createDataFrame([], T.StructType.fromDDL("tax_id long, a_id long, assessee string, plinth_sqft double, usage string"))
    links = predicted(a, b).where("bucket = 'accept'").select("a_id", "b_id", F.round("iou", 6).alias("p"))
    out = harmonise.harmonise(a.withColumn("land_use", F.lit("Residential")), links, revenue, empty)
    return out.select("parcel_id", "link_type", "revenue_ids", "patta_no", "recorded_area_m2", F.array_contains(F.split("conflicts", ";"), "area").alias("area_conflict"))


@query("layer_a", "layer_b", "revenue", "tax", more=_RECORDS, sql="select a_id as parcel_id, unnest(kinds) as type from rec")
def conflict_list(a, b, revenue, tax):
    out = _records(a, b, revenue, tax).where("n_conflicts > 0")
    return out.select("parcel_id", F.explode(F.split("conflicts", ";")).alias("type"))


@query("layer_a", "layer_b", "revenue", "tax", more=_RECORDS, sql="select cast(least(floor(round_even(score, 0) / 10), 9) as bigint) as bin, count(*) as n, avg(round_even(score, 0)) as mean_confidence from rec group by 1")
def confidence_histogram(a, b, revenue, tax):
    c = _records(a, b, revenue, tax)
    return c.groupBy(F.least(F.floor(F.col("confidence") / 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


@table_query("customer", sql="""select 'c_name' as "column", avg(case when try_cast(replace(c_name, ',', '') as double) is not null then 1 else 0 end) as "numeric", count(distinct c_name) / count(c_name) as uniq, avg(case when regexp_matches(c_name, '^[A-Za-z][A-Za-z .,'']+$') then 1 else 0 end) as name_like, 0.0::double as multiword, avg(case when regexp_matches(c_name, '[0-9]+\\s*/\\s*\\w+') then 1 else 0 end) as slash from (select c_name from customer order by c_custkey limit 400) t
  union all select 'c_mktsegment', 0.0::double, count(distinct c_mktsegment) / count(c_mktsegment), avg(case when regexp_matches(c_mktsegment, '^[A-Za-z][A-Za-z .,'']+$') then 1 else 0 end), 0.0::double, 0.0::double from (select c_mktsegment from customer order by c_custkey limit 400) t
  union all select 'c_acctbal', 1.0::double, count(distinct c_acctbal) / count(c_acctbal), 0.0::double, 0.0::double, 0.0::double from (select c_acctbal from customer order by c_custkey limit 400) t""")
def value_profile(customer):
    return schema_match.profile(customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), "c_custkey").where("column <> 'c_custkey'")


_COLUMNS = ("b_id", "patta_no", "pattadar", "extent", "classfn", "sf_no")
_VALUES = " union all ".join(f"""(select '{c}' as col, v from (select cast({c} as varchar) as v from revenue where {c} is not null order by b_id limit 400) z)""" for c in _COLUMNS)
_CALLED = " union all ".join(f"select '{f}' as field, '{x}' as called" for f, own in schema_match.FIELDS.items() for x in own)
_VALUE = """case field when 'parcel_ref' then case when num < 1 then (1 - num * 0.5::double) * uniq else 0.3::double * uniq end when 'owner_name' then name_like * (0.5::double + 0.5::double * multiword) * uniq when 'area' then num * case when uniq > 0.5 then 1.0::double else 0.4::double end
  when 'land_use' then (1 - num) * case when uniq < 0.05::double then 1.0::double else 0.0::double end else slash end"""
_EVIDENCE = f"""vals as ({_VALUES}), prof as (select col, avg(case when try_cast(replace(v, ',', '') as double) is not null then 1 else 0 end) as num, count(distinct v) / count(v) as uniq, avg(case when regexp_matches(v, '^[A-Za-z][A-Za-z .,'']+$') then 1 else 0 end) as name_like,
    avg(case when len(list_filter(string_split_regex(v, '\\s+'), lambda w: w <> '')) >= 2 then 1 else 0 end) as multiword, avg(case when regexp_matches(v, '[0-9]+\\s*/\\s*\\w+') then 1 else 0 end) as slash from vals group by col),
  called as ({_CALLED}), pairs_ as (select col, field, col as oa, called as ob from prof cross join called), {names("select oa, ob from pairs_")},
  ev as (select col, field, max(token_set) as name_evidence from pairs_ join nm using (oa, ob) group by col, field), ev2 as (select col, field, name_evidence, {_VALUE} as value_evidence from ev join prof using (col))"""


@query("revenue", more=_EVIDENCE, sql='select col as "column", field, name_evidence, value_evidence, 0.55::double * name_evidence + 0.45::double * value_evidence as score from ev2')
def schema_evidence(revenue):
    """Evidence for each column and field; the assignment is checked by tests."""
    return schema_match.evidence(schema_match.profile(revenue, "b_id"))


@table_query("customer", sql="select c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) as name from customer")
def normalize_name(customer):
    return customer.select("c_custkey", strings.normal(F.col("c_name")).alias("name"))


_OWNERS = "ow as (select pred.a_id, pred.b_id, layer_a.owner as oa, layer_b.owner as ob from pred join layer_a on layer_a.a_id = pred.a_id join layer_b on layer_b.b_id = pred.b_id where bucket <> 'reject')"


@query("layer_a", "layer_b", more=f"{BUCKETS}, {_OWNERS}, {names('select oa, ob from ow')}", sql="select a_id, b_id, ratio, token_sort, token_set, owner_similarity from ow join nm using (oa, ob)")
def name_similarity(a, b):
    """Similarities of the owners of overlapping parcels."""
    pairs = predicted(a, b).where("bucket <> 'reject'").select("a_id", "b_id").join(a.select("a_id", F.col("owner").alias("oa")), "a_id").join(b.select("b_id", F.col("owner").alias("ob")), "b_id")
    na, nb = strings.normal(F.col("oa")), strings.normal(F.col("ob"))
    return pairs.select("a_id", "b_id", strings.ratio(na, nb).alias("ratio"), strings.token_sort(na, nb).alias("token_sort"), strings.token_set(na, nb).alias("token_set"), strings.owner_similarity(F.col("oa"), F.col("ob")).alias("owner_similarity"))


# --- logs ------------------------------------------------------------------------------------------------------------


@query("decisions", sql="select pair, arg_max(decision, seq) as decision, arg_max(officer, seq) as officer, max(seq) as seq from decisions group by pair")
def latest_decision(log):
    return audit.latest(log, "pair").select("pair", "decision", "officer", "seq")


@query("decisions", sql="select seq, pair, decision, lag(seq) over (partition by pair order by seq) as supersedes, row_number() over (partition by pair order by seq) as revision from decisions")
def decision_history(log):
    return audit.history(log, "pair").select("seq", "pair", "decision", "supersedes", "revision")


@query("decisions", sql="select seq, pair from decisions where coalesce(dataset, 'synthetic') = 'synthetic'")
def decisions_of_dataset(log):
    return audit.of_dataset(log, "synthetic").select("seq", "pair")


@query("layer_a", "layer_b", "decisions", more=f"{BUCKETS}, q as (select a_id, b_id, iou, a_id % 400 as pair from pred where bucket = 'review')", sql="select a_id, b_id from q where pair not in (select pair from decisions)")
def pending_review(a, b, log):
    queue = predicted(a, b).where("bucket = 'review'").withColumn("pair", F.col("a_id") % 400)
    return audit.pending(queue, log, "pair").select("a_id", "b_id")


@query("layer_a", "layer_b", more=BUCKETS, sql="select a_id, b_id, abs(iou - 0.5) as doubt from pred where bucket = 'review' order by doubt, a_id, b_id limit 200")
def review_queue(a, b):
    """Pairs a person should look at first."""
    return predicted(a, b).where("bucket = 'review'").select("a_id", "b_id", F.abs(F.col("iou") - 0.5).alias("doubt")).orderBy("doubt", "a_id", "b_id").limit(200)


@query("layer_a", "layer_b", more=BUCKETS, sql="select a_id, b_id, iou, row_number() over (partition by a_id order by case when bucket = 'review' then 0 else 1 end, iou desc, b_id) as place from pred where bucket <> 'reject' qualify place <= 4")
def top_candidates(a, b):
    from pyspark.sql import Window

    w = Window.partitionBy("a_id").orderBy(F.when(F.col("bucket") == "review", 0).otherwise(1), F.col("iou").desc(), "b_id")
    return predicted(a, b).where("bucket <> 'reject'").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 4").select("a_id", "b_id", "iou", "place")


@query("layer_a", "decisions", more="o as (select pair, officer, arg_max(decision, seq) as decision, max(seq) as seq from decisions group by 1, 2), t as (select pair, string_agg(officer || ' ' || decision, '; ' order by seq) as x from o group by 1)", sql="select a_id, coalesce(x, '') as officer_decisions from layer_a left join t on a_id = pair")
def records_with_decisions(a, log):
    return audit.decisions_on(a.select("a_id"), log.withColumnRenamed("pair", "a_id"), "a_id")


_BODY = "concat(cast(pair as {s}), ':', decision, ':', officer)"
_CHAIN = f"e as (select seq, officer, {_BODY.format(s='varchar')} as body, row_number() over (partition by officer order by seq) as rn from decisions), h as (with recursive c as (select officer, seq, body, rn, '{'0' * 64}' as prev, sha256('{'0' * 64}' || body) as hash from e where rn = 1 union all select e.officer, e.seq, e.body, e.rn, c.hash, sha256(c.hash || e.body) from e join c on e.officer = c.officer and e.rn = c.rn + 1) select * from c)"


@query("decisions", more=_CHAIN, sql="select officer, seq, body, prev, hash from h")
def hash_chain_build(log):
    return audit.chain_build(log.withColumn("body", F.expr(_BODY.format(s="string"))), "officer", "seq", "body")


@query("decisions", more=_CHAIN, sql="""select officer, count(*) as n, min(case when bad then seq end) as first_bad from (select *, prev <> coalesce(lag(hash) over (partition by officer order by seq), repeat('0', 64)) or hash <> sha256(prev || body) as bad from
  (select officer, seq, case when seq % 97 = 0 then body || '!' else body end as body, prev, hash from h) x) t group by officer""")
def hash_chain_verify(log):
    """The chain with every 97th body changed afterwards."""
    chain = audit.chain_build(log.withColumn("body", F.expr(_BODY.format(s="string"))), "officer", "seq", "body")
    return audit.chain_check(chain.withColumn("body", F.when(F.col("seq") % 97 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))), "officer", "seq", "body")


@query("access_log", more="t as (select *, epoch_us(ts) as us, coalesce(sum(case when event = 'success' then 1 else 0 end) over (partition by user_id order by ts, seq rows between unbounded preceding and 1 preceding), 0) as run from access_log where event in ('failed', 'success'))",
       sql="select a.seq, a.user_id, a.event, count(b.seq) as failures_before, count(b.seq) >= 2 as locked from t a left join t b on a.user_id = b.user_id and a.run = b.run and b.event = 'failed' and b.us < a.us and a.us - b.us < 7200000000 group by 1, 2, 3")
def login_lockout(log):
    return audit.lockouts(log, 7200, 2).select("seq", "user_id", "event", "failures_before", "locked")


@query("access_log", sql="select seq, user_id, event from access_log order by seq desc limit 50")
def access_tail(log):
    return audit.tail(log).select("seq", "user_id", "event")


@query("access_log", sql="select 'officer' as role, seq, user_id from (select * from access_log where user_id = 7 order by seq desc limit 50) o union all select 'supervisor', seq, user_id from (select * from access_log order by seq desc limit 50) s")
def uploads_visible(log):
    """What an officer (their own) and a supervisor (all) see, newest first."""
    of = lambda role: audit.visible(log, 7, role).select(F.lit(role).alias("role"), "seq", "user_id")
    return of("officer").unionByName(of("supervisor"))


@query("access_log", more="t as (select *, epoch_us(ts) as us, coalesce(sum(case when event = 'success' then 1 else 0 end) over (partition by user_id order by ts, seq rows between unbounded preceding and 1 preceding), 0) as run from access_log where event in ('failed', 'success'))",
       sql="select a.seq, a.user_id, a.event, count(b.seq) as failures_before, count(b.seq) >= 5 as locked from t a left join t b on a.user_id = b.user_id and a.run = b.run and b.event = 'failed' and b.us < a.us and a.us - b.us < 300000000 group by 1, 2, 3")
def login_lockout_policy(log):
    """Five failures within five minutes, as the policy has it; login_lockout is the same with a limit that this log reaches."""
    return audit.lockouts(log).select("seq", "user_id", "event", "failures_before", "locked")


@query("decisions", sql="select seq, officer from decisions where contains(lower(concat_ws(' ', cast(seq as varchar), cast(pair as varchar), officer, decision)), 'officer1') order by seq limit 300")
def record_search(log):
    return audit.search(log.select("seq", "pair", "officer", "decision"), "OFFICER1", order="seq").select("seq", "officer")


@query("decisions", more="p as (select seq, pair % 260 as pair, case when seq % 2 = 0 then 'accept' else 'reject' end as decision, case when seq % 7 = 0 then 'auditor' when seq % 3 = 0 then 'supervisor' else 'officer' end as role, case when seq % 4 = 0 then '' else 'seen' end as reason, pair % 9 <> 0 as known from decisions), l as (select pair, arg_max(decision, seq) as now, count(*) - 1 as revisions from decisions group by pair)",
       sql="select seq, case when not known then 404 when role = 'auditor' then 403 when now is null then 201 when now = decision then 200 when role <> 'supervisor' then 403 when trim(reason) = '' then 400 when revisions >= 4 then 409 else 201 end as status from p left join l using (pair)")
def decision_status(log):
    p = log.selectExpr("seq", "pair % 260 as pair", "case when seq % 2 = 0 then 'accept' else 'reject' end as decision", "case when seq % 7 = 0 then 'auditor' when seq % 3 = 0 then 'supervisor' else 'officer' end as role", "case when seq % 4 = 0 then '' else 'seen' end as reason", "pair % 9 <> 0 as known")
    return audit.judged(p, log).select("seq", "status")


# --- rasters ---------------------------------------------------------------------------------------------------------

_DRIFT = "dr as (select coalesce(quantile_cont(p1 - p0, 0.5), 0) as drift from pixels where p0 > 0.2 and p1 > 0.2), mk as (select r, q, case when p1 - p0 - drift >= 0.4 and p1 >= 0.55 then 'new' when p1 - p0 - drift <= -0.4 and p0 >= 0.55 then 'demolished' end as change from pixels, dr)"


@query("pixels", more=_DRIFT, sql="select drift from dr")
def presence_drift(pixels):
    return raster.drift(pixels)


@query("pixels", more=_DRIFT, sql="select * from mk where change is not null")
def raster_change(pixels):
    return raster.masks(pixels)


@query("pixels", more=f"{_DRIFT}, m as (select * from mk where change is not null), w as (select a.change, a.r, a.q from m a where (select count(*) from m b where b.change = a.change and b.r - a.r in (0, 1) and b.q - a.q in (0, 1)) = 4), o as (select distinct w.change, w.r + i as r, w.q + j as q from w, (values (0), (1)) x(i), (values (0), (1)) y(j))", sql="select * from o")
def raster_opened(pixels):
    return raster.opened(raster.masks(pixels))


_OPENED = f"{_DRIFT}, m as (select * from mk where change is not null), w as (select a.change, a.r, a.q from m a where (select count(*) from m b where b.change = a.change and b.r - a.r in (0, 1) and b.q - a.q in (0, 1)) = 4), o as (select distinct w.change, w.r + i as r, w.q + j as q from w, (values (0), (1)) x(i), (values (0), (1)) y(j))"


@query("pixels", more=f"{_OPENED}, f as (with recursive reach as (select change, r, q, r as r0, q as q0 from o union select o.change, o.r, o.q, reach.r0, reach.q0 from reach join o on o.change = reach.change and abs(o.r - reach.r) + abs(o.q - reach.q) = 1) select * from reach), n as (select change, r, q, min(lpad(cast(r0 as varchar), 9, '0') || ':' || lpad(cast(q0 as varchar), 9, '0')) as first from f group by 1, 2, 3)",
       sql="select change, change || ':' || first as part, count(*) as n_pixels, count(*) * 16.0::double as area_m2 from n group by 1, 2 having count(*) >= 8")
def raster_components(pixels):
    """Compact clusters of change."""
    return raster.clusters(pixels)


_ZONE = "select cast((r - r % 10) / 10 as int) * 100 + cast((q - q % 10) / 10 as int) as zone, r, q from pixels"


@query("pixels", more=f"z as ({_ZONE})", sql="select zone, count(*) as n, avg(p0) as mean_p0, avg(p1) as mean_p1, quantile_cont(h0, 0.5) as h0, quantile_cont(h1, 0.5) as h1 from pixels join z using (r, q) group by zone")
def zonal_stats(pixels):
    return raster.zonal(pixels, pixels.selectExpr("cast((r - r % 10) / 10 as int) * 100 + cast((q - q % 10) / 10 as int) as zone", "r", "q"))


@query("pixels", more=f"z as ({_ZONE}), s as (select zone, count(*) as n, avg(p0) as m0, avg(p1) as m1, quantile_cont(h0, 0.5) as h0, quantile_cont(h1, 0.5) as h1 from pixels join z using (r, q) group by zone)",
       sql="select zone, round(h1 - h0, 1) as gain_m, cast(round_even((h1 - h0) / 3, 0) as bigint) as floors_added from s where n >= 4 and m0 >= 0.5 and m1 >= 0.5 and h1 - h0 >= 6")
def taller_buildings(pixels):
    return raster.taller(raster.zonal(pixels, pixels.selectExpr("cast((r - r % 10) / 10 as int) * 100 + cast((q - q % 10) / 10 as int) as zone", "r", "q")))


# --- delivery --------------------------------------------------------------------------------------------------------


@query("layer_a", sql="""select a_id, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[' || x1 || ',' || y1 || '],[' || x2 || ',' || y1 || '],[' || x2 || ',' || y2 || '],[' || x1 || ',' || y2 || '],[' || x1 || ',' || y1 || ']]]},"properties":{"a_id":' || a_id || ',"owner":"' || owner || '"}}' as feature from layer_a""")
def geojson_export(a):
    from landlace.sources.geojson import feature, ring_of_box

    return a.select("a_id", feature(F.array(ring_of_box()), F.struct("a_id", "owner")).alias("feature"))


@query("layer_a", sql="select concat_ws(',', cast(a_id as varchar), owner, error_type, '') as line from layer_a")
def csv_export(a):
    from landlace.sources.delivery import csv_lines

    return csv_lines(a, ["a_id", "owner", "error_type", "officer"])


_DIGITS = " || ".join(f"cast(((x >> {i}) & 1) + 2 * ((y >> {i}) & 1) as varchar)" for i in range(8, -1, -1))


@query("layer_a", more="c as (select a_id, (y1 + y2) / 2 / 1000.0 + 10 as lat, (x1 + x2) / 2 / 1000.0 + 78 as lon from layer_a), t as (select a_id, cast(floor((lon + 180) / 360 * 512) as int) as x, cast(floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 512) as int) as y from c)", sql=f"select a_id, {_DIGITS} as quadkey from t")
def quadkey(a):
    """Map tile of each parcel's centre, read as degrees."""
    x, y = boxes.centre()
    return a.select("a_id", projection.quadkey((y / 1000.0) + 10, (x / 1000.0) + 78, 9).alias("quadkey"))


@query("layer_a", sql="select count(*) as n, 0 as over_a_millimetre from layer_a")
def projected_round_trip(a):
    """Centres as degrees to UTM and back, on either half of the earth, those past 90 degrees over the pole: how many come back more than a millimetre off."""
    x, y = boxes.centre()
    deg = a.select((x / 10000.0 + 79).alias("lon"), (F.when(F.col("a_id") % 2 == 0, 1).otherwise(-1) * (y / 10000.0 + 12)).alias("lat"))
    e, n = projection.utm(F.col("lon"), F.col("lat"), 44)
    back = deg.withColumns({"e": e, "n": n})
    lon, lat = projection.from_utm(F.col("e"), F.col("n"), 44)
    return back.agg(F.count("*").alias("n"), F.count_if(~(projection.apart((lon, lat), (F.col("lon"), F.col("lat"))) <= 0.001)).alias("over_a_millimetre"))


# --- links, repair priority, scores by type ------------------------------------------------------------------------------


@query("layer_a", "layer_b", more=BUCKETS, sql="select a_id, b_id, iou as p, row_number() over (order by iou desc, a_id, b_id) as place from pred where bucket = 'accept' qualify place <= 500")
def links_by_score(a, b):
    """The 500 surest links, best first."""
    from pyspark.sql import Window

    top = predicted(a, b).where("bucket = 'accept'").select("a_id", "b_id", F.col("iou").alias("p")).orderBy(F.desc("p"), "a_id", "b_id").limit(500)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p"), "a_id", "b_id")).cast("long"))  # 500 rows


@query("layer_a", "layer_b", more=BUCKETS, sql="select b_id, coalesce(max(iou), 0.0) as best_p from layer_b left join pred using (b_id) group by b_id")
def best_score_of_b(a, b):
    """What repair ranks the second layer's shapes by."""
    return matching.best_of(predicted(a, b).withColumnRenamed("iou", "p"), b, "b_id")


_IOU = f"{INTER} / greatest({AREA_A} + {AREA_B} - {INTER}, 1e-9)"
_LABELLED = "lab as (select t.a_id is not null as hit from pred p left join (select distinct a_id, b_id from truth) t on p.a_id = t.a_id and p.b_id = t.b_id where bucket = 'accept')"
_AREA = f"""{BUCKETS}, {_LINKS}, f as (select a.a_id as parcel_id from layer_a a join lk on lk.a_id = a.a_id join revenue r on r.b_id = lk.b_id where n_links = 1 and n_a = 1 and abs((round(extent * 40.468564::double, 1) - (x2 - x1) * (y2 - y1)) / ((x2 - x1) * (y2 - y1))) > 0.15),
  t as (select a_id as parcel_id from lk where n_links = 1 and n_a = 1 and b_id % 13 = 0), s as (select 'area' as type, (select count(*) from t) as injected, (select count(*) from f) as flagged, (select count(*) from f join t using (parcel_id)) as correct),
  ps as (select *, case when flagged > 0 then correct / flagged else 1.0 end as "precision", case when injected > 0 then correct / injected else 1.0 end as recall from s)"""


def _area_conflicts(a, b, revenue):
    links = predicted(a, b).where("bucket = 'accept'").select("a_id", "b_id", F.round("iou", 6).alias("p"))
    empty = revenue.sparkSession.createDataFrame([], "tax_id long, a_id long, assessee string, plinth_sqft double, usage string")
    rec = settled(harmonise.harmonise(a.withColumn("land_use", F.lit("Residential")), links, revenue, empty))
    found = rec.select("parcel_id", F.explode(F.split("conflicts", ";")).alias("type")).where("type = 'area'")
    own = rec.where("link_type = '1:1'").select("parcel_id", F.col("revenue_ids").cast("long").alias("b_id"))
    return harmonise.conflict_scores(found, own.where("b_id % 13 = 0").select("parcel_id", F.lit("area").alias("type")), ("area",))


@query("layer_a", "layer_b", "revenue", more=_AREA, sql="select * from ps")
def conflict_scores(a, b, revenue):
    """Area conflicts against what the register was given wrong."""
    return _area_conflicts(a, b, revenue)


@query("layer_a", "layer_b", "revenue", "truth", more=f"{_AREA}, {_LABELLED}", sql='select avg("precision") as "precision", avg(recall) as recall from (select "precision", recall from ps union all select cast(sum(case when hit then 1 else 0 end) as double) / count(*), cast(sum(case when hit then 1 else 0 end) as double) / (select count(*) from (select distinct a_id, b_id from truth)) from lab) u')
def macro_scores(a, b, revenue, truth):
    """The plain mean over kinds: area conflicts and links."""
    accepted = matching.labelled(predicted(a, b).where("bucket = 'accept'"), truth)
    links = accepted.agg((F.sum("label") / F.count("*")).alias("precision"), F.sum("label").alias("hit")).crossJoin(truth.select("a_id", "b_id").distinct().agg(F.count("*").alias("n")))
    rows = _area_conflicts(a, b, revenue).select("precision", "recall").unionByName(links.select("precision", (F.col("hit") / F.col("n")).alias("recall")))
    return matching.macro(rows, "precision", "recall")


_MOVED = "mv as (select b_id, x1 + 2 as x1, y1, x2 + 2 as x2, y2 from layer_b)"


@query("layer_a", "layer_b", more=f"{_MOVED}, u as (select 'as it is' as profile, {_IOU} as iou from layer_a a join layer_b b on {D2} <= 900 union all select 'moved', {_IOU} from layer_a a join mv b on {D2} <= 900)", sql="select profile, count(*) as pairs, count_if(iou >= 0.5) as overlapping from u group by profile")
def training_profiles(a, b):
    """Training pairs of two error profiles, one below the other."""
    moved = b.withColumns({"x1": F.col("x1") + 2, "x2": F.col("x2") + 2})
    rows = matching.profiles({"as it is": predicted(a, b), "moved": predicted(a, moved)})
    return rows.groupBy("profile").agg(F.count("*").alias("pairs"), F.count_if(F.col("iou") >= 0.5).alias("overlapping"))


# --- the classifier --------------------------------------------------------------------------------------------------


def _training(a, b, truth):
    from landlace.operators.features import pair_features as measured

    x, y = boxes.centre()
    fold = matching.blocks(a, x, y, 300.0).select("a_id", ((F.col("bi") * 3 + F.col("bj")) % 4).alias("fold"))
    return matching.labelled(measured(a, b), truth).join(fold, "a_id")


@query("layer_a", "layer_b", "truth")
def gbt_scores(a, b, truth):
    """Out-of-fold calibrated scores and buckets; tests hold their accuracy against the overlap rule."""
    from landlace.operators import learn

    out = learn.out_of_fold(settled(_training(a, b, truth)), "fold", rounds=10, depth=3)
    return out.select("a_id", "b_id", "label", "p", F.when(F.col("p") >= F.col("t_high"), "accept").when(F.col("p") < F.col("t_low"), "reject").otherwise("review").alias("bucket"))


@query("layer_a", "layer_b", "truth")
def shap_topk(a, b, truth):
    """The four features that moved each score most; tests hold the sums against the trees' own output."""
    from landlace.operators import learn

    rows = settled(_training(a, b, truth))
    m = learn.fit(rows.where("fold < 3"), rows.where("fold = 3"), rounds=5, depth=3)
    return learn.contributions(rows.where("iou > 0"), m).select("a_id", "b_id", F.explode("contrib").alias("x")).select("a_id", "b_id", "x.feature", "x.value")


@table_query("labels", "documents", sql=f"""with s as ({SCORED}), g as (select p, count(*) as n, sum(y) as t, row_number() over (order by p) as i from s group by p), c as (select i, p, n, sum(n) over (order by i) as cn, sum(t) over (order by i) as ct from g),
  e as (select a.i as a, b.i as b, (b.ct - coalesce(z.ct, 0)) / (b.cn - coalesce(z.cn, 0)) as m from c a join c b on a.i <= b.i left join c z on z.i = a.i - 1), l as (select x.i, e.a, min(e.m) as low from c x join e on e.a <= x.i and e.b >= x.i group by 1, 2)
  select p, n, round(max(low), 9) as calibrated from c join l using (i) group by p, n""")
def isotonic_fit(labels, documents):
    """Calibrated scores: the SQL is the max-min form of the monotone fit."""
    from pyspark.ml.regression import IsotonicRegression

    own = scored(labels, documents).select(F.col("y").cast("double").alias("label"), "p")
    m = IsotonicRegression(featuresCol="p", labelCol="label").fit(own)
    return m.transform(own).groupBy("p").agg(F.count("*").alias("n"), F.round(F.first("prediction"), 9).alias("calibrated"))
