"""Candidate pairs, features, topology, relations, co-registration, points, roads."""

from __future__ import annotations

from pyspark.sql import functions as F

from landlace.functions import boxes
from landlace.operators import changes, coreg, features, harmonise, matching, relations, roads, topology
from landlace.operators.spatial_join import cover, join_boxes, nearest_growing
from landlace.plans.registry import query

DX = "greatest(b.x1 - a.x2, a.x1 - b.x2, 0.0)"
DY = "greatest(b.y1 - a.y2, a.y1 - b.y2, 0.0)"
D2 = f"({DX} * {DX} + {DY} * {DY})"
INTER = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0.0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0.0))"
AREA_A, AREA_B = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((b.x2 - b.x1) * (b.y2 - b.y1))"
CENTRE = "sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) * ((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) * ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2))"


def _outline(px: str, py: str, t: str) -> str:
    dx, dy = f"greatest({t}.x1 - {px}, {px} - {t}.x2, 0.0)", f"greatest({t}.y1 - {py}, {py} - {t}.y2, 0.0)"
    return f"case when {dx} = 0 and {dy} = 0 then least({px} - {t}.x1, {t}.x2 - {px}, {py} - {t}.y1, {t}.y2 - {py}) else sqrt({dx} * {dx} + {dy} * {dy}) end"


HAUSDORFF = "greatest(" + ", ".join(_outline(f"{p}.{x}", f"{p}.{y}", q) for p, q in (("a", "b"), ("b", "a")) for x in ("x1", "x2") for y in ("y1", "y2")) + ")"
PAIRS = f"pairs as (select a_id, b_id, {AREA_A} as area_a, {AREA_B} as area_b, {INTER} / greatest({AREA_A} + {AREA_B} - {INTER}, 1e-9) as iou, {INTER} / greatest({AREA_A}, 1e-9) as inter_over_a, {INTER} / greatest({AREA_B}, 1e-9) as inter_over_b, {CENTRE} as centroid_dist, least({AREA_A}, {AREA_B}) / greatest({AREA_A}, {AREA_B}, 1e-9) as area_ratio, {HAUSDORFF} / sqrt(greatest({AREA_A}, 1e-9)) as hausdorff_norm from layer_a a join layer_b b on {D2} <= 900)"
BUCKETS = f"{PAIRS}, pred as (select *, case when iou >= 0.5 then 'accept' when iou >= 0.2 then 'review' else 'reject' end as bucket from pairs)"
PART = lambda s, sk, b, bk, anti, name: f"""{name} as (select {sk}, {bk}, share from (select a.{sk}, b.{bk}, {INTER} / {AREA_A} as share, row_number() over (partition by a.{sk} order by {INTER} / {AREA_A} desc, b.{bk}) as rn
  from {s} a join {b} b on {INTER} > 0 where {INTER} / {AREA_A} >= 0.6 and {AREA_B} >= 1.8 * {AREA_A}{anti}) t where rn = 1)"""  # noqa: E731


def predicted(a, b):
    return features.measured(features.candidates(a, b)).withColumn("bucket", matching.overlap_bucket(F.col("iou"))).select("a_id", "b_id", "area_a", "area_b", *features.FEATURES[:6], "bucket")


@query("layer_a", "layer_b", sql=f"select a_id, b_id, sqrt({D2}) as dist from layer_a a join layer_b b on {D2} <= 900")
def candidate_pairs(a, b):
    return features.candidates(a, b).select("a_id", "b_id", boxes.distance("a_", "b_").alias("dist"))


@query("layer_a", "layer_b", more=PAIRS, sql="""select *, rank() over (partition by a_id order by centroid_dist) as rank_a, count(*) over (partition by a_id) as n_cand_a, centroid_dist - min(centroid_dist) over (partition by a_id) as gap_a,
  rank() over (partition by b_id order by centroid_dist) as rank_b, count(*) over (partition by b_id) as n_cand_b, centroid_dist - min(centroid_dist) over (partition by b_id) as gap_b from pairs""")
def pair_features(a, b):
    return features.pair_features(a, b)


@query("layer_a", "layer_b", more=BUCKETS, sql="select a_id, b_id, iou, bucket from pred")
def iou_bucket(a, b):
    return predicted(a, b).select("a_id", "b_id", "iou", "bucket")


@query("layer_a", "layer_b", "truth", more=BUCKETS, sql="select p.a_id, p.b_id, case when t.a_id is null then 0 else 1 end as label from pred p left join (select distinct a_id, b_id from truth) t on p.a_id = t.a_id and p.b_id = t.b_id")
def pair_labels(a, b, truth):
    return matching.labelled(predicted(a, b), truth).select("a_id", "b_id", "label")


@query("layer_t", sql=f"select a.id as i, b.id as j, {INTER} as overlap from layer_t a join layer_t b on a.id < b.id and {INTER} > 0.5")
def overlap_pairs(t):
    return topology.overlaps(t)


@query("layer_t", sql=f"select a.id as i, b.id as j, sqrt({D2}) as gap from layer_t a join layer_t b on a.id < b.id and {D2} > 0 and sqrt({D2}) <= 0.3")
def near_miss_pairs(t):
    return topology.near_misses(t)


SLIVER = "select id, (x2 - x1) * (y2 - y1) as area, 4 * pi() * ((x2 - x1) * (y2 - y1)) / ((2 * (x2 - x1) + 2 * (y2 - y1)) * (2 * (x2 - x1) + 2 * (y2 - y1))) as compactness from layer_t"


@query("layer_t", sql=f"select id, area, round(compactness, 9) as compactness, area > 0 and (area < 2 or compactness < 0.08) as sliver from ({SLIVER}) s")
def sliver_flags(t):
    return topology.slivers(t).withColumn("compactness", F.round("compactness", 9))


@query("layer_t", sql=f"""select (select count(*) from layer_t a join layer_t b on a.id < b.id and {INTER} > 0.5) as overlaps, (select sum({INTER}) from layer_t a join layer_t b on a.id < b.id and {INTER} > 0.5) as overlap_area_m2,
  (select count(*) from layer_t a join layer_t b on a.id < b.id and {D2} > 0 and sqrt({D2}) <= 0.3) as near_miss_gaps, (select count(*) from layer_t) as parcels, (select count(*) from ({SLIVER}) s where area > 0 and (area < 2 or compactness < 0.08)) as slivers""")
def topology_report(t):
    return topology.report(t)


@query("layer_a", "big", more=PART("layer_a", "a_id", "big", "big_id", "", "p"), sql="select * from p")
def part_of(a, big):
    return relations.part_of(a, "a_id", big, "big_id")


@query("layer_a", "big", "layer_b", more=BUCKETS + ", " + PART("layer_a", "a_id", "big", "big_id", " and not exists (select 1 from pred where bucket <> 'reject' and pred.a_id = a.a_id)", "p"), sql="select * from p")
def part_of_unlinked(a, big, b):
    return relations.part_of(a, "a_id", big, "big_id", predicted(a, b).where("bucket <> 'reject'").select("a_id").distinct())


@query("layer_a", "big", more=PART("layer_a", "a_id", "big", "big_id", "", "p"), sql="select big_id, count(*) as n from p group by big_id having count(*) >= 2")
def covering_groups(a, big):
    return relations.covering(relations.part_of(a, "a_id", big, "big_id"), "big_id")


ONE = "one as (select * from (select *, count(*) over (partition by a_id) as na, count(*) over (partition by b_id) as nb from pred where bucket = 'accept') t where na = 1 and nb = 1)"


@query("layer_a", "layer_b", more=f"{BUCKETS}, {ONE}", sql="select a_id, b_id, iou from one")
def one_to_one_links(a, b):
    return relations.one_to_one(predicted(a, b)).select("a_id", "b_id", "iou")


_DESCRIBE = ", ".join([
    BUCKETS, ONE, "a_hit as (select distinct a_id from pred where bucket <> 'reject'), b_hit as (select distinct b_id from pred where bucket <> 'reject')",
    PART("layer_a", "a_id", "layer_b", "b_id", " and a.a_id not in (select a_id from a_hit)", "ab"), PART("layer_b", "b_id", "layer_a", "a_id", " and a.b_id not in (select b_id from b_hit)", "ba"),
    "a_any as (select a_id from a_hit union select a_id from ab union select a_id from ba), b_any as (select b_id from b_hit union select b_id from ba union select b_id from ab)",
])


@query("layer_a", "layer_b", more=_DESCRIBE, sql="""select (select count(*) from pred) as candidates, (select count(*) from pred where bucket = 'accept') as auto_links, (select count(*) from pred where bucket = 'review') as review_links,
  (select count(*) from one) as one_to_one, round((select quantile_cont(centroid_dist, 0.5) from one), 9) as median_offset_m, round((select quantile_cont(centroid_dist, 0.9) from one), 9) as p90_offset_m, round((select quantile_cont(iou, 0.5) from one), 9) as median_iou,
  round((select quantile_cont(area_ratio, 0.5) from one), 9) as median_area_ratio, (select count(*) from layer_a) as n_a, (select count(*) from layer_b) as n_b, (select count(*) from ab) as a_inside_larger_b, (select count(*) from ba) as b_inside_larger_a,
  (select count(*) from (select b_id from ab group by b_id having count(*) >= 2)) as b_polygons_covering_several_a, (select count(*) from (select a_id from ba group by a_id having count(*) >= 2)) as a_polygons_covering_several_b,
  (select count(*) from a_any) / greatest((select count(*) from layer_a), 1) as a_with_counterpart, (select count(*) from b_any) / greatest((select count(*) from layer_b), 1) as b_with_counterpart,
  (select count(*) from layer_a) - (select count(*) from a_any) as a_only, (select count(*) from layer_b) - (select count(*) from b_any) as b_only""")
def describe_layers(a, b):
    out = relations.describe(predicted(a, b), a, b)
    return out.withColumns({c: F.round(c, 9) for c in ("median_offset_m", "p90_offset_m", "median_iou", "median_area_ratio")})


_STATUS = "found as (select a_id, bucket from pred where bucket <> 'reject')"


def _status(screen: str, names: dict[str, str]):
    order = relations.PRECEDENCE[screen]
    rank = "case " + " ".join(f"when bucket = '{b}' then {order.index(s)}" for b, s in names.items()) + " end"
    label = "case " + " ".join(f"when r = {i} then '{s}'" for i, s in enumerate(order)) + " else 'unmatched' end"

    @query("layer_a", "layer_b", more=f"{BUCKETS}, {_STATUS}, best as (select a_id, min({rank}) as r from found group by a_id)", sql=f"select l.a_id, {label} as status from layer_a l left join best on l.a_id = best.a_id")
    def f(a, b):
        own = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("bucket")]
        return relations.status(a, "a_id", predicted(a, b).where("bucket <> 'reject'").select("a_id", own.alias("status")), screen)

    return f


def _statuses():
    from landlace.plans import registry

    for name, screen, names in (("shape_status_synthetic", "synthetic", {"accept": "auto", "review": "review"}), ("shape_status_review", "review_screen", {"accept": "auto", "review": "review"}),
                                ("shape_status_real", "real", {"accept": "matched", "review": "uncertain"}), ("shape_status_upload", "upload", {"accept": "matched", "review": "review"})):
        _status(screen, names)
        registry.QUERIES[name], registry.ORACLES[name] = registry.QUERIES.pop("f"), registry.ORACLES.pop("f")


_statuses()


@query("layer_a", "layer_b", "big", more=f"{BUCKETS}, " + PART("layer_a", "a_id", "big", "big_id", "", "p") + ", seen as (select distinct a_id, 's1' as s from pred where bucket = 'accept' union select a_id, 's2' as s from p), n as (select a_id, count(*) as k from seen group by a_id)",
       sql="select coalesce(k, 0) + 1 as n_sources, count(*) as n from layer_a l left join n on l.a_id = n.a_id group by 1")
def consensus_counts(a, b, big):
    one = predicted(a, b).where("bucket = 'accept'").select("a_id", F.lit("s1").alias("source"))
    return relations.consensus(one.union(relations.part_of(a, "a_id", big, "big_id").select("a_id", F.lit("s2"))), a, "a_id")


# --- co-registration -------------------------------------------------------------------------------------------------

_CA = "ca as (select a_id, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y from layer_a), cb as (select b_id, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y from layer_b)"
_ND = "sqrt((ca.x - cb.x) * (ca.x - cb.x) + (ca.y - cb.y) * (ca.y - cb.y))"
_MUTUAL = f"""{_CA}, near as (select ca.a_id, cb.b_id, {_ND} as dist, cb.x - ca.x as dx, cb.y - ca.y as dy, ca.x as a_x, ca.y as a_y from ca join cb on {_ND} < 15),
  m as (select * from (select *, row_number() over (partition by a_id order by dist, b_id) as ra, row_number() over (partition by b_id order by dist, a_id) as rb from near) t where ra = 1 and rb = 1)"""


@query("layer_a", "layer_b", more=_MUTUAL, sql="select a_id, b_id, dist, dx, dy from m")
def mutual_nn(a, b):
    return coreg.anchors(a, b).select("a_id", "b_id", "dist", "dx", "dy")


@query("layer_a", "layer_b", more=_MUTUAL, sql="select count(*) as anchors, round(quantile_cont(dx, 0.5), 9) as gx, round(quantile_cont(dy, 0.5), 9) as gy from m")
def global_shift(a, b):
    return coreg.global_shift(coreg.anchors(a, b)).select("anchors", F.round("gx", 9).alias("gx"), F.round("gy", 9).alias("gy"))


_KNN = f"{_MUTUAL}, knn as (select * from (select cb.b_id, m.a_id, sqrt((cb.x - m.a_x) * (cb.x - m.a_x) + (cb.y - m.a_y) * (cb.y - m.a_y)) as dist, m.dx, m.dy, row_number() over (partition by cb.b_id order by sqrt((cb.x - m.a_x) * (cb.x - m.a_x) + (cb.y - m.a_y) * (cb.y - m.a_y)), m.a_id) as place from cb join m on sqrt((cb.x - m.a_x) * (cb.x - m.a_x) + (cb.y - m.a_y) * (cb.y - m.a_y)) < 250) t where place <= 25)"


@query("layer_a", "layer_b", more=_KNN, sql="select b_id, a_id, dist, place from knn")
def knn_anchors(a, b):
    found = coreg.anchors(a, b).select("a_id", F.col("a_x").alias("x"), F.col("a_y").alias("y"))
    return nearest_growing(coreg.centres(b, "b_id"), "b_id", found, "a_id", 250.0, 25, first=100.0).select(F.col("a_key").alias("b_id"), F.col("b_key").alias("a_id"), "dist", "place")


@query("layer_a", "layer_b", more=f"{_KNN}, own as (select b_id, count(*) as n, quantile_cont(dx, 0.5) as mx, quantile_cont(dy, 0.5) as my from knn group by b_id), g as (select quantile_cont(dx, 0.5) as gx, quantile_cont(dy, 0.5) as gy from m)",
       sql="select cb.b_id, coalesce(n, 0) as n_anchors, round(case when coalesce(n, 0) >= 5 then mx else gx end, 9) as sx, round(case when coalesce(n, 0) >= 5 then my else gy end, 9) as sy from cb left join own on cb.b_id = own.b_id cross join g")
def local_shift(a, b):
    out = coreg.local_shift(coreg.centres(b, "b_id"), coreg.anchors(a, b))
    return out.select("b_id", "n_anchors", F.round("sx", 9).alias("sx"), F.round("sy", 9).alias("sy"))


def _round(n: int) -> str:
    """Round n of the shift field, from f{n - 1} (b_id, sx, sy) to f{n}: anchors of the moved layer that overlap well, their offset before any move, medians."""
    far = "sqrt((u.x - g.a_x) * (u.x - g.a_x) + (u.y - g.a_y) * (u.y - g.a_y))"
    apart = "sqrt((ca.x - u.x) * (ca.x - u.x) + (ca.y - u.y) * (ca.y - u.y))"
    return f"""w{n} as (select *, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y from (select b_id, x1 - sx as x1, x2 - sx as x2, y1 - sy as y1, y2 - sy as y2 from layer_b join f{n - 1} using (b_id)) z),
  i{n} as (select a_id, b_id, a_x, a_y from (select ca.a_id, u.b_id, ca.x as a_x, ca.y as a_y, row_number() over (partition by ca.a_id order by {apart}, u.b_id) as ra, row_number() over (partition by u.b_id order by {apart}, ca.a_id) as rb from ca join w{n} u on {apart} < 15) z where ra = 1 and rb = 1),
  g{n} as (select i.a_id, i.b_id, a_x, a_y, cb.x - a_x as dx, cb.y - a_y as dy from i{n} i join layer_a a on a.a_id = i.a_id join w{n} b on b.b_id = i.b_id join cb on cb.b_id = i.b_id where {INTER} / ({AREA_A} + {AREA_B} - {INTER}) >= 0.4::double),
  k{n} as (select b_id, count(*) as n, quantile_cont(dx, 0.5) as mx, quantile_cont(dy, 0.5) as my from (select u.b_id, dx, dy, row_number() over (partition by u.b_id order by {far}, g.a_id) as place from w{n} u join g{n} g on {far} < 250) z where place <= 25 group by b_id),
  f{n} as (select w{n}.b_id, case when coalesce(n, 0) >= 5 then mx else gx end as sx, case when coalesce(n, 0) >= 5 then my else gy end as sy from w{n} left join k{n} on k{n}.b_id = w{n}.b_id cross join (select quantile_cont(dx, 0.5) as gx, quantile_cont(dy, 0.5) as gy from g{n}) z)"""


_FIELD = f"{_MUTUAL}, f0 as (select b_id, gx as sx, gy as sy from layer_b cross join (select quantile_cont(dx, 0.5) as gx, quantile_cont(dy, 0.5) as gy from m) z), {_round(1)}, {_round(2)}"


@query("layer_a", "layer_b", more=_FIELD, sql="select b_id, round(sx, 9) as sx, round(sy, 9) as sy from f2")
def shift_field(a, b):
    """Two rounds of anchors and local shifts."""
    return coreg.estimate(a, b).select("b_id", F.round("sx", 9).alias("sx"), F.round("sy", 9).alias("sy"))


# --- points, empty space, cover, roads -------------------------------------------------------------------------------

_PD = "sqrt(greatest(p.x1 - t.px, t.px - p.x2, 0.0) * greatest(p.x1 - t.px, t.px - p.x2, 0.0) + greatest(p.y1 - t.py, t.py - p.y2, 0.0) * greatest(p.y1 - t.py, t.py - p.y2, 0.0))"
_IN = "(t.px > p.x1 and t.px < p.x2 and t.py > p.y1 and t.py < p.y2)"


IN_PARCEL = f"select tax_id, a_id, dist from (select t.tax_id, p.a_id, {_PD} as dist, row_number() over (partition by t.tax_id order by not {_IN}, {_PD}, case when {_IN} then -p.a_id else p.a_id end) as rn from tax t join layer_a p on {_IN} or {_PD} <= 3) x where rn = 1"


@query("tax", "layer_a", sql=IN_PARCEL)
def point_in_parcel(tax, a):
    return harmonise.join_points(tax, "tax_id", a, "a_id")


@query("layer_a", "big", sql=f"select a.big_id from (select big_id, x1 + 40 as x1, y1 + 20 as y1, x1 + 52 as x2, y1 + 32 as y2 from big) a where not exists (select 1 from layer_a b where {D2} <= 2.25)")
def empty_space(a, big):
    """Boxes that keep 1.5 m from every parcel."""
    new = big.select("big_id", (F.col("x1") + 40).alias("x1"), (F.col("y1") + 20).alias("y1"), (F.col("x1") + 52).alias("x2"), (F.col("y1") + 32).alias("y2"))
    near = join_boxes(new.withColumnRenamed("big_id", "key"), a.withColumnRenamed("a_id", "key"), 1.5).select(F.col("a_key").alias("big_id"))
    return new.join(near, "big_id", "left_anti").select("big_id")


@query("big", "layer_a", sql=f"select a.big_id, coalesce(sum({INTER}), 0) / max({AREA_A}) as share from big a left join layer_a b on {INTER} > 0 group by a.big_id")
def cover_share(big, a):
    return cover(big, "big_id", a.select("x1", "y1", "x2", "y2"))


_ROAD = "select * from (values (0.0, 130.0, 4000.0, 160.0), (0.0, 280.0, 4000.0, 300.0), (310.0, 0.0, 325.0, 120.0)) v(x1, y1, x2, y2)"


def _reserve(df):
    rows = "inline(array(struct(0D as x1, 130D as y1, 4000D as x2, 160D as y2), struct(0D as x1, 280D as y1, 4000D as x2, 300D as y2), struct(310D as x1, 0D as y1, 325D as x2, 120D as y2)))"
    return df.sparkSession.range(1).selectExpr(rows)


_ENC = f"(select id, round(ov, 1) as overlap_m2, round(ov / area, 3) as share from (select a.{{key}} as id, {AREA_A} as area, sum({INTER}) as ov from {{layer}} a join ({_ROAD}) b on {INTER} > 0 group by 1, 2) t where ov > 5 and ov / area > 0.10)"


@query("layer_a", "layer_b", sql=f"select e.id as a_id, overlap_m2, share, exists (select 1 from {_ENC.format(key='b_id', layer='layer_b')} o join layer_b b on b.b_id = o.id join layer_a a on a.a_id = e.id where {D2} <= 0) as confirmed from {_ENC.format(key='a_id', layer='layer_a')} e")
def encroachment(a, b):
    flags = roads.encroaching(a, "a_id", _reserve(a)).join(a.select("a_id", "x1", "y1", "x2", "y2"), "a_id")
    others = roads.encroaching(b, "b_id", _reserve(a)).join(b.select("b_id", "x1", "y1", "x2", "y2"), "b_id").select("x1", "y1", "x2", "y2")
    return roads.confirmed(flags, "a_id", others).select("a_id", "overlap_m2", "share", "confirmed")


_TABLE = "case highway " + " ".join(f"when '{k}' then {v}" for k, v in roads.HALF_WIDTH.items()) + " else 3.0 end"


@query("roads", sql=f"""select road_id, highway, cast(case when try_cast(split_part(trim(replace(width, 'm', ' ')), ' ', 1) as double) / 2 between 0.5 and 30 then try_cast(split_part(trim(replace(width, 'm', ' ')), ' ', 1) as double) / 2
  when try_cast(split_part(lanes, ';', 1) as double) is not null then greatest(1.0, try_cast(split_part(lanes, ';', 1) as double) * 3.5 / 2) else {_TABLE} end as double) as half_width from roads where highway not in {roads.NOT_ROADS}""")
def road_half_width(r):
    return r.where(~F.col("highway").isin(*roads.NOT_ROADS)).select("road_id", "highway", roads.half_width(F.col("width"), F.col("lanes"), F.col("highway")).alias("half_width"))


@query("layer_a", "layer_b", sql="select count(*) > 0 as overlap from (select min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from layer_a) a, (select min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from layer_b) b where b.x1 <= a.x2 + 50 and b.x2 >= a.x1 - 50 and b.y1 <= a.y2 + 50 and b.y2 >= a.y1 - 50")
def layer_guard(a, b):
    """Whether two layers lie in the same place: their extents, 50 m apart at most."""
    extent = lambda df, p: df.agg(F.min("x1").alias(f"{p}x1"), F.min("y1").alias(f"{p}y1"), F.max("x2").alias(f"{p}x2"), F.max("y2").alias(f"{p}y2"))
    dx, dy = boxes.apart("a_", "b_")
    return extent(a, "a_").crossJoin(extent(b, "b_")).select(((dx <= 50) & (dy <= 50)).alias("overlap"))


# --- change ----------------------------------------------------------------------------------------------------------


def _epochs(a, b):
    return predicted(a, b).select(F.col("a_id").alias("earlier_id"), F.col("b_id").alias("later_id"), F.round("iou", 6).alias("p"), "area_ratio", F.col("area_a").alias("area_e"), F.col("area_b").alias("area_l"))


_GREEDY = f"""{PAIRS}, s as (select a_id, b_id, round(iou, 6) as p, area_ratio, area_a, area_b, row_number() over (order by round(iou, 6) desc, a_id, b_id) as i from pairs where round(iou, 6) >= 0.3),
  g as (with recursive c as (select cast(0 as bigint) as i, [cast(-1 as bigint)] as ua, [cast(-1 as bigint)] as ub, false as take union all select s.i, case when list_contains(ua, a_id) or list_contains(ub, b_id) then ua else list_append(ua, a_id) end,
    case when list_contains(ua, a_id) or list_contains(ub, b_id) then ub else list_append(ub, b_id) end, not (list_contains(ua, a_id) or list_contains(ub, b_id)) from c join s on s.i = c.i + 1) select s.* from c join s using (i) where take)"""


@query("layer_a", "layer_b", more=_GREEDY, sql="select a_id as earlier_id, b_id as later_id, p, area_ratio, area_a as area_e, area_b as area_l from g")
def greedy_match(a, b):
    """One-to-one links by overlap; the SQL is the pass itself, pair by pair."""
    return changes.greedy(_epochs(a, b).where("p >= 0.3"), "earlier_id", "later_id")


@query("layer_a", "layer_b", more=_GREEDY, sql="""select a_id as earlier_id, b_id as later_id, case when area_ratio < 0.8 then 'altered' else 'unchanged' end as change, p, round(100 * (area_b - area_a) / greatest(area_a, 1e-9), 1) as area_change_pct from g
  union all select a_id, null, 'demolished', null, null from layer_a where a_id not in (select a_id from g) union all select null, b_id, 'new', null, null from layer_b where b_id not in (select b_id from g)""")
def change_classes(a, b):
    return changes.classify(_epochs(a, b), a.select(F.col("a_id").alias("earlier_id")), b.select(F.col("b_id").alias("later_id")), 0.3)


_CLS = """f as (select case when b_id is null then 'demolished' when iou >= 0.8 then 'unchanged' else 'altered' end as change, l.a_id as earlier_id, o.b_id as later_id from layer_a l left join one o on l.a_id = o.a_id),
  t as (select case when error_type = 'scale' then 'altered' when error_type = 'missing' then 'demolished' else 'unchanged' end as change, l.a_id as earlier_id, u.b_id as later_id from layer_a l left join (select a_id, min(b_id) as b_id from truth group by a_id) u on l.a_id = u.a_id),
  fk as (select distinct change, coalesce(cast(earlier_id as varchar), '') as e, coalesce(cast(later_id as varchar), '') as l from f), tk as (select distinct change, coalesce(cast(earlier_id as varchar), '') as e, coalesce(cast(later_id as varchar), '') as l from t)"""


@query("layer_a", "layer_b", "truth", more=f"{BUCKETS}, {ONE}, {_CLS}, j as (select coalesce(fk.change, tk.change) as change, fk.change is not null as d, tk.change is not null as t from fk full join tk on fk.change = tk.change and fk.e = tk.e and fk.l = tk.l)",
       sql="select change, count_if(t) as n_true, count_if(d) as n_detected, count_if(t and d) as n_correct, case when count_if(d) > 0 then count_if(t and d) / count_if(d) else 1.0 end as \"precision\", case when count_if(t) > 0 then count_if(t and d) / count_if(t) else 1.0 end as recall from j group by change")
def change_scores(a, b, truth):
    one = relations.one_to_one(predicted(a, b)).select("a_id", "b_id", "iou")
    kind = F.when(F.col("b_id").isNull(), "demolished").when(F.col("iou") >= 0.8, "unchanged").otherwise("altered")
    found = a.select("a_id").join(one, "a_id", "left").select(kind.alias("change"), F.col("a_id").alias("earlier_id"), F.col("b_id").alias("later_id"))
    own = truth.groupBy("a_id").agg(F.min("b_id").alias("b_id"))
    true = F.when(F.col("error_type") == "scale", "altered").when(F.col("error_type") == "missing", "demolished").otherwise("unchanged")
    return changes.score(found, a.select("a_id", "error_type").join(own, "a_id", "left").select(true.alias("change"), F.col("a_id").alias("earlier_id"), F.col("b_id").alias("later_id")))
