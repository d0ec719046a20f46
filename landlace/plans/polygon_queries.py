"""The spatial operators on polygons that aren't boxes: L-shaped layers, whose measures SQL adds up from two boxes each, and turned squares,
whose measures are those of boxes in turned coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.operators import coreg, polygons, raster
from landlace.plans.registry import query
from landlace.plans.spatial_queries import D2, INTER

#: A distance that no two corners on the layers' grid can have exactly.
REACH = 29.9


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ell(layer: DataFrame, key: str, *more: str) -> DataFrame:
    """Each box without its upper right quarter."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    xm, ym = (x1 + x2) / 2, (y1 + y2) / 2
    return layer.select(key, *more, F.array(F.array(*[_point(*p) for p in ((x1, y1), (x2, y1), (x2, ym), (xm, ym), (xm, y2), (x1, y2))])).alias("geom"))


def turned(layer: DataFrame, key: str) -> DataFrame:
    """A square on its corner at each box's centre, as wide as the box."""
    x, y, r = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, (F.col("x2") - F.col("x1")) / 2
    return layer.select(key, F.array(F.array(*[_point(*p) for p in ((x - r, y), (x, y - r), (x + r, y), (x, y + r))])).alias("geom"))


def _ells(name: str, layer: str, key: str) -> str:
    """The two boxes of each L, and areas."""
    return f"""{name} as (select {key} as k, x1, y1, x2, (y1 + y2) / 2 as y2 from {layer} union all select {key} as k, x1, (y1 + y2) / 2 as y1, (x1 + x2) / 2 as x2, y2 from {layer}),
  {name}_area as (select {key} as k, (x2 - x1) * (y2 - y1) * 0.75 as m, (x2 - x1 + y2 - y1) * 2 as p from {layer})"""


def _pairs(name: str, a: str, b: str, on: str = "true") -> str:
    return f"{name} as (select a.k as i, b.k as j, sum({INTER}) as inter, min(sqrt({D2})) as dist from {a} a join {b} b on {on} group by 1, 2)"


_AB = ", ".join([_ells("la", "layer_a", "a_id"), _ells("lb", "layer_b", "b_id"), _pairs("ab", "la", "lb", f"{D2} <= 1600")])


@query("layer_a", "layer_b", more=_AB, sql=f"select i as a_id, j as b_id, round(inter / (x.m + y.m - inter), 6) as iou, round(inter / x.m, 6) as inter_over_a, round(inter / y.m, 6) as inter_over_b, round(least(x.m, y.m) / greatest(x.m, y.m), 6) as area_ratio, count(*) over (partition by i) as n_cand_a from ab join la_area x on x.k = i join lb_area y on y.k = j where dist <= {REACH}")
def polygon_features(a, b):
    out = polygons.pair_features(ell(a, "a_id"), ell(b, "b_id"), REACH)
    return out.select("a_id", "b_id", *[F.round(c, 6).alias(c) for c in ("iou", "inter_over_a", "inter_over_b", "area_ratio")], "n_cand_a")


_TURN = lambda name, layer, key: f"{name} as (select {key} as k, (x1 + x2) / 2 + (y1 + y2) / 2 - (x2 - x1) / 2 as x1, (x1 + x2) / 2 - (y1 + y2) / 2 - (x2 - x1) / 2 as y1, (x1 + x2) / 2 + (y1 + y2) / 2 + (x2 - x1) / 2 as x2, (x1 + x2) / 2 - (y1 + y2) / 2 + (x2 - x1) / 2 as y2 from {layer})"


@query("layer_a", "layer_b", more=f"{_TURN('ta', 'layer_a', 'a_id')}, {_TURN('tb', 'layer_b', 'b_id')}", sql=f"select a.k as a_id, b.k as b_id, round({INTER} / 2, 6) as inter, round(sqrt({D2} / 2), 6) as dist from ta a join tb b on sqrt({D2} / 2) <= {REACH}")
def turned_pairs(a, b):
    pairs = polygons._joined(turned(a, "a_id"), "a_id", turned(b, "b_id"), "b_id", REACH)
    g, h = F.col("a_geom"), F.col("b_geom")
    found = pairs.select(F.col("a_key").alias("a_id"), F.col("b_key").alias("b_id"), polygons.shared(g, h).alias("inter"), polygons.distance(g, h).alias("dist")).where(F.col("dist") <= REACH)
    return found.select("a_id", "b_id", F.round("inter", 6).alias("inter"), F.round("dist", 6).alias("dist"))


_T = ", ".join([_ells("lt", "layer_t", "id"), _pairs("tt", "lt", "lt", f"a.k < b.k and {D2} <= 1")])


@query("layer_t", more=_T, sql="select i, j, round(inter, 6) as overlap from tt where inter > 0.5")
def polygon_overlaps(t):
    return polygons.overlaps(ell(t, "id"), "id").select("i", "j", F.round("overlap", 6).alias("overlap"))


@query("layer_t", more=_T, sql="select i, j, round(dist, 6) as gap from tt where dist > 0 and dist <= 0.3")
def polygon_near_misses(t):
    return polygons.near_misses(ell(t, "id"), "id").select("i", "j", F.round("gap", 6).alias("gap"))


@query("layer_t", more=_T, sql="""select (select count(*) from tt where inter > 0.5) as overlaps, round((select coalesce(sum(inter), 0) from tt where inter > 0.5), 6) as overlap_area_m2, (select count(*) from tt where dist > 0 and dist <= 0.3) as near_miss_gaps,
  (select count(*) from layer_t) + (select count(*) from layer_t where id % 29 = 0) as parcels, (select count(*) from layer_t where id % 29 = 0) as invalid, (select count(*) from lt_area where m > 0 and (m < 2 or 4 * pi() * m / (p * p) < 0.08)) as slivers""")
def polygon_topology(t):
    """With a bow-tie of its own place for every 29th parcel."""
    x = F.lit(1e6) + F.col("id") * 100
    corners = F.array(*[_point(x + dx, F.lit(dy)) for dx, dy in ((0, 0), (10, 10), (10, 0), (0, 10))])
    ties = t.where("id % 29 = 0").select((-1 - F.col("id")).alias("id"), F.array(corners).alias("geom"))
    return polygons.report(ell(t, "id").unionByName(ties), "id").withColumn("overlap_area_m2", F.round("overlap_area_m2", 6))


_BIG = ", ".join([_ells("la", "layer_a", "a_id"), _ells("lg", "big", "big_id"), _pairs("ag", "la", "lg", f"{INTER} > 0")])


@query("layer_a", "big", more=_BIG, sql="select a_id, big_id, share from (select i as a_id, j as big_id, round(inter / x.m, 9) as share, row_number() over (partition by i order by round(inter / x.m, 9) desc, j) as rn from ag join la_area x on x.k = i join lg_area y on y.k = j where round(inter / x.m, 9) >= 0.6 and y.m >= 1.8 * x.m) t where rn = 1")
def polygon_part_of(a, big):
    return polygons.part_of(ell(a, "a_id"), "a_id", ell(big, "big_id"), "big_id")


_IN = "((t.px > p.x1 and t.px < p.x2 and t.py > p.y1 and t.py < (p.y1 + p.y2) / 2) or (t.px > p.x1 and t.px < (p.x1 + p.x2) / 2 and t.py > p.y1 and t.py < p.y2))"
_OUT = lambda x2, y1, y2: f"sqrt(pow(greatest(p.x1 - t.px, t.px - {x2}, 0.0), 2) + pow(greatest({y1} - t.py, t.py - {y2}, 0.0), 2))"
_PD = f"case when {_IN} then 0.0 else round(least({_OUT('p.x2', 'p.y1', '(p.y1 + p.y2) / 2')}, {_OUT('(p.x1 + p.x2) / 2', 'p.y1', 'p.y2')}), 9) end"


@query("tax", "layer_a", sql=f"select tax_id, a_id, round(dist, 6) as dist from (select t.tax_id, p.a_id, {_PD} as dist, row_number() over (partition by t.tax_id order by not {_IN}, {_PD}, case when {_IN} then -p.a_id else p.a_id end) as rn from tax t join layer_a p on {_IN} or {_PD} <= 3) x where rn = 1")
def point_in_polygon(tax, a):
    return polygons.join_points(tax, "tax_id", ell(a, "a_id"), "a_id").withColumn("dist", F.round("dist", 6))


@query("tax", "layer_a", sql=f"select count(*) as joined, round(avg(case when a_id = a_true then 1 else 0 end), 9) as accuracy from (select t.tax_id, t.a_true, p.a_id, row_number() over (partition by t.tax_id order by not {_IN}, {_PD}, case when {_IN} then -p.a_id else p.a_id end) as rn from tax t join layer_a p on {_IN} or {_PD} <= 3) x where rn = 1")
def join_accuracy(tax, a):
    """Share of register points that meet the parcel they belong to."""
    found = polygons.join_points(tax, "tax_id", ell(a, "a_id"), "a_id").join(tax.select("tax_id", "a_true"), "tax_id")
    return found.agg(F.count("*").alias("joined"), F.round(F.avg((F.col("a_id") == F.col("a_true")).cast("int")), 9).alias("accuracy"))


@query("layer_a", "big", more=_BIG, sql="select x.k as big_id, round(coalesce(sum(inter), 0) / max(x.m), 6) as share from lg_area x left join ag on ag.j = x.k group by 1")
def union_cover(a, big):
    """Covers that overlap: each parcel's L, and again its lower half."""
    y = (F.col("y1") + F.col("y2")) / 2
    lower = F.array(F.array(_point(F.col("x1"), F.col("y1")), _point(F.col("x2"), F.col("y1")), _point(F.col("x2"), y), _point(F.col("x1"), y)))
    covers = ell(a, "a_id").select("geom").unionByName(a.select(lower.alias("geom")))
    return polygons.cover(ell(big, "big_id"), "big_id", covers).select("big_id", F.round(F.col("covered") / F.col("area"), 6).alias("share"))


#: Road lines (x, y, x, y) and half widths; the upright one crosses both others.
LINES = ((0.0, 145.0, 4000.0, 145.0, 15.0), (0.0, 290.0, 4000.0, 290.0, 10.0), (317.5, 0.0, 317.5, 320.0, 7.5))
_FLAT = ", ".join(f"({a}, {b - h}, {c}, {d + h})" for a, b, c, d, h in LINES[:2])
_UP = ", ".join(f"({a - h}, {b}, {c + h}, {d})" for a, b, c, d, h in LINES[2:])
_CROSS = ", ".join(f"({a - h}, {f - w}, {a + h}, {f + w})" for a, _, _, _, h in LINES[2:] for _, f, _, _, w in LINES[:2])


def _taken(name: str, parts: str) -> str:
    strips = f"(select *, 1 as sign from (values {_FLAT}, {_UP}) v(x1, y1, x2, y2) union all select *, -1 as sign from (values {_CROSS}) w(x1, y1, x2, y2))"
    return f"{name} as (select k, round(ov, 1) as overlap_m2, round(ov / m, 3) as share from (select a.k, sum(sign * {INTER}) as ov from {parts} a join {strips} b on {INTER} > 0 group by 1) t join {parts}_area using (k) where ov > 5 and ov / m > 0.10)"


@query("layer_a", "layer_b", more=", ".join([_ells("la", "layer_a", "a_id"), _ells("lb", "layer_b", "b_id"), _taken("ea", "la"), _taken("eb", "lb")]),
       sql=f"select k as a_id, overlap_m2, share, exists (select 1 from la a join lb b on {D2} <= 0 join eb on eb.k = b.k where a.k = ea.k) as confirmed from ea")
def road_encroachment(a, b):
    """Shapes in the union of roads that cross one another, from their lines and widths."""
    row = lambda l: F.struct(F.array(_point(F.lit(l[0]), F.lit(l[1])), _point(F.lit(l[2]), F.lit(l[3]))).alias("line"), F.lit(l[4]).alias("half"))
    roads = a.sparkSession.range(1).select(F.posexplode(F.array(*map(row, LINES))).alias("road_id", "r")).select("road_id", "r.*")
    strips = polygons.reserve(roads, "road_id", "half")
    la, lb = ell(a, "a_id"), ell(b, "b_id")
    flags = polygons.encroaching(la, "a_id", strips).join(la.hint("merge"), "a_id")
    others = polygons.encroaching(lb, "b_id", strips).join(lb.hint("merge"), "b_id")
    return polygons.confirmed(flags, "a_id", others).select("a_id", "overlap_m2", "share", "confirmed")


@query("layer_a", "big", more=_ells("la", "layer_a", "a_id") + ", new as (select big_id, x1 + 40 as x1, y1 + 20 as y1, x1 + 52 as x2, y1 + 32 as y2 from big), " + _ells("ln", "new", "big_id"), sql=f"select big_id from big where big_id not in (select a.k from ln a join la b on {D2} <= 2.56)")
def polygon_empty_space(a, big):
    new = big.select("big_id", *[(F.col(c) + d).alias(n) for n, c, d in (("x1", "x1", 40), ("y1", "y1", 20), ("x2", "x1", 52), ("y2", "y1", 32))])
    return polygons.apart_from(ell(new, "big_id"), "big_id", ell(a, "a_id"), 1.6).select("big_id")


@query("layer_a", more=_ells("la", "layer_a", "a_id"), sql=f"select distinct a.k as a_id from la a join (select 295.0 as x1, 295.0 as y1, 505.0 as x2, 405.0 as y2) b on {D2} <= 0")
def near_box(a):
    box = a.sparkSession.range(1).select(F.lit(300.0).alias("x1"), F.lit(300.0).alias("y1"), F.lit(500.0).alias("x2"), F.lit(400.0).alias("y2"))
    return polygons.near_box(ell(a, "a_id"), box).select("a_id")


_CENTRE = lambda n, layer, key: f"{n} as (select {key} as k, x1 + 5 * (x2 - x1) / 12 as x, y1 + 5 * (y2 - y1) / 12 as y from {layer})"
_ND = "sqrt((ca.x - cb.x) * (ca.x - cb.x) + (ca.y - cb.y) * (ca.y - cb.y))"


@query("layer_a", "layer_b", more=f"{_CENTRE('ca', 'layer_a', 'a_id')}, {_CENTRE('cb', 'layer_b', 'b_id')}, near as (select ca.k as a_id, cb.k as b_id, round({_ND}, 6) as dist, cb.x - ca.x as dx, cb.y - ca.y as dy from ca join cb on {_ND} < 15)",
       sql="select a_id, b_id, dist, round(dx, 6) as dx, round(dy, 6) as dy from (select *, row_number() over (partition by a_id order by dist, b_id) as ra, row_number() over (partition by b_id order by dist, a_id) as rb from near) t where ra = 1 and rb = 1")
def centroid_anchors(a, b):
    """Mutual nearest centroids of L-shaped layers, which aren't the centres of their envelopes."""
    return coreg.anchors(ell(a, "a_id"), ell(b, "b_id")).select("a_id", "b_id", *[F.round(c, 6).alias(c) for c in ("dist", "dx", "dy")])


@query("pixels", sql="select zone, r, q from pixels, (values (1, 8.0, -112.0, 120.0, -32.0), (2, 180.0, -260.0, 260.0, -180.0)) v(zone, x1, y1, x2, y2) where ((q + 0.5) * 4 > x1 and (q + 0.5) * 4 < x2 and -(r + 0.5) * 4 > y1 and -(r + 0.5) * 4 < (y1 + y2) / 2) or ((q + 0.5) * 4 > x1 and (q + 0.5) * 4 < (x1 + x2) / 2 and -(r + 0.5) * 4 > y1 and -(r + 0.5) * 4 < y2)")
def pixels_in_polygons(pixels):
    """Pixels of two L-shaped zones, 4 m a pixel."""
    rows = [(1, 8.0, -112.0, 120.0, -32.0), (2, 180.0, -260.0, 260.0, -180.0)]
    zones = pixels.sparkSession.createDataFrame(rows, "zone int, x1 double, y1 double, x2 double, y2 double")
    return raster.zones_of(pixels, ell(zones, "zone"), "zone")


_OPEN = """dr as (select coalesce(quantile_cont(p1 - p0, 0.5), 0) as drift from pixels where p0 > 0.2 and p1 > 0.2), mk as (select r, q, case when p1 - p0 - drift >= 0.4 and p1 >= 0.55 then 'new' when p1 - p0 - drift <= -0.4 and p0 >= 0.55 then 'demolished' end as change from pixels, dr)"""


@query("pixels", more=f"{_OPEN}, m as (select * from mk where change is not null and r >= 40 and r < 80)", sql="""select change, cast(count(*) * 16.0 as double) as area, cast(sum(greatest(least((q + 1) * 4, 220.0) - greatest(q * 4, 90.0), 0) * greatest(least(-r * 4, -215.0) - greatest(-(r + 1) * 4, -289.0), 0)) as double) as covered from m group by change""")
def raster_cover(pixels):
    """The large clusters as polygons, and how much of them a current map's two overlapping outlines cover."""
    m = raster.masks(pixels).where("r >= 40 and r < 80")
    rows = [(1, 90.0, -289.0, 220.0, -215.0), (2, 100.0, -280.0, 200.0, -220.0)]
    box = m.sparkSession.createDataFrame(rows, "k int, x1 double, y1 double, x2 double, y2 double")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    current = box.select(F.array(F.array(_point(x1, y1), _point(x2, y1), _point(x2, y2), _point(x1, y2))).alias("geom"))
    by = raster.cover_by_map(m, current)
    return by.groupBy("change").agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("covered"), 6).alias("covered"))
