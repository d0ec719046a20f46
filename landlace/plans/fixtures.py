"""Layers, registers and logs made from the driver tables.

Each is a select list that Spark and DuckDB read alike. Coordinates are small multiples of powers of one half, so both
engines agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST = "Asha,Bilal,Chitra,Dinesh,Esther,Farid,Gita,Harish,Indu,Jamal,Kavya,Lalit"
LAST = "Acharya,Banerjee,Chauhan,Dutta,Fernandes,Gomes,Hegde,Joshi,Kulkarni,Mehta,Nayak"

_GX, _GY = "(p_partkey % 40)", "((p_partkey - p_partkey % 40) / 40)"
_X1 = f"{_GX} * 30 + ({_GX} - {_GX} % 10) / 10 * 14 + 1 + (p_partkey * 5) % 7"
_Y1 = f"{_GY} * 30 + (p_partkey - p_partkey % 400) / 400 * 14 + 1 + (p_partkey * 3) % 7"
_NEXT = f"({_GX} + 1) * 30 + (({_GX} + 1) - ({_GX} + 1) % 10) / 10 * 14 + 1 + ((p_partkey + 1) * 5) % 7"
_OWNER = f"concat(split_part('{FIRST}', ',', cast(1 + p_partkey % 12 as int)), ' ', split_part('{LAST}', ',', cast(1 + (p_partkey * 7) % 11 as int)))"

BASE = f"""select p_partkey as k, (p_partkey * 37) % 100 as c, cast({_X1} as double) as x, cast({_Y1} as double) as y,
  cast(10 + (p_partkey * 7) % 13 as double) as w, cast(10 + (p_partkey * 11) % 13 as double) as d, cast({_NEXT} as double) as x_next, {_OWNER} as owner from part"""
_KIND = """case when c < 38 then 'clean' when c < 54 then 'offset' when c < 70 then 'scale' when c < 84 then 'split' when c < 92 then 'missing' else 'nudged' end"""

LAYER_A = f"select k as a_id, owner, {_KIND} as error_type, x as x1, y as y1, x + w as x2, y + d as y2 from ({BASE}) t"

_DX = "case when c < 38 then ((k * 3) % 9 - 4) / 4.0 when c < 54 then 3 + k % 8 when c < 70 then 1 when c < 84 then 0 else 1 end"
_DY = "case when c < 38 then ((k * 5) % 9 - 4) / 4.0 when c < 54 then -(3 + k % 5) when c < 70 then -0.5 when c < 84 then 0 else -0.5 end"
_F = "case when c >= 54 and c < 64 then 0.75 when c >= 64 and c < 70 then 1.25 else 1.0 end"
_B = f"select k, c, owner, x + cast({_DX} as double) as x1, y + cast({_DY} as double) as y1, w * cast({_F} as double) as w, d * cast({_F} as double) as d from ({BASE}) t where not (c >= 84 and c < 92)"
_VARIANT = """case when k % 7 = 1 then upper(owner) when k % 7 = 2 then concat(split_part(owner, ' ', 2), ', ', split_part(owner, ' ', 1))
  when k % 7 = 3 then concat(substr(owner, 1, 1), '. ', split_part(owner, ' ', 2)) else owner end"""
_LEFT, _WHOLE = "c >= 70 and c < 84", "not (c >= 70 and c < 84)"
LAYER_B = f"""select 2 * k as b_id, {_VARIANT} as owner, x1, y1, case when {_LEFT} then x1 + w / 2 else x1 + w end as x2, y1 + d as y2 from ({_B}) u
  union all select 2 * k + 1 as b_id, {_VARIANT} as owner, x1 + w / 2 as x1, y1, x1 + w as x2, y1 + d as y2 from ({_B}) u where {_LEFT}"""
TRUTH = f"select k as a_id, 2 * k as b_id, {_KIND} as error_type from ({BASE}) t where not (c >= 84 and c < 92) union all select k as a_id, 2 * k + 1 as b_id, 'split' as error_type from ({BASE}) t where {_LEFT}"

#: A layer with faults: every 17th box meets its neighbour, every 19th leaves a quarter metre, every 23rd is a sliver.
LAYER_T = f"""select k as id, x as x1, y as y1, case when k % 17 = 0 then x + 31 when k % 19 = 0 and ({'k % 40'}) % 10 <> 9 then x_next - 0.25 else x + w end as x2,
  case when k % 23 = 0 then y + 0.125 else y + d end as y2 from ({BASE}) t"""
#: Large outlines that take in a parcel and part of its surroundings.
BIG = f"select k as big_id, x - 1 as x1, y - 1 as y1, x + 61 as x2, y + d + 13 as y2 from ({BASE}) t"
#: Tax register: points near the centre of a parcel, with a name, a plinth area in square feet and a usage code.
TAX = f"""select c_custkey as tax_id, t.k as a_true, x + w / 2 + ((c_custkey * 3) % 9 - 4) * 2 as px, y + d / 2 + ((c_custkey * 5) % 9 - 4) * 2 as py,
  case when c_custkey % 11 = 0 then c_name when c_custkey % 5 = 0 then upper(owner) else owner end as assessee, cast(w * d * 8 as double) as plinth_sqft,
  case when c_mktsegment = 'HOUSEHOLD' then 'Res' when c_mktsegment = 'MACHINERY' then 'shop' when c_mktsegment = 'BUILDING' then 'mix' else 'dwelling' end as usage
  from customer join ({BASE}) t on c_custkey = t.k"""
#: Revenue register: areas in cents, a classification, a survey number.
REVENUE = """select b_id, concat('P-', cast(b_id as string)) as patta_no, owner as pattadar, (x2 - x1) * (y2 - y1) / 32.0 * (case when b_id % 13 = 0 then 2 else 1 end) as extent,
  case when b_id % 3 = 0 then 'residential' when b_id % 10 = 1 then 'Com' else 'natham' end as classfn, concat(cast(b_id % 50 as string), '/', cast(b_id % 7 as string)) as sf_no from layer_b"""
#: Roads of the map: strips along the streets between blocks; tags as they come, clean or not.
ROADS = """select o_orderkey as road_id, case o_orderkey % 8 when 0 then 'motorway' when 1 then 'primary' when 2 then 'residential' when 3 then 'service' when 4 then 'footway' when 5 then 'track' when 6 then 'tertiary' else 'path' end as highway,
  case o_orderkey % 5 when 0 then '7' when 1 then '6 m' when 2 then 'wide' when 3 then '' else null end as width, case o_orderkey % 4 when 0 then '2;3' when 1 then '2' when 2 then 'two' else null end as lanes from orders"""
#: A log of decisions: clicks accept, views reject, purchases go to review, by `user_id % 40` officers on 200 pairs.
DECISIONS = """select event_id as seq, ts, user_id % 200 as pair, concat('officer', cast(user_id % 40 as string)) as officer,
  case event_type when 'click' then 'accept' when 'view' then 'reject' else 'review' end as decision, case when event_id % 5 = 0 then cast(null as string) when event_id % 3 = 0 then 'real' else 'synthetic' end as dataset
  from events where event_type in ('click', 'view', 'purchase')"""
LABELS = """select event_id as seq, concat('pair', cast(event_id % 300 as string)) as pair_id, concat('user', cast(user_id % 4 as string)) as labeller,
  case when event_id % 11 = 0 then 'unsure' when value > 20 then 'same' else 'different' end as label, case when event_id % 9 = 0 then cast(null as double) else 3 + floor(value) end as secs from events where event_type <> 'signup'"""
#: The sample the labels are for: strata by score, each with what it stands for.
SAMPLE = """select concat('pair', cast(item as string)) as pair_id, item % 5 as stratum, ((item * 37) % 100) / 100.0 as p, ((item * 53) % 100) / 100.0 as iou from (select distinct event_id % 300 as item from events) t"""
STRATA = "select stratum, 40 + 100 * stratum as population, count(*) as sampled from sample group by stratum"
ACCESS = """select event_id as seq, user_id, ts, case event_type when 'error' then 'failed' when 'signup' then 'success' else event_type end as event from events"""
#: Two years of a raster: presence and height by pixel; blocks appear, vanish and grow.
PIXELS = """select r, q, case when r >= 10 and r < 20 and q >= 10 and q < 30 then 0.75 when r >= 70 and r < 74 and q >= 20 and q < 40 then 0.8125 else 0.0625 end as p0,
  case when r >= 10 and r < 20 and q >= 10 and q < 30 then 0.8125 when r >= 50 and r < 60 and q >= 50 and q < 60 then 0.875 when r = 5 and q = 5 then 0.9375 else 0.0625 end as p1,
  case when r >= 10 and r < 20 then 6.0 else 3.0 end as h0, case when r >= 10 and r < 20 and q >= 20 then 13.5 when r >= 10 and r < 20 then 6.5 else 3.0 end as h1
  from (select cast(event_id % 100 as int) as r, cast((event_id - event_id % 100) / 100 as int) as q from events) g"""

PARTS = {
    "layer_a": LAYER_A, "layer_b": LAYER_B, "truth": TRUTH, "layer_t": LAYER_T, "big": BIG, "tax": TAX, "revenue": REVENUE, "roads": ROADS, "decisions": DECISIONS,
    "labels_log": LABELS, "sample": SAMPLE, "strata": STRATA, "access_log": ACCESS, "pixels": PIXELS,
}
NEEDS = {"revenue": ("layer_b",), "strata": ("sample",)}


def ctes(*names: str) -> str:
    """`with ...` of the named parts and of what they need, for DuckDB."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*NEEDS.get(n, ()), n) if x not in order]
    return "with " + ",\n".join(f"{n} as ({PARTS[n].replace(' as string)', ' as varchar)')})" for n in order)


def part(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A part as a DataFrame; its tables are read by path, so nothing is registered."""
    sql = PARTS[name]
    frames = {}
    for n in NEEDS.get(name, ()):
        frames[n] = part(spark, sf_dir, n)
    for t in ("part", "customer", "orders", "events"):
        if f"from {t}" in sql or f"join {t}" in sql:
            frames[f"{t}_table"] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = sql.replace(f"from {t}", f"from {{{t}_table}}").replace(f"join {t} ", f"join {{{t}_table}} ")
    for n in NEEDS.get(name, ()):
        sql = sql.replace(f"from {n}", f"from {{{n}}}")
    return spark.sql(sql, **frames)
