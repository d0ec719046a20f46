"""DuckDB SQL of the name similarities: bits of one number again, but as expressions over lists."""

from __future__ import annotations


def _normal(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _tokens(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def _expanded(own: str, other: str) -> str:
    return f"list_transform({own}, lambda w: case when length(w) = 1 then coalesce(list_filter({other}, lambda o: length(o) > 1 and o[1] = w)[1], w) else w end)"


def _line(words: str) -> str:
    return f"array_to_string({words}, ' ')"


_BIT = "list_aggregate(list_transform(range(length(s)), lambda i: case when s[i + 1] = c then 1::hugeint << i::hugeint else 0::hugeint end), 'sum')::hugeint"
_FULL = "((1::hugeint << length(s)::hugeint) - 1)"
_ROW = f"list_reduce(list_prepend({_FULL}, list_transform(string_split(t, ''), lambda c: {_BIT})), lambda r, h: ((r + (r & h)) | (r - (r & h))) & {_FULL})"


def _set(x: str) -> str:
    """Token set ratio of what sides() calls x."""
    return f"""case when len({x}a) = 0 or len({x}b) = 0 then 0.0::double when len({x}both) > 0 and (len({x}own_a) = 0 or len({x}own_b) = 0) then 1.0::double
    else greatest({x}r_full, case when len({x}both) > 0 then greatest({x}r_a, {x}r_b) else 0 end) end"""


def names(pairs: str) -> str:
    """Common table expressions that end in nm (oa, ob, ratio, token_sort, token_set, owner_similarity), one row for each different pair of `pairs` (oa, ob)."""
    sides = lambda x: f"""list_sort(list_distinct(list_filter({x}a, lambda w: list_contains({x}b, w)))) as {x}both, list_sort(list_distinct(list_filter({x}a, lambda w: not list_contains({x}b, w)))) as {x}own_a,
      list_sort(list_distinct(list_filter({x}b, lambda w: not list_contains({x}a, w)))) as {x}own_b"""  # noqa: E731
    full = lambda x, k: _line(f"list_concat({x}both, {x}own_{k})")
    texts = {"r_plain": ("na", "nb"), "r_sort": (_line("list_sort(ta)"), _line("list_sort(tb)")), "r_esort": (_line("list_sort(ea)"), _line("list_sort(eb)")),
             "r_loose1": ("array_to_string(list_sort(ea), '')", "array_to_string(list_sort(eb), '')"), "r_loose2": ("array_to_string(ea, '')", "array_to_string(eb, '')")}
    for x in ("t", "e"):
        texts |= {f"{x}r_full": (full(x, "a"), full(x, "b")), f"{x}r_a": (_line(f"{x}both"), full(x, "a")), f"{x}r_b": (_line(f"{x}both"), full(x, "b"))}
    compared = ", ".join(f"{{'kind': '{k}', 's': {s}, 't': {t}}}" for k, (s, t) in texts.items())
    wide = ", ".join(f"max(case when kind = '{k}' then r end) as {k}" for k in texts)
    return f"""np as (select distinct oa, ob from ({pairs}) z), n0 as (select row_number() over () as id, oa, ob, {_normal("oa")} as na, {_normal("ob")} as nb from np), n1 as (select *, {_tokens("na")} as ta, {_tokens("nb")} as tb from n0),
  n2 as (select *, {_expanded("ta", "tb")} as ea, {_expanded("tb", "ta")} as eb from n1), n3 as (select *, {sides("t")}, {sides("e")} from n2),
  n4 as (select id, c.kind as kind, c.s as s, c.t as t from (select id, unnest([{compared}]) as c from n3) z),
  nr as (select s, t, case when s = '' and t = '' then 1.0::double when s = '' or t = '' then 0.0::double else 2.0::double * (length(s) - bit_count({_ROW})) / (length(s) + length(t)) end as r from (select distinct s, t from n4) z),
  n5 as (select id, {wide} from n4 join nr using (s, t) group by id),
  nm as (select oa, ob, r_plain as ratio, r_sort as token_sort, {_set("t")} as token_set,
    case when len(ta) = 0 or len(tb) = 0 then 0.0::double else greatest(r_esort, ({_set("e")}) * 0.95::double, greatest(r_loose1, r_loose2) * 0.97::double) end as owner_similarity from n3 join n5 using (id))"""
