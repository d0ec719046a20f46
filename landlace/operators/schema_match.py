"""Which column of a register means what: evidence from names and from values, and the best assignment."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.functions import strings

#: Fields of a record and what registers call them.
FIELDS = {
    "parcel_ref": ("patta no", "khata no", "parcel id", "property id", "assessment no", "ulpin", "record no"),
    "owner_name": ("owner name", "pattadar name", "assessee", "holder", "khatedar", "owner", "name of owner"),
    "area": ("area", "extent", "plinth area", "size", "built up area", "area sqft", "area cents"),
    "land_use": ("land use", "classification", "usage", "use", "category", "zoning", "classfn"),
    "survey_no": ("survey no", "sf no", "s f no", "khasra no", "plot no", "survey field no"),
}


def profile(table: DataFrame, order: str | None = None, rows: int = 400) -> DataFrame:
    """(column, numeric, uniq, name_like, multiword, slash): shares over each column's first non-null values in the given order.

    Only a bounded number of rows is profiled: that many of each column, taken as top-k.
    """
    parts = []
    for c in table.columns:
        own = table.where(F.col(c).isNotNull())
        v = F.col(c).cast("string")
        head = (own.orderBy(order) if order else own).limit(rows).select(v.alias("v"))
        words = F.size(F.filter(F.split("v", "\\s+"), lambda w: w != ""))
        share = lambda cond: F.avg(cond.cast("int"))
        parts.append(head.agg(F.lit(c).alias("column"), share(F.regexp_replace("v", ",", "").try_cast("double").isNotNull()).alias("numeric"), (F.countDistinct("v") / F.count("v")).alias("uniq"),
                              share(F.col("v").rlike("^[A-Za-z][A-Za-z .,']+$")).alias("name_like"), share(words >= 2).alias("multiword"), share(F.col("v").rlike("[0-9]+\\s*/\\s*\\w+")).alias("slash")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def evidence(profiles: DataFrame) -> DataFrame:
    """(column, field, name_evidence, value_evidence, score) for every column and field."""
    numeric, uniq = F.col("numeric"), F.col("uniq")
    value = {
        "parcel_ref": F.when(numeric < 1, (1 - numeric * 0.5) * uniq).otherwise(0.3 * uniq), "owner_name": F.col("name_like") * (0.5 + 0.5 * F.col("multiword")) * uniq,
        "area": numeric * F.when(uniq > 0.5, 1.0).otherwise(0.4), "land_use": (1 - numeric) * F.when(uniq < 0.05, 1.0).otherwise(0.0), "survey_no": F.col("slash"),
    }
    name = strings.cleaned(F.col("column"))
    fields = [F.struct(F.lit(f).alias("field"), F.greatest(*[strings.token_set(name, F.lit(s)) for s in own]).alias("name_evidence"), F.coalesce(value[f], F.lit(0.0)).alias("value_evidence")) for f, own in FIELDS.items()]
    rows = profiles.select("column", F.explode(F.array(*fields)).alias("x")).select("column", "x.*")
    return rows.withColumn("score", 0.55 * F.col("name_evidence") + 0.45 * F.col("value_evidence"))


def assign(scores: dict[tuple[str, str], float], columns: list[str], fields: list[str]) -> dict[str, str]:
    """Column to field, one to one, with the largest total: dynamic programming over which of the few fields are taken."""

    @cache
    def best(i: int, taken: int) -> tuple[float, tuple]:
        if i == len(columns):
            return 0.0, ()
        options = [best(i + 1, taken)]
        for k, f in enumerate(fields):
            if not taken >> k & 1:
                total, rest = best(i + 1, taken | 1 << k)
                options.append((total + scores[columns[i], f], ((columns[i], f), *rest)))
        return max(options, key=lambda o: o[0])

    return dict(best(0, 0)[1])


def match(table: DataFrame, order: str | None = None) -> list[dict]:
    """One entry for each column: its field (None if none is left), confidence and evidence. As many scores as columns times fields reach the driver."""
    rows = {(r["column"], r["field"]): r for r in evidence(profile(table, order)).collect()}
    columns, fields = list(table.columns), list(FIELDS)
    chosen = assign({k: r["score"] for k, r in rows.items()}, columns, fields)
    out = []
    for c in columns:
        r = rows.get((c, chosen.get(c, "")))
        out.append({"column": c, "field": chosen.get(c), "confidence": round(r["score"], 3) if r else 0.0, "name_evidence": round(r["name_evidence"], 2) if r else 0.0, "value_evidence": round(r["value_evidence"], 2) if r else 0.0})
    return out
