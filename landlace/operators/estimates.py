"""Accuracy from hand-checked samples drawn in strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share of k in n; (0, 1) where n is not positive."""
    p, zz = k / n, z * z
    d = 1 + zz / n
    c, h = (p + zz / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / d
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), c - h)).otherwise(F.lit(0.0)), F.when(some, F.least(F.lit(1.0), c + h)).otherwise(F.lit(1.0))


def latest(labels: DataFrame, key: str = "pair_id", order: str = "seq") -> DataFrame:
    """The last row of each key."""
    own = [c for c in labels.columns if c != key]
    return labels.groupBy(key).agg(F.max_by(F.struct(*own), order).alias("x")).select(key, *[f"x.{c}" for c in own])


def checked(sample: DataFrame, labels: DataFrame, strata: DataFrame) -> DataFrame:
    """Sampled pairs with their last label, if that is same or different, and what they weigh."""
    w = strata.select("stratum", (F.col("population") / F.col("sampled")).alias("weight"))
    return sample.join(latest(labels).where("label in ('same', 'different')").select("pair_id", "label"), "pair_id").join(F.broadcast(w), "stratum")


def weighted(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """For each rule: precision and recall weighted by stratum (null where undefined), the interval of precision, and how many it picks."""
    same = F.col("label") == "same"
    parts = []
    for name, rule in rules.items():
        add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("weight"))), F.lit(0.0))
        tp, fp, fn = add(rule & same), add(rule & ~same), add(~rule & same)
        own = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count_if(rule & same).alias("k"), F.count_if(rule).alias("n_predicted"))
        low, high = wilson(F.col("k"), F.col("n_predicted"))
        some = F.col("n_predicted") > 0
        parts.append(own.select(F.lit(name).alias("rule"), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), F.when(some, low).alias("low"), F.when(some, high).alias("high"), "n_predicted"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_stratum(rows: DataFrame, strata: DataFrame) -> DataFrame:
    own = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.count_if(F.col("label") == "same").alias("k"))
    out = strata.join(own, "stratum", "left")
    low, high = wilson(F.col("k"), F.col("n"))
    some = F.col("n").isNotNull()
    return out.select("stratum", "population", F.coalesce("n", F.lit(0)).alias("labelled"), "mean_p", (F.col("k") / F.col("n")).alias("share_same"), F.when(some, low).alias("low"), F.when(some, high).alias("high"))


def agreement(labels: DataFrame) -> DataFrame:
    """One row: pairs that two or more people labelled, and the share on whose last labels they all agree."""
    last = labels.groupBy("pair_id", "labeller").agg(F.max_by("label", "seq").alias("label"))
    by = last.groupBy("pair_id").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("z")).where("n >= 2")
    return by.agg(F.count("*").alias("double_labelled"), F.avg((F.col("a") == F.col("z")).cast("int")).alias("agreement"))


def upper_median(rows: DataFrame, c: str) -> DataFrame:
    """One row: the value at place n div 2 (from 0) of the sorted non-null values, never between two.

    The exact percentile at that place: values are counted in groups first, so no task holds them all.
    """
    own = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    total = own.agg(F.sum("n").alias("total"))
    from pyspark.sql import Window

    run = own.withColumn("upto", F.sum("n").over(Window.orderBy(c))).crossJoin(F.broadcast(total))
    return run.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min(c).alias("upper_median"))


def stratified(rows: DataFrame, p: str, strata: list[tuple[float, float, int]], draw: Column, key: str) -> DataFrame:
    """A sample of each stratum [low, high) in the order of a draw; what a small stratum can't give goes round the others.

    The strata's sizes are counted and allotted on the driver (a handful of numbers); a row's place is a window by stratum
    over the rows that can be drawn at all.
    """
    number = F.coalesce(*[F.when((F.col(p) >= lo) & (F.col(p) < hi), F.lit(i)) for i, (lo, hi, _) in enumerate(strata)])
    pool = rows.withColumn("stratum", number).where("stratum is not null")
    sizes = {r["stratum"]: r["count"] for r in pool.groupBy("stratum").count().collect()}
    take = [min(n, sizes.get(i, 0)) for i, (_, _, n) in enumerate(strata)]
    spare = sum(n for *_, n in strata) - sum(take)
    while spare > 0 and any(t < sizes.get(i, 0) for i, t in enumerate(take)):
        for i, t in enumerate(take):
            if spare and t < sizes.get(i, 0):
                take[i], spare = t + 1, spare - 1
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("stratum").orderBy(draw, key))
    most = F.element_at(F.array(*map(F.lit, take)), F.col("stratum") + 1)
    return pool.withColumn("place", place.cast("long")).where(F.col("place") <= most)
