"""Change between two dates: one-to-one links by score, classes of change, and their accuracy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.workers import settled, ship

KINDS = ("unchanged", "altered", "demolished", "new")


#: Pairs that one task may finish in order, at about 40 bytes each.
FEW = 200_000


def greedy(pairs: DataFrame, a: str, b: str, p: str = "p", few: int = FEW) -> DataFrame:
    """One-to-one links as a greedy pass by score would take them, in rounds until no pair is left.

    A round takes every pair that is the best left for both its ends, and drops the pairs of these ends; with a total
    order (score, then the smaller keys) this gives just what the pass gives. Each round ends in a written table. A chain of rising
    scores gives one link a round, so once `few` pairs are left, the pass itself takes them, sorted, in one task.
    """
    order = F.struct(F.col(p), -F.col(a), -F.col(b)) if dict(pairs.dtypes)[a] in ("bigint", "int") else None
    if order is None:
        raise TypeError("keys have to be numbers; number them first")
    left, taken = settled(pairs.withColumn("rank_", order)), None
    while (n := left.count()) > few:
        best = lambda c: left.groupBy(c).agg(F.max("rank_").alias(f"best_{c}"))  # noqa: E731, B023
        now = settled(left.join(best(a), a).join(best(b), b).where((F.col("rank_") == F.col(f"best_{a}")) & (F.col("rank_") == F.col(f"best_{b}"))).select(pairs.columns))
        taken = now if taken is None else taken.union(now)
        left = settled(left.join(now.select(a), a, "left_anti").join(now.select(b), b, "left_anti").select(*pairs.columns, "rank_"))
    if n:
        rest = _passed(left.orderBy(F.desc("rank_")).drop("rank_").coalesce(1), a, b)
        taken = rest if taken is None else taken.union(rest)
    return pairs.limit(0) if taken is None else taken


def _passed(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """The pass over sorted pairs in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen_a: set = set()
        seen_b: set = set()
        for df in frames:
            keep = []
            for x, y in zip(df[a], df[b], strict=True):
                free = x not in seen_a and y not in seen_b
                if free:
                    seen_a.add(x), seen_b.add(y)
                keep.append(free)
            yield df[keep]

    ship(pairs.sparkSession)
    return pairs.mapInPandas(run, pairs.schema)


def classify(pairs: DataFrame, earlier: DataFrame, later: DataFrame, least_p: float, altered: float = 0.8) -> DataFrame:
    """(earlier_id, later_id, change, p, area_change_pct) for every shape of either date."""
    links = greedy(pairs.where(F.col("p") >= least_p), "earlier_id", "later_id")
    kind = F.when(F.col("area_ratio") < altered, "altered").otherwise("unchanged")
    pct = F.round(100 * (F.col("area_l") - F.col("area_e")) / F.greatest("area_e", F.lit(1e-9)), 1)
    both = links.select("earlier_id", "later_id", kind.alias("change"), "p", pct.alias("area_change_pct"))
    gone = earlier.select("earlier_id").join(links, "earlier_id", "left_anti").withColumn("change", F.lit("demolished"))
    new = later.select("later_id").join(links, "later_id", "left_anti").withColumn("change", F.lit("new"))
    return both.unionByName(gone, allowMissingColumns=True).unionByName(new, allowMissingColumns=True)


def score(found: DataFrame, truth: DataFrame) -> DataFrame:
    """By kind of change: true, detected, correct, precision, recall; 1 where there is nothing to divide by."""
    keys = ["change", "e", "l"]
    keyed = lambda df, n: df.select("change", F.coalesce(F.col("earlier_id").cast("string"), F.lit("")).alias("e"), F.coalesce(F.col("later_id").cast("string"), F.lit("")).alias("l")).distinct().withColumn(n, F.lit(1))
    both = keyed(found, "d").join(keyed(truth, "t"), keys, "full")
    by = both.groupBy("change").agg(F.count("t").alias("n_true"), F.count("d").alias("n_detected"), F.count_if(F.col("t").isNotNull() & F.col("d").isNotNull()).alias("n_correct"))
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(F.lit(1.0))
    return by.withColumns({"precision": share("n_correct", "n_detected"), "recall": share("n_correct", "n_true")})
