"""Decisions on scored pairs and how good they are."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(p: Column, low: float, high: float) -> Column:
    """accept from `high` on, reject below `low`, review between; accept is tested first."""
    return F.when(p >= high, "accept").when(p < low, "reject").otherwise("review")


def overlap_bucket(iou: Column, accept: float = 0.5, review: float = 0.2) -> Column:
    return F.when(iou >= accept, "accept").when(iou >= review, "review").otherwise("reject")


def combined(p: Column, iou: Column, low: float, high: float, iou_accept: float = 0.5) -> tuple[Column, Column]:
    """(bucket, why): a confident score or a good overlap accepts."""
    why = F.when(p >= high, "model").when(iou >= iou_accept, "overlap").otherwise("")
    return F.when(why != "", "accept").when(p < low, "reject").otherwise("review"), why


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where they are true links."""
    own = truth.select("a_id", "b_id").distinct().withColumn("label", F.lit(1))
    return pairs.join(own, ["a_id", "b_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def evaluation(pred: DataFrame, truth: DataFrame, parcels: DataFrame) -> DataFrame:
    """One row of precision, recall, F1, assisted recall and review load over the given parcels (a_id).

    pred: a_id, b_id, bucket; truth: a_id, b_id. One full outer join on the link, then sums.
    """
    own = parcels.select("a_id").distinct()
    pred = pred.join(own, "a_id", "left_semi").groupBy("a_id", "b_id").agg(F.max((F.col("bucket") == "accept").cast("int")).alias("acc"), F.max((F.col("bucket") == "review").cast("int")).alias("rev"))
    true = truth.join(own, "a_id", "left_semi").select("a_id", "b_id").distinct().withColumn("t", F.lit(1))
    both = pred.join(true, ["a_id", "b_id"], "full").select("a_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("acc", "rev", "t")])
    by_parcel = both.groupBy("a_id").agg(
        F.sum("acc").alias("acc"), F.sum("t").alias("t"), F.sum(F.col("acc") * F.col("t")).alias("tp"), F.sum(F.greatest("acc", "rev") * F.col("t")).alias("tp_any"), F.max("rev").alias("rev")
    )
    s = by_parcel.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("acc", "t", "tp", "tp_any", "rev")])
    n = own.agg(F.count("*").alias("n"))
    at_least = lambda c: F.greatest(F.col(c), F.lit(1))
    out = s.crossJoin(n).select(
        F.col("n").alias("n_parcels"), F.col("t").alias("n_true_links"), (F.col("tp") / at_least("acc")).alias("auto_precision"), (F.col("tp") / at_least("t")).alias("auto_recall"),
        (F.col("tp_any") / at_least("t")).alias("assisted_recall"), (F.col("rev") / at_least("n")).alias("review_load"),
    )  # one row beside one row
    p, r = F.col("auto_precision"), F.col("auto_recall")
    return out.withColumns({"auto_f1": 2 * p * r / F.greatest(p + r, F.lit(1e-9)), "auto_resolved_share": 1 - F.col("review_load")})


def recall_by_type(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """For each error type that occurs: links, and the shares accepted and accepted or in review."""
    own = pred.groupBy("a_id", "b_id").agg(F.max((F.col("bucket") == "accept").cast("int")).alias("acc"), F.max((F.col("bucket") != "reject").cast("int")).alias("any"))
    joined = truth.select("error_type", "a_id", "b_id").distinct().join(own, ["a_id", "b_id"], "left")
    return joined.groupBy("error_type").agg(F.count("*").alias("n"), F.avg(F.coalesce("acc", F.lit(0))).alias("auto_recall"), F.avg(F.coalesce("any", F.lit(0))).alias("assisted_recall"))


def false_link_rates(pred: DataFrame, a: DataFrame, spurious: DataFrame) -> DataFrame:
    """Share of parcels without a counterpart that got an accepted link, and of spurious ones seen that got one."""
    missing = a.where("error_type = 'missing'").select("a_id").distinct()
    hit = pred.where("bucket = 'accept'").select("a_id").distinct()
    by_a = missing.join(hit.withColumn("hit", F.lit(1)), "a_id", "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("missing_false_link_rate"))
    seen = pred.join(spurious.select("b_id").distinct(), "b_id", "left_semi").groupBy("b_id").agg(F.max((F.col("bucket") == "accept").cast("int")).alias("hit"))
    return by_a.crossJoin(seen.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("spurious_false_link_rate")))


def calibration(scored: DataFrame, edges: Sequence[float], right_closed: bool, p: str = "p", y: str = "y") -> DataFrame:
    """Mean score and share of true rows by bin; empty bins have no row.

    right_closed: bins (a, b], the first with its lower edge; otherwise [a, b), the last with its upper edge.
    """
    bins, c = len(edges) - 1, F.col(p)
    above = sum(((c > F.lit(e)) if right_closed else (c >= F.lit(e))).cast("int") for e in edges)
    number = F.greatest(above - 1, F.lit(0)) if right_closed else F.least(above - 1, F.lit(bins - 1))
    inside = scored.where((c >= edges[0]) & (c <= edges[-1])).withColumn("bin", number.cast("long"))
    return inside.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share_true"))


def thresholds(scored: DataFrame, target: float = 0.99, missed: float = 0.01, least: int = 20, p: str = "p", y: str = "y") -> DataFrame:
    """One row (t_low, t_high). t_high: the lowest score from which on at least `least` rows reach the target precision, 1.01 if none.

    Running sums are over different scores, one row each, so their window is as long as the scores are many, not the rows.
    """
    by = scored.groupBy(p).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("t"))
    w = Window.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = by.select(p, F.sum("n").over(w).alias("n"), F.sum("t").over(w).alias("t"))
    high = run.where((F.col("n") >= least) & (F.col("t") / F.col("n") >= target)).agg(F.coalesce(F.min(p), F.lit(1.01)).alias("t_high"))
    low = scored.where(F.col(y) == 1).agg(F.percentile(p, F.lit(missed)).alias("q"))
    return high.crossJoin(low).select(F.when(F.col("q").isNull(), F.lit(0.0)).otherwise(F.least("q", F.lit(0.5), "t_high")).alias("t_low"), "t_high")


def blocks(a: DataFrame, x: Column, y: Column, size: float = 150.0) -> DataFrame:
    """Rows with the square block (bi, bj) they lie in, counted from the layer's lower corner."""
    low = a.agg(F.min(x).alias("x0"), F.min(y).alias("y0"))  # one row
    out = a.withColumns({"px": x, "py": y}).crossJoin(F.broadcast(low))
    return out.withColumns({"bi": F.floor((F.col("px") - F.col("x0")) / size), "bj": F.floor((F.col("py") - F.col("y0")) / size)}).drop("px", "py", "x0", "y0")


def roles(a: DataFrame, key: Column, shares: Sequence[float] = (0.5, 0.2, 0.3)) -> DataFrame:
    """Whole blocks to train, calib and test in the order of a draw; one of each at least where there are blocks enough.

    `a` has bi and bj; key orders the blocks. The window is over blocks, one row each.
    """
    own = a.select("bi", "bj").distinct().withColumn("draw", key)
    ranked = own.withColumns({"place": F.row_number().over(Window.orderBy("draw", "bi", "bj")), "n": F.count("*").over(Window.partitionBy())})
    train = F.greatest(F.lit(1), F.round(F.lit(shares[0]) * F.col("n"))).cast("long")
    calib = F.greatest(F.lit(1), F.round(F.lit(shares[1]) * F.col("n"))).cast("long")
    role = F.when(F.col("place") <= F.least(train, F.greatest(F.col("n") - 1, F.lit(1))), "train").when((F.col("place") <= train + calib) & (F.col("place") < F.col("n")), "calib").otherwise("test")
    return a.join(ranked.select("bi", "bj", role.alias("role")), ["bi", "bj"])


def best_of(pairs: DataFrame, layer: DataFrame, key: str, p: str = "p") -> DataFrame:
    """(key, best_p): the best score of each shape of a layer, 0 where it is in no pair."""
    best = pairs.groupBy(key).agg(F.max(p).alias("best_p"))
    return layer.select(key).join(best, key, "left").select(key, F.coalesce("best_p", F.lit(0.0)).alias("best_p"))


def macro(rows: DataFrame, *measures: str) -> DataFrame:
    """One row: the plain mean of each measure over kinds, however many cases each kind has."""
    return rows.agg(*[F.avg(m).alias(m) for m in measures])


def profiles(sets: dict[str, DataFrame]) -> DataFrame:
    """Training pairs of several error profiles, with the profile's name."""
    return reduce(DataFrame.unionByName, [df.withColumn("profile", F.lit(name)) for name, df in sets.items()])
