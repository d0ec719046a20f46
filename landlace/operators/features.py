"""Measures of candidate pairs, and their place among the candidates of either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landlace.functions import boxes, strings
from landlace.operators.spatial_join import join_boxes

TINY = 1e-9


def candidates(a: DataFrame, b: DataFrame, radius: float = 30.0) -> DataFrame:
    """Pairs of parcels at most `radius` apart."""
    return join_boxes(a, b, radius)


def measured(pairs: DataFrame) -> DataFrame:
    """Overlap, distance and size features of pairs of boxes."""
    aa, ab, tiny = boxes.area("a_"), boxes.area("b_"), F.lit(TINY)
    pairs = boxes.with_hausdorff(pairs, "a_", "b_", "hausdorff").withColumns({"inter": boxes.shared("a_", "b_"), "area_a": aa, "area_b": ab})
    inter, aa, ab = F.col("inter"), F.col("area_a"), F.col("area_b")
    return pairs.withColumns({
        "iou": inter / F.greatest(aa + ab - inter, tiny), "inter_over_a": inter / F.greatest(aa, tiny), "inter_over_b": inter / F.greatest(ab, tiny),
        "centroid_dist": boxes.centre_distance("a_", "b_"), "area_ratio": F.least(aa, ab) / F.greatest(F.greatest(aa, ab), tiny),
        "hausdorff_norm": F.col("hausdorff") / F.sqrt(F.greatest(aa, tiny)),
    })


def placed(pairs: DataFrame, a_key: str = "a_id", b_key: str = "b_id", d: str = "centroid_dist") -> DataFrame:
    """Rank, number of candidates and gap to the nearest, for either side; one sort for each side serves all three."""
    out = pairs
    for side, key in (("a", a_key), ("b", b_key)):
        w = Window.partitionBy(key)
        out = out.withColumns({f"rank_{side}": F.rank().over(w.orderBy(d)).cast("long"), f"n_cand_{side}": F.count("*").over(w), f"gap_{side}": F.col(d) - F.min(d).over(w)})
    return out


FEATURES = ("iou", "inter_over_a", "inter_over_b", "centroid_dist", "area_ratio", "hausdorff_norm", "rank_a", "rank_b", "n_cand_a", "n_cand_b", "gap_a", "gap_b")


def pair_features(a: DataFrame, b: DataFrame, radius: float = 30.0) -> DataFrame:
    """Candidate pairs with all features. The boxes go before the windows, so these sort narrow rows."""
    return placed(measured(candidates(a, b, radius)).select("a_id", "b_id", "area_a", "area_b", *FEATURES[:6]))


NAMES = ("name_sort", "name_set")


def named(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the likeness of the owners' names, sorted by word and as sets of words, from 0 to 1."""
    own = lambda df, key, name: df.select(key, strings.normal(F.col("owner")).alias(name))
    both = pairs.join(own(a, "a_id", "owner_a"), "a_id").join(own(b, "b_id", "owner_b"), "b_id")
    x, y = F.col("owner_a"), F.col("owner_b")
    return both.withColumns({"name_sort": strings.token_sort(x, y), "name_set": strings.token_set(x, y)}).drop("owner_a", "owner_b")
