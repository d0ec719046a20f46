"""Whole runs: matching two layers, and a trial with known errors from generation to accuracy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlace.operators import coreg, generate, learn, matching, polygons, relations
from landlace.operators.features import FEATURES, NAMES, named
from landlace.workers import settled

GEOMETRY, ALL = FEATURES, FEATURES + NAMES


@dataclass(frozen=True)
class Match:
    """Scored pairs (bucket, why), the second layer as moved, the shift, and one row of description."""

    pairs: DataFrame
    b: DataFrame
    shift: DataFrame | None
    description: DataFrame


def match_layers(a: DataFrame, b: DataFrame, m: learn.Matcher, register: bool = True, iou_accept: float = 0.5) -> Match:
    """a: a_id, geom; b: b_id, geom, in the same metres. The second is moved onto the first, pairs are scored, and a confident score or a good overlap accepts."""
    shift = None
    if register:
        shift = coreg.estimate(a.select("a_id", "geom"), b.select("b_id", "geom"))
        b = settled(coreg.moved(b, shift))
    scored = learn.score(polygons.pair_features(a, b, m.radius), m)
    bucket, why = matching.combined(F.col("p"), F.col("iou"), m.t_low, m.t_high, iou_accept)
    pairs = settled(scored.withColumns({"bucket": bucket, "why": why}))
    return Match(pairs, b, shift, relations.describe(pairs, a.select("a_id", "geom"), b.select("b_id", "geom"), polygons.part_of))


def training(t: generate.Trial, radius: float = 30.0) -> DataFrame:
    """Pairs of a trial with features, label and the role of the first parcel's block."""
    env = polygons.enveloped(t.a)
    roles = matching.blocks(env, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    roles = matching.roles(roles, F.xxhash64("bi", "bj")).select("a_id", "role")
    return settled(matching.labelled(named(polygons.pair_features(t.a, t.b, radius), t.a, t.b), t.truth).join(roles, "a_id"))


def benchmark(layer: DataFrame, seed: int = 7, rounds: int = 60, target: float = 0.99, columns: tuple[str, ...] = ALL, **errors) -> tuple[learn.Matcher, DataFrame]:
    """Errors into a layer, pairs, blocks to roles, classifier, thresholds; one row of accuracy on the test blocks for the classifier and for plain overlap."""
    t = generate.trial(layer, seed, **errors)
    t = generate.Trial(settled(t.a), settled(t.b), settled(t.truth))
    rows = training(t)
    m = learn.fit(rows.where("role = 'train'"), rows.where("role = 'calib'"), columns, rounds=rounds, target=target)
    test = rows.where("role = 'test'")
    scored = settled(learn.score(test, m).select("a_id", "b_id", "iou", matching.bucket(F.col("p"), m.t_low, m.t_high).alias("bucket")))
    own, out = test.select("a_id").distinct(), None
    for name, pred in (("classifier", scored), ("overlap", scored.withColumn("bucket", matching.overlap_bucket(F.col("iou"))))):
        one = matching.evaluation(pred, t.truth, own).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return m, out


def upload(spark, path_a: str, path_b: str, m: learn.Matcher, register: bool = True, most: int = 20_000) -> tuple[Match, DataFrame, DataFrame]:
    """Two files to a match with the status of each shape: (match, status of a, status of b). Raises where the layers lie apart."""
    from landlace.functions import boxes
    from landlace.sources import layers
    from landlace.sources.files import LayerError

    a = layers.load(spark, path_a, "A", most=most).withColumnRenamed("id", "a_id")
    east = a.select(F.min("x1")).first()[0]
    b = layers.load(spark, path_b, "B", most=most).withColumnRenamed("id", "b_id")
    ends = lambda df, p: df.agg(*[f(c).alias(f"{p}{c}") for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
    dx, dy = boxes.apart("a_", "b_")
    if east is None or not ends(a, "a_").crossJoin(ends(b, "b_")).select((dx <= 50) & (dy <= 50)).first()[0]:
        raise LayerError("The two layers do not cover the same place.")
    found = match_layers(a.select("a_id", "geom"), b.select("b_id", "geom"), m, register)
    state = F.when(F.col("bucket") == "accept", "matched").when(F.col("bucket") == "review", "review")
    some = found.pairs.where("bucket <> 'reject'").withColumn("status", state)
    return found, relations.status(a, "a_id", some.select("a_id", "status"), "upload"), relations.status(b, "b_id", some.select("b_id", "status"), "upload")
