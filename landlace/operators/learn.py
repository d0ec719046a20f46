"""The pair classifier: boosted trees, isotonic calibration, spatial folds, contributions of features."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landlace.operators.features import FEATURES
from landlace.operators.matching import thresholds
from landlace.workers import ship


@dataclass
class Matcher:
    """Trees, calibration steps and thresholds."""

    trees: GBTClassificationModel
    columns: tuple[str, ...]
    cal_x: list[float] = field(default_factory=lambda: [0.0, 1.0])
    cal_y: list[float] = field(default_factory=lambda: [0.0, 1.0])
    t_low: float = 0.0
    t_high: float = 1.01
    radius: float = 30.0

    def save(self, path: str) -> None:
        """The trees as Spark writes them and the rest as one line of JSON beside them."""
        self.trees.write().overwrite().save(f"{path}/trees")
        rest = {"columns": self.columns, "cal_x": self.cal_x, "cal_y": self.cal_y, "t_low": self.t_low, "t_high": self.t_high, "radius": self.radius}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/matcher")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Matcher:
        rest = json.loads(spark.read.text(f"{path}/matcher").first()["value"])
        return cls(GBTClassificationModel.load(f"{path}/trees"), tuple(rest.pop("columns")), **rest)


def vectors(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="vector", handleInvalid="keep").transform(rows)


def raw_score(rows: DataFrame, m: Matcher) -> DataFrame:
    own = m.trees.transform(vectors(rows, m.columns)).withColumn("raw", vector_to_array("probability")[1])
    return own.drop("vector", "rawPrediction", "probability", "prediction")


def interpolated(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear between the calibrator's points, level beyond its ends."""
    pieces = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(u).alias("u"), F.lit(v).alias("v")) for a, b, u, v in zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True) if b > a])
    hit = F.try_element_at(F.filter(pieces, lambda p: (x >= p["a"]) & (x <= p["b"])), F.lit(1))
    inner = hit["u"] + (hit["v"] - hit["u"]) * (x - hit["a"]) / (hit["b"] - hit["a"])
    return F.when(x <= xs[0], F.lit(ys[0])).when(x >= xs[-1], F.lit(ys[-1])).otherwise(inner)


def score(rows: DataFrame, m: Matcher) -> DataFrame:
    """Rows with p, the calibrated score."""
    return raw_score(rows, m).withColumn("p", interpolated(F.col("raw"), m.cal_x, m.cal_y)).drop("raw")


def fit(train: DataFrame, calib: DataFrame, columns: tuple[str, ...] = FEATURES, rounds: int = 60, depth: int = 4, rate: float = 0.1, seed: int = 7, target: float = 0.99) -> Matcher:
    """Trees on `train`, calibration and thresholds on `calib`; both have a 0/1 column label."""
    gbt = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=seed)
    m = Matcher(gbt.fit(vectors(train, columns).select("vector", F.col("label").cast("double"))), tuple(columns))
    own = raw_score(calib, m).select("raw", F.col("label").cast("double").alias("label"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(own)
    m.cal_x, m.cal_y = ([float(x) for x in v.toArray()] for v in (steps.boundaries, steps.predictions))
    if len(m.cal_x) == 1:
        m.cal_x, m.cal_y = [m.cal_x[0], m.cal_x[0] + 1e-9], m.cal_y * 2
    cut = thresholds(score(calib, m).select("p", F.col("label").alias("y")), target).first()
    m.t_low, m.t_high = cut["t_low"], cut["t_high"]
    return m


def out_of_fold(rows: DataFrame, fold: str, folds: int = 4, **params) -> DataFrame:
    """Each fold scored by trees that saw neither it nor the next one, which calibrates."""
    out = None
    for k in range(folds):
        m = fit(rows.where(~F.col(fold).isin(k, (k + 1) % folds)), rows.where(F.col(fold) == (k + 1) % folds), **params)
        own = score(rows.where(F.col(fold) == k), m).withColumns({"t_low": F.lit(m.t_low), "t_high": F.lit(m.t_high)})
        out = own if out is None else out.unionByName(own)
    return out


def leaves(m: Matcher) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Of every tree: (value, for each feature on the way to the leaf its number, lower and upper bound, and share of rows that pass)."""
    out = []

    def walk(node, path, weight):
        if node.numDescendants() == 0:
            own: dict[int, list[float]] = {}
            for f, low, high, share in path:
                x = own.setdefault(f, [-np.inf, np.inf, 1.0])
                x[0], x[1], x[2] = max(x[0], low), min(x[1], high), x[2] * share
            out.append((weight * node.prediction(), [(f, *x) for f, x in own.items()]))
            return
        split, n = node.split(), max(1, node.impurityStats().count())
        f, t = split.featureIndex(), split.threshold()
        for child, low, high in ((node.leftChild(), -np.inf, t), (node.rightChild(), t, np.inf)):
            walk(child, [*path, (f, low, high, child.impurityStats().count() / n)], weight)

    for tree, w in zip(m.trees.trees, m.trees.treeWeights, strict=True):
        walk(tree._call_java("rootNode"), [], w)
    return out


def shapley(x: np.ndarray, own: list) -> np.ndarray:
    """Shapley values of each feature for each row. A leaf's game is a product over the few features on its way, so its values
    are sums over their subsets."""
    out = np.zeros(x.shape)
    for value, path in own:
        n = len(path)
        passes = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in path]
        for i, (f, *_rest) in enumerate(path):
            others = [j for j in range(n) if j != i]
            total = np.zeros(len(x))
            for k in range(n):
                weight = factorial(k) * factorial(n - k - 1) / factorial(n)
                for s in combinations(others, k):
                    term = np.full(len(x), weight)
                    for j in others:
                        term *= passes[j] if j in s else path[j][3]
                    total += term
            out[:, f] += value * total * (passes[i] - path[i][3])
    return out


def contributions(rows: DataFrame, m: Matcher, top: int = 4) -> DataFrame:
    """Rows with contrib: the features that moved the score most, with how much."""
    spark = rows.sparkSession
    ship(spark)
    held, columns = spark.sparkContext.broadcast(leaves(m)), m.columns  # trees x leaves: fixed by the model's size

    @F.pandas_udf("array<struct<feature:string,value:double>>")
    def run(*cols: pd.Series) -> pd.Series:
        values = shapley(np.column_stack([c.to_numpy(float) for c in cols]), held.value)
        order = np.argsort(-np.abs(values), axis=1, kind="stable")[:, :top]
        return pd.Series([[{"feature": columns[j], "value": float(v[j])} for j in o] for v, o in zip(values, order, strict=True)])

    return rows.withColumn("contrib", run(*[F.col(c).cast("double") for c in columns]))
