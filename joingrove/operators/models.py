"""Classifiers on Spark ML.

Each algorithm is fitted on rows `(label double, v array<double>)` and returns a
function that adds `prediction` to rows with `v`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from joingrove.operators.forests import boosted, extra_trees
from joingrove.operators.neighbours import Neighbours, vote
from joingrove.sources.staging import stage

Predict = Callable[[DataFrame], DataFrame]
SEED = 10


@dataclass(frozen=True)
class Algorithm:
    name: str
    full_name: str
    fit: Callable[[DataFrame], Predict]


def _with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("v"))


def _spark_ml(estimator) -> Callable[[DataFrame], Predict]:
    def fit(train: DataFrame) -> Predict:
        # The copy leaves behind the training summary, which holds the session.
        model = estimator().fit(_with_vector(train)).copy()
        return lambda df: model.transform(_with_vector(df)).drop(
            "features", "rawPrediction", "probability")
    return fit


def _logistic(train: DataFrame) -> Predict:
    """L1 logistic regression; the fitted line is applied as an expression."""
    model = LogisticRegression(elasticNetParam=1.0, regParam=0.01, maxIter=50).fit(_with_vector(train))
    weights = ", ".join(f"{float(c)!r}D" for c in model.coefficients)
    side = (f"aggregate(zip_with(v, array({weights}), (x, c) -> x * c), "
            f"{float(model.intercept)!r}D, (total, x) -> total + x)")
    return lambda df: df.withColumn("prediction", F.expr(f"CASE WHEN {side} > 0 THEN 1D ELSE 0D END"))


def _nearest(train: DataFrame) -> Predict:
    """Votes of the five nearest rows, entries scaled to unit deviation. Equal
    vectors are one with their rows and labels added up."""
    grouped = stage(train.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")), "vectors")
    index = Neighbours(grouped)

    def predict(df: DataFrame) -> DataFrame:
        asked = stage(df.select("v").distinct().withColumn("qid", F.monotonically_increasing_id()), "asked")
        votes = index.of(asked).select("qid", vote("top").alias("prediction"))
        named = stage(asked.join(votes, "qid", "left").select("v", F.coalesce("prediction", F.lit(0.0)).alias("prediction")), "votes")
        return df.join(named, "v")
    return predict


ALGORITHMS = {a.name: a for a in [
    Algorithm("RF", "RandomForest (Spark ML)", _spark_ml(
        lambda: RandomForestClassifier(numTrees=50, maxDepth=8, seed=SEED))),
    Algorithm("GBM", "GradientBoostedTrees (Spark ML)", _spark_ml(
        lambda: GBTClassifier(maxIter=20, maxDepth=5, seed=SEED))),
    Algorithm("XT", "ExtraTrees (random cuts, level by level)", extra_trees),
    Algorithm("XGB", "XGBoost (second-order boosting on histograms)", boosted),
    Algorithm("KNN", "KNearestNeighbours (five, exact)", _nearest),
    Algorithm("LR", "LogisticRegression L1 (Spark ML)", _logistic),
]}


def algorithms(name: str | None = None) -> list[Algorithm]:
    """The algorithm of a name, or all of them."""
    if name is None:
        return list(ALGORITHMS.values())
    if name not in ALGORITHMS:
        raise ValueError(f"unsupported algorithm {name!r}; choose one of {', '.join(ALGORITHMS)}")
    return [ALGORITHMS[name]]
