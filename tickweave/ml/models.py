"""Nested, grouped cross-validation of Spark ML classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import sized
from .evaluation import average_precision, chronological_split, f1_threshold, group_folds

LOGISTIC = [{"regParam": r, "elasticNetParam": e} for r in (0.01, 0.1) for e in (0.0, 0.5)]
FOREST = [{"maxDepth": d, "minInstancesPerNode": m} for d in (3, 6) for m in (5, 20)]
BOOSTED = [{"maxDepth": d, "stepSize": e} for d in (2, 3) for e in (0.05, 0.1)]
#: Trees of a forest, rounds of boosting, iterations of a logistic fit; fits that run at a time.
TREES, ROUNDS, ITERATIONS, AT_A_TIME = 100, 20, 100, 8


def classifier(kind: str, params: dict, features: list[str], label: str):
    make = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier}[kind]
    more = {"numTrees": TREES, "seed": 5} if kind == "forest" else {"maxIter": ROUNDS, "seed": 5} if kind == "boosted" else {"maxIter": ITERATIONS}
    model = make(featuresCol="_x", labelCol=label, weightCol="_w", **more, **params)
    steps = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip")]
    steps.append(StandardScaler(inputCol="_raw", outputCol="_x", withMean=True))
    return Pipeline(stages=[*steps, model])


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """``_w``: weights that give both labels the same sum."""
    n, pos = rows.agg(F.count(F.lit(1)), F.sum(label)).first()
    return rows.withColumn("_w", F.when(F.col(label) == 1, n / (2.0 * max(pos or 0, 1))).otherwise(n / (2.0 * max(n - (pos or 0), 1))))


def scored(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("_raw", "_x", "_w", "rawPrediction", "probability", "prediction")


def _fit_scores(train: DataFrame, test: DataFrame, kind: str, params: dict, features: list[str], label: str) -> DataFrame:
    return scored(classifier(kind, params, features, label).fit(balanced(train, label)), balanced(test, label))


def tuned(train: DataFrame, kind: str, grid: list[dict], features: list[str], label: str, group: str, inner: int) -> tuple[dict, float]:
    """The grid point with the best average precision over inner out-of-fold scores, and the F1 threshold of those scores.

    Fits are independent Spark jobs, a few at a time.
    """
    from multiprocessing.pool import ThreadPool

    dealt = sized(group_folds(train, group, label, inner)).cache()
    try:
        jobs = [(i, j) for i in range(len(grid)) for j in range(inner)]
        with ThreadPool(AT_A_TIME) as pool:
            parts = pool.map(lambda ij: _fit_scores(dealt.where(F.col("fold") != ij[1]), dealt.where(F.col("fold") == ij[1]), kind, grid[ij[0]], features, label), jobs)
            whole = [reduce(DataFrame.unionByName, parts[i * inner : (i + 1) * inner]).select(label, "score") for i in range(len(grid))]
            value = [v if v is not None and v == v else 0.0 for v in pool.map(lambda rows: average_precision(rows, "score", label).first()[0], whole)]
        best = max(range(len(grid)), key=lambda i: (value[i], -i))
        return grid[best], f1_threshold(whole[best], "score", label)
    finally:
        dealt.unpersist()


def nested_scores(rows: DataFrame, kind: str, grid: list[dict], features: list[str], label: str, group: str, outer: int = 5, inner: int = 3) -> DataFrame:
    """Out-of-fold ``score`` of every row, with its fold's threshold ``cut``; both that and the grid point come from inner folds of the training groups."""
    dealt = sized(group_folds(rows, group, label, outer))  # read by every fit
    parts = []
    for k in range(outer):
        train, test = dealt.where(F.col("fold") != k).drop("fold"), dealt.where(F.col("fold") == k)
        best, threshold = tuned(train, kind, grid, features, label, group, inner)
        parts.append(_fit_scores(train, test, kind, best, features, label).withColumn("cut", F.lit(float(threshold))))
    return reduce(DataFrame.unionByName, parts)


def holdout_scores(rows: DataFrame, kind: str, grid: list[dict], features: list[str], label: str, group: str, at: str, inner: int = 3) -> DataFrame:
    """Scores of the latest groups by a model of the earlier ones, tuned and cut on inner folds of those alone."""
    dealt = sized(chronological_split(rows, group, at))  # read by every fit
    train, test = dealt.where("is_train").drop("is_train"), dealt.where("not is_train")
    best, threshold = tuned(train, kind, grid, features, label, group, inner)
    return _fit_scores(train, test, kind, best, features, label).withColumn("cut", F.lit(float(threshold)))
