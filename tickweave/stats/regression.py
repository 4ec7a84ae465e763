"""Fixed-effects regression from distributed sufficient statistics.

Rows never leave the executors: effects are absorbed by alternating group means, and the
driver sees the k x k products of the design and one row of scores per cluster at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .special import f_upper, t_quantile, t_two_sided

#: Rounds of alternating means at most (then it is an error), and the change that ends them.
ROUNDS, TOLERANCE = 1_000, 1e-10
#: Most levels of the smaller effect, and most combinations, of an exact absorption.
MOST_LEVELS, MOST_CELLS = 3_000, 2_000_000
#: Most clusters whose scores go to the driver.
MOST_CLUSTERS = 200_000


def demean(rows: DataFrame, columns: list[str], effects: list[str], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` with ``columns`` as residuals on all ``effects``.

    The residual of a row is its value less one term per effect. Each round updates the terms
    of one effect as group means of what the others leave, so what is iterated over and
    checkpointed is the table of distinct effect combinations with their sums, not the rows.
    """
    cells = rows.groupBy(*effects).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in columns])
    for e in effects:
        for c in columns:
            cells = cells.withColumn(f"_{e}_{c}", F.lit(0.0))
    cells = cut(cells)
    change = None
    for _ in range(rounds if len(effects) > 1 else 1):
        cells = cells.withColumn("_moved", F.lit(0.0))
        for e in effects:
            others = [x for x in effects if x != e]
            left = {c: F.col(f"_s_{c}") - F.col("_n") * sum((F.col(f"_{o}_{c}") for o in others), F.lit(0.0)) for c in columns}
            means = cells.groupBy(e).agg(*[(F.sum(left[c]) / F.sum("_n")).alias(f"_new_{c}") for c in columns])
            cells = cells.join(means, e)
            moved = F.greatest("_moved", *[F.abs(F.col(f"_new_{c}") - F.col(f"_{e}_{c}")) for c in columns])
            cells = cut(cells.withColumn("_moved", moved).withColumns({f"_{e}_{c}": F.col(f"_new_{c}") for c in columns}).drop(*[f"_new_{c}" for c in columns]))
        change = cells.agg(F.max("_moved")).first()[0]
        cells = cells.drop("_moved")
        if change is None or change < tolerance:
            break
    else:
        if len(effects) > 1:
            raise ArithmeticError(f"means still move by {change} after {rounds} rounds")
    terms = cells.select(*effects, *[sum((F.col(f"_{e}_{c}") for e in effects), F.lit(0.0)).alias(f"_t_{c}") for c in columns])
    return _less(rows, terms, columns, effects)


def _less(rows: DataFrame, terms: DataFrame, columns: list[str], effects: list[str]) -> DataFrame:
    return rows.join(terms, effects).withColumns({c: F.col(c) - F.col(f"_t_{c}") for c in columns}).drop(*[f"_t_{c}" for c in columns])


def absorb_exact(rows: DataFrame, columns: list[str], many: str, few: str) -> DataFrame:
    """``rows`` with ``columns`` as residuals on two effects, from the normal equations instead of rounds.

    Only sums per combination reach the driver, at most ``MOST_CELLS`` with ``MOST_LEVELS``
    levels of ``few``; beyond that it is an error, and ``demean`` is there. Unconnected
    groups of levels leave the terms undetermined but not the residuals: the least-norm
    terms are taken.
    """
    spark = rows.sparkSession
    cells = rows.groupBy(many, few).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in columns]).limit(MOST_CELLS + 1).collect()
    if len(cells) > MOST_CELLS or len({r[1] for r in cells}) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_CELLS} combinations, or {MOST_LEVELS} levels of {few}")
    if not cells:
        return rows
    a_names, b_names = list(dict.fromkeys(r[0] for r in cells)), list(dict.fromkeys(r[1] for r in cells))
    a_at, b_at = ({v: i for i, v in enumerate(names)} for names in (a_names, b_names))
    a, b = np.array([a_at[r[0]] for r in cells]), np.array([b_at[r[1]] for r in cells])
    n, sums = np.array([r[2] for r in cells], float), np.array([list(r[3:]) for r in cells], float)
    k = len(columns)
    per_a, per_b = np.bincount(a, n), np.bincount(b, n)
    sum_a, sum_b = np.zeros((len(a_names), k)), np.zeros((len(b_names), k))
    np.add.at(sum_a, a, sums)
    np.add.at(sum_b, b, sums)
    left, right = np.diag(per_b), sum_b.copy()
    order = np.argsort(a, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
        at, i = b[group], a[group[0]]
        left[np.ix_(at, at)] -= np.outer(n[group], n[group]) / per_a[i]
        right[at] -= np.outer(n[group], sum_a[i] / per_a[i])
    of_b = np.linalg.lstsq(left, right, rcond=None)[0]
    shared = np.zeros((len(a_names), k))
    np.add.at(shared, a, n[:, None] * of_b[b])
    of_a = (sum_a - shared) / per_a[:, None]
    terms = of_a[a] + of_b[b]
    schema = rows.select(many, few).schema
    for c in columns:
        schema = schema.add(f"_t_{c}", "double")
    found = spark.createDataFrame([(r[0], r[1], *map(float, t)) for r, t in zip(cells, terms)], schema)
    return _less(rows, found, columns, [many, few])


def without_singletons(rows: DataFrame, effects: list[str]) -> DataFrame:
    """``rows`` less those that are alone in a level of an effect, until none is left (such rows fit perfectly)."""
    cells = cut(rows.groupBy(*effects).agg(F.count(F.lit(1)).alias("_n")))
    while True:
        kept = cells
        for e in effects:
            alone = kept.groupBy(e).agg(F.sum("_n").alias("_k")).where("_k = 1").select(e)
            kept = kept.join(alone, e, "left_anti")
        kept = cut(kept)
        if kept.count() == cells.count():
            return rows.join(kept.select(*effects), effects, "left_semi")
        cells = kept


def _products(rows: DataFrame, names: list[str], weight: Column | None = None) -> np.ndarray:
    """Matrix of sums of products of the named columns, in one aggregation."""
    k = len(names)
    w = F.lit(1.0) if weight is None else weight
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*[F.sum(w * F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, found):
        out[i, j] = out[j, i] = v or 0.0
    return out


class Fit:
    """Coefficients, and covariances by cluster; scores per cluster come from one aggregation each."""

    def __init__(self, rows: DataFrame, y: str, xs: list[str]):
        # materialised once: products, scores and every covariance read it
        self.rows, self.y, self.xs = cut(rows.where(" or ".join(f"abs({x}) > 1e-14" for x in xs))), y, xs
        both = _products(self.rows, [*xs, y])
        self.n = self.rows.count()
        self.bread = np.linalg.pinv(both[:-1, :-1])
        self.beta = self.bread @ both[:-1, -1]
        size = np.sqrt(np.diag(both)[:-1])
        #: Whether the regressors have one solution: none is constant within the effects, or a sum of others.
        self.identified = bool((size > 0).all() and np.linalg.matrix_rank(both[:-1, :-1] / np.outer(size, size), hermitian=True) == len(xs))

    def residual(self) -> Column:
        return F.col(self.y) - sum((float(b) * F.col(x) for b, x in zip(self.beta, self.xs)), F.lit(0.0))

    def scores(self, clusters: list[str]) -> np.ndarray:
        e = self.residual()
        found = self.rows.groupBy(*clusters).agg(*[F.sum(F.col(x) * e).alias(x) for x in self.xs]).select(*self.xs).limit(MOST_CLUSTERS + 1).collect()
        if len(found) > MOST_CLUSTERS:
            raise ValueError(f"more than {MOST_CLUSTERS} clusters")
        return np.array([tuple(r) for r in found], float).reshape(-1, len(self.xs))

    def covariance(self, clusters: list[str]) -> tuple[np.ndarray, int]:
        """CRV1 with factor G/(G-1) * (n-1)/(n-k), and G."""
        s = self.scores(clusters)
        g, k = len(s), len(self.xs)
        return self.bread @ (s.T @ s) @ self.bread * g / (g - 1) * (self.n - 1) / (self.n - k), g

    def two_way(self, first: str, second: str) -> tuple[np.ndarray, int]:
        (a, ga), (b, gb), (ab, _) = self.covariance([first]), self.covariance([second]), self.covariance([first, second])
        return a + b - ab, min(ga, gb)

    def contrast(self, weights: list[float], covariance: np.ndarray, groups: int) -> tuple[float, float, float, float, float, float]:
        """Estimate, standard error, t, p, and the bounds of the 95 % interval; an error of 0 (a perfect fit) has no t, a single cluster neither t nor bounds."""
        w = np.array(weights)
        used = np.flatnonzero(w)  # a covariance of one cluster is not finite, and 0 times that is no number
        value, error = float(w @ self.beta), float(np.sqrt(w[used] @ covariance[np.ix_(used, used)] @ w[used]))
        if error == 0:
            return value, error, float("nan"), float("nan"), value, value
        if groups < 2:
            return value, error, float("nan"), float("nan"), float("nan"), float("nan")
        t, wide = value / error, t_quantile(0.05, groups - 1) * error
        return value, error, t, t_two_sided(t, groups - 1), value - wide, value + wide

    def joint_test(self, covariance: np.ndarray, groups: int) -> tuple[float, float]:
        """F of all coefficients being 0, and its p."""
        k = len(self.xs)
        f = float(self.beta @ np.linalg.pinv(covariance) @ self.beta) / k
        return f, f_upper(f, k, groups - 1)
