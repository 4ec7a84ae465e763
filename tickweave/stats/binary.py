"""Logit and complementary log-log models with an intercept per group.

The intercepts are never part of a matrix. A scoring step takes one aggregation per group,
which gives the group's own weight, its weighted regressors and their products; eliminating
the intercept from these leaves a k x k system, summed over groups, that the driver solves,
and the table of intercepts moves by what each group's own equation then says. Rows and
intercepts stay on executors, however many groups there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .special import t_quantile, t_two_sided

#: Scoring steps at most (then it is an error), the largest change that ends them, and halvings of a step.
STEPS, TOLERANCE, HALVINGS = 50, 1e-8, 20
#: Bounds of the linear predictor and of probabilities away from 0 and 1.
LOWEST, HIGHEST, EDGE = -30.0, 30.0, 1e-12


class NotConverged(ArithmeticError):
    pass


def _shape(link: str, eta: Column) -> tuple[Column, Column, Column]:
    """Probability, its first and its second derivative by the linear predictor."""
    eta = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST if link == "logit" else 3.5), eta))
    if link == "logit":
        p = 1 / (1 + F.exp(-eta))
        return p, p * (1 - p), p * (1 - p) * (1 - 2 * p)
    if link == "cloglog":
        hazard = F.exp(eta)
        slope = F.exp(eta - hazard)
        return -F.expm1(-hazard), slope, slope * (1 - hazard)
    raise ValueError(f"no link {link}")


@dataclass
class BinaryFit:
    """Estimates of a binary model; ``gradient`` is that of the mean slope by the coefficients."""

    link: str
    xs: list[str]
    beta: np.ndarray
    cover: np.ndarray
    rows: int
    groups: int
    clusters: int
    steps: int
    log_likelihood: float
    slope: float
    gradient: np.ndarray

    def contrast(self, weights: list[float]) -> dict[str, float]:
        """Estimate, clustered error, t, p and 95 % interval of a combination of coefficients."""
        w = np.array(weights, float)
        return self._tested(float(w @ self.beta), float(w @ self.cover @ w))

    def marginal(self, weights: list[float]) -> dict[str, float]:
        """Average marginal effect of a combination, its error by the delta method, and that with the mean slope held fixed.

        The mean slope moves with the coefficients, both directly and through the intercepts
        that follow them; ``gradient`` has both.
        """
        w = np.array(weights, float)
        value = float(w @ self.beta)
        by = self.slope * w + value * self.gradient
        return self._tested(value * self.slope, float(by @ self.cover @ by)) | {"held_error": self.slope * math.sqrt(float(w @ self.cover @ w)), "mean_slope": self.slope}

    def _tested(self, value: float, variance: float) -> dict[str, float]:
        error, df = math.sqrt(variance), self.clusters - 1
        if df < 1 or not error > 0:
            return {"estimate": value, "error": math.nan, "t": math.nan, "p": math.nan, "low": math.nan, "high": math.nan}
        wide = t_quantile(0.05, df) * error
        return {"estimate": value, "error": error, "t": value / error, "p": t_two_sided(value / error, df), "low": value - wide, "high": value + wide}


def binary_fit(rows: DataFrame, y: str, xs: list[str], effect: str, cluster: str, link: str = "logit", steps: int = STEPS) -> BinaryFit | None:
    """Fit of ``y`` (0 or 1) on ``xs`` with an intercept per ``effect`` and errors clustered by ``cluster``.

    Rows with a null in any of these columns are left out, and so are groups in which ``y`` does
    not vary: their intercept is infinite, and they say nothing about slopes. None if no row is
    left. ``NotConverged`` if coefficients or intercepts still move after ``steps`` steps, as
    they do where a regressor separates the outcomes. A constant regressor, or one that does
    not vary within groups, gets 0 with an error of 0.
    """
    k = len(xs)
    z = [f"_z{j}" for j in range(k)]
    data = rows.select(F.col(effect).alias("_m"), F.col(cluster).alias("_c"), F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(n) for x, n in zip(xs, z)]).dropna()
    varied = data.groupBy("_m").agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi")).where("_lo < _hi").select("_m")
    data = cut(data.join(varied, "_m", "left_semi"))
    seen = data.agg(F.count(F.lit(1)), F.avg("_y"), *[f(n) for n in z for f in (F.avg, F.stddev_pop)]).first()
    n = seen[0]
    if not n:
        return None
    mean, scale = np.array(seen[2::2], float), np.array(seen[3::2], float)
    scale[~(scale > 1e-12)] = 1.0
    scaled = {n_: (F.col(n_) - float(m)) / float(s) for n_, m, s in zip(z, mean, scale)}
    start = math.log(seen[1] / (1 - seen[1])) if link == "logit" else math.log(-math.log1p(-seen[1]))
    state = data.select("_m").distinct().select("_m", F.lit(start).alias("_a"), F.lit(0.0).alias("_da"))
    beta, step, best, halved = np.zeros(k), np.zeros(k), -math.inf, 0
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for at in range(1, steps + 1):
        own = _scored(data.withColumns(scaled).join(state, "_m"), link, beta, z)
        per = cut(
            own.groupBy("_m").agg(
                F.first("_a").alias("_a"), F.first("_da").alias("_da"), F.sum("_l").alias("_l"), F.sum("_w").alias("_w"), F.sum("_s").alias("_s"), F.count(F.lit(1)).alias("_n"),
                *[F.sum(F.col("_w") * F.col(x)).alias(f"_w{x}") for x in z], *[F.sum(F.col("_s") * F.col(x)).alias(f"_s{x}") for x in z],
                *[F.sum(F.col("_w") * F.col(z[i]) * F.col(z[j])).alias(f"_p{i}_{j}") for i, j in pairs],
            )
        )
        found = per.agg(
            F.sum("_l"), F.count(F.lit(1)), *[F.sum(F.col(f"_s{x}") - F.col(f"_w{x}") * F.col("_s") / F.col("_w")) for x in z],
            *[F.sum(F.col(f"_p{i}_{j}") - F.col(f"_w{z[i]}") * F.col(f"_w{z[j]}") / F.col("_w")) for i, j in pairs],
        ).first()
        likelihood = found[0]
        if likelihood < best - 1e-10 * abs(best):
            halved += 1
            if halved > HALVINGS:
                raise NotConverged(f"no step raises the likelihood of {best}")
            step = step / 2
            beta = beta - step
            state = per.select("_m", (F.col("_a") - F.col("_da") / 2).alias("_a"), (F.col("_da") / 2).alias("_da"))
            continue
        best, halved = likelihood, 0
        info = np.zeros((k, k))
        for (i, j), v in zip(pairs, found[2 + k :]):
            info[i, j] = info[j, i] = v
        bread = np.linalg.pinv(info, rcond=1e-10, hermitian=True)
        step = bread @ np.array(found[2 : 2 + k], float)
        move = (F.col("_s") - sum((float(d) * F.col(f"_w{x}") for d, x in zip(step, z)), F.lit(0.0))) / F.col("_w")
        moved = per.agg(F.max(F.abs(move))).first()[0]
        if max(float(np.abs(step).max(initial=0.0)), moved) < TOLERANCE:
            break
        beta = beta + step
        state = per.select("_m", (F.col("_a") + move).alias("_a"), move.alias("_da"))
    else:
        raise NotConverged(f"{link} still moves after {steps} steps")
    centred = per.select("_m", "_a", *[(F.col(f"_w{x}") / F.col("_w")).alias(f"_c{x}") for x in z])
    own = _scored(data.withColumns(scaled).join(centred, "_m"), link, beta, z).withColumns({x: F.col(x) - F.col(f"_c{x}") for x in z})
    by = own.groupBy("_c").agg(
        F.sum("_d").alias("_d"), *[F.sum(F.col("_s") * F.col(x)).alias(f"_s{x}") for x in z], *[F.sum(F.col("_dd") * F.col(x)).alias(f"_g{x}") for x in z]
    )
    last = by.agg(F.count(F.lit(1)), F.sum("_d"), *[F.sum(f"_g{x}") for x in z], *[F.sum(F.col(f"_s{z[i]}") * F.col(f"_s{z[j]}")) for i, j in pairs]).first()
    clusters = last[0]
    meat = np.zeros((k, k))
    for (i, j), v in zip(pairs, last[2 + k :]):
        meat[i, j] = meat[j, i] = v
    factor = clusters / (clusters - 1) * (n - 1) / (n - k) if clusters > 1 and n > k else math.nan
    cover = bread @ meat @ bread * factor / np.outer(scale, scale)
    return BinaryFit(link, xs, beta / scale, cover, n, found[1], clusters, at, best, last[1] / n, np.array(last[2 : 2 + k], float) / n * scale)


def _scored(rows: DataFrame, link: str, beta: np.ndarray, z: list[str]) -> DataFrame:
    """Likelihood, weight, score, slope and curvature of each row at the present coefficients and intercepts."""
    p, slope, curve = _shape(link, F.col("_a") + sum((float(b) * F.col(x) for b, x in zip(beta, z)), F.lit(0.0)))
    at = rows.withColumns({"_p": F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p)), "_d": F.greatest(F.lit(EDGE), slope), "_dd": curve})
    spread = F.col("_p") * (1 - F.col("_p"))
    return at.withColumns(
        {
            "_l": F.when(F.col("_y") == 1, F.log("_p")).otherwise(F.log1p(-F.col("_p"))), "_w": F.col("_d") * F.col("_d") / spread,
            "_s": (F.col("_y") - F.col("_p")) * F.col("_d") / spread,
        }
    )
