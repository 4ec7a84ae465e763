"""Queries on binary models with market effects: whether an hour's flow is bought on balance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..sources.tables import trades
from ..stats.binary import binary_fit
from .binding import T
from .panels import PANEL

LINKS = ("logit", "cloglog")
TERMS = {"gross": [1.0, 0.0], "trades": [0.0, 1.0], "gross-trades": [1.0, -1.0]}


def _rows(spark: SparkSession, d: str) -> DataFrame:
    p = agg.panel(trades(spark, d))
    return p.select("market", F.expr("bucket div 86400").alias("dy"), (F.col("net") > 0).cast("int").alias("up"), F.log1p("gross").alias("gross"), F.log("n_trades").alias("trades"))


def _rounded(value: float, digits: int = 6) -> float | None:
    return None if math.isnan(value) else round(float(value), digits)


def fe_logit(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients and their difference under both links, with errors clustered by day."""
    rows, out = _rows(spark, d), []
    for link in LINKS:
        fit = binary_fit(rows, "up", ["gross", "trades"], "market", "dy", link)
        for term, w in TERMS.items() if fit else ():
            found = fit.contrast(w)
            out.append((link, term, *(_rounded(found[c]) for c in ("estimate", "error", "t")), fit.rows, fit.groups, fit.clusters, _rounded(fit.log_likelihood, 4)))
    return spark.createDataFrame(out, "link string, term string, estimate double, error double, t double, n_rows long, markets long, clusters long, log_likelihood double")


def marginal_effects(spark: SparkSession, d: str) -> DataFrame:
    """Average marginal effects under both links: errors by the delta method, and with the mean slope held fixed."""
    rows, out = _rows(spark, d), []
    for link in LINKS:
        fit = binary_fit(rows, "up", ["gross", "trades"], "market", "dy", link)
        for term, w in TERMS.items() if fit else ():
            found = fit.marginal(w)
            out.append((link, term, *(_rounded(found[c]) for c in ("estimate", "error", "held_error", "mean_slope"))))
    return spark.createDataFrame(out, "link string, term string, effect double, delta_error double, held_error double, mean_slope double")


# Scoring steps as a recursion whose state is a row per link and market; then scores by day.
_STEPS = 14
_P = "CASE link WHEN 'logit' THEN 1 / (1 + exp(-e)) ELSE 1 - exp(-exp(e)) END"
_D = "CASE link WHEN 'logit' THEN 1 / (1 + exp(-e)) / (1 + exp(e)) ELSE exp(e - exp(e)) END"
_RECURSION = f"""WITH RECURSIVE {T}, {PANEL},
r AS (SELECT market, bucket // 86400 AS dy, (net > 0)::INT AS y, ln(1 + gross) AS z1, ln(n_trades) AS z2 FROM p QUALIFY min(y) OVER (PARTITION BY market) < max(y) OVER (PARTITION BY market)),
f AS (SELECT avg(y) AS m FROM r),
s(link, step, market, a, b1, b2) AS (
  SELECT link, 0, market, CASE link WHEN 'logit' THEN ln(m / (1 - m)) ELSE ln(-ln(1 - m)) END, 0.0::DOUBLE, 0.0::DOUBLE
  FROM (SELECT DISTINCT market FROM r), f, (VALUES ('logit'), ('cloglog')) l(link)
  UNION ALL
  SELECT link, step + 1, market, a + (q - w1 * d1 - w2 * d2) / w, b1 + d1, b2 + d2 FROM (
    SELECT *, (g1 * c22 - g2 * c12) / (c11 * c22 - c12 * c12) AS d1, (g2 * c11 - g1 * c12) / (c11 * c22 - c12 * c12) AS d2 FROM (
      SELECT *, sum(q1 - w1 * q / w) OVER l AS g1, sum(q2 - w2 * q / w) OVER l AS g2,
        sum(w11 - w1 * w1 / w) OVER l AS c11, sum(w12 - w1 * w2 / w) OVER l AS c12, sum(w22 - w2 * w2 / w) OVER l AS c22 FROM (
        SELECT link, step, market, any_value(a) AS a, any_value(b1) AS b1, any_value(b2) AS b2, sum(w) AS w, sum(w * z1) AS w1, sum(w * z2) AS w2,
          sum(w * z1 * z1) AS w11, sum(w * z1 * z2) AS w12, sum(w * z2 * z2) AS w22, sum(q) AS q, sum(q * z1) AS q1, sum(q * z2) AS q2 FROM (
          SELECT *, d * d / (p * (1 - p)) AS w, (y - p) * d / (p * (1 - p)) AS q FROM (
            SELECT *, {_P} AS p, {_D} AS d FROM (SELECT s.*, y, z1, z2, a + b1 * z1 + b2 * z2 AS e FROM s JOIN r USING (market) WHERE step < {_STEPS}))) GROUP BY link, step, market)
      WINDOW l AS (PARTITION BY link)))),
e AS (
  SELECT *, d * d / (p * (1 - p)) AS w, (y - p) * d / (p * (1 - p)) AS q, CASE link WHEN 'logit' THEN d * (1 - 2 * p) ELSE d * (1 - exp(e)) END AS dd FROM (
    SELECT *, {_P} AS p, {_D} AS d FROM (SELECT s.*, dy, y, z1, z2, a + b1 * z1 + b2 * z2 AS e FROM s JOIN r USING (market) WHERE step = {_STEPS}))),
c AS (SELECT *, z1 - sum(w * z1) OVER g / sum(w) OVER g AS x1, z2 - sum(w * z2) OVER g / sum(w) OVER g AS x2 FROM e WINDOW g AS (PARTITION BY link, market)),
i AS (
  SELECT link, any_value(b1) AS b1, any_value(b2) AS b2, sum(w * x1 * x1) AS c11, sum(w * x1 * x2) AS c12, sum(w * x2 * x2) AS c22, count(*) AS n, count(DISTINCT market) AS markets,
    sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS ll, avg(d) AS slope, avg(dd * x1) AS h1, avg(dd * x2) AS h2 FROM c GROUP BY link),
m AS (
  SELECT link, sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22, count(*) AS g FROM (SELECT link, dy, sum(q * x1) AS u1, sum(q * x2) AS u2 FROM c GROUP BY link, dy) GROUP BY link),
b AS (
  SELECT *, c22 / det AS i11, -c12 / det AS i12, c11 / det AS i22, g / (g - 1.0) * (n - 1.0) / (n - 2.0) AS factor FROM (SELECT *, c11 * c22 - c12 * c12 AS det FROM i JOIN m USING (link))),
v AS (
  SELECT *, factor * (i11 * (m11 * i11 + m12 * i12) + i12 * (m12 * i11 + m22 * i12)) AS v11, factor * (i11 * (m11 * i12 + m12 * i22) + i12 * (m12 * i12 + m22 * i22)) AS v12,
    factor * (i12 * (m11 * i12 + m12 * i22) + i22 * (m12 * i12 + m22 * i22)) AS v22 FROM b),
k AS (
  SELECT *, r1 * b1 + r2 * b2 AS estimate, sqrt(r1 * r1 * v11 + 2 * r1 * r2 * v12 + r2 * r2 * v22) AS error
  FROM v, (VALUES ('gross', 1.0, 0.0), ('trades', 0.0, 1.0), ('gross-trades', 1.0, -1.0)) x(term, r1, r2))"""
FE_LOGIT = f"""{_RECURSION}
SELECT link, term, round(estimate, 6) AS estimate, round(error, 6) AS error, round(estimate / error, 6) AS t, n AS n_rows, markets, g AS clusters, round(ll, 4) AS log_likelihood FROM k"""
MARGINAL_EFFECTS = f"""{_RECURSION},
j AS (SELECT *, slope * r1 + estimate * h1 AS j1, slope * r2 + estimate * h2 AS j2 FROM k)
SELECT link, term, round(estimate * slope, 6) AS effect, round(sqrt(j1 * j1 * v11 + 2 * j1 * j2 * v12 + j2 * j2 * v22), 6) AS delta_error, round(slope * error, 6) AS held_error,
  round(slope, 6) AS mean_slope FROM j"""

NAMES = ("fe_logit", "marginal_effects")
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
