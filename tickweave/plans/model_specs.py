"""Model families as rows of a specification, each estimated by the same fixed-effects fit.

A specification's expressions are SQL that Spark and DuckDB both read, so the oracle solves the
same normal equations (two regressors, one effect) in closed form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators.order_statistics import exact_quantiles
from ..sources.shared import cut
from ..sources.tables import trades
from ..stats import regression
from .binding import KICKOFF, RESOLUTION, T
from .estimators import TWO_WAY
from .panels import PANEL

S = SparkSession
#: Markets that may become columns.
MOST_DUMMIES = 50
_FLOW = "sign(net) * ln(1 + abs(net))"


@dataclass(frozen=True)
class Spec:
    """``y`` on ``x1`` and ``x2`` with effects of ``market``, clustered by day, over the panel's rows that hold ``where``."""

    y: str
    x1: str
    x2: str
    where: str = "true"
    #: Markets with fewer rows of the sample than this share of a market's mean are left out.
    least_share: float = 0.0


def _after(k: int) -> str:
    return f"CASE WHEN bucket >= {k} THEN 1.0 ELSE 0.0 END"


def _within(low: int, high: int) -> str:
    return f"CASE WHEN {KICKOFF} - bucket > {low} AND {KICKOFF} - bucket <= {high} THEN 1.0 ELSE 0.0 END"


#: Flow by phase and by time to kickoff: the first term is the base's slope, the sum that of the phase or band.
INTERACTIONS = {
    "phase": Spec("ln(1 + gross)", _FLOW, f"({_FLOW}) * ({_after(KICKOFF)})", f"bucket < {RESOLUTION}"),
    "last_day": Spec("ln(1 + gross)", _FLOW, f"({_FLOW}) * ({_within(0, 86_400)})", f"bucket < {KICKOFF}"),
    "last_three_days": Spec("ln(1 + gross)", _FLOW, f"({_FLOW}) * ({_within(86_400, 3 * 86_400)})", f"bucket < {KICKOFF}"),
}
#: Whether there is more than one trade, and how large the rest is where there is.
TWO_PART = {
    "any": Spec("CASE WHEN n_trades > 1 THEN 1.0 ELSE 0.0 END", _FLOW, "ln(1 + buy_value)"),
    "size": Spec("ln(gross)", _FLOW, "ln(1 + buy_value)", "n_trades > 1"),
}
#: All markets, those with enough rows, and the sample without the last days.
EXCLUSIONS = {
    "all": Spec("ln(1 + gross)", _FLOW, "ln(n_trades)"),
    "not_sparse": Spec("ln(1 + gross)", _FLOW, "ln(n_trades)", least_share=1.0),
    "before_resolution": Spec("ln(1 + gross)", _FLOW, "ln(n_trades)", f"bucket < {RESOLUTION}"),
}
#: Limits of a large hour by transforms of flow.
SENSITIVITY = {
    f"{limit}_{name}": Spec("ln(1 + gross)", f"CASE WHEN gross >= {limit} THEN {x} ELSE 0.0 END", f"CASE WHEN gross < {limit} THEN {x} ELSE 0.0 END")
    for limit in (80, 120, 200) for name, x in (("raw", "net / 1000"), ("log", _FLOW), ("asinh", "asinh(net)"))
}


def _sample(spark: S, d: str, spec: Spec) -> DataFrame:
    p = agg.panel(trades(spark, d)).where(spec.where)
    rows = p.select("market", F.expr("bucket div 86400").alias("dy"), *[F.expr(e).cast("double").alias(n) for n, e in (("y", spec.y), ("x1", spec.x1), ("x2", spec.x2))])
    if spec.least_share:
        counts = rows.groupBy("market").count()
        least = spec.least_share * counts.agg(F.avg("count")).first()[0]
        rows = rows.join(counts.where(F.col("count") >= least).select("market"), "market", "left_semi")
    return rows


def fitted(spark: S, d: str, spec: Spec) -> regression.Fit:
    return regression.Fit(regression.demean(_sample(spark, d, spec), ["y", "x1", "x2"], ["market"]), "y", ["x1", "x2"])


def _family(specs: dict[str, Spec]):
    """Terms of every model of a family: both slopes and their sum, with clustered errors; NaN where the two slopes have no one solution."""
    def query(spark: S, d: str) -> DataFrame:
        rows = []
        for name, spec in specs.items():
            fit = fitted(spark, d, spec)
            cover, groups = fit.covariance(["dy"])
            for term, w in (("x1", [1.0, 0.0]), ("x2", [0.0, 1.0]), ("sum", [1.0, 1.0])):
                estimate, error = fit.contrast(w, cover, groups)[:2] if fit.identified else (float("nan"), float("nan"))
                rows.append((name, term, round(estimate, 7), round(error, 7), fit.n, groups))
        return spark.createDataFrame(rows, "model string, term string, estimate double, error double, n bigint, clusters int")

    return query


def _source_sql(spec: Spec) -> str:
    keep = f" QUALIFY count(*) OVER (PARTITION BY market) >= {spec.least_share} * (count(*) OVER ()) / (SELECT count(DISTINCT market) FROM p WHERE {spec.where})" if spec.least_share else ""
    return f"SELECT market, bucket // 86400 AS dy, ({spec.y})::DOUBLE AS y, ({spec.x1})::DOUBLE AS x1, ({spec.x2})::DOUBLE AS x2 FROM p WHERE {spec.where}{keep}"


def _solved_sql(name: str, spec: Spec) -> str:
    """CTEs that end in ``v_<name>``: slopes and the clustered covariance by Cramer's rule."""
    within = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY market) AS {c}" for c in ("y", "x1", "x2"))
    return f"""s_{name} AS ({_source_sql(spec)}), r_{name} AS (SELECT * FROM (SELECT dy, {within} FROM s_{name}) WHERE abs(x1) > 1e-14 OR abs(x2) > 1e-14),
m_{name} AS (SELECT sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS d, sum(x2 * y) AS e, count(*) AS n FROM r_{name}),
k_{name} AS (SELECT *, (c * d - b * e) / (a * c - b * b) AS b1, (a * e - b * d) / (a * c - b * b) AS b2, a * c - b * b AS det FROM m_{name}),
g_{name} AS (SELECT dy, sum(x1 * (y - b1 * x1 - b2 * x2)) AS g1, sum(x2 * (y - b1 * x1 - b2 * x2)) AS g2 FROM r_{name}, k_{name} GROUP BY dy),
q_{name} AS (SELECT sum(g1 * g1) AS p, sum(g1 * g2) AS q, sum(g2 * g2) AS r, count(*) AS g FROM g_{name}),
v_{name} AS (SELECT b1, b2, n, g, (c * c * p - 2 * b * c * q + b * b * r) / (det * det) * f AS v11, (b * b * p - 2 * a * b * q + a * a * r) / (det * det) * f AS v22,
  (-b * c * p + (a * c + b * b) * q - a * b * r) / (det * det) * f AS v12 FROM (SELECT *, g / (g - 1.0) * (n - 1.0) / (n - 2.0) AS f FROM k_{name}, q_{name}))"""


def _family_sql(specs: dict[str, Spec]) -> str:
    names = {n: f"m{i}" for i, n in enumerate(specs)}
    ends = " UNION ALL ".join(
        f"SELECT '{n}' AS model, '{t}' AS term, round({b}, 7) AS estimate, round(sqrt({v}), 7) AS error, n, g::INT AS clusters FROM v_{names[n]}"
        for n in specs for t, b, v in (("x1", "b1", "v11"), ("x2", "b2", "v22"), ("sum", "b1 + b2", "v11 + 2 * v12 + v22"))
    )
    return f"WITH {T}, {PANEL}, " + ", ".join(_solved_sql(names[n], s) for n, s in specs.items()) + " " + ends


interaction_models, INTERACTION_MODELS = _family(INTERACTIONS), _family_sql(INTERACTIONS)
two_part_models, TWO_PART_MODELS = _family(TWO_PART), _family_sql(TWO_PART)
exclusion_models, EXCLUSION_MODELS = _family(EXCLUSIONS), _family_sql(EXCLUSIONS)
sensitivity_models, SENSITIVITY_MODELS = _family(SENSITIVITY), _family_sql(SENSITIVITY)


def standardised_effects(spark: S, d: str) -> DataFrame:
    """Slopes times the regressor's deviation, its interquartile range, and the effect of a flow of 1,000."""
    spec = EXCLUSIONS["all"]
    fit, rows = fitted(spark, d, spec), _sample(spark, d, spec)
    out = []
    for i, x in enumerate(fit.xs):
        sd, q = rows.agg(F.stddev_samp(x)).first()[0], exact_quantiles(rows, x, [0.25, 0.75]).select("q0", "q1").first()
        out.append((x, round(fit.beta[i] * sd, 7), round(fit.beta[i] * (q[1] - q[0]), 7), round(float(fit.beta[i]) * 6.90875477931522, 7)))
    return spark.createDataFrame([(t, *map(float, v)) for t, *v in out], "term string, per_sd double, per_iqr double, per_thousand double")


STANDARDISED_EFFECTS = f"WITH {T}, {PANEL}, {_solved_sql('a', EXCLUSIONS['all'])} " + " UNION ALL ".join(
    f"SELECT '{x}' AS term, round({b} * (SELECT stddev_samp({x}) FROM s_a), 7) AS per_sd, round({b} * (SELECT quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) FROM s_a), 7) AS per_iqr, round({b} * ln(1001), 7) AS per_thousand FROM v_a"
    for x, b in (("x1", "b1"), ("x2", "b2"))
)


def estimate_invariance(spark: S, d: str) -> DataFrame:
    """The same two-way model estimated three ways: by sweeps of means, from the normal equations, and with market dummies."""
    names = ["y", "x1", "x2"]
    rows = cut(_sample(spark, d, EXCLUSIONS["all"]).select("market", "dy", *names))
    fits = {"sweeps": regression.demean(rows, names, ["market", "dy"]), "exact": regression.absorb_exact(rows, names, "dy", "market")}
    out = [(kind, *map(float, regression.Fit(at, "y", ["x1", "x2"]).beta)) for kind, at in fits.items()]
    markets = [r[0] for r in rows.select("market").distinct().orderBy("market").limit(MOST_DUMMIES + 1).collect()]
    if len(markets) > MOST_DUMMIES:
        raise ValueError(f"more than {MOST_DUMMIES} markets")
    flags = [f"m{i}" for i in range(1, len(markets))]
    marked = rows.withColumns({f: (F.col("market") == m).cast("double") for f, m in zip(flags, markets[1:])})
    within = regression.demean(marked, [*names, *flags], ["dy"])
    out.append(("dummies", *map(float, regression.Fit(within, "y", ["x1", "x2", *flags]).beta[:2])))
    return spark.createDataFrame([(kind, round(a, 6), round(b, 6)) for kind, a, b in out], "estimator string, x1 double, x2 double")


ESTIMATE_INVARIANCE = f"{TWO_WAY} SELECT estimator, round(b1, 6) AS x1, round(b2, 6) AS x2 FROM b, (VALUES ('sweeps'), ('exact'), ('dummies')) v(estimator)"


def absorbed_two_way(spark: S, d: str) -> DataFrame:
    """Residuals on market and day by exact absorption: rows and squares of every level, and its sum, which must be 0."""
    spec = EXCLUSIONS["all"]
    at = cut(regression.absorb_exact(_sample(spark, d, spec), ["y"], "dy", "market"))
    total = F.round(F.abs(F.sum("y")), 6).alias("off")
    by = lambda k: at.groupBy(k).agg(F.count("*").alias("n"), F.round(F.sum(F.col("y") * F.col("y")), 6).alias("squares"), total).select(F.lit(k).alias("effect"), F.col(k).cast("string").alias("level"), "n", "squares", "off")
    return by("market").unionByName(by("dy"))


ABSORBED_TWO_WAY = f"""{TWO_WAY} SELECT 'market' AS effect, market AS level, count(*) AS n, round(sum(y * y), 6) AS squares, round(abs(sum(y)), 6) AS "off" FROM left_over GROUP BY market
UNION ALL SELECT 'dy', dy::VARCHAR, count(*), round(sum(y * y), 6), round(abs(sum(y)), 6) FROM left_over GROUP BY dy"""

NAMES = "interaction_models two_part_models exclusion_models sensitivity_models standardised_effects estimate_invariance absorbed_two_way".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
