"""Operators against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.functions import market as m
from tickweave.ml import evaluation as ev
from tickweave.operators import dedupe, matching, temporal, windows
from tickweave.stats import regression, special, tests


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("most", [None, 7])
def test_asof(spark, strict, forward, most):
    rng = np.random.default_rng(1)
    left = [(i, str(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-50, 50, 60)))] + [(99, None, 5), (98, "0", None)]
    right = sorted({(str(k), int(t)) for k, t in zip(rng.integers(0, 2, 25), rng.integers(-50, 50, 25))})
    ticks = spark.createDataFrame([(k, t, t / 10) for k, t in right], "market string, sec long, price double")
    out = temporal.asof(spark.createDataFrame(left, "id long, market string, sec long"), ticks, strict=strict, forward=forward, most_gap=most, bucket=9)
    got = {r.id: r.asof_sec for r in out.collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        near = [s for a, s in right if a == k and t is not None and ((s > t or s == t and not strict) if forward else (s < t or s == t and not strict))]
        best = (min(near) if forward else max(near)) if near else None
        assert got[i] == (best if best is not None and (most is None or abs(best - t) <= most) else None)


def test_interval_pairs(spark):
    a = spark.createDataFrame([(i, "k", i * 3) for i in range(20)], "id long, key string, sec long")
    b = spark.createDataFrame([(i, "k", i * 2 - 5) for i in range(40)], "r_id long, key string, r_sec long")
    got = {(r.id, r.r_id) for r in temporal.interval_pairs(a, b, ["key"], -4, 6).collect()}
    assert got == {(i, j) for i in range(20) for j in range(40) if -4 < (j * 2 - 5) - i * 3 <= 6}


def test_dedupe_and_unique(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1.0), (4, None, None)], "at long, x string, y double")
    assert sorted(r.at for r in dedupe.exact_objects(rows, ["at"]).collect()) == [1, 3, 4]
    with pytest.raises(Exception):
        dedupe.assert_unique(rows, ["x"]).collect()
    assert dedupe.assert_unique(rows, ["at"]).count() == 4
    assert dedupe.exact_objects(rows.limit(0), ["at"]).count() == 0


def test_past_only_quantiles(spark):
    rng = np.random.default_rng(2)
    data = [("m", int(d), float(v)) for d, v in zip(rng.integers(0, 12, 150), rng.integers(0, 30, 150))]
    rows = spark.createDataFrame(data, "market string, dy long, value double")
    for days in (None, 3):
        for r in windows.past_only_quantiles(rows, [0.9], 20, days).collect():
            past = [v for _, d, v in data if d < r.dy and (days is None or d >= r.dy - days)]
            assert r.history == len(past)
            assert (r.q0 is None) if len(past) < 20 else r.q0 == pytest.approx(np.quantile(past, 0.9))


def test_thinned_and_matching(spark):
    rows = spark.createDataFrame([("a", t) for t in (0, 4, 10, 11, 19, 20, 33)], "k string, sec long")
    assert sorted(r.sec for r in windows.thinned(rows, ["k"], "sec", 10).collect()) == [0, 10, 20, 33]
    cases = spark.createDataFrame([(1, "a", 100), (2, "a", 104), (3, "a", 900)], "id long, k string, sec long")
    controls = spark.createDataFrame([(10, "a", 101), (11, "a", 110), (12, "b", 100)], "id long, k string, sec long")
    got = {(r.case_id, r.control_id, r.gap) for r in matching.greedy_nearest(cases, controls, ["k"], "sec", "id", 8).collect()}
    assert got == {(1, 10, 1), (2, 11, 6)}


def test_direction_fails_on_unknown_pairs(spark):
    good = spark.createDataFrame([("BUY", "YES"), ("SELL", "YES"), ("BUY", "NO"), ("SELL", "NO")], "s string, o string")
    assert [r[0] for r in good.select(m.direction("s", "o")).collect()] == [1, -1, -1, 1]
    with pytest.raises(Exception):
        good.select(F.lit("x").alias("s"), "o").select(m.direction("s", "o")).collect()


def _sample(rng, n=400):
    a, b = rng.integers(0, 12, n), rng.integers(0, 9, n)
    x = rng.normal(size=(n, 2)) + a[:, None] * 0.1
    y = x @ [0.5, -0.2] + a * 0.3 - b * 0.2 + rng.normal(size=n)
    return a, b, x, y


def test_fixed_effects_and_clusters(spark):
    a, b, x, y = _sample(np.random.default_rng(4))
    rows = spark.createDataFrame([(int(i), int(j), *map(float, r), float(v)) for i, j, r, v in zip(a, b, x, y)], "a int, b int, x1 double, x2 double, y double")
    fit = regression.Fit(regression.demean(rows, ["y", "x1", "x2"], ["a", "b"]), "y", ["x1", "x2"])
    dummies = np.hstack([np.eye(12)[a], np.eye(9)[b][:, 1:]])
    take = lambda v: v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
    xr, yr = take(x), take(y)
    beta = np.linalg.lstsq(xr, yr, rcond=None)[0]
    assert fit.beta == pytest.approx(beta, abs=1e-7)
    e, bread = yr - xr @ beta, np.linalg.inv(xr.T @ xr)
    s = np.array([(xr[a == g] * e[a == g, None]).sum(0) for g in range(12)])
    want = bread @ s.T @ s @ bread * 12 / 11 * 399 / 398
    cover, groups = fit.covariance(["a"])
    assert groups == 12 and cover == pytest.approx(want, rel=1e-6)


def test_registered_queries_use_the_reference_draws(spark, monkeypatch):
    from tickweave.plans import estimators

    seen = {}
    whole = ev.isolation_scores
    monkeypatch.setattr(estimators.ev, "isolation_scores", lambda *a, **k: seen.update(k) or whole(*a, **k))
    monkeypatch.setattr(estimators, "trades", lambda s, d: s.createDataFrame(
        [(i, "m", i % 5, i * 600, i * 600 // 86400, float(i % 37), i % 37 / 500, "BUY", "YES", 1 if i % 3 else -1) for i in range(1200)],
        "event_id long, market string, wallet long, sec long, dy long, value double, price double, side string, outcome string, direction int",
    ))
    assert {r.draws for r in estimators.wild_bootstrap(spark, "").collect()} == {9_999}
    assert estimators.cluster_bootstrap(spark, "").first().draws == 4_999
    draws = []
    real = tests.permutation_p
    monkeypatch.setattr(estimators.tests, "permutation_p", lambda d: draws.append(d.count()) or real(d))
    estimators.permutation_p(spark, "")
    assert draws == [2_000]
    assert estimators.isolation_screen(spark, "").count() and seen == {"trees": 500}


def test_tails():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert special.f_upper(3.0, 2, 20) == pytest.approx(0.0725, abs=1e-4)
    assert special.t_quantile(0.05, 30) == pytest.approx(2.042272, abs=1e-5)


def test_permutation_and_average_precision(spark):
    rows = spark.createDataFrame([("s", 1, 5.0), ("s", 0, 1.0), ("s", 0, 2.0), ("r", 1, 4.0), ("r", 0, 3.0)], "s string, l int, v double")
    draws = tests.permutation(rows, "s", "l", "v", draws=200, batch=50)
    real = [r.effect for r in draws.where("draw = -1").collect()]
    assert real == [pytest.approx(4.5 - 2.0)] and draws.count() == 201
    assert 0 < tests.permutation_p(draws).first().p_upper <= 1
    at = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "x double, y int")
    assert ev.average_precision(at, "x", "y").first().ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_isolation_finds_the_outlier(spark):
    rng = np.random.default_rng(6)
    data = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))] + [(999, 12.0, -12.0)]
    out = ev.isolation_scores(spark.createDataFrame(data, "k long, a double, b double"), "k", ["a", "b"], trees=30)
    assert out.orderBy(F.desc("score")).first().k == 999 and out.count() == 301


def test_absorption_is_exact_and_guarded(spark):
    rng = np.random.default_rng(31)
    a, b, x, y = _sample(rng, 300)
    a[:10], b[:10] = 50, 60  # a component of its own
    rows = spark.createDataFrame([(i, int(p), int(q), float(u), float(v)) for i, (p, q, u, v) in enumerate(zip(a, b, x[:, 0], y))], "i long, a long, b long, x double, y double")
    dummies = np.concatenate([(a[:, None] == np.unique(a)).astype(float), (b[:, None] == np.unique(b)).astype(float)], axis=1)
    want = np.stack([v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0] for v in (x[:, 0], y)], axis=1)
    for found in (regression.absorb_exact(rows, ["x", "y"], "a", "b"), regression.demean(rows, ["x", "y"], ["a", "b"])):
        got = np.array([(r.x, r.y) for r in found.orderBy("i").collect()])
        assert np.abs(got - want).max() < 1e-7
    with pytest.raises(ArithmeticError, match="after 2 rounds"):
        regression.demean(rows, ["y"], ["a", "b"], rounds=2)
    assert regression.absorb_exact(rows.limit(0), ["y"], "a", "b").count() == 0


def test_absorption_and_bootstrap_bounds_raise(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 4, i % 3, float(i)) for i in range(24)], "a long, b long, y double")
    monkeypatch.setattr(regression, "MOST_LEVELS", 2)
    with pytest.raises(ValueError, match="more than"):
        regression.absorb_exact(rows, ["y"], "a", "b")
    monkeypatch.setattr(tests, "MOST_CLUSTERS", 3)
    with pytest.raises(ValueError, match="more than 3 clusters"):
        tests.cluster_bootstrap(rows, "a", "y", "y", draws=10)


def test_singletons_go_until_none_is_left(spark):
    rows = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (2, "q"), (3, "r"), (4, "r"), (4, "s")], "a long, b string")
    assert {(r.a, r.b) for r in regression.without_singletons(rows, ["a", "b"]).collect()} == {(1, "p"), (1, "q"), (2, "p"), (2, "q")}


def test_running_sums_by_blocks(spark):
    rng = np.random.default_rng(32)
    values = rng.permutation(500).astype(float) ** 2
    rows = spark.createDataFrame([(float(v), int(i % 7)) for i, v in enumerate(values)], "v double, k long")
    weight = {float(v): i % 7 for i, v in enumerate(values)}
    for falling in (False, True):
        for r in windows.running(rows, "v", {"before": "k"}, descending=falling, blocks=8).collect():
            assert r.before == sum(k for v, k in weight.items() if (v > r.v if falling else v < r.v))


@pytest.mark.parametrize("block, shuffled", [(2, 0), (2, 200_000), (50_000, 0), (50_000, 200_000)])
def test_permutation_has_the_law_of_permutations(spark, monkeypatch, block, shuffled):
    """Means and spreads of the drawn sums against the exact ones, with strata in one block and in several, by counts and by rows."""
    monkeypatch.setattr(tests, "STRATUM_BLOCK", block)
    monkeypatch.setattr(tests, "BLOCK_ROWS", shuffled)
    rng = np.random.default_rng(33)
    data = [(s, int(rng.random() < 0.4), float(rng.integers(0, 6))) for s in "ab" for _ in range(40)]
    rows = spark.createDataFrame(data, "s string, l int, v double")
    draws = [r.effect for r in tests.permutation(rows, "s", "l", "v", draws=2_000).where("draw >= 0").collect()]
    assert len(draws) == 2_000
    ones, n, total = sum(d[1] for d in data), len(data), sum(d[2] for d in data)
    mean = spread = 0.0
    for s in "ab":
        v, k = np.array([d[2] for d in data if d[0] == s]), sum(d[1] for d in data if d[0] == s)
        mean += k * v.mean()
        spread += k * (1 - k / len(v)) * v.var(ddof=1)
    scale = 1 / ones + 1 / (n - ones)
    assert abs(np.mean(draws) - (mean * scale - total / (n - ones))) < 5 * (spread**0.5 * scale) / 2_000**0.5
    assert np.std(draws) == pytest.approx(spread**0.5 * scale, rel=0.08)


def test_models_are_tuned_on_inner_folds_alone(spark, monkeypatch):
    """Thresholds and grid points come from the training groups; scores cover every row once."""
    from tickweave.ml import models

    monkeypatch.setattr(models, "ITERATIONS", 5)
    rng = np.random.default_rng(34)
    data = [(i, int(i % 12), float(x), int(x + rng.normal() > 0.5), float(i)) for i, x in enumerate(rng.normal(size=360))]
    rows = spark.createDataFrame(data, "i long, g long, x double, label long, at double")
    out = models.nested_scores(rows, "logistic", models.LOGISTIC[:2], ["x"], "label", "g", outer=3, inner=2)
    found = out.select("i", "fold", "cut", "score").collect()
    assert sorted(r.i for r in found) == list(range(360)) and all(0 <= r.score <= 1 for r in found)
    assert len({r.fold for r in found}) == 3 and len({(r.fold, r.cut) for r in found}) == 3
    late = models.holdout_scores(rows, "logistic", models.LOGISTIC[:1], ["x"], "label", "g", "at", inner=2).collect()
    assert {r.g for r in late} == {9, 10, 11}
    auc = ev.roc_auc(out.withColumn("k", F.lit(0)), "score", "label", ["k"]).first().auc
    score, label = np.array([r.score for r in out.orderBy("i").collect()]), np.array([d[3] for d in data])
    gap = score[label == 1][:, None] - score[label == 0][None]
    assert auc == pytest.approx(((gap > 0) + 0.5 * (gap == 0)).mean())


def test_sources_that_differ_are_told(spark, tmp_path):
    from tickweave.operators import checks
    from tickweave.sources import paged, sinks

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    rows.write.parquet(f"{tmp_path}/0")
    rows.write.parquet(f"{tmp_path}/1")
    rows.select("v", "k").write.parquet(f"{tmp_path}/2")
    good = spark.createDataFrame([(0, 2), (1, 2)], "part int, n_rows long")
    assert sinks.combined(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], good).count() == 4
    with pytest.raises(ValueError, match="differ in their columns"):
        sinks.combined(spark, [f"{tmp_path}/0", f"{tmp_path}/2"])
    with pytest.raises(Exception, match="another number of rows"):
        sinks.combined(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], good.withColumn("n_rows", F.lit(3).cast("long"))).count()
    other = spark.createDataFrame([(1, 10), (2, 20), (2, 21)], "k long, w long")
    assert checks.whole_join(rows.where("k = 1"), other, ["k"]).collect()[0].w == 10
    for left in (rows, rows.withColumn("k", F.lit(9).cast("long"))):
        with pytest.raises(Exception, match="none or several"):
            checks.whole_join(left, other, ["k"]).collect()
    with pytest.raises(Exception, match="do not end"):
        paged.cursor_pages(rows.select("v"), lambda chain, cursor: ([(1,)], "again"), "x long").collect()
