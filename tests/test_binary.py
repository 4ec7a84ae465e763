"""Binary models with group intercepts against dense scoring with dummies, and their ends."""

import math

import numpy as np
import pytest

from tickweave.stats.binary import NotConverged, binary_fit

ROWS = "g int, c int, x double, w double, y int"


def dense(rows, link):
    """Coefficients, clustered covariance, mean slope and delta errors by a dense design."""
    g, c, y = (np.array([r[i] for r in rows]) for i in (0, 1, 4))
    x = np.array([[r[2], r[3]] for r in rows], float)
    d = np.concatenate([x, (g[:, None] == np.unique(g)[None, :]).astype(float)], 1)

    def parts(b):
        e = d @ b
        if link == "logit":
            p = 1 / (1 + np.exp(-e))
            return p, p * (1 - p)
        return -np.expm1(-np.exp(e)), np.exp(e - np.exp(e))

    b = np.zeros(d.shape[1])
    b[2:] = -0.5
    for _ in range(60):
        p, s = parts(b)
        w = s * s / (p * (1 - p))
        b = b + np.linalg.solve(d.T @ (w[:, None] * d), d.T @ ((y - p) * s / (p * (1 - p))))
    p, s = parts(b)
    w, q = s * s / (p * (1 - p)), (y - p) * s / (p * (1 - p))
    bread = np.linalg.inv(d.T @ (w[:, None] * d))
    scores = np.array([(d * q[:, None])[c == k].sum(0) for k in np.unique(c)])
    n, k, m = len(y), 2, len(scores)
    cover = (bread @ scores.T @ scores @ bread)[:2, :2] * m / (m - 1) * (n - 1) / (n - k)
    effects = d[:, 2:]
    centred = x - effects @ np.linalg.solve(effects.T @ (w[:, None] * effects), effects.T @ (w[:, None] * x))
    curve = s * (1 - 2 * p) if link == "logit" else s * (1 - np.exp(d @ b))
    by = np.outer(np.eye(2)[0], 1)[:, 0] * s.mean() + b[0] * (curve[:, None] * centred).mean(0)
    return b[:2], cover, s.mean(), math.sqrt(by @ cover @ by)


def made(n=600, seed=3):
    rng = np.random.default_rng(seed)
    g, c = rng.integers(0, 12, n), rng.integers(0, 25, n)
    x, w = rng.normal(size=n) * 3 + 50, rng.normal(size=n)
    y = rng.random(n) < 1 / (1 + np.exp(-(0.2 * (x - 50) - 0.7 * w + 0.1 * (g - 6))))
    return [(int(a), int(b), float(u), float(v), int(z)) for a, b, u, v, z in zip(g, c, x, w, y)]


@pytest.mark.parametrize("link", ["logit", "cloglog"])
def test_equals_dense_scoring(spark, link):
    rows = made()
    want, cover, slope, error = dense(rows, link)
    extra = [(77, 1, 3.0, 1.0, 1), (77, 2, 4.0, 1.0, 1), (78, 1, 3.0, 1.0, 0)]  # no variation: left out
    nulls = [(None, 1, 3.0, 1.0, 1), (1, None, 3.0, 1.0, 1), (1, 1, None, 1.0, 0), (1, 1, 3.0, 1.0, None)]
    fit = binary_fit(spark.createDataFrame(rows + extra + nulls, ROWS), "y", ["x", "w"], "g", "c", link)
    assert (fit.rows, fit.groups, fit.clusters) == (600, 12, 25)
    assert fit.beta == pytest.approx(want, abs=1e-7) and fit.cover == pytest.approx(cover, rel=1e-5)
    assert fit.slope == pytest.approx(slope, rel=1e-7)
    found = fit.marginal([1.0, 0.0])
    assert found["error"] == pytest.approx(error, rel=1e-5) and found["estimate"] == pytest.approx(slope * want[0], rel=1e-6)
    assert found["held_error"] == pytest.approx(slope * math.sqrt(cover[0, 0]), rel=1e-5)
    tested = fit.contrast([1.0, -1.0])
    assert tested["low"] < tested["estimate"] < tested["high"] and 0 <= tested["p"] <= 1


def test_separated_outcomes_do_not_converge(spark):
    rows = [(i % 3, i % 7, float(i), float(i % 5), int(i > 60)) for i in range(120)]
    with pytest.raises(NotConverged):
        binary_fit(spark.createDataFrame(rows, ROWS), "y", ["x", "w"], "g", "c")
    with pytest.raises(NotConverged):
        binary_fit(spark.createDataFrame(made(), ROWS), "y", ["x", "w"], "g", "c", steps=2)
    with pytest.raises(ValueError):
        binary_fit(spark.createDataFrame(made(50), ROWS), "y", ["x"], "g", "c", "probit")


def test_nothing_to_fit(spark):
    assert binary_fit(spark.createDataFrame([], ROWS), "y", ["x", "w"], "g", "c") is None
    assert binary_fit(spark.createDataFrame([(1, 1, 1.0, 2.0, 1)] * 3, ROWS), "y", ["x", "w"], "g", "c") is None
    rows = [(g, 1, x, 5.0, y) for g, _, x, _, y in made(200)]  # one cluster, a constant regressor
    fit = binary_fit(spark.createDataFrame(rows, ROWS), "y", ["x", "w"], "g", "c")
    assert fit.beta[1] == 0 and math.isnan(fit.contrast([1.0, 0.0])["error"])
