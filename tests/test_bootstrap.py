"""The contrast bootstrap against dense draws, and its table of draws."""

import hashlib

import numpy as np
import pytest

from tickweave.stats import bootstrap, regression


def fitted(spark, rng, n=300, clusters=14):
    g = rng.integers(0, clusters, n)
    x = rng.normal(size=(n, 2)) + g[:, None] * 0.05
    y = x @ [0.3, 0.1] + rng.normal(size=n) * (1 + g % 3)
    rows = spark.createDataFrame([(int(c), *map(float, r), float(v)) for c, r, v in zip(g, x, y)], "c int, x1 double, x2 double, y double")
    return g, x, y, regression.Fit(rows, "y", ["x1", "x2"])


def by_hand(g, x, y, r, draws):
    n, k = x.shape
    names = sorted(set(g.tolist()))
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    held = beta - inverse @ r * (r @ beta) / (r @ inverse @ r)
    left, out = y - x @ held, []
    for draw in range(draws):
        sign = {c: 1 if hashlib.md5(f"{draw // 32}:{c}".encode()).hexdigest()[draw % 32] < "8" else -1 for c in names}
        again = x @ held + np.array([sign[c] for c in g.tolist()]) * left
        b = inverse @ x.T @ again
        e = again - x @ b
        scores = np.array([(x[g == c] * e[g == c, None]).sum(0) for c in names])
        cover = inverse @ scores.T @ scores @ inverse * len(names) / (len(names) - 1) * (n - 1) / (n - k)
        out.append(r @ b / np.sqrt(r @ cover @ r))
    return out


@pytest.mark.parametrize("weights", [[1.0, 0.0], [1.0, -1.0], [0.5, 2.0]])
def test_draws_equal_dense_ones(spark, monkeypatch, weights):
    monkeypatch.setattr(bootstrap, "TASK", 5)
    monkeypatch.setattr(bootstrap, "CHUNK", 3)
    g, x, y, fit = fitted(spark, np.random.default_rng(2))
    got = [r.t for r in bootstrap.contrast_draws(fit, "c", weights, draws=70, batch=25).orderBy("draw").collect()]
    assert got == pytest.approx(by_hand(g, x, y, np.array(weights), 70), abs=1e-8)


def test_a_run_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    *_, fit = fitted(spark, np.random.default_rng(3))
    folder, made, real = f"file://{tmp_path}/draws", [], bootstrap._sums
    monkeypatch.setattr(bootstrap, "_sums", lambda names, draws, batch, wanted: made.append(list(wanted)) or real(names, draws, batch, wanted))
    whole = bootstrap.contrast_draws(fit, "c", [1.0, -1.0], draws=110, batch=20, folder=folder, portion=2).orderBy("draw").collect()
    assert made == [[0, 1], [2, 3], [4, 5]] and [r.draw for r in whole] == list(range(110))
    path = next(p for p in (tmp_path / "draws").iterdir())
    kept = spark.createDataFrame([r for r in spark.read.parquet(str(path)).collect() if r.batch in (0, 1, 4) or r.batch == 3 and r.draw < 70])
    kept.write.mode("overwrite").parquet(str(tmp_path / "left"))
    for f in path.glob("*.parquet"):
        f.unlink()
    spark.read.parquet(str(tmp_path / "left")).write.mode("append").parquet(str(path))
    made.clear()
    again = bootstrap.contrast_draws(fit, "c", [1.0, -1.0], draws=110, batch=20, folder=folder, portion=2).orderBy("draw").collect()
    assert made == [[2, 3], [5]] and [r.draw for r in again] == list(range(110))
    assert [r.t for r in again] == pytest.approx([r.t for r in whole], abs=1e-9)
    made.clear()
    bootstrap.contrast_draws(fit, "c", [1.0, -1.0], draws=110, batch=20, folder=folder)
    assert made == []
    bootstrap.contrast_draws(fit, "c", [1.0, 0.0], draws=110, batch=20, folder=folder)  # another contrast, another table
    assert made == [[0, 1, 2, 3, 4, 5]]


def test_ends(spark):
    *_, fit = fitted(spark, np.random.default_rng(4), clusters=1)
    with pytest.raises(ValueError):
        bootstrap.contrast_draws(fit, "c", [1.0, 0.0], draws=10)
    with pytest.raises(ValueError):
        bootstrap.contrast_draws(fit, "c", [0.0, 0.0], draws=10)
