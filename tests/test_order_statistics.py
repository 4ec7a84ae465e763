"""Exact quantiles in small cells against numpy, and thinning in blocks against a walk."""

import random

import numpy as np
import pytest

from tickweave.operators import order_statistics as stats
from tickweave.operators import windows


def values(rng, n):
    kinds = [lambda: rng.random(), lambda: rng.choice([1.0, 2.0, 5.0]), lambda: rng.expovariate(0.01), lambda: 7.0]
    return [rng.choice(kinds[: rng.randint(1, 4)])() for _ in range(n)]


@pytest.mark.parametrize(("cell", "parts"), [(50_000, 64), (12, 4), (3, 2)])
def test_expanding_quantiles(spark, monkeypatch, cell, parts):
    monkeypatch.setattr(stats, "CELL", cell)
    monkeypatch.setattr(stats, "PARTS", parts)
    rng = random.Random(9)
    rows = [(k, day, v) for k in "ab" for day in range(1, 9) if day != 4 for v in values(rng, rng.randint(1, 40))]
    rows += [("c", day, 7.0) for day in range(3) for _ in range(30)] + [("a", 3, None), (None, 3, 1.0), ("a", None, 1.0)]
    qs = [0.0, 0.25, 0.9, 0.99, 1.0]
    found = windows.past_only_quantiles(spark.createDataFrame(rows, "market string, dy int, value double"), qs, 10).collect()
    assert len(found) == len({(k, d) for k, d, _ in rows if k is not None and d is not None})
    for r in found:
        past = [v for k, d, v in rows if k == r.market and d is not None and d < r.dy and v is not None]
        assert r.history == len(past)
        want = np.quantile(past, qs) if len(past) >= 10 else [None] * len(qs)
        assert [r[f"q{i}"] for i in range(len(qs))] == (pytest.approx(want) if len(past) >= 10 else want)


def test_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(stats, "CELL", 20)
    monkeypatch.setattr(stats, "PARTS", 3)
    rng = random.Random(3)
    rows = [(rng.choice("xy"), v) for v in values(rng, 600)] + [("x", None), ("z", None)]
    table = spark.createDataFrame(rows, "k string, v double")
    by = {r.k: r for r in stats.exact_quantiles(table, "v", [0.1, 0.5, 0.995], ["k"]).collect()}
    assert set(by) == {"x", "y"}
    for k, r in by.items():
        own = [v for key, v in rows if key == k and v is not None]
        assert (r.history, r.q0, r.q1, r.q2) == (len(own), *(pytest.approx(x) for x in np.quantile(own, [0.1, 0.5, 0.995])))
    assert stats.exact_quantiles(table, "v", [0.5]).first().q0 == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert stats.exact_quantiles(table.where("k = 'z'"), "v", [0.5]).count() == 0


@pytest.mark.parametrize("gap", [1, 7, 40])
def test_thinning_in_blocks(spark, monkeypatch, gap):
    rng = random.Random(gap)
    rows = [(k, t, i) for i, (k, t) in enumerate((rng.choice("abc"), rng.choice([rng.randrange(3_000), rng.randrange(100)])) for _ in range(700))]
    rows += [("d", 5, 900), ("e", -50, 901), ("e", 9_999, 902), (None, 3, 903), ("a", None, 904)]
    want = set()
    for key in "abcde":
        last = None
        for t in sorted({t for k, t, _ in rows if k == key and t is not None}):
            if last is None or t - last >= gap:
                last = t
                want |= {i for k, s, i in rows if k == key and s == t}
    table = spark.createDataFrame(rows, "k string, sec long, id long")
    for blocks in (64, 2):
        monkeypatch.setattr(windows, "BLOCK_GAPS", blocks)
        out = windows.thinned(table, ["k"], "sec", gap)
        assert out.columns == table.columns and sorted(r.id for r in out.collect()) == sorted(want)
    assert windows.thinned(table.limit(0), ["k"], "sec", gap).count() == 0
