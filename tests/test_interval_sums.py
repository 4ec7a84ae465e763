"""Sums and distinct counts in windows of time against brute force, and without pairs."""

import random

import pytest

from tickweave.operators import temporal


@pytest.mark.parametrize(("after", "until"), [(0, 10), (-10, -1), (-3, 4)])
def test_sums_equal_brute_force(spark, after, until):
    rng = random.Random(until)
    left = [(i, rng.choice("ab"), rng.randrange(60)) for i in range(40)] + [(90, None, 3), (91, "c", 5), (92, "a", None)]
    right = [(rng.choice("ab"), rng.randrange(60), rng.randrange(9)) for _ in range(200)]
    found = temporal.interval_sums(spark.createDataFrame(left, "id int, k string, sec long"), spark.createDataFrame(right, "k string, r_sec long, v long"), ["k"], after, until, {"s": "v"})
    want = {i: sum(v for c, r, v in right if c == k and t is not None and after < r - t <= until) for i, k, t in left}
    assert {r.id: r.s for r in found.collect()} == want and found.columns == ["id", "k", "sec", "s"]


def test_distinct_equals_brute_force(spark):
    rng = random.Random(4)
    left = [(i, rng.choice("ab"), rng.randrange(-20, 60)) for i in range(60)] + [(90, None, 3), (91, "c", 5)]
    right = [(rng.choice("ab"), rng.randrange(-20, 60), rng.choice([1, 2, 3, 4, None])) for _ in range(120)]
    found = temporal.distinct_within(spark.createDataFrame(left, "id int, k string, sec long"), spark.createDataFrame(right, "k string, r_sec long, w int"), ["k"], "w", 7, "n")
    want = {i: len({w for c, r, w in right if c == k and 0 < r - t <= 7 and w is not None}) for i, k, t in left}
    assert {r.id: r.n for r in found.collect()} == want


def test_dense_times_shuffle_no_pairs(spark):
    many = spark.range(3_000).selectExpr("'a' AS k", "id % 5 AS r_sec", "1 AS v")
    found = temporal.interval_sums(spark.range(3_000).selectExpr("id", "'a' AS k", "id % 5 AS sec"), many, ["k"], 0, 10, {"s": "v"})
    assert {(r.sec, r.s) for r in found.collect()} == {(t, 600 * (4 - t)) for t in range(5)}
    assert "r_sec - " not in found._jdf.queryExecution().toString() and temporal.interval_pairs  # no condition on pairs of rows
