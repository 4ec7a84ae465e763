"""Restricted wild cluster bootstrap of a linear contrast, its draws kept in a table that grows.

Under the restriction R b = 0 (imposed by projecting the estimate) a draw flips the sign of
each cluster's score. With c the cluster's part of the contrast and l its row of R'B A B, all
that a draw needs are two sign-weighted sums over clusters, of scores and of c l, so the
draws are an aggregation over the table of clusters, as many as there are, and no array of
clusters goes anywhere. Signs come from md5 of block and cluster, so any engine draws alike
and a draw is the same whenever it is made.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, new_folder
from .regression import Fit

#: Draws that share an md5, clusters of a task (about), and clusters worked on at once.
SIGNS, TASK, CHUNK = 32, 2_000, 256


def signs_of(keys: list[str], first: int, size: int) -> np.ndarray:
    """+1 or -1 per draw and cluster: the hex digit ``draw % 32`` of md5 of ``draw // 32:cluster`` is below 8, or not."""
    blocks = range(first // SIGNS, (first + size - 1) // SIGNS + 1)
    digits = np.array([np.frombuffer("".join(hashlib.md5(f"{b}:{key}".encode()).hexdigest() for b in blocks).encode(), np.uint8) for key in keys])
    begin = first - blocks[0] * SIGNS
    return np.where(digits[:, begin : begin + size] < ord("8"), 1.0, -1.0).T


def cluster_scores(fit: Fit, cluster: str, weights: list[float]) -> tuple[DataFrame, dict]:
    """``key, s0.., m0..`` of each cluster (scores under the restriction, and c l), and the sums that all draws share."""
    k, xs, r = len(fit.xs), fit.xs, np.array(weights, float)
    b = fit.bread
    spread = float(r @ b @ r)
    if not spread > 0:
        raise ValueError("the contrast has no variance")
    held = fit.beta - b @ r * float(r @ fit.beta) / spread
    per = fit.rows.groupBy(F.col(cluster).cast("string").alias("key")).agg(
        *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"a{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(i, k)], *[F.sum(F.col(x) * F.col(fit.y)).alias(f"q{i}") for i, x in enumerate(xs)]
    )
    a = lambda i, j: F.col(f"a{min(i, j)}_{max(i, j)}")
    total = lambda terms: sum(terms, F.lit(0.0))
    rb = r @ b
    score = per.select("*", *[(F.col(f"q{i}") - total(a(i, j) * float(held[j]) for j in range(k))).alias(f"s{i}") for i in range(k)])
    own = total(F.col(f"s{i}") * float(rb[i]) for i in range(k))
    row = [total(a(i, m) * float(rb[i] * b[m, j]) for i in range(k) for m in range(k)) for j in range(k)]
    table = cut(score.select("key", *[f"s{i}" for i in range(k)], own.alias("c"), *[x.alias(f"l{j}") for j, x in enumerate(row)]))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = table.agg(F.count(F.lit(1)), F.sum(F.col("c") * F.col("c")), *[F.sum(F.col(f"l{i}") * F.col(f"l{j}")) for i, j in pairs]).first()
    groups, square = found[0], np.zeros((k, k))
    if groups < 2:
        raise ValueError("fewer than two clusters")
    for (i, j), v in zip(pairs, found[2:]):
        square[i, j] = square[j, i] = v
    factor = groups / (groups - 1) * (fit.n - 1) / (fit.n - k)
    shared = {"rb": rb, "square": square, "own": found[1], "factor": factor, "groups": groups, "held": held}
    return table.select("key", *[f"s{i}" for i in range(k)], *[(F.col("c") * F.col(f"l{j}")).alias(f"m{j}") for j in range(k)]), shared


def _sums(names: list[str], draws: int, batch: int, wanted: list[int]):
    """Sign-weighted sums of the clusters of a partition, for the batches wanted."""

    def run(frames):
        import pandas as pd

        sums = {w: np.zeros((min(batch, draws - w * batch), len(names))) for w in wanted}
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK]
                keys, values = part["key"].tolist(), part[names].to_numpy(float)
                for w, own in sums.items():
                    own += signs_of(keys, w * batch, len(own)) @ values
        for w, own in sums.items():
            yield pd.DataFrame({"batch": w, "draw": w * batch + np.arange(len(own)), **{n: own[:, i] for i, n in enumerate(names)}})

    return run


def _done(spark: SparkSession, path: str, draws: int, batch: int) -> DataFrame | None:
    """Batches whose draws are all in the table; None if there is no table yet."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    full = F.least(F.lit(batch), F.lit(draws) - F.col("batch") * batch)
    return found.groupBy("batch").agg(F.countDistinct("draw").alias("n")).where(F.col("n") >= full).select("batch")


def contrast_draws(fit: Fit, cluster: str, weights: list[float], draws: int = 9_999, batch: int = 250, folder: str | None = None, portion: int = 20) -> DataFrame:
    """``draw, t`` of the contrast under the restriction that it is 0.

    Draws are appended to a table below ``folder`` (a new one if None), ``portion`` batches at
    a time. A call that finds a table of the same estimates and settings makes only the
    batches that it lacks, so a run that was ended goes on where it was.
    """
    spark = fit.rows.sparkSession
    table, shared = cluster_scores(fit, cluster, weights)
    k = len(fit.xs)
    told = [fit.y, *fit.xs, cluster, weights, draws, batch, fit.n, shared["groups"], [f"{v:.6e}" for v in shared["held"]]]
    path = f"{(folder or new_folder(spark, 'draws')).rstrip('/')}/{hashlib.md5(repr(told).encode()).hexdigest()}"
    names = [*[f"s{i}" for i in range(k)], *[f"m{i}" for i in range(k)]]
    done = _done(spark, path, draws, batch)
    every = spark.range(-(-draws // batch)).withColumnRenamed("id", "batch")
    missing = [r[0] for r in (every if done is None else every.join(done, "batch", "left_anti")).orderBy("batch").collect()]  # one number per batch
    table = table.repartition(max(1, -(-shared["groups"] // TASK)), "key")
    for at in range(0, len(missing), portion):
        schema = "batch long, draw long, " + ", ".join(f"{n} double" for n in names)
        drawn = table.mapInPandas(_sums(names, draws, batch, missing[at : at + portion]), schema).groupBy("batch", "draw").agg(*[F.sum(n).alias(n) for n in names])
        s, m = ([F.col(f"{c}{i}") for i in range(k)] for c in "sm")
        top = sum((float(v) * x for v, x in zip(shared["rb"], s)), F.lit(0.0))
        cross = sum((x * y for x, y in zip(m, s)), F.lit(0.0))
        square = sum((float(shared["square"][i, j]) * s[i] * s[j] for i in range(k) for j in range(k)), F.lit(0.0))
        t = top / F.sqrt(float(shared["factor"]) * (F.lit(float(shared["own"])) - 2 * cross + square))
        drawn.select("batch", "draw", t.alias("t")).write.mode("append").parquet(path)
    return spark.read.parquet(path).dropDuplicates(["draw"]).select("draw", "t")


def exceedance(draws: DataFrame, t: float) -> DataFrame:
    """``draws, exceed, p``: how many draws lie beyond the observed statistic on either side."""
    beyond = F.sum(F.when(F.abs("t") > abs(t), 1).otherwise(0))
    return draws.agg(F.count(F.lit(1)).alias("draws"), beyond.alias("exceed"), (beyond / F.count(F.lit(1))).alias("p"))
