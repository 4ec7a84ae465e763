"""Multiple testing, paired tests, permutations and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import running
from .regression import MOST_CLUSTERS
from .special import normal_cdf, t_two_sided

#: Distinct values of a stratum that a task permutes at a time (about), and rows that it shuffles instead of drawing counts.
STRATUM_BLOCK, BLOCK_ROWS = 50_000, 200_000


def holm(tests: DataFrame, family: str, p: str = "p", name: str = "test") -> DataFrame:
    """``p_holm``: step-down adjusted p within each family, ties by name."""
    w = Window.partitionBy(family).orderBy(p, name)
    size = F.count(F.lit(1)).over(Window.partitionBy(family))
    raw = (size - F.row_number().over(w) + 1) * F.col(p)
    return tests.withColumn("_raw", raw).withColumn("p_holm", F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def paired(rows: DataFrame, a: str, b: str) -> dict[str, float]:
    """Paired t and Wilcoxon signed-rank (normal approximation, ties by mean rank, zeros left out).

    Ranks come from counts per distinct absolute difference and their running sums by block.
    """
    diff = rows.select((F.col(a) - F.col(b)).alias("d")).where("d is not null")
    n, mean, sd = diff.agg(F.count("d"), F.avg("d"), F.stddev_samp("d")).first()
    t = mean / (sd / n**0.5)
    by = diff.where("d <> 0").groupBy(F.abs("d").alias("m")).agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("up"), F.count(F.lit(1)).alias("k"))
    ranked = running(by, "m", {"before": "k"})
    size, plus, ties = ranked.agg(F.sum("k"), F.sum(F.col("up") * (F.col("before") + (F.col("k") + 1) / 2)), F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k"))).first()
    spread = (size * (size + 1) * (2 * size + 1) / 24 - ties / 48) ** 0.5
    z = (plus - size * (size + 1) / 4) / spread
    return {"n": n, "mean": mean, "t": t, "p_t": t_two_sided(t, n - 1), "w_plus": plus, "z": z, "p_w": 2 * (1 - normal_cdf(abs(z)))}


def permutation(rows: DataFrame, strata: str, label: str, value: str, draws: int = 1_999, batch: int = 50) -> DataFrame:
    """``draw, effect``: mean difference (label 1 less 0) with labels permuted within strata; draw -1 is the real one.

    A stratum is counted per distinct value and dealt into blocks of about ``STRATUM_BLOCK``
    values. How many of its labels fall to each block, and in a block to each value, is drawn
    from the multivariate hypergeometric law, which is the law of a permutation; so a block
    is all that a task holds, and a draw is the same whichever task makes it. Batches of
    draws of a block are further split over tasks; only sums are combined.
    """
    totals = rows.agg(F.sum(F.col(label).cast("double")), F.count(F.lit(1)), F.sum(value), F.sum(F.when(F.col(label) == 1, F.col(value)))).first()
    ones, n, total, real = totals
    cells = rows.groupBy(strata, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_ones"))
    sizes = cells.groupBy(strata).agg(F.ceil(F.count(F.lit(1)) / STRATUM_BLOCK).cast("int").alias("_blocks"), F.sum("_ones").alias("ones"))
    block = F.pmod(F.xxhash64("_v"), F.col("_blocks")).cast("int")
    dealt = cells.join(sizes, strata).withColumn("block", block).groupBy(strata, "block").agg(
        F.max("ones").alias("ones"), F.sum("_n").alias("size"), F.array_sort(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_n").alias("n")))).alias("cells")
    )
    layout = dealt.groupBy(strata).agg(F.array_sort(F.collect_list(F.struct("block", "size"))).alias("layout"))  # two numbers a block
    every = dealt.join(layout, strata).withColumn("job", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-draws // batch) - 1)))))

    def run(frames):
        import zlib

        import pandas as pd

        for frame in frames:
            for key, block, ones, cells, layout, job in zip(frame[strata], frame["block"], frame["ones"], frame["cells"], frame["layout"], frame["job"]):
                seed = [int(job), zlib.crc32(str(key).encode())]
                size = min(batch, draws - job * batch)
                names, counts = [b["block"] for b in layout], np.array([b["size"] for b in layout])
                shares = np.random.default_rng(seed).multivariate_hypergeometric(counts, int(ones), size, method="marginals")[:, names.index(block)]
                v, many = np.array([c["v"] for c in cells], float), np.array([c["n"] for c in cells])
                rng = np.random.default_rng([*seed, int(block)])
                if many.sum() <= BLOCK_ROWS:  # few ties: labels fall on rows, by a shuffle
                    each = np.repeat(v, many)
                    sums = [each[rng.permutation(len(each))[: int(k)]].sum() for k in shares]
                else:
                    sums = [v @ rng.multivariate_hypergeometric(many, int(k), method="marginals") for k in shares]
                yield pd.DataFrame({"draw": job * batch + np.arange(size), "s": np.array(sums, float)})

    # few bytes but much work, which adaptive execution would put into one task
    every = every.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), strata, "block", "job")
    drawn = every.mapInPandas(run, "draw long, s double").groupBy("draw").agg(F.sum("s").alias("s"))
    own = rows.sparkSession.createDataFrame([(-1, real)], "draw long, s double")
    return drawn.union(own).select("draw", (F.col("s") / ones - (total - F.col("s")) / (n - ones)).alias("effect"))


def permutation_p(draws: DataFrame) -> DataFrame:
    """``p_upper, p_lower, p_two_sided``, each (1 + count) / (B + 1)."""
    real = F.max(F.when(F.col("draw") == -1, F.col("effect"))).over(Window.partitionBy(F.lit(1)))  # one row per draw, whatever the data
    at = draws.withColumn("_real", real).where("draw >= 0")
    share = lambda c: (1 + F.sum(F.when(c, 1).otherwise(0))) / (F.count(F.lit(1)) + 1)
    return at.agg(share(F.col("effect") >= F.col("_real")).alias("p_upper"), share(F.col("effect") <= F.col("_real")).alias("p_lower"), share(F.abs("effect") >= F.abs("_real")).alias("p_two_sided"))


def cluster_bootstrap(rows: DataFrame, cluster: str, a: str, b: str, draws: int = 4_999, batch: int = 250) -> DataFrame:
    """``draw, increment`` of the difference of two means when whole clusters are drawn with replacement."""
    spark = rows.sparkSession
    by = rows.groupBy(cluster).agg(F.sum(a), F.sum(b), F.count(F.lit(1))).orderBy(cluster).drop(cluster).limit(MOST_CLUSTERS + 1).collect()  # three numbers a cluster
    if len(by) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    shared = spark.sparkContext.broadcast(np.array([tuple(r) for r in by], float))

    def run(frames):
        import pandas as pd

        m = shared.value
        for frame in frames:
            for seed in frame["id"]:
                size = min(batch, draws - seed * batch)
                at = np.random.default_rng([29, int(seed)]).integers(0, len(m), (size, len(m)))
                s = m[at].sum(1)
                yield pd.DataFrame({"draw": seed * batch + np.arange(size), "increment": (s[:, 0] - s[:, 1]) / s[:, 2]})

    return spark.range(-(-draws // batch)).mapInPandas(run, "draw long, increment double")


def mean_difference(rows: DataFrame, flag: str, value: str) -> DataFrame:
    """``smd``: difference of means over the root of the mean variance."""
    one, zero = F.col(flag) == 1, F.col(flag) == 0
    pick = lambda f, c: f(F.when(c, F.col(value)))
    return rows.agg(((pick(F.avg, one) - pick(F.avg, zero)) / F.sqrt((pick(F.var_samp, one) + pick(F.var_samp, zero)) / 2)).alias("smd"))
