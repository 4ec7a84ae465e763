"""Panels, rollups and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a panel's bucket.
GRAIN = 3600


def with_bucket(trades: DataFrame, grain: int = GRAIN) -> DataFrame:
    return trades.withColumn("bucket", F.col("sec") - F.pmod("sec", F.lit(grain)))


def panel(trades: DataFrame, grain: int = GRAIN) -> DataFrame:
    """Sparse panel: one row per market and active bucket."""
    signed = F.col("value") * F.col("direction")
    return with_bucket(trades, grain).groupBy("market", "bucket").agg(
        F.count(F.lit(1)).alias("n_trades"), F.countDistinct("wallet").alias("n_wallets"), F.sum("value").alias("gross"), F.sum(signed).alias("net"),
        F.sum(F.when(F.col("direction") > 0, F.col("value")).otherwise(0.0)).alias("buy_value"),
    )


def split_flow(trades: DataFrame, limits: DataFrame, grain: int = GRAIN) -> DataFrame:
    """Large and ordinary net flow per market and bucket, by the market's limit of the day.

    Ties at the limit are large; a day without a limit is neither and adds 0.
    """
    large, ordinary = F.col("value") >= F.col("q0"), F.col("value") < F.col("q0")
    signed = F.col("value") * F.col("direction")
    at = with_bucket(trades, grain).join(limits.select("market", "dy", "q0"), ["market", "dy"], "left")
    return at.groupBy("market", "bucket").agg(
        F.sum(F.when(large, signed).otherwise(0.0)).alias("large_net"), F.sum(F.when(ordinary, signed).otherwise(0.0)).alias("ordinary_net"),
        F.sum(F.when(large, 1).otherwise(0)).alias("large_count"), F.sum(F.when(ordinary, 1).otherwise(0)).alias("ordinary_count"),
    )


def concentration(rows: DataFrame, keys: list[str], unit: str = "wallet", value: str = "value") -> DataFrame:
    """``top1, top3, hhi`` of the units' shares of each group, pre-aggregated by unit."""
    by_unit = rows.groupBy(*keys, unit).agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_v"), unit)
    ranked = by_unit.withColumn("_place", F.row_number().over(w))
    total = F.sum("_v")
    return ranked.groupBy(*keys).agg(
        (F.max("_v") / total).alias("top1"), (F.sum(F.when(F.col("_place") <= 3, F.col("_v"))) / total).alias("top3"),
        (F.sum(F.col("_v") * F.col("_v")) / (total * total)).alias("hhi"),
    )


def actions(trades: DataFrame) -> DataFrame:
    """Trades of one wallet and transaction on a market as one action; those of no net value go.

    The price is weighted by value and the time is that of the first trade.
    """
    key = F.concat_ws("-", "wallet", F.expr("sec div 21600"))
    signed = F.col("value") * F.col("direction")
    out = trades.withColumn("action", key).groupBy("market", "wallet", "action").agg(
        F.min("sec").alias("sec"), F.sum(signed).alias("net"), F.sum("value").alias("gross"), (F.sum(F.col("value") * F.col("price")) / F.sum("value")).alias("price"),
        F.count(F.lit(1)).alias("n_trades"),
    )
    return out.where("net <> 0").withColumn("direction", F.signum("net").cast("int"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, mean, sample deviation, minimum, quartiles, maximum; in one pass."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")).select("c.*")
    q = F.expr("percentile(x, array(0.25, 0.5, 0.75))")
    return long.groupBy("column").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), q.alias("_q"), F.max("x").alias("most")
    ).select("column", "n", "mean", "sd", "least", *[F.col("_q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)], "most")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], measure: str, tolerance: float = 1e-6) -> DataFrame:
    """Keys on which two tables differ by more than the tolerance, or that one of them lacks."""
    both = left.select(*keys, F.col(measure).alias("left_value")).join(right.select(*keys, F.col(measure).alias("right_value")), keys, "full")
    off = F.abs(F.col("left_value") - F.col("right_value")) > tolerance
    return both.where(F.col("left_value").isNull() | F.col("right_value").isNull() | off)


def threshold_panel(trades: DataFrame, limits: DataFrame, names: dict[str, str], grain: int = GRAIN) -> DataFrame:
    """Counts, wallets, gross and net of large and ordinary trades under several limits of the day.

    ``names`` maps the prefix of a limit's columns to its column in ``limits``. Sums are first
    taken per wallet, so distinct wallets are counted without a copy of the rows per limit.
    """
    at = with_bucket(trades, grain).join(limits.select("market", "dy", *names.values()), ["market", "dy"], "left")
    signed = F.col("value") * F.col("direction")
    kinds = [(f"{p}_{k}", F.col("value") >= F.col(q) if k == "large" else F.col("value") < F.col(q)) for p, q in names.items() for k in ("large", "ordinary")]
    pick = lambda c, x: F.sum(F.when(c, x).otherwise(F.lit(0)))
    own = at.groupBy("market", "bucket", "wallet").agg(
        *[a for n, c in kinds for a in (pick(c, F.lit(1)).alias(f"{n}_count"), pick(c, F.col("value")).alias(f"{n}_gross"), pick(c, signed).alias(f"{n}_net"))]
    )
    return own.groupBy("market", "bucket").agg(
        *[a for n, _ in kinds for a in (*[F.sum(f"{n}_{v}").alias(f"{n}_{v}") for v in ("count", "gross", "net")], F.sum(F.when(F.col(f"{n}_count") > 0, 1).otherwise(0)).alias(f"{n}_wallets"))]
    )
