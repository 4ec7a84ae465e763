"""Joins and comparisons that must hold, or say what does not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join, if every left row finds exactly one right row; otherwise the job fails.

    The right side is reduced to one row per key with its count, so both faults are seen in
    the join itself and nothing is counted in a job of its own.
    """
    rest = [c for c in right.columns if c not in keys]
    one = right.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_right"), F.count(F.lit(1)).alias("_n"))
    at = left.join(one, keys, "left")
    good = F.coalesce(F.col("_n") == 1, F.lit(False))
    checked = F.when(good, F.col("_right")).otherwise(F.raise_error(F.lit(f"a row with none or several matches on {keys}")).cast(one.schema["_right"].dataType))
    return at.withColumn("_right", checked).select(*left.columns, "_right.*")


def reconciled_flows(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value", direction: str = "direction", least: float = 1e-5, relative: float = 1e-10) -> DataFrame:
    """Keys whose rows, gross or net differ by more than ``max(least, relative * gross)``."""
    def sums(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{side}_rows"), F.sum(value).alias(f"{side}_gross"), F.sum(F.col(value) * F.col(direction)).alias(f"{side}_net"))

    both = sums(left, "left").join(sums(right, "right"), keys, "full").na.fill(0).na.fill(0.0)
    bound = F.greatest(F.lit(least), relative * F.col("left_gross"))
    gap = lambda c: F.col(f"right_{c}") - F.col(f"left_{c}")
    off = (F.col("left_rows") != F.col("right_rows")) | (F.abs(gap("gross")) > bound) | (F.abs(gap("net")) > bound)
    return both.where(off).select(*keys, "left_rows", "right_rows", gap("gross").alias("gross_gap"), gap("net").alias("net_gap"))


def conserved(source: DataFrame, included: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the rows of all three, and whether what is kept and left out adds up to the source."""
    tagged = [rows.select(*keys, *[F.lit(int(i == j)).alias(n) for j, n in enumerate(("source", "included", "excluded"))]) for i, rows in enumerate((source, included, excluded))]
    at = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return at.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("source", "included", "excluded")]).withColumn("conserved", F.col("source") == F.col("included") + F.col("excluded"))


def changed_keys(frozen: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose manifest row differs from the frozen one: ``changed``, ``missing`` or ``new``."""
    a = frozen.select(*keys, F.col("n_rows").alias("_n0"), F.col("fingerprint").alias("_f0"))
    b = now.select(*keys, F.col("n_rows").alias("_n1"), F.col("fingerprint").alias("_f1"))
    state = F.when(F.col("_n1").isNull(), "missing").when(F.col("_n0").isNull(), "new").when((F.col("_n0") != F.col("_n1")) | (F.col("_f0") != F.col("_f1")), "changed")
    return a.join(b, keys, "full").withColumn("state", state).where("state is not null")
