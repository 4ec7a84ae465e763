"""Exact duplicates and keys that must be unique."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_objects(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of rows that are equal in all columns but ``order``, the first in that order.

    Equality is that of a SHA-256 over the canonical JSON of the row (columns by name, nulls kept).
    """
    body = F.to_json(F.struct(*sorted(c for c in rows.columns if c not in order)), {"ignoreNullFields": "false"})
    rest = [c for c in rows.columns if c not in order]
    # an aggregate combines copies in each task before the shuffle; a window would move them all
    first = rows.withColumn("_key", F.sha2(body, 256)).groupBy("_key").agg(F.min(F.struct(*order)).alias("_first"), F.first(F.struct(*rest)).alias("_rest"))
    return first.select("_rest.*", "_first.*").select(*rows.columns)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``; an error at once if a key repeats. Only keys are counted, pre-aggregated, and one of them is read back."""
    found = duplicate_keys(rows, keys).first()
    if found is not None:
        raise ValueError(f"{keys} repeat: {found.asDict()}")
    return rows
