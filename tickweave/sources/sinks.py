"""Outputs: tables by key, and a manifest that lets a reader verify them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_key(df: DataFrame, path: str, *keys: str) -> None:
    """One folder per key; rows are dealt by key and a salt, so a hot key has several writers."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(8)))
    salted.repartition(*keys, "_salt").drop("_salt").write.partitionBy(*keys).parquet(path)


def row_digest(df: DataFrame):
    """64-bit digest of a row, nulls and column order included."""
    return F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))


def manifest(df: DataFrame, time: str, *keys: str) -> DataFrame:
    """Per key: rows, time bounds and a fingerprint that does not depend on row order."""
    return df.withColumn("_digest", row_digest(df)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_sec"), F.max(time).alias("last_sec"), F.bit_xor("_digest").alias("fingerprint")
    )


def scan_keys(spark: SparkSession, path: str, listed: DataFrame, key: str) -> DataFrame:
    """Rows of the keys that a manifest lists; only their folders are read.

    The manifest's keys are a broadcast side while Spark finds them small, and prune the
    partitions of the scan.
    """
    return spark.read.parquet(path).join(listed.select(key), key, "left_semi")


def combined(spark: SparkSession, paths: list[str], expected: DataFrame | None = None, part: str = "part") -> DataFrame:
    """All parts as one table with the part's number as ``part``.

    Parts must have the same columns of the same types in the same order. ``expected``
    (``part, n_rows``) is checked in the pass that reads the result: each row carries its
    part's count, and a part that has another number of rows fails the job.
    """
    frames = [spark.read.parquet(p) for p in paths]
    heads = {tuple(f.dtypes) for f in frames}
    if len(heads) != 1:
        raise ValueError(f"parts differ in their columns: {sorted(heads)}")
    whole = frames[0].withColumn(part, F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        whole = whole.unionByName(f.withColumn(part, F.lit(i)))
    if expected is None:
        return whole
    counts = whole.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).join(expected.withColumnRenamed("n_rows", "_want"), part, "full")
    good = F.coalesce(F.col("_n") == F.col("_want"), F.lit(False))
    checked = counts.withColumn("_ok", F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("a part has another number of rows than its manifest")).cast("boolean"))).where("_ok")
    return whole.join(F.broadcast(checked.select(part)), part)  # one row per part
