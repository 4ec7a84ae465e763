"""Inputs: files as tables with declared schemas, and trades and ticks bound to an event table.

Every event is bound as a trade and as a tick of its market. ``trades`` and ``ticks`` read only
the columns named here, so the scan is pruned; filters on them reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
#: A tick price is a value over this.
PRICE_SCALE = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV (also gz, also with a byte-order mark) with a header that must match the schema."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST")


def json_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One multi-line JSON page per file; a page that does not fit the schema fills ``_corrupt_record``."""
    return spark.read.json(path, schema=f"{schema}, _corrupt_record string", multiLine=True, mode="PERMISSIVE").withColumn("file", F.col("_metadata.file_path"))


def epoch(ts: str = "ts") -> Column:
    """Whole seconds since 1970, for a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def fixed_windows(spark: SparkSession, start: int, stop: int, width: int) -> DataFrame:
    """Half-open windows ``begin, finish`` of ``width`` seconds over ``[start, stop)``."""
    begin = spark.range(start, stop, width).withColumnRenamed("id", "begin")
    return begin.withColumn("finish", F.least(F.col("begin") + width, F.lit(stop)))


def _bound(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("market"), F.col("user_id").alias("wallet"), epoch().alias("sec"), "value",
        (F.col("value") / PRICE_SCALE).alias("price"),
    ).withColumn("dy", F.expr(f"sec div {DAY}"))


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id, market, wallet, sec, dy, value, price, side, outcome, direction``."""
    from ..functions.market import direction

    side = F.when(F.col("event_id") % 3 != 0, "BUY").otherwise("SELL")
    outcome = F.when(F.col("wallet") % 2 == 0, "YES").otherwise("NO")
    found = _bound(spark, folder).withColumns({"side": side, "outcome": outcome})
    return found.withColumn("direction", direction("side", "outcome"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """``market, sec, price, source_row``: one row per tick, in source order by ``source_row``."""
    return _bound(spark, folder).select("market", "sec", "price", F.col("event_id").alias("source_row"))
