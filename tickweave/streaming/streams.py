"""Structured Streaming counterparts of the panel, the dedupe and the sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import new_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """The event table as a stream, timed by ``at``."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/events.parquet*")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def minute_panel(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums per market and window; ``late`` sets a watermark, beyond which state goes and rows are left out."""
    timed = events if late is None else events.withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), F.col("event_type").alias("market")).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("value").alias("gross")
    ).select("market", F.unix_seconds("w.start").alias("bucket"), "n_trades", "gross")


def deduplicated(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """First row of each key, whatever the order of the files; the state holds every key.

    For a stream without end, ``late`` sets a watermark: state of keys older than it goes, and
    so do rows that come later than it.
    """
    return events.dropDuplicates(keys) if late is None else events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Per wallet, runs of events with gaps shorter than ``gap``; ``late`` sets a watermark, beyond which rows are left out."""
    timed = events if late is None else events.withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events")
    ).select(F.col("user_id").alias("wallet"), F.unix_seconds("w.start").alias("begin"), (F.unix_seconds("w.end")).alias("finish"), "n_events")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums per market over overlapping windows."""
    timed = events if late is None else events.withWatermark("at", late)
    return timed.groupBy(F.window("at", width, step).alias("w"), F.col("event_type").alias("market")).agg(
        F.count(F.lit(1)).alias("n_trades"), F.sum("value").alias("gross")
    ).select("market", F.unix_seconds("w.start").alias("bucket"), "n_trades", "gross")


def run_once(stream: DataFrame, spark: SparkSession, mode: str = "complete", keys: list[str] | None = None, settings: dict[str, str] | None = None, arrivals: Iterable[Callable[[], None]] | None = None) -> DataFrame:
    """Everything there is now, through the stream and its sink, as a table.

    With ``keys`` the stream runs in ``update`` mode: a batch writes the rows that it changed,
    and the last one of each key counts. Without, it runs in ``mode``: ``append``, or
    ``complete`` where rows merge, as sessions do. A batch that runs again overwrites its own
    output. Output and progress go below ``spark.checkpoint.dir``, which all executors share.
    ``settings`` hold for this stream only. ``arrivals`` put more of the input in place, one
    after another; the stream goes on after each, with the files that are there by then.
    """
    mode = "update" if keys else mode
    folder = new_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else number}")

    before = {name: spark.conf.get(name, None) for name in settings or {}}
    for name, value in (settings or {}).items():
        spark.conf.set(name, value)
    try:
        for arrive in [lambda: None] if arrivals is None else arrivals:
            arrive()
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
            query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", LongType())])).parquet(f"{folder}/out/*")
    if keys:
        rest = [c for c in stream.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*keys, "_row.*")
    return out.select(*stream.columns)
