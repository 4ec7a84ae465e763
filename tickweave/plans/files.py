"""Queries that go through files which they write themselves, below the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from ..sources.sinks import combined, manifest, scan_keys, write_by_key
from ..sources.stages import staged
from ..sources.tables import csv_table, fixed_windows, json_pages, table, trades
from ..sources.windowed import windowed, write_pages
from .binding import FIRST_DAY, KICKOFF, T

S = SparkSession
TRADE_ROWS = "event_id bigint, market string, wallet bigint, sec bigint, value double, side string"


def gz_csv_scan(spark: S, d: str) -> DataFrame:
    """Trades written as gzip CSV with a header, read back under a declared schema with an early filter."""
    path = new_folder(spark, "csv")
    trades(spark, d).select(*[c.split()[0] for c in TRADE_ROWS.split(", ")]).write.csv(path, header=True, compression="gzip")
    return csv_table(spark, path, TRADE_ROWS).where("value >= 50").groupBy("market", "side").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("gross"), F.max("sec").alias("last_sec"))


GZ_CSV_SCAN = f"WITH {T} SELECT market, side, count(*) AS n, round(sum(value), 4) AS gross, max(sec) AS last_sec FROM t WHERE value >= 50 GROUP BY ALL"


def json_page_scan(spark: S, d: str) -> DataFrame:
    """Pages of orders as JSON arrays, one file each; what does not parse is told from what does."""
    path = new_folder(spark, "pages")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.expr("o_custkey % 40").alias("page"))
    body = F.to_json(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))))
    pages = orders.groupBy("page").agg(body.alias("value"))
    cut_off = F.when(F.col("page") % 7 == 3, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    pages.select("page", cut_off.alias("value")).write.partitionBy("page").text(path, compression="gzip")
    rows = json_pages(spark, path, "o_orderkey bigint, o_totalprice double")
    page = F.regexp_extract("file", r"page=(\d+)", 1).cast("int")
    bad = F.col("_corrupt_record").isNotNull()
    return rows.groupBy(page.alias("page")).agg(F.max(bad).alias("corrupt"), F.sum(F.when(bad, 0).otherwise(1)).alias("n"), F.round(F.coalesce(F.sum(F.when(~bad, F.col("o_totalprice"))), F.lit(0.0)), 2).alias("total"))


JSON_PAGE_SCAN = """SELECT (o_custkey % 40)::INT AS page, (o_custkey % 40) % 7 = 3 AS corrupt, CASE WHEN (o_custkey % 40) % 7 = 3 THEN 0 ELSE count(*) END AS n,
  CASE WHEN (o_custkey % 40) % 7 = 3 THEN 0.0 ELSE round(sum(o_totalprice::DOUBLE), 2) END AS total FROM orders GROUP BY o_custkey % 40"""


def keyed_manifest_scan(spark: S, d: str) -> DataFrame:
    """One folder per market, a manifest of them, and a scan of the markets that it lists as busy, with rows counted again."""
    path = new_folder(spark, "by-key")
    rows = trades(spark, d).select("event_id", "market", "sec", "value")
    write_by_key(rows, path, "market")
    listed = manifest(rows, "sec", "market")
    busy = listed.where("n_rows % 2 = 0").select("market", "n_rows")
    found = scan_keys(spark, path, busy, "market").groupBy("market").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("gross"))
    return found.join(busy, "market").select("market", "n", "gross", (F.col("n") == F.col("n_rows")).alias("reconciled"))


KEYED_MANIFEST_SCAN = f"WITH {T} SELECT market, count(*) AS n, round(sum(value), 4) AS gross, true AS reconciled FROM t GROUP BY ALL HAVING count(*) % 2 = 0"


def combined_parts(spark: S, d: str) -> DataFrame:
    """Four parts of the trades, put together under equal headers and reconciled with their counts."""
    rows = trades(spark, d).select("event_id", "market", "value", F.expr("sec % 4").cast("int").alias("part"))
    folder = new_folder(spark, "parts")
    paths = [f"{folder}/{i}" for i in range(4)]
    for i, path in enumerate(paths):
        rows.where(F.col("part") == i).drop("part").write.parquet(path)
    expected = rows.groupBy("part").agg(F.count("*").alias("n_rows"))
    return combined(spark, paths, expected).groupBy("part", "market").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("gross"))


COMBINED_PARTS = f"WITH {T} SELECT (sec % 4)::INT AS part, market, count(*) AS n, round(sum(value), 4) AS gross FROM t GROUP BY ALL"


def appended_log(spark: S, d: str) -> DataFrame:
    """A JSON-lines log that two runs append to."""
    path = new_folder(spark, "log")
    for run in (1, 2):
        trades(spark, d).groupBy("market").agg(F.count("*").alias("n")).withColumn("run", F.lit(run)).write.mode("append").json(path)
    return spark.read.schema("market string, n bigint, run int").json(path).groupBy("market").agg(F.sum("n").alias("n"), F.countDistinct("run").alias("runs"))


APPENDED_LOG = f"WITH {T} SELECT market, 2 * count(*) AS n, 2::BIGINT AS runs FROM t GROUP BY ALL"


def archived_bytes(spark: S, d: str) -> DataFrame:
    """Responses kept byte for byte, one file each: their length and SHA-256 as stored."""
    path = new_folder(spark, "archive")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.concat("n_name", F.lit(": "), F.col("n_regionkey").cast("string")).alias("value"))
    nation.write.partitionBy("key").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/*")
    key = F.regexp_extract("path", r"key=(\d+)", 1).cast("int")
    return files.select(key.alias("key"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"))


ARCHIVED_BYTES = r"""SELECT n_nationkey::INT AS key, strlen(n_name || ': ' || n_regionkey::VARCHAR || chr(10)) AS bytes, sha256(n_name || ': ' || n_regionkey::VARCHAR || chr(10)) AS digest FROM nation"""
#: Span of the paged scan, seconds of a stored slot, rows of a page, and rows that a window may hold.
SPAN = (FIRST_DAY * 86_400, (FIRST_DAY + 40) * 86_400)
SLOT, PAGE, MOST = 86_400, 100, 400


def paged_scan(spark: S, d: str) -> DataFrame:
    """Trades behind a service that hands out at most ``MOST`` rows of a window: written as its pages, read back by
    windows halved until they fit, under a filter on time, and counted against what was written."""
    path = new_folder(spark, "service")
    rows = trades(spark, d).select("event_id", "market", "wallet", "sec", "value")
    write_pages(rows, path, "market", "sec", SLOT)
    source = windowed(
        spark, path=path, columns="event_id bigint, market string, wallet bigint, sec bigint, value double", key="market", time="sec", order="event_id",
        start=SPAN[0], stop=SPAN[1], limit=PAGE, most=MOST, slot=SLOT,
    )
    found = source.where(F.col("sec") >= KICKOFF).withColumn("task", F.spark_partition_id()).groupBy("market").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("gross"), F.countDistinct("task").alias("windows")
    )
    written = rows.where(F.col("sec") >= KICKOFF).groupBy("market").agg(F.count("*").alias("n_written"))
    return written.join(found, "market", "left")


PAGED_SCAN = f"""WITH RECURSIVE {T}, u AS (SELECT market, sec, value FROM t WHERE sec >= {KICKOFF}),
w(market, start, stop, n) AS (
  SELECT market, {KICKOFF}::BIGINT, {SPAN[1]}::BIGINT, count(*) FROM u WHERE sec < {SPAN[1]} GROUP BY market
  UNION ALL
  SELECT h.market, h.start, h.stop, count(*) FROM (
    SELECT market, start, start + (stop - start) // 2 AS stop FROM w WHERE n > {MOST} UNION ALL SELECT market, start + (stop - start) // 2, stop FROM w WHERE n > {MOST}) h
  JOIN u ON u.market = h.market AND u.sec >= h.start AND u.sec < h.stop GROUP BY h.market, h.start, h.stop),
c AS (SELECT market, count(*) AS windows FROM w WHERE n <= {MOST} GROUP BY market)
SELECT market, count(*) AS n_written, count(*) FILTER (sec < {SPAN[1]}) AS n, round(sum(value) FILTER (sec < {SPAN[1]}), 4) AS gross, any_value(windows) AS windows
FROM u LEFT JOIN c USING (market) GROUP BY market"""


def windowed_counts(spark: S, d: str) -> DataFrame:
    """Half-open windows of three days over the span, with their trades; empty ones count 0."""
    begin = FIRST_DAY * 86_400
    windows = fixed_windows(spark, begin, begin + 31 * 86_400, 3 * 86_400)
    own = trades(spark, d).withColumn("begin", F.lit(begin) + F.floor((F.col("sec") - begin) / (3 * 86_400)) * (3 * 86_400))
    counts = own.groupBy("begin").agg(F.count("*").alias("n"))
    return windows.join(counts, "begin", "left").select("begin", "finish", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


WINDOWED_COUNTS = f"""WITH {T}, w AS (SELECT unnest(range({FIRST_DAY * 86_400}, {(FIRST_DAY + 31) * 86_400}, {3 * 86_400})) AS begin)
SELECT begin, least(begin + {3 * 86_400}, {(FIRST_DAY + 31) * 86_400}) AS finish, count(sec) AS n FROM w LEFT JOIN t ON sec >= begin AND sec < begin + {3 * 86_400} GROUP BY ALL"""

def _hours(rows: DataFrame) -> DataFrame:
    return rows.groupBy("market", F.expr("sec - sec % 3600").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("gross"))


def staged_panel(spark: S, d: str) -> DataFrame:
    """The hourly panel as a stage over trades by market, run twice; before the second run the least market gets all its rows again."""
    source, store = new_folder(spark, "trades"), new_folder(spark, "store")
    rows = trades(spark, d).select("event_id", "market", "sec", "value")
    write_by_key(rows, source, "market")
    staged(spark, store, "hours", "1", source, "market", _hours)
    least = rows.agg(F.min("market").alias("market"))
    rows.join(F.broadcast(least), "market", "left_semi").write.mode("append").partitionBy("market").parquet(source)
    return staged(spark, store, "hours", "1", source, "market", _hours)


STAGED_PANEL = f"""WITH {T}, h AS (SELECT market, sec - sec % 3600 AS bucket, count(*) AS n, sum(value) AS gross, market = (SELECT min(market) FROM t) AS again FROM t GROUP BY ALL)
SELECT market, bucket, CASE WHEN again THEN 2 * n ELSE n END AS n, round(CASE WHEN again THEN 2 * gross ELSE gross END, 6) AS gross, (CASE WHEN again THEN 2 ELSE 1 END)::BIGINT AS run FROM h"""

NAMES = "gz_csv_scan json_page_scan keyed_manifest_scan combined_parts appended_log archived_bytes paged_scan windowed_counts staged_panel".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
