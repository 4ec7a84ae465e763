"""Queries on as-of lookups, interval joins and what is built on them, the flagship among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market as m
from ..operators import aggregates, temporal, windows
from ..sources.tables import ticks, trades
from .binding import HORIZON, K, LEAST_HISTORY, T

S = SparkSession
AGE = 7_200


def _asof(spark: S, d: str, **how) -> DataFrame:
    left = trades(spark, d).select("event_id", "market", "sec")
    return temporal.asof(left, temporal.last_per_second(ticks(spark, d)), **how).select("event_id", "asof_sec", F.round("asof_price", 9).alias("asof_price"))


def asof_backward_incl(spark: S, d: str) -> DataFrame:
    return _asof(spark, d)


def asof_backward_strict(spark: S, d: str) -> DataFrame:
    return _asof(spark, d, strict=True)


def asof_bounded_age(spark: S, d: str) -> DataFrame:
    return _asof(spark, d, most_gap=AGE)


def asof_forward(spark: S, d: str) -> DataFrame:
    return _asof(spark, d, forward=True)


def asof_forward_bounded(spark: S, d: str) -> DataFrame:
    return _asof(spark, d, forward=True, most_gap=AGE)


def _asof_sql(op: str, most: int | None = None) -> str:
    gap = "" if most is None else f" AND abs(t.sec - k.sec) <= {most}"
    near = f"CASE WHEN k.sec IS NOT NULL{gap} THEN"
    return f"""WITH {T}, {K} SELECT t.event_id, {near} k.sec END AS asof_sec, {near} round(k.price, 9) END AS asof_price
FROM t ASOF LEFT JOIN k ON t.market = k.market AND t.sec {op} k.sec"""


ASOF_BACKWARD_INCL, ASOF_BACKWARD_STRICT, ASOF_BOUNDED_AGE = _asof_sql(">="), _asof_sql(">"), _asof_sql(">=", AGE)
ASOF_FORWARD, ASOF_FORWARD_BOUNDED = _asof_sql("<="), _asof_sql("<=", AGE)


def _others(spark: S, d: str) -> DataFrame:
    return trades(spark, d).select("market", F.col("wallet").alias("r_wallet"), F.col("sec").alias("r_sec"), F.col("value").alias("r_value"), F.col("direction").alias("r_direction"))


def follower_window(spark: S, d: str) -> DataFrame:
    """Other wallets' trades in ``(t, t + h]`` after each large trade, by direction; none gives nulls."""
    large = trades(spark, d).where("value >= 150").select("event_id", "market", "wallet", "sec", "direction")
    rows = _others(spark, d).withColumnRenamed("r_wallet", "wallet").where("wallet is not null")
    by = {f"{n}": F.when(F.col("r_direction") == s, F.col("r_value")).otherwise(0.0) for n, s in (("up", 1), ("down", -1))}
    rows = rows.withColumns({**by, "one": F.lit(1)})
    found = temporal.interval_sums(large, rows, ["market"], 0, HORIZON, {"all_up": "up", "all_down": "down", "all_n": "one"})
    found = temporal.interval_sums(found, rows, ["market", "wallet"], 0, HORIZON, {"own_up": "up", "own_down": "down", "own_n": "one"})
    found = temporal.distinct_within(found, rows, ["market"], "wallet", HORIZON, "wallets")
    up, down = (F.round(F.col(f"all_{n}") - F.col(f"own_{n}"), 9) for n in ("up", "down"))
    any_ = F.col("wallet").isNotNull() & (F.col("all_n") > F.col("own_n"))
    rises = F.col("direction") > 0
    found = found.select(
        "event_id", F.when(any_, F.when(rises, up).otherwise(down)).alias("same"), F.when(any_, F.when(rises, down).otherwise(up)).alias("opposite"),
        F.when(any_, F.col("wallets") - F.when(F.col("own_n") > 0, 1).otherwise(0)).alias("n_followers"),
    )
    total = F.col("same") + F.col("opposite")
    balance = F.when(total == 0, F.lit(float("nan"))).otherwise((F.col("same") - F.col("opposite")) / total)
    return found.select("event_id", F.round("same", 6).alias("same"), F.round("opposite", 6).alias("opposite"), "n_followers", F.round(balance, 9).alias("balance"))


FOLLOWER_WINDOW = f"""WITH {T}, s AS (
SELECT a.event_id, sum(CASE WHEN a.direction = b.direction THEN b.value ELSE 0 END) AS same, sum(CASE WHEN a.direction = b.direction THEN 0 ELSE b.value END) AS opposite,
  count(DISTINCT b.wallet) AS n_followers
FROM t a JOIN t b ON a.market = b.market AND b.sec > a.sec AND b.sec <= a.sec + {HORIZON} AND a.wallet <> b.wallet WHERE a.value >= 150 GROUP BY a.event_id)
SELECT t.event_id, round(same, 6) AS same, round(opposite, 6) AS opposite, n_followers, round((same - opposite) / (same + opposite), 9) AS balance
FROM t LEFT JOIN s USING (event_id) WHERE t.value >= 150"""


def prepost_open_window(spark: S, d: str) -> DataFrame:
    """Others' signed value in the open windows ``(t - h, t)`` and ``(t, t + h)``."""
    found = trades(spark, d).where("value >= 150").select("event_id", "market", "wallet", "sec")
    rows = _others(spark, d).withColumnRenamed("r_wallet", "wallet").where("wallet is not null").withColumn("signed", F.col("r_value") * F.col("r_direction"))
    for name, after, until in (("pre", -HORIZON, -1), ("post", 0, HORIZON - 1)):
        found = temporal.interval_sums(found, rows, ["market"], after, until, {f"all_{name}": "signed"})
        found = temporal.interval_sums(found, rows, ["market", "wallet"], after, until, {f"own_{name}": "signed"})
    others = lambda c: F.round(F.when(F.col("wallet").isNull(), 0.0).otherwise(F.col(f"all_{c}") - F.col(f"own_{c}")), 6).alias(c)
    return found.select("event_id", others("pre"), others("post"))


PREPOST_OPEN_WINDOW = f"""WITH {T}, s AS (
SELECT a.event_id, sum(CASE WHEN b.sec < a.sec THEN b.value * b.direction ELSE 0 END) AS pre, sum(CASE WHEN b.sec > a.sec THEN b.value * b.direction ELSE 0 END) AS post
FROM t a JOIN t b ON a.market = b.market AND b.sec > a.sec - {HORIZON} AND b.sec < a.sec + {HORIZON} AND b.sec <> a.sec AND a.wallet <> b.wallet WHERE a.value >= 150 GROUP BY a.event_id)
SELECT t.event_id, round(coalesce(pre, 0), 6) AS pre, round(coalesce(post, 0), 6) AS post FROM t LEFT JOIN s USING (event_id) WHERE t.value >= 150"""
OPPOSITE_WITHIN = 6 * 86_400


def first_opposite(spark: S, d: str) -> DataFrame:
    """The wallet's own first trade in the other direction on the market in ``(t, t + s]``."""
    found = windows.first_opposite(trades(spark, d).select("event_id", "market", "wallet", "sec", "direction", "value"), ["market", "wallet"], "direction", "sec", "event_id")
    gap = F.col("first_opposite.time") - F.col("sec")
    near = gap <= OPPOSITE_WITHIN
    return found.where("value >= 120").select("event_id", F.when(near, F.col("first_opposite.name")).alias("first_id"), F.when(near, gap).alias("gap"))


FIRST_OPPOSITE = f"""WITH {T}, f AS (SELECT a.event_id, min(b.sec) AS s, arg_min(b.event_id, b.sec * 1000000000 + b.event_id) AS first_id FROM t a
JOIN t b ON a.market = b.market AND a.wallet = b.wallet AND a.direction <> b.direction AND b.sec > a.sec AND b.sec <= a.sec + {OPPOSITE_WITHIN} WHERE a.value >= 120 GROUP BY a.event_id)
SELECT t.event_id, first_id, s - t.sec AS gap FROM t LEFT JOIN f USING (event_id) WHERE t.value >= 120"""


def anti_proximity(spark: S, d: str) -> DataFrame:
    """Ordinary trades with no large one within the buffer on either side."""
    rows = trades(spark, d)
    large = rows.where("value >= 150").groupBy("market", "sec").agg(F.max("value").alias("price"))
    controls = rows.where("value < 100").select("event_id", "market", "sec")
    near = temporal.asof(controls, large, most_gap=HORIZON, prefix="before")
    near = temporal.asof(near, large, most_gap=HORIZON, forward=True, prefix="behind")
    return near.where("before_sec is null and behind_sec is null").select("event_id", "market")


ANTI_PROXIMITY = f"""WITH {T} SELECT event_id, market FROM t WHERE value < 100 AND NOT EXISTS (
SELECT 1 FROM t b WHERE b.market = t.market AND b.value >= 150 AND abs(b.sec - t.sec) <= {HORIZON})"""


def large_ordinary_flow(spark: S, d: str) -> DataFrame:
    """Large and ordinary flow per market and hour under past-only P99 limits, with prices before and after.

    The baseline is the last tick strictly before the hour, the target the last one up to
    ``HORIZON`` after it begins.
    """
    rows = trades(spark, d)
    limits = windows.past_only_quantiles(rows, [0.9], LEAST_HISTORY)
    flow = aggregates.split_flow(rows, limits)
    ticks_ = temporal.last_per_second(ticks(spark, d))
    at = temporal.asof(flow, ticks_, at="bucket", strict=True, prefix="base").withColumn("target", F.col("bucket") + HORIZON)
    at = temporal.asof(at, ticks_, at="target", prefix="goal")
    return at.select(
        "market", "bucket", F.round(m.signed_log(F.col("large_net")), 7).alias("large_flow"), F.round(m.signed_log(F.col("ordinary_net")), 7).alias("ordinary_flow"),
        "large_count", "ordinary_count", F.round(F.col("goal_price") - F.col("base_price"), 9).alias("price_change"), (F.col("bucket") - F.col("base_sec")).alias("base_age"),
    )


LIMITS = f"""q AS (SELECT e.market, e.dy, CASE WHEN count(h.value) >= {LEAST_HISTORY} THEN quantile_cont(h.value, 0.9) END AS q0
FROM (SELECT DISTINCT market, dy FROM t) e LEFT JOIN t h ON h.market = e.market AND h.dy < e.dy GROUP BY ALL)"""
SPLIT = """f AS (SELECT t.market, sec - sec % 3600 AS bucket, sum(CASE WHEN value >= q0 THEN value * direction ELSE 0 END) AS large_net,
  sum(CASE WHEN value < q0 THEN value * direction ELSE 0 END) AS ordinary_net, count(*) FILTER (value >= q0) AS large_count, count(*) FILTER (value < q0) AS ordinary_count
FROM t LEFT JOIN q USING (market, dy) GROUP BY ALL)"""
LARGE_ORDINARY_FLOW = f"""WITH {T}, {K}, {LIMITS}, {SPLIT}
SELECT f.market, f.bucket, round(sign(large_net) * ln(1 + abs(large_net)), 7) AS large_flow, round(sign(ordinary_net) * ln(1 + abs(ordinary_net)), 7) AS ordinary_flow,
  large_count, ordinary_count, round(g.price - b.price, 9) AS price_change, f.bucket - b.sec AS base_age
FROM f ASOF LEFT JOIN k b ON b.market = f.market AND f.bucket > b.sec ASOF LEFT JOIN k g ON g.market = f.market AND f.bucket + {HORIZON} >= g.sec"""


def large_ordinary_split(spark: S, d: str) -> DataFrame:
    rows = trades(spark, d)
    at = aggregates.split_flow(rows, windows.past_only_quantiles(rows, [0.9], LEAST_HISTORY))
    return at.select("market", "bucket", F.round("large_net", 6).alias("large_net"), F.round("ordinary_net", 6).alias("ordinary_net"), "large_count", "ordinary_count")


LARGE_ORDINARY_SPLIT = f"WITH {T}, {LIMITS}, {SPLIT} SELECT market, bucket, round(large_net, 6) AS large_net, round(ordinary_net, 6) AS ordinary_net, large_count, ordinary_count FROM f"


def reversal_labels(spark: S, d: str) -> DataFrame:
    """Whether a large trade's price move had turned by a later time; null where a price is missing."""
    ticks_ = temporal.last_per_second(ticks(spark, d))
    at = trades(spark, d).where("value >= 150").select("event_id", "market", "sec", "direction")
    at = temporal.asof(at, ticks_, strict=True, prefix="p0")
    for i, h in ((1, HORIZON), (2, 6 * HORIZON)):
        at = temporal.asof(at.withColumn(f"t{i}", F.col("sec") + h), ticks_, at=f"t{i}", prefix=f"p{i}")
    first, later = (F.col("direction") * (F.col(f"p{i}_price") - F.col("p0_price")) for i in (1, 2))
    at = at.withColumns({"first": first, "later": later}).withColumn("label", m.movement_label(F.col("direction"), F.col("p1_price") - F.col("p0_price")))
    moved = (F.col("first") > 0) & F.col("later").isNotNull()
    return at.select("event_id", "label", F.when(moved, (F.col("later") < F.col("first")).cast("int")).alias("partly"), F.when(moved, (F.col("later") < 0).cast("int")).alias("fully"))


REVERSAL_LABELS = f"""WITH {T}, {K}, j AS (SELECT t.event_id, direction * (a.price - z.price) AS first, direction * (b.price - z.price) AS later FROM t
ASOF LEFT JOIN k z ON z.market = t.market AND t.sec > z.sec ASOF LEFT JOIN k a ON a.market = t.market AND t.sec + {HORIZON} >= a.sec
ASOF LEFT JOIN k b ON b.market = t.market AND t.sec + {6 * HORIZON} >= b.sec WHERE t.value >= 150)
SELECT event_id, CASE WHEN first IS NULL THEN 'unavailable' WHEN first = 0 THEN 'no_movement' WHEN first > 0 THEN 'momentum' ELSE 'contrarian' END AS label,
  CASE WHEN first > 0 AND later IS NOT NULL THEN (later < first)::INT END AS partly, CASE WHEN first > 0 AND later IS NOT NULL THEN (later < 0)::INT END AS fully FROM j"""


def coverage(spark: S, d: str) -> DataFrame:
    """Share of trades with a tick within each tolerance before them."""
    at = temporal.asof(trades(spark, d).select("market", "sec"), temporal.last_per_second(ticks(spark, d)))
    age = F.col("sec") - F.col("asof_sec")
    return at.groupBy("market").agg(F.count("*").alias("n"), *[F.sum(F.when(age <= s, 1).otherwise(0)).alias(f"within_{s}") for s in (600, 3600, 7200)])


COVERAGE = f"""WITH {T}, {K} SELECT t.market, count(*) AS n, {", ".join(f"count(*) FILTER (t.sec - k.sec <= {s}) AS within_{s}" for s in (600, 3600, 7200))}
FROM t ASOF LEFT JOIN k ON k.market = t.market AND t.sec >= k.sec GROUP BY ALL"""

NAMES = (
    "large_ordinary_flow asof_backward_incl asof_backward_strict asof_bounded_age asof_forward asof_forward_bounded follower_window prepost_open_window "
    "first_opposite anti_proximity large_ordinary_split reversal_labels coverage"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
