"""Queries on panels, rollups, windows, ranks and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import windows as win
from ..operators.order_statistics import exact_quantiles
from ..sources.shared import cut
from ..sources.sinks import manifest
from ..sources.tables import table, trades
from .binding import KICKOFF, LEAST_HISTORY, RESOLUTION, A, T

S = SparkSession
GAP = 21_600


def minute_panel(spark: S, d: str) -> DataFrame:
    p = agg.panel(trades(spark, d))
    return p.select("market", "bucket", "n_trades", "n_wallets", *[F.round(c, 6).alias(c) for c in ("gross", "net", "buy_value")])


PANEL = "p AS (SELECT market, sec - sec % 3600 AS bucket, count(*) AS n_trades, count(DISTINCT wallet) AS n_wallets, sum(value) AS gross, sum(value * direction) AS net, sum(CASE WHEN direction > 0 THEN value ELSE 0 END) AS buy_value FROM t GROUP BY ALL)"
MINUTE_PANEL = f"WITH {T}, {PANEL} SELECT market, bucket, n_trades, n_wallets, round(gross, 6) AS gross, round(net, 6) AS net, round(buy_value, 6) AS buy_value FROM p"


def wallet_market_rollup(spark: S, d: str) -> DataFrame:
    buy = F.when(F.col("side") == "BUY", 1).otherwise(0)
    return trades(spark, d).groupBy("wallet", "market").agg(
        F.count("*").alias("n"), F.sum(buy).alias("buys"), F.sum(1 - buy).alias("sells"), F.round(F.sum("value"), 6).alias("volume"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec")
    )


WALLET_MARKET_ROLLUP = f"""WITH {T} SELECT wallet, market, count(*) AS n, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side <> 'BUY') AS sells,
  round(sum(value), 6) AS volume, min(sec) AS first_sec, max(sec) AS last_sec FROM t GROUP BY ALL"""


def wallet_rollup(spark: S, d: str) -> DataFrame:
    by = trades(spark, d).groupBy("wallet", "market").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return by.groupBy("wallet").agg(F.sum("n").alias("n"), F.count("*").alias("markets"), F.round(F.sum("v"), 6).alias("volume"))


WALLET_ROLLUP = f"WITH {T} SELECT wallet, count(*) AS n, count(DISTINCT market) AS markets, round(sum(value), 6) AS volume FROM t GROUP BY ALL"


def scalar_totals(spark: S, d: str) -> DataFrame:
    return trades(spark, d).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("volume"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))


SCALAR_TOTALS = f"WITH {T} SELECT count(*) AS n, round(coalesce(sum(value), 0), 4) AS volume, min(sec) AS first_sec, max(sec) AS last_sec FROM t"


def concentration_hhi(spark: S, d: str) -> DataFrame:
    return agg.concentration(trades(spark, d), ["market", "dy"]).select("market", "dy", *[F.round(c, 9).alias(c) for c in ("top1", "top3", "hhi")])


CONCENTRATION_HHI = f"""WITH {T}, w AS (SELECT market, dy, wallet, sum(value) AS v FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY market, dy ORDER BY v DESC, wallet) AS place FROM w)
SELECT market, dy, round(max(v) / sum(v), 9) AS top1, round(sum(v) FILTER (place <= 3) / sum(v), 9) AS top3, round(sum(v * v) / (sum(v) * sum(v)), 9) AS hhi FROM r GROUP BY ALL"""
CELLS = ["large_heavy", "large_light", "ordinary_heavy", "ordinary_light"]


def two_by_two_pivot(spark: S, d: str) -> DataFrame:
    cell = F.concat(F.when(F.col("value") >= 100, "large").otherwise("ordinary"), F.when(F.col("wallet") % 3 == 0, F.lit("_heavy")).otherwise("_light"))
    p = trades(spark, d).withColumn("cell", cell).groupBy("market", "dy").pivot("cell", CELLS).agg(F.sum("value"))
    return p.select("market", "dy", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in CELLS])


_CELL = "(CASE WHEN value >= 100 THEN 'large' ELSE 'ordinary' END) || (CASE WHEN wallet % 3 = 0 THEN '_heavy' ELSE '_light' END)"
TWO_BY_TWO_PIVOT = f"""WITH {T} SELECT market, dy, {", ".join(f"round(coalesce(sum(value) FILTER ({_CELL} = '{c}'), 0), 6) AS {c}" for c in CELLS)} FROM t GROUP BY ALL"""


def market_quantiles(spark: S, d: str) -> DataFrame:
    rows = trades(spark, d)
    q = rows.groupBy("market").agg(F.percentile("value", F.array(F.lit(0.95), F.lit(0.99))).alias("q"))
    at = rows.join(q, "market")
    return at.groupBy("market").agg(
        F.round(F.max(F.col("q")[0]), 9).alias("p95"), F.round(F.max(F.col("q")[1]), 9).alias("p99"), F.sum(F.when(F.col("value") >= F.col("q")[1], 1).otherwise(0)).alias("n_large"),
        F.sum(F.when(F.col("value") == F.col("q")[1], 1).otherwise(0)).alias("n_ties"), F.round(F.sum(F.when(F.col("value") >= F.col("q")[1], F.col("value"))) / F.sum("value"), 9).alias("share"),
    )


MARKET_QUANTILES = f"""WITH {T}, q AS (SELECT market, quantile_cont(value, 0.95) AS a, quantile_cont(value, 0.99) AS b FROM t GROUP BY market)
SELECT market, round(max(a), 9) AS p95, round(max(b), 9) AS p99, count(*) FILTER (value >= b) AS n_large, count(*) FILTER (value = b) AS n_ties,
  round(sum(value) FILTER (value >= b) / sum(value), 9) AS share FROM t JOIN q USING (market) GROUP BY market"""


def definition_overlap(spark: S, d: str) -> DataFrame:
    """Large by the market's P99 against large by 1 % of the market's volume of the day."""
    rows = trades(spark, d)
    q = rows.groupBy("market").agg(F.percentile("value", F.lit(0.99)).alias("q"))
    v = rows.groupBy("market", "dy").agg(F.sum("value").alias("vol"))
    a, b = F.col("value") >= F.col("q"), F.col("value") >= 0.01 * F.col("vol")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.join(q, "market").join(v, ["market", "dy"]).groupBy("market").agg(one(a & b).alias("both"), one(a & ~b).alias("only_p99"), one(b & ~a).alias("only_volume"))


DEFINITION_OVERLAP = f"""WITH {T}, q AS (SELECT market, quantile_cont(value, 0.99) AS q FROM t GROUP BY market), v AS (SELECT market, dy, sum(value) AS vol FROM t GROUP BY ALL)
SELECT market, count(*) FILTER (value >= q AND value >= 0.01 * vol) AS "both", count(*) FILTER (value >= q AND value < 0.01 * vol) AS only_p99,
  count(*) FILTER (value < q AND value >= 0.01 * vol) AS only_volume FROM t JOIN q USING (market) JOIN v USING (market, dy) GROUP BY ALL"""


def rate_mean(spark: S, d: str) -> DataFrame:
    """Rates per market and day, then their plain mean per day."""
    cells = trades(spark, d).groupBy("market", "dy").agg((F.sum(F.when(F.col("direction") > 0, 1).otherwise(0)) / F.count("*")).alias("rate"))
    return cells.groupBy("dy").agg(F.round(F.avg("rate"), 9).alias("rate"))


RATE_MEAN = f"WITH {T}, c AS (SELECT market, dy, count(*) FILTER (direction > 0) / count(*) AS rate FROM t GROUP BY ALL) SELECT dy, round(avg(rate), 9) AS rate FROM c GROUP BY ALL"


def rate_pooled(spark: S, d: str) -> DataFrame:
    return trades(spark, d).groupBy("dy").agg(F.round(F.sum(F.when(F.col("direction") > 0, 1).otherwise(0)) / F.count("*"), 9).alias("rate"))


RATE_POOLED = f"WITH {T} SELECT dy, round(count(*) FILTER (direction > 0) / count(*), 9) AS rate FROM t GROUP BY ALL"


def descriptive_stats(spark: S, d: str) -> DataFrame:
    out = agg.describe(agg.panel(trades(spark, d)), ["gross", "net", "n_wallets"])
    return out.select("column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "least", "q25", "q50", "q75", "most")])


DESCRIPTIVE_STATS = f"""WITH {T}, {PANEL}, l AS (SELECT 'gross' AS "column", gross AS x FROM p UNION ALL SELECT 'net', net FROM p UNION ALL SELECT 'n_wallets', n_wallets::DOUBLE FROM p)
SELECT "column", count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q25,
  round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS most FROM l GROUP BY ALL"""


MATRIX = ("gross", "net", "buy_value", "n_trades", "n_wallets")
_PAIRS = [(a, b) for i, a in enumerate(MATRIX) for b in MATRIX[i:]]


def correlations(spark: S, d: str) -> DataFrame:
    """The correlation matrix of the panel's columns per market, each pair once, from one aggregation."""
    wide = agg.panel(trades(spark, d)).groupBy("market").agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(_PAIRS)])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 8).alias("r")) for i, (a, b) in enumerate(_PAIRS)]))
    return wide.select("market", cells.alias("c")).select("market", "c.*")


CORRELATIONS = f"WITH {T}, {PANEL} " + " UNION ALL ".join(f"SELECT market, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM p GROUP BY market" for a, b in _PAIRS)


def category_share(spark: S, d: str) -> DataFrame:
    by = table(spark, d, "part").groupBy("p_brand", F.when(F.col("p_size") > 5, F.col("p_size")).alias("size")).agg(F.count("*").alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("p_brand")), 9))


CATEGORY_SHARE = """WITH b AS (SELECT p_brand, CASE WHEN p_size > 5 THEN p_size END AS size, count(*) AS n FROM part GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY p_brand), 9) AS share FROM b"""


def two_sided_wallets(spark: S, d: str) -> DataFrame:
    by = trades(spark, d).groupBy("market", "wallet").agg(F.countDistinct("direction").alias("sides"), F.count("*").alias("n"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return by.groupBy("market").agg(F.count("*").alias("wallets"), one(F.col("sides") == 2).alias("two_sided"), one(F.col("n") > 1).alias("repeated"))


TWO_SIDED_WALLETS = f"""WITH {T}, b AS (SELECT market, wallet, count(DISTINCT direction) AS sides, count(*) AS n FROM t GROUP BY ALL)
SELECT market, count(*) AS wallets, count(*) FILTER (sides = 2) AS two_sided, count(*) FILTER (n > 1) AS repeated FROM b GROUP BY ALL"""


def mode_and_names(spark: S, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.mode("p_size", True).alias("usual_size"), F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("types"))


MODE_AND_NAMES = """WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), u AS (SELECT p_brand, arg_max(p_size, n * 1000000 - p_size) AS usual_size FROM c GROUP BY ALL)
SELECT p_brand, usual_size, types FROM u JOIN (SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ';') AS types FROM part GROUP BY ALL) USING (p_brand)"""


def trailing_30m(spark: S, d: str) -> DataFrame:
    p = agg.panel(trades(spark, d))
    return p.select("market", "bucket", F.round(win.trailing_sum("gross", "market", "bucket", 6 * 3600), 6).alias("trailing"))


TRAILING_30M = f"""WITH {T}, {PANEL} SELECT market, bucket, round(coalesce(sum(gross) OVER (PARTITION BY market ORDER BY bucket RANGE BETWEEN 21600 PRECEDING AND 1 PRECEDING), 0), 6) AS trailing FROM p"""


def _limits(spark: S, d: str, qs: list[float], days: int | None) -> DataFrame:
    out = win.past_only_quantiles(trades(spark, d), qs, LEAST_HISTORY, days)
    return out.select("market", "dy", "history", *[F.round(f"q{i}", 9).alias(f"q{i}") for i in range(len(qs))])


def past_only_p99(spark: S, d: str) -> DataFrame:
    return _limits(spark, d, [0.99], None)


def rolling7_p99(spark: S, d: str) -> DataFrame:
    return _limits(spark, d, [0.99], 7)


QS = [0.95, 0.975, 0.99, 0.995]


def multi_quantile(spark: S, d: str) -> DataFrame:
    return _limits(spark, d, QS, None)


def _limits_sql(qs: list[float], days: int | None) -> str:
    back = "" if days is None else f" AND h.dy >= e.dy - {days}"
    cols = ", ".join(f"CASE WHEN count(h.value) >= {LEAST_HISTORY} THEN round(quantile_cont(h.value, {q}), 9) END AS q{i}" for i, q in enumerate(qs))
    return f"""WITH {T} SELECT e.market, e.dy, count(h.value) AS history, {cols} FROM (SELECT DISTINCT market, dy FROM t) e
LEFT JOIN t h ON h.market = e.market AND h.dy < e.dy{back} GROUP BY ALL"""


PAST_ONLY_P99, ROLLING7_P99, MULTI_QUANTILE = _limits_sql([0.99], None), _limits_sql([0.99], 7), _limits_sql(QS, None)


def top_percent_wallets(spark: S, d: str) -> DataFrame:
    by = trades(spark, d).groupBy("market", "wallet").agg(F.round(F.sum("value"), 6).alias("volume"))
    return win.top_percent(by, 5, "volume", "wallet", ["market"])


TOP_PERCENT_WALLETS = f"""WITH {T}, b AS (SELECT market, wallet, round(sum(value), 6) AS volume FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY volume DESC, wallet) AS place, count(*) OVER (PARTITION BY market) AS n FROM b)
SELECT market, wallet, volume, place::INT AS place FROM r WHERE place <= greatest(1, ceil(n * 5 / 100))"""


def _whales(spark: S, d: str, days: int | None, active: bool = False) -> DataFrame:
    past = win.daily_past_totals(trades(spark, d), days).withColumn("past", F.round("past", 6))
    if active:
        past = past.where("actions >= 5 or active_days >= 3")
    return win.top_percent(past, 5, "past", "wallet", ["dy"]).select("dy", "wallet", "past", "place")


def daily_whales_expanding(spark: S, d: str) -> DataFrame:
    return _whales(spark, d, None)


def daily_whales_rolling(spark: S, d: str) -> DataFrame:
    return _whales(spark, d, 7)


def eligible_high_activity(spark: S, d: str) -> DataFrame:
    return _whales(spark, d, 7, active=True)


def _whales_sql(days: int | None, having: str = "") -> str:
    spread = f"unnest(range(dy + 1, dy + {days} + 1))" if days else "unnest(range(dy + 1, (SELECT max(dy) FROM t) + 1))"
    return f"""WITH {T}, w AS (SELECT wallet, dy, sum(value) AS v, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT wallet, v, n, {spread} AS later FROM w),
p AS (SELECT wallet, later AS dy, round(sum(v), 6) AS past FROM s GROUP BY ALL {having}),
r AS (SELECT *, row_number() OVER (PARTITION BY dy ORDER BY past DESC, wallet) AS place, count(*) OVER (PARTITION BY dy) AS m FROM p)
SELECT dy, wallet, past, place::INT AS place FROM r WHERE place <= greatest(1, ceil(m * 5 / 100))"""


DAILY_WHALES_EXPANDING, DAILY_WHALES_ROLLING = _whales_sql(None), _whales_sql(7)
ELIGIBLE_HIGH_ACTIVITY = _whales_sql(7, "HAVING sum(n) >= 5 OR count(*) >= 3")


def wallet_actions(spark: S, d: str) -> DataFrame:
    return agg.actions(trades(spark, d)).select("market", "wallet", "action", "sec", F.round("net", 6).alias("net"), F.round("price", 8).alias("price"), "n_trades", "direction")


WALLET_ACTIONS = f"WITH {T}, {A} SELECT market, wallet, action, sec, round(net, 6) AS net, round(price, 8) AS price, n_trades, direction FROM a"


def lead_next_action(spark: S, d: str) -> DataFrame:
    w = Window.partitionBy("market", "wallet").orderBy("sec", "action")
    at = agg.actions(trades(spark, d))
    return at.select("market", "action", (F.lead("sec").over(w) - F.col("sec")).alias("gap"), F.lead("direction").over(w).alias("next_direction"))


LEAD_NEXT_ACTION = f"""WITH {T}, {A} SELECT market, action, lead(sec) OVER w - sec AS gap, lead(direction) OVER w AS next_direction FROM a WINDOW w AS (PARTITION BY market, wallet ORDER BY sec, action)"""


def next_opposite(spark: S, d: str) -> DataFrame:
    at = win.next_opposite(agg.actions(trades(spark, d)), ["market", "wallet"], ["sec", "action"], "direction", "sec")
    return at.select("market", "action", (F.col("next_opposite_sec") - F.col("sec")).alias("gap"))


NEXT_OPPOSITE = f"""WITH {T}, {A} SELECT a.market, a.action, min(b.sec) - a.sec AS gap FROM a LEFT JOIN a b ON a.market = b.market AND a.wallet = b.wallet AND a.direction = -b.direction
  AND (b.sec > a.sec OR b.sec = a.sec AND b.action > a.action) GROUP BY a.market, a.action, a.sec"""


def sequences_60s(spark: S, d: str) -> DataFrame:
    at = win.sequences(agg.actions(trades(spark, d)), ["market", "wallet"], ["sec", "action"], "direction", "sec", 8 * GAP)
    return at.groupBy("market", "wallet", "sequence").agg(F.min("sec").alias("begin"), F.count("*").alias("n_actions"), F.round(F.sum("gross"), 6).alias("gross"), F.min("direction").alias("direction"))


SEQUENCES_60S = f"""WITH {T}, {A}, f AS (SELECT *, CASE WHEN lag(sec) OVER w IS NULL OR lag(direction) OVER w <> direction OR sec - lag(sec) OVER w > {8 * GAP} THEN 1 ELSE 0 END AS starts
FROM a WINDOW w AS (PARTITION BY market, wallet ORDER BY sec, action)), s AS (SELECT *, (sum(starts) OVER (PARTITION BY market, wallet ORDER BY sec, action))::BIGINT AS sequence FROM f)
SELECT market, wallet, sequence, min(sec) AS begin, count(*) AS n_actions, round(sum(gross), 6) AS gross, min(direction) AS direction FROM s GROUP BY ALL"""


def zscore_daily(spark: S, d: str) -> DataFrame:
    past = win.daily_past_totals(trades(spark, d), None).withColumn("x", F.log1p("past"))
    w = Window.partitionBy("dy")
    return past.select("dy", "wallet", F.round((F.col("x") - F.avg("x").over(w)) / F.nullif(F.stddev_pop("x").over(w), F.lit(0.0)), 6).alias("z"))


ZSCORE_DAILY = f"""WITH {T}, w AS (SELECT wallet, dy, sum(value) AS v FROM t GROUP BY ALL), s AS (SELECT wallet, v, unnest(range(dy + 1, (SELECT max(dy) FROM t) + 1)) AS later FROM w),
p AS (SELECT wallet, later AS dy, ln(1 + sum(v)) AS x FROM s GROUP BY ALL)
SELECT dy, wallet, round((x - avg(x) OVER d) / nullif(stddev_pop(x) OVER d, 0), 6) AS z FROM p WINDOW d AS (PARTITION BY dy)"""


def family_rank(spark: S, d: str) -> DataFrame:
    p = agg.panel(trades(spark, d)).withColumn("gross", F.round("gross", 6))
    w = Window.partitionBy("market").orderBy("gross")
    return p.select("market", "bucket", F.rank().over(w).alias("place"), F.round(F.cume_dist().over(w), 9).alias("percent_rank"))


FAMILY_RANK = f"""WITH {T}, {PANEL}, g AS (SELECT market, bucket, round(gross, 6) AS gross FROM p)
SELECT market, bucket, (rank() OVER w)::INT AS place, round(cume_dist() OVER w, 9) AS percent_rank FROM g WINDOW w AS (PARTITION BY market ORDER BY gross)"""


def non_overlapping(spark: S, d: str) -> DataFrame:
    """Large trades thinned so that each comes at least a day after the last one kept."""
    return win.thinned(trades(spark, d).where("value >= 150").select("market", "sec", "event_id"), ["market"], "sec", 86_400)


NON_OVERLAPPING = f"""WITH RECURSIVE {T}, l AS (SELECT market, sec, event_id FROM t WHERE value >= 150),
r(market, sec) AS (SELECT market, min(sec) FROM l GROUP BY market UNION ALL
  SELECT market, s FROM (SELECT r.market, (SELECT min(l.sec) FROM l WHERE l.market = r.market AND l.sec >= r.sec + 86400) AS s FROM r) WHERE s IS NOT NULL)
SELECT market, sec, event_id FROM l WHERE (market, sec) IN (SELECT (market, sec) FROM r)"""


def complete_case(spark: S, d: str) -> DataFrame:
    """How many rows lack each field, alone and in sequence."""
    at = table(spark, d, "part").select("p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).alias("a"), F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice")).alias("b"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a, b = F.col("a").isNull(), F.col("b").isNull()
    return at.groupBy("p_brand").agg(one(a).alias("a_missing"), one(b).alias("b_missing"), one(~a & b).alias("b_missing_next"), one(~a & ~b).alias("complete"))


COMPLETE_CASE = """SELECT p_brand, count(*) FILTER (a IS NULL) AS a_missing, count(*) FILTER (b IS NULL) AS b_missing, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS b_missing_next,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS complete
FROM (SELECT p_brand, CASE WHEN p_size > 10 THEN p_size END AS a, CASE WHEN p_retailprice > 1000 THEN p_retailprice END AS b FROM part) GROUP BY ALL"""


def case_topk_union(spark: S, d: str) -> DataFrame:
    """Top 10 by gross, top 10 by size of net, and rows in both, each with its reasons."""
    p = agg.panel(trades(spark, d)).select("market", "bucket", F.round("gross", 6).alias("gross"), F.round(F.abs("net"), 6).alias("net"))
    top = lambda c: p.withColumn("_r", F.row_number().over(Window.partitionBy("market").orderBy(F.desc(c), "bucket"))).where("_r <= 10").select("market", "bucket", F.lit(c).alias("reason"))
    return top("gross").unionByName(top("net")).groupBy("market", "bucket").agg(F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reasons"))


CASE_TOPK_UNION = f"""WITH {T}, {PANEL}, g AS (SELECT market, bucket, round(gross, 6) AS gross, round(abs(net), 6) AS net FROM p),
u AS (SELECT market, bucket, 'gross' AS reason FROM g QUALIFY row_number() OVER (PARTITION BY market ORDER BY gross DESC, bucket) <= 10
UNION ALL SELECT market, bucket, 'net' FROM g QUALIFY row_number() OVER (PARTITION BY market ORDER BY net DESC, bucket) <= 10)
SELECT market, bucket, array_to_string(list_sort(list(DISTINCT reason)), '+') AS reasons FROM u GROUP BY ALL"""


def winsorised(spark: S, d: str) -> DataFrame:
    p = cut(agg.panel(trades(spark, d)))  # read for the bounds and for the rows
    bounds = exact_quantiles(p, "net", [0.005, 0.995]).select("q0", "q1")
    return p.join(F.broadcast(bounds)).select("market", "bucket", F.round(F.greatest("q0", F.least("q1", "net")) / 1000, 9).alias("net"))  # one row of bounds


WINSORISED = f"""WITH {T}, {PANEL}, q AS (SELECT quantile_cont(net, 0.005) AS a, quantile_cont(net, 0.995) AS b FROM p)
SELECT market, bucket, round(greatest(a, least(b, net)) / 1000, 9) AS net FROM p, q"""


#: Markets that must trade in an hour.
SUPPORT = (2, 4, 5)


def cell_support(spark: S, d: str) -> DataFrame:
    """For each least number of markets the hours in which so many trade: rows of every market's hour, and whether its direction varies."""
    at = agg.with_bucket(trades(spark, d)).groupBy("bucket", "market").agg(F.count("*").alias("n"), (F.min("direction") != F.max("direction")).alias("varies"))
    hours = at.groupBy("bucket").agg(F.count("market").alias("markets"))
    least = F.explode(F.filter(F.array(*map(F.lit, SUPPORT)), lambda k: k <= F.col("markets")))
    return at.join(hours.select("bucket", least.alias("least")), "bucket").select("least", "bucket", "market", "n", "varies")


CELL_SUPPORT = f"""WITH {T}, c AS (SELECT sec - sec % 3600 AS bucket, market, count(*) AS n, min(direction) <> max(direction) AS varies FROM t GROUP BY ALL),
h AS (SELECT bucket, count(market) AS markets FROM c GROUP BY ALL)
SELECT least, bucket, market, n, varies FROM c JOIN h USING (bucket) JOIN (VALUES {", ".join(f"({k}::INT)" for k in SUPPORT)}) l(least) ON markets >= least"""


def reconcile_counts(spark: S, d: str) -> DataFrame:
    """Orders whose lines do not add up to the order's own total."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total")).withColumnRenamed("l_orderkey", "o_orderkey")
    own = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"))
    return agg.reconcile(own, lines, ["o_orderkey"], "total", 1.0)


RECONCILE_COUNTS = """WITH l AS (SELECT l_orderkey AS o_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL)
SELECT o_orderkey, o.o_totalprice AS left_value, l.total AS right_value FROM orders o FULL JOIN l USING (o_orderkey)
WHERE o.o_totalprice IS NULL OR l.total IS NULL OR abs(o.o_totalprice - l.total) > 1.0"""


def reconcile_flows(spark: S, d: str) -> DataFrame:
    """Sum over wallets against sum over markets and hours; empty if both agree."""
    rows = trades(spark, d)
    a = agg.panel(rows).groupBy("market").agg(F.sum("gross").alias("gross"))
    b = rows.groupBy("market", "wallet").agg(F.sum("value").alias("v")).groupBy("market").agg(F.sum("v").alias("gross"))
    return agg.reconcile(a, b, ["market"], "gross", 1e-5)


RECONCILE_FLOWS = "SELECT '' AS market, 0.0::DOUBLE AS left_value, 0.0::DOUBLE AS right_value WHERE false"


def key_manifest(spark: S, d: str) -> DataFrame:
    """Rows and bounds per market; the fingerprints are compared with themselves after a reshuffle."""
    rows = trades(spark, d)
    a = manifest(rows, "sec", "market")
    b = manifest(rows.repartition(7, "wallet"), "sec", "market").select("market", F.col("fingerprint").alias("again"))
    return a.join(b, "market").select("market", "n_rows", "first_sec", "last_sec", (F.col("fingerprint") == F.col("again")).alias("stable"))


KEY_MANIFEST = f"WITH {T} SELECT market, count(*) AS n_rows, min(sec) AS first_sec, max(sec) AS last_sec, true AS stable FROM t GROUP BY ALL"


def domain_checks(spark: S, d: str) -> DataFrame:
    """Violations per rule."""
    rules = {"price_range": "price < 0 or price > 1", "size": "value <= 0", "after_resolution": f"sec >= {RESOLUTION}", "at_kickoff": f"sec = {KICKOFF}"}
    found = trades(spark, d).select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.expr(r).cast("int").alias("bad")) for n, r in rules.items()])).alias("c"))
    return found.groupBy("c.rule").agg(F.sum("c.bad").alias("violations"))


DOMAIN_CHECKS = f"""WITH {T} SELECT 'price_range' AS rule, count(*) FILTER (price < 0 OR price > 1) AS violations FROM t UNION ALL SELECT 'size', count(*) FILTER (value <= 0) FROM t
UNION ALL SELECT 'after_resolution', count(*) FILTER (sec >= {RESOLUTION}) FROM t UNION ALL SELECT 'at_kickoff', count(*) FILTER (sec = {KICKOFF}) FROM t"""

NAMES = (
    "minute_panel wallet_market_rollup wallet_rollup scalar_totals concentration_hhi two_by_two_pivot market_quantiles definition_overlap rate_mean rate_pooled descriptive_stats correlations "
    "category_share two_sided_wallets mode_and_names trailing_30m past_only_p99 rolling7_p99 multi_quantile top_percent_wallets daily_whales_expanding daily_whales_rolling "
    "eligible_high_activity wallet_actions lead_next_action next_opposite sequences_60s zscore_daily family_rank non_overlapping complete_case case_topk_union winsorised cell_support "
    "reconcile_counts reconcile_flows key_manifest domain_checks"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
