"""Queries on projection, filters, dedupe and plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market as m
from ..operators import dedupe
from ..sources.tables import table, ticks, trades
from .binding import HORIZON, KICKOFF, RESOLUTION, T

S = SparkSession


def trade_normalize(spark: S, d: str) -> DataFrame:
    return trades(spark, d).select(
        "event_id", "market", "wallet", "sec", "side", "outcome", "direction", F.round(m.yes_price("price", "outcome"), 9).alias("yes_price"),
        F.round(F.col("value") * F.col("direction"), 6).alias("signed_value"),
    )


TRADE_NORMALIZE = f"""WITH {T} SELECT event_id, market, wallet, sec, side, outcome, direction,
  round(CASE WHEN outcome = 'YES' THEN price ELSE 1 - price END, 9) AS yes_price, round(value * direction, 6) AS signed_value FROM t"""


def phase_label(spark: S, d: str) -> DataFrame:
    at = trades(spark, d).withColumn("phase", m.phase(F.col("sec"), KICKOFF, RESOLUTION))
    return at.groupBy("market", "phase").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("gross"))


PHASE = f"CASE WHEN sec >= {RESOLUTION} THEN 'resolved' WHEN sec < {KICKOFF} THEN 'prematch' ELSE 'inplay' END"
PHASE_LABEL = f"WITH {T} SELECT market, {PHASE} AS phase, count(*) AS n, round(sum(value), 4) AS gross FROM t GROUP BY ALL"


def price_decile(spark: S, d: str) -> DataFrame:
    return trades(spark, d).groupBy("market", m.price_decile(F.col("price")).alias("decile")).agg(F.count("*").alias("n"))


PRICE_DECILE = f"WITH {T} SELECT market, least(9, greatest(0, floor(price * 10)))::INT AS decile, count(*) AS n FROM t GROUP BY ALL"
BANDS = [86_400, 3 * 86_400, 7 * 86_400, 14 * 86_400]


def time_band(spark: S, d: str) -> DataFrame:
    before = trades(spark, d).where(F.col("sec") < KICKOFF)
    return before.groupBy(m.time_band(KICKOFF - F.col("sec"), BANDS).alias("band"), "market").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


TIME_BAND = f"""WITH {T} SELECT CASE {" ".join(f"WHEN {KICKOFF} - sec <= {e} THEN {i}" for i, e in enumerate(BANDS))} ELSE {len(BANDS)} END AS band, market,
  count(*) AS n, round(avg(value), 6) AS mean_value FROM t WHERE sec < {KICKOFF} GROUP BY ALL"""


def signed_log_flow(spark: S, d: str) -> DataFrame:
    net = trades(spark, d).groupBy("market", F.expr("sec - sec % 3600").alias("bucket")).agg(F.sum(F.col("value") * F.col("direction")).alias("net"))
    return net.select("market", "bucket", F.round(m.signed_log(F.col("net")), 7).alias("flow"))


SIGNED_LOG_FLOW = f"""WITH {T}, n AS (SELECT market, sec - sec % 3600 AS bucket, sum(value * direction) AS net FROM t GROUP BY ALL)
SELECT market, bucket, round(sign(net) * ln(1 + abs(net)), 7) AS flow FROM n"""


def brier_improvement(spark: S, d: str) -> DataFrame:
    won = F.when(F.col("wallet") % 2 == 0, 1.0).otherwise(0.0)
    gain = m.brier_improvement(F.col("price"), F.least(F.lit(1.0), F.col("price") + 0.1), won)
    return trades(spark, d).groupBy("market", "dy").agg(F.round(F.avg(gain), 6).alias("gain"), F.count("*").alias("n"))


BRIER_IMPROVEMENT = f"""WITH {T}, w AS (SELECT market, dy, price AS p, least(1.0, price + 0.1) AS q, CASE WHEN wallet % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS o FROM t)
SELECT market, dy, round(avg((p - o) * (p - o) - (q - o) * (q - o)), 6) AS gain, count(*) AS n FROM w GROUP BY ALL"""


def json_field(spark: S, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("most"), F.count("k").alias("n"))


JSON_FIELD = """SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, max(json_extract(props, '$.k')::BIGINT) AS most,
  count(json_extract(props, '$.k')) AS n FROM events GROUP BY event_type"""
CLASSES = [("metal", "(?i)steel|copper|brass|nickel|tin"), ("coat", "(?i)polished|plated|anodized|burnished|brushed")]


def market_regex_class(spark: S, d: str) -> DataFrame:
    kind = F.lit("other")
    for name, pattern in reversed(CLASSES):
        kind = F.when(F.col("p_type").rlike(pattern), name).otherwise(kind)
    return table(spark, d, "part").groupBy(kind.alias("kind"), "p_brand").agg(F.count("*").alias("n"))


MARKET_REGEX_CLASS = f"""SELECT CASE {" ".join(f"WHEN regexp_matches(p_type, '{p}') THEN '{n}'" for n, p in CLASSES)} ELSE 'other' END AS kind, p_brand, count(*) AS n
FROM part GROUP BY ALL"""


def canonical_bool(spark: S, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(m.tri_state(F.col("o_orderstatus"), ["f"], ["o"]).alias("done")).agg(F.count("*").alias("n"))


CANONICAL_BOOL = "SELECT CASE lower(trim(o_orderstatus)) WHEN 'f' THEN true WHEN 'o' THEN false END AS done, count(*) AS n FROM orders GROUP BY ALL"
RULES = [("resolved", f"sec < {RESOLUTION}"), ("in_play", f"sec < {KICKOFF}"), ("small", "value >= 25"), ("extreme_price", "price BETWEEN 0.1 AND 0.9")]


def exclusion_flow(spark: S, d: str) -> DataFrame:
    reason = m.first_failing([(name, F.expr(rule)) for name, rule in RULES])
    return trades(spark, d).groupBy("market", F.coalesce(reason, F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))


EXCLUSION_FLOW = f"""WITH {T} SELECT market, CASE {" ".join(f"WHEN NOT ({r}) THEN '{n}'" for n, r in RULES)} ELSE 'included' END AS reason, count(*) AS n FROM t GROUP BY ALL"""


def exact_object_dedupe(spark: S, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id").withColumn("page", F.lit(0))
    twice = rows.unionByName(rows.where("event_id % 5 = 0").withColumn("page", F.lit(1)))
    return dedupe.exact_objects(twice, ["page", "event_id"]).groupBy("event_type", "page").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


EXACT_OBJECT_DEDUPE = """WITH r AS (SELECT user_id, event_type, value, ts, event_id, 0 AS page FROM events UNION ALL SELECT user_id, event_type, value, ts, event_id, 1 FROM events WHERE event_id % 5 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, value, ts ORDER BY page, event_id) AS place FROM r)
SELECT event_type, page, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM f WHERE place = 1 GROUP BY ALL"""


def last_tick_wins(spark: S, d: str) -> DataFrame:
    rows = ticks(spark, d).withColumn("sec", F.expr("sec - sec % 3600"))
    return dedupe.last_wins(rows, ["market", "sec"], "source_row").select("market", "sec", F.round("price", 9).alias("price"), "source_row")


LAST_TICK_WINS = """WITH r AS (SELECT event_type AS market, (floor(epoch(ts))::BIGINT // 3600) * 3600 AS sec, value / 500 AS price, event_id AS source_row FROM events)
SELECT market, sec, round(arg_max(price, source_row), 9) AS price, max(source_row) AS source_row FROM r GROUP BY ALL"""


def duplicate_keys(spark: S, d: str) -> DataFrame:
    return dedupe.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATE_KEYS = "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def dim_enrich(spark: S, d: str) -> DataFrame:
    """Facts with their dimensions; Spark broadcasts a dimension while its size is below the threshold."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    at = orders.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "left")
    at = at.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey")), "c_nationkey", "left")
    at = at.join(table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey", "left")
    return at.groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


DIM_ENRICH = """SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""


def semi_required(spark: S, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


SEMI_REQUIRED = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY ALL"


def anti_missing(spark: S, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


ANTI_MISSING = "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL"


def full_outer_specs(spark: S, d: str) -> DataFrame:
    at = trades(spark, d).withColumn("bucket", F.expr("sec - sec % 3600"))
    a = at.where("value >= 100").groupBy("market", "bucket").agg(F.count("*").alias("n_large"))
    b = at.where("value < 50").groupBy("market", "bucket").agg(F.count("*").alias("n_small"))
    return a.join(b, ["market", "bucket"], "full")


FULL_OUTER_SPECS = f"""WITH {T}, b AS (SELECT *, sec - sec % 3600 AS bucket FROM t)
SELECT market, bucket, n_large, n_small FROM (SELECT market, bucket, count(*) AS n_large FROM b WHERE value >= 100 GROUP BY ALL)
FULL JOIN (SELECT market, bucket, count(*) AS n_small FROM b WHERE value < 50 GROUP BY ALL) USING (market, bucket)"""


def key_intersection(spark: S, d: str) -> DataFrame:
    day = lambda cond: trades(spark, d).where(cond).select("wallet", "dy").distinct()
    both = day("price < 0.3").join(day("price > 0.6"), ["wallet", "dy"]).join(day("direction = 1"), ["wallet", "dy"])
    return both.groupBy("dy").agg(F.count("*").alias("n_wallets"))


KEY_INTERSECTION = f"""WITH {T} SELECT dy, count(*) AS n_wallets FROM (SELECT wallet, dy FROM t WHERE price < 0.3 INTERSECT SELECT wallet, dy FROM t WHERE price > 0.6
INTERSECT SELECT wallet, dy FROM t WHERE direction = 1) GROUP BY ALL"""


def membership_by_day(spark: S, d: str) -> DataFrame:
    rows = trades(spark, d)
    busy = rows.groupBy("wallet", "dy").agg(F.sum("value").alias("v")).where("v >= 150").select("wallet", (F.col("dy") + 1).alias("dy"), F.lit(1).alias("_in"))
    member = F.col("_in").isNotNull()
    return rows.join(busy, ["wallet", "dy"], "left").groupBy("market", "dy").agg(
        F.sum(F.when(member, 1).otherwise(0)).alias("n_member"), F.round(F.sum(F.when(member, F.col("value")).otherwise(0.0)), 4).alias("member_value")
    )


MEMBERSHIP_BY_DAY = f"""WITH {T}, b AS (SELECT wallet, dy + 1 AS dy, 1 AS is_in FROM t GROUP BY wallet, dy HAVING sum(value) >= 150)
SELECT market, dy, count(is_in)::BIGINT AS n_member, round(sum(CASE WHEN is_in = 1 THEN value ELSE 0 END), 4) AS member_value FROM t LEFT JOIN b USING (wallet, dy) GROUP BY ALL"""


def nonoverlap_grid(spark: S, d: str) -> DataFrame:
    return trades(spark, d).withColumn("bucket", F.expr("sec - sec % 3600")).where(F.pmod("bucket", F.lit(3 * HORIZON)) == 0).groupBy("market", "bucket").agg(F.count("*").alias("n"))


NONOVERLAP_GRID = f"WITH {T} SELECT market, sec - sec % 3600 AS bucket, count(*) AS n FROM t WHERE (sec - sec % 3600) % {3 * HORIZON} = 0 GROUP BY ALL"


def union_phase(spark: S, d: str) -> DataFrame:
    rows = trades(spark, d)
    pre = rows.where(F.col("sec") < KICKOFF).withColumn("post", F.lit(0))
    post = rows.where((F.col("sec") >= KICKOFF) & (F.col("sec") < RESOLUTION)).withColumn("post", F.lit(1))
    at = pre.unionByName(post)
    flow = F.col("value") * F.col("direction")
    return at.groupBy("post", "market").agg(F.count("*").alias("n"), F.round(F.sum(flow), 4).alias("net"), F.round(F.sum(flow * F.col("post")), 4).alias("net_post"))


UNION_PHASE = f"""WITH {T} SELECT (sec >= {KICKOFF})::INT AS post, market, count(*) AS n, round(sum(value * direction), 4) AS net,
  round(sum(value * direction * (sec >= {KICKOFF})::INT), 4) AS net_post FROM t WHERE sec < {RESOLUTION} GROUP BY ALL"""


def jaccard_sets(spark: S, d: str) -> DataFrame:
    by = trades(spark, d).groupBy("dy", "wallet").agg((F.max("value") >= 150).alias("a"), (F.count(F.lit(1)) >= 2).alias("b"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return by.groupBy("dy").agg(one(F.col("a") & F.col("b")).alias("both"), one(F.col("a") | F.col("b")).alias("either")).withColumn("jaccard", F.round(F.col("both") / F.nullif("either", F.lit(0)), 9))


JACCARD_SETS = f"""WITH {T}, b AS (SELECT dy, wallet, max(value) >= 150 AS a, count(*) >= 2 AS b FROM t GROUP BY ALL), c AS (
SELECT dy, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a OR b) AS either FROM b GROUP BY ALL)
SELECT dy, "both", either, round("both" / nullif(either, 0), 9) AS jaccard FROM c"""


def team_pairs(spark: S, d: str) -> DataFrame:
    """Entity resolution: pairs of names in any order and spelling of blanks, with the preferred record."""
    from pyspark.sql import Window

    a = table(spark, d, "nation").select(F.col("n_name").alias("x"), F.col("n_regionkey").alias("g"))
    b = a.select(F.col("x").alias("y"), "g")
    pairs = a.join(b, "g").where("x <> y").select("g", m.unordered_pair(F.concat(F.lit("  "), "x"), F.col("y")).alias("pair"), "x")
    w = Window.partitionBy("pair").orderBy("x")
    return pairs.withColumn("place", F.row_number().over(w)).where("place = 1").select("g", "pair", "x")


TEAM_PAIRS = """SELECT a.n_regionkey AS g, lower(least(a.n_name, b.n_name)) || '|' || lower(greatest(a.n_name, b.n_name)) AS pair, min(a.n_name) AS x
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name GROUP BY ALL"""

NAMES = (
    "trade_normalize phase_label price_decile time_band signed_log_flow brier_improvement json_field market_regex_class canonical_bool exclusion_flow "
    "exact_object_dedupe last_tick_wins duplicate_keys dim_enrich semi_required anti_missing full_outer_specs key_intersection membership_by_day "
    "nonoverlap_grid union_phase jaccard_sets team_pairs"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
