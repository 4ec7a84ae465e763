"""Queries on threshold panels, behavioural samples, audits and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import market as m
from ..operators import aggregates as agg
from ..operators import checks, temporal, windows
from ..sources.sinks import manifest
from ..sources.tables import table, ticks, trades
from .binding import HORIZON, KICKOFF, LEAST_HISTORY, RESOLUTION, K, T
from .panels import PANEL

S = SparkSession


def two_threshold_panel(spark: S, d: str) -> DataFrame:
    """Counts, wallets, gross and net of large and ordinary trades under past-only P99 and P95 limits."""
    rows = trades(spark, d)
    limits = windows.past_only_quantiles(rows, [0.99, 0.95], LEAST_HISTORY)
    return agg.threshold_panel(rows, limits, {"p99": "q0", "p95": "q1"}).select(
        "market", "bucket", *[c for t in ("p99", "p95") for k in ("large", "ordinary") for c in (f"{t}_{k}_count", f"{t}_{k}_wallets", *[F.round(f"{t}_{k}_{v}", 6).alias(f"{t}_{k}_{v}") for v in ("gross", "net")])]
    )


def _threshold_sql() -> str:
    parts = []
    for t, q in (("p99", "q0"), ("p95", "q1")):
        for k, op in (("large", ">="), ("ordinary", "<")):
            at = f"FILTER (value {op} {q})"
            parts.append(
                f"count(*) {at} AS {t}_{k}_count, count(DISTINCT wallet) {at} AS {t}_{k}_wallets, round(coalesce(sum(value) {at}, 0), 6) AS {t}_{k}_gross, round(coalesce(sum(value * direction) {at}, 0), 6) AS {t}_{k}_net"
            )
    return ", ".join(parts)


TWO_THRESHOLD_PANEL = f"""WITH {T}, q AS (SELECT e.market, e.dy, CASE WHEN count(h.value) >= {LEAST_HISTORY} THEN quantile_cont(h.value, 0.99) END AS q0,
  CASE WHEN count(h.value) >= {LEAST_HISTORY} THEN quantile_cont(h.value, 0.95) END AS q1
FROM (SELECT DISTINCT market, dy FROM t) e LEFT JOIN t h ON h.market = e.market AND h.dy < e.dy GROUP BY ALL)
SELECT t.market, sec - sec % 3600 AS bucket, {_threshold_sql()} FROM t LEFT JOIN q USING (market, dy) GROUP BY ALL"""


def executed_price_asof(spark: S, d: str) -> DataFrame:
    """Executed prices around each active hour: the last trade before it and the first from its end on."""
    rows = trades(spark, d)
    hours = agg.panel(rows).select("market", "bucket", (F.col("bucket") + 3600).alias("finish"))
    last = rows.groupBy("market", "sec").agg(F.max_by("price", "event_id").alias("price"))
    first = rows.groupBy("market", "sec").agg(F.min_by("price", "event_id").alias("price"))
    at = temporal.asof(hours, last, at="bucket", strict=True, prefix="before")
    at = temporal.asof(at, first, at="finish", forward=True, prefix="after")
    return at.select("market", "bucket", "before_sec", F.round("before_price", 9).alias("before_price"), "after_sec", F.round("after_price", 9).alias("after_price"))


EXECUTED_PRICE_ASOF = f"""WITH {T}, {PANEL}, l AS (SELECT market, sec, arg_max(price, event_id) AS price FROM t GROUP BY ALL), f AS (SELECT market, sec, arg_min(price, event_id) AS price FROM t GROUP BY ALL)
SELECT p.market, p.bucket, l.sec AS before_sec, round(l.price, 9) AS before_price, f.sec AS after_sec, round(f.price, 9) AS after_price
FROM p ASOF LEFT JOIN l ON l.market = p.market AND p.bucket > l.sec ASOF LEFT JOIN f ON f.market = p.market AND p.bucket + 3600 <= f.sec"""
TOLERANCES = (600, 3_600, 7_200)


def boundary_flags(spark: S, d: str) -> DataFrame:
    """Whether an hour's window from its end to the target crosses kickoff or resolution, and how old its baseline price is."""
    hours = agg.panel(trades(spark, d)).select("market", "bucket")
    at = temporal.asof(hours, temporal.last_per_second(ticks(spark, d)), at="bucket", strict=True)
    end, target = F.col("bucket") + 3600, F.col("bucket") + 3600 + 24 * HORIZON
    crosses = {f"crosses_{n}": (end <= k) & (target > k) for n, k in (("kickoff", KICKOFF), ("resolution", RESOLUTION))}
    near = {f"base_within_{s}": F.coalesce(F.col("bucket") - F.col("asof_sec") <= s, F.lit(False)) for s in TOLERANCES}
    return at.select("market", "bucket", *[c.alias(n) for n, c in (crosses | near).items()])


BOUNDARY_FLAGS = f"""WITH {T}, {K}, {PANEL} SELECT p.market, p.bucket, p.bucket + 3600 <= {KICKOFF} AND p.bucket + {3600 + 24 * HORIZON} > {KICKOFF} AS crosses_kickoff,
  p.bucket + 3600 <= {RESOLUTION} AND p.bucket + {3600 + 24 * HORIZON} > {RESOLUTION} AS crosses_resolution,
  {", ".join(f"coalesce(p.bucket - k.sec <= {s}, false) AS base_within_{s}" for s in TOLERANCES)} FROM p ASOF LEFT JOIN k ON k.market = p.market AND p.bucket > k.sec"""


def z_weighted_flow(spark: S, d: str) -> DataFrame:
    """Flow per market and hour, weighted by how far a wallet's log volume of earlier days is from that of all wallets known by then.

    Large and ordinary trades apart; trades of wallets without earlier volume have no weight and are counted.
    """
    rows = trades(spark, d)
    past = windows.daily_past_totals(rows, None).select("dy", "wallet", F.log1p("past").alias("v"))
    spread = past.groupBy("dy").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    z = past.join(F.broadcast(spread), "dy").select("dy", "wallet", ((F.col("v") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("z"))  # one row per day
    at = agg.with_bucket(rows).join(z, ["dy", "wallet"], "left")
    sums = []
    for name, kind in (("large", F.col("value") >= 150), ("ordinary", F.col("value") < 150)):
        pick = lambda x: F.round(F.coalesce(F.sum(F.when(kind, F.col("z") * x)), F.lit(0.0)), 5)  # noqa: B023, E731
        sums += [pick(F.col("value")).alias(f"{name}_z_gross"), pick(F.col("value") * F.col("direction")).alias(f"{name}_z_net")]
    return at.groupBy("market", "bucket").agg(*sums, F.sum(F.when(F.col("z").isNull(), 1).otherwise(0)).alias("unscored"))


Z_WEIGHTED_FLOW = f"""WITH {T}, w AS (SELECT wallet, dy, sum(value) AS v FROM t GROUP BY ALL), s AS (SELECT wallet, v, unnest(range(dy + 1, (SELECT max(dy) FROM t) + 1)) AS later FROM w),
p AS (SELECT wallet, later AS dy, ln(1 + sum(v)) AS v FROM s GROUP BY ALL),
z AS (SELECT dy, wallet, (v - avg(v) OVER d) / nullif(stddev_pop(v) OVER d, 0) AS z FROM p WINDOW d AS (PARTITION BY dy))
SELECT market, sec - sec % 3600 AS bucket, """ + ", ".join(
    f"round(coalesce(sum(z * {x}) FILTER (value {op} 150), 0), 5) AS {n}_z_{k}" for n, op in (("large", ">="), ("ordinary", "<")) for k, x in (("gross", "value"), ("net", "value * direction"))
) + " , count(*) FILTER (z IS NULL) AS unscored FROM t LEFT JOIN z USING (dy, wallet) GROUP BY ALL"


def median_split(spark: S, d: str) -> DataFrame:
    """Wallets above the median volume of their market, and what they trade."""
    by = trades(spark, d).groupBy("market", "wallet").agg(F.sum("value").alias("volume"))
    middle = by.groupBy("market").agg(F.percentile("volume", F.lit(0.5)).alias("middle"))
    return by.join(middle, "market").groupBy("market", (F.col("volume") > F.col("middle")).alias("above")).agg(F.count("*").alias("wallets"), F.round(F.sum("volume"), 4).alias("volume"))


MEDIAN_SPLIT = f"""WITH {T}, b AS (SELECT market, wallet, sum(value) AS volume FROM t GROUP BY ALL), q AS (SELECT market, quantile_cont(volume, 0.5) AS middle FROM b GROUP BY ALL)
SELECT market, volume > middle AS above, count(*) AS wallets, round(sum(volume), 4) AS volume FROM b JOIN q USING (market) GROUP BY ALL"""


def paired_cells(spark: S, d: str) -> DataFrame:
    """Hours in which large and ordinary trades both occur, with the two cells side by side."""
    cell = agg.with_bucket(trades(spark, d)).groupBy("market", "bucket").agg(
        *[f(F.when(c, x)).alias(n) for c, k in ((F.col("value") >= 120, "large"), (F.col("value") < 120, "ordinary")) for f, x, n in ((F.sum, F.col("value") * F.col("direction"), f"{k}_net"), (F.avg, F.col("price"), f"{k}_price"))]
    ).where("large_net is not null and ordinary_net is not null")
    return cell.select("market", "bucket", F.round("large_net", 6).alias("large_net"), F.round("ordinary_net", 6).alias("ordinary_net"), F.round(F.col("large_price") - F.col("ordinary_price"), 9).alias("price_gap"))


PAIRED_CELLS = f"""WITH {T}, c AS (SELECT market, sec - sec % 3600 AS bucket, sum(value * direction) FILTER (value >= 120) AS a, sum(value * direction) FILTER (value < 120) AS b,
  avg(price) FILTER (value >= 120) AS p, avg(price) FILTER (value < 120) AS q FROM t GROUP BY ALL)
SELECT market, bucket, round(a, 6) AS large_net, round(b, 6) AS ordinary_net, round(p - q, 9) AS price_gap FROM c WHERE a IS NOT NULL AND b IS NOT NULL"""


def version_rewrite(spark: S, d: str) -> DataFrame:
    """Columns dropped and renamed, and a version written into a label."""
    at = table(spark, d, "part").withColumnRenamed("p_partkey", "key").withColumn("label", F.regexp_replace("p_brand", r"^Brand#(\d)(\d)$", r"B$1-v$2"))
    return at.drop(*[c for c in at.columns if c not in ("key", "label", "p_type")])


VERSION_REWRITE = r"SELECT p_partkey AS key, regexp_replace(p_brand, '^Brand#(\d)(\d)$', 'B\1-v\2') AS label, p_type FROM part"


def whole_join(spark: S, d: str) -> DataFrame:
    """Lines with their orders by a join that must keep every line, once."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return checks.whole_join(lines, orders, ["o_orderkey"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


WHOLE_JOIN = "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"


def cluster_representatives(spark: S, d: str) -> DataFrame:
    """The largest trade of each cluster of large trades no more than six hours apart, ties to the smaller id."""
    at = trades(spark, d).where("value >= 120").select("market", "sec", "event_id", "value")
    w = Window.partitionBy("market").orderBy("sec", "event_id")
    starts = (F.coalesce(F.col("sec") - F.lag("sec").over(w) > 21_600, F.lit(True))).cast("long")
    at = at.withColumn("_s", starts).withColumn("cluster", F.sum("_s").over(w))
    best = at.groupBy("market", "cluster").agg(F.max(F.struct("value", (-F.col("event_id")).alias("i"))).alias("b"), F.count("*").alias("size"))
    return best.select("market", "cluster", (-F.col("b.i")).alias("event_id"), F.round("b.value", 6).alias("value"), "size")


CLUSTER_REPRESENTATIVES = f"""WITH {T}, l AS (SELECT market, sec, event_id, value, sec - lag(sec) OVER w AS gap FROM t WHERE value >= 120 WINDOW w AS (PARTITION BY market ORDER BY sec, event_id)),
c AS (SELECT *, sum((gap IS NULL OR gap > 21600)::INT) OVER (PARTITION BY market ORDER BY sec, event_id)::BIGINT AS cluster FROM l)
SELECT market, cluster, event_id, round(value, 6) AS value, count(*) OVER (PARTITION BY market, cluster) AS size FROM c QUALIFY row_number() OVER (PARTITION BY market, cluster ORDER BY value DESC, event_id) = 1"""


def numbered_cases(spark: S, d: str) -> DataFrame:
    """Case ids of the large trades in one order over all of them: by day, then market, second and id."""
    at = trades(spark, d).where("value >= 150").select("dy", "market", "sec", "event_id")
    out = windows.numbered(at, ["dy", "market"], ["sec", "event_id"], "place")
    return out.select("event_id", F.format_string("C%06d", "place").alias("case_id"))


NUMBERED_CASES = f"WITH {T} SELECT event_id, printf('C%06d', row_number() OVER (ORDER BY dy, market, sec, event_id)) AS case_id FROM t WHERE value >= 150"


def _planted(spark: S, d: str) -> tuple[DataFrame, DataFrame]:
    """Trades, and a copy with lost, doubled and slightly changed rows."""
    rows = trades(spark, d)
    value = F.when(F.col("event_id") % 1_009 == 0, F.col("value") + 0.5).when(F.col("event_id") % 1_013 == 0, F.col("value") * (1 + 1e-13)).otherwise(F.col("value"))
    return rows, rows.where("event_id % 2003 <> 0").withColumn("value", value)


PLANTED = f"""{T}, c AS (SELECT * REPLACE (CASE WHEN event_id % 1009 = 0 THEN value + 0.5 WHEN event_id % 1013 = 0 THEN value * (1 + 1e-13) ELSE value END AS value) FROM t WHERE event_id % 2003 <> 0)"""


def planted_reconciliation(spark: S, d: str) -> DataFrame:
    """Market days whose rows, gross or net differ between two copies by more than ``max(1e-5, 1e-10 * gross)``."""
    a, b = _planted(spark, d)
    return checks.reconciled_flows(a, b, ["market", "dy"]).select("market", "dy", "left_rows", "right_rows", F.round("gross_gap", 4).alias("gross_gap"))


PLANTED_RECONCILIATION = f"""WITH {PLANTED}, a AS (SELECT market, dy, count(*) AS n, sum(value) AS g, sum(value * direction) AS s FROM t GROUP BY ALL), b AS (SELECT market, dy, count(*) AS n, sum(value) AS g, sum(value * direction) AS s FROM c GROUP BY ALL)
SELECT market, dy, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows, round(coalesce(b.g, 0) - coalesce(a.g, 0), 4) AS gross_gap FROM a FULL JOIN b USING (market, dy)
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0) OR abs(coalesce(a.g, 0) - coalesce(b.g, 0)) > greatest(1e-5, 1e-10 * coalesce(a.g, 0)) OR abs(coalesce(a.s, 0) - coalesce(b.s, 0)) > greatest(1e-5, 1e-10 * coalesce(a.g, 0))"""


def count_conservation(spark: S, d: str) -> DataFrame:
    """Rows of each market as read, kept and left out, counted in separate passes."""
    rows = trades(spark, d)
    kept = rows.where(f"sec < {RESOLUTION} and value >= 25")
    return checks.conserved(rows, kept, rows.where(f"not (sec < {RESOLUTION} and value >= 25)"), ["market"])


COUNT_CONSERVATION = f"""WITH {T} SELECT market, count(*) AS source, count(*) FILTER (sec < {RESOLUTION} AND value >= 25) AS included, count(*) FILTER (NOT (sec < {RESOLUTION} AND value >= 25)) AS excluded, true AS conserved
FROM t GROUP BY ALL"""


def fingerprint_gate(spark: S, d: str) -> DataFrame:
    """Market days whose frozen fingerprint no longer fits, in a copy with planted changes."""
    a, b = _planted(spark, d)
    frozen, now = (manifest(x.select("event_id", "market", "dy", "sec", "value"), "sec", "market", "dy") for x in (a, b))
    return checks.changed_keys(frozen, now, ["market", "dy"]).select("market", "dy", "state")


FINGERPRINT_GATE = f"""WITH {PLANTED}, a AS (SELECT market, dy, bool_or(event_id % 2003 = 0 OR event_id % 1009 = 0 OR (event_id % 1013 = 0 AND value * (1 + 1e-13) <> value)) AS off FROM t GROUP BY ALL), b AS (SELECT DISTINCT market, dy FROM c)
SELECT market, dy, CASE WHEN b.dy IS NULL THEN 'missing' ELSE 'changed' END AS state FROM a LEFT JOIN b USING (market, dy) WHERE off"""
NAMES_BY_TYPE = {"click": "touch", "purchase": "buy", "view": "look"}


def dict_remap(spark: S, d: str) -> DataFrame:
    """Keys renamed by a map, unknown ones kept."""
    known = F.create_map(*[F.lit(x) for kv in NAMES_BY_TYPE.items() for x in kv])
    return table(spark, d, "events").groupBy(F.coalesce(F.try_element_at(known, F.col("event_type")), F.col("event_type")).alias("name")).agg(F.count("*").alias("n"))


DICT_REMAP = f"SELECT CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in NAMES_BY_TYPE.items())} ELSE event_type END AS name, count(*) AS n FROM events GROUP BY ALL"


def link_functions(spark: S, d: str) -> DataFrame:
    """Inverse hyperbolic sine of flow, and clipped logit and complementary log-log of prices."""
    p = m.clipped(F.col("price"))
    return trades(spark, d).groupBy("market", "dy").agg(
        F.round(F.sum(F.asinh(F.col("value") * F.col("direction"))), 6).alias("asinh_flow"), F.round(F.avg(m.logit(p)), 6).alias("logit_price"), F.round(F.avg(m.cloglog(p)), 6).alias("cloglog_price")
    )


LINK_FUNCTIONS = f"""WITH {T}, c AS (SELECT market, dy, value * direction AS v, greatest(1e-6, least(1 - 1e-6, price)) AS p FROM t)
SELECT market, dy, round(sum(asinh(v)), 6) AS asinh_flow, round(avg(ln(p / (1 - p))), 6) AS logit_price, round(avg(ln(-ln(1 - p))), 6) AS cloglog_price FROM c GROUP BY ALL"""


def roc_auc(spark: S, d: str) -> DataFrame:
    from ..ml import evaluation as ev

    rows = trades(spark, d).select("market", F.round("price", 3).alias("score"), (F.col("direction") > 0).cast("int").alias("label"))
    return ev.roc_auc(rows, "score", "label", ["market"]).select("market", F.round("auc", 9).alias("auc"))


ROC_AUC = f"""WITH {T}, c AS (SELECT market, round(price, 3) AS s, count(*) FILTER (direction > 0) AS p, count(*) FILTER (direction < 0) AS n FROM t GROUP BY ALL),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY market ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT market, round(sum(p * (below + n / 2.0)) / (sum(p) * sum(n)), 9) AS auc FROM r GROUP BY ALL"""
#: Warnings of a case by precedence, and how grave each is.
WARNINGS = [("after_resolution", f"sec >= {RESOLUTION}", 3), ("extreme_price", "price <= 0.02 or price >= 0.98", 2), ("whole_number", "value = floor(value)", 1)]


def _cases(spark: S, d: str) -> DataFrame:
    at = trades(spark, d).where("value >= 120")
    at = temporal.asof(at, temporal.last_per_second(ticks(spark, d)), strict=True, most_gap=7_200)
    warning, severity = F.lit("none"), F.lit(0)
    for name, rule, weight in reversed(WARNINGS):
        warning, severity = F.when(F.expr(rule), name).otherwise(warning), F.when(F.expr(rule), weight).otherwise(severity)
    return at.select("event_id", "market", "dy", m.phase(F.col("sec"), KICKOFF, RESOLUTION).alias("phase"), F.when(F.col("asof_sec").isNull(), "unavailable").otherwise("available").alias("price_state"), warning.alias("warning"), severity.alias("severity"))


def case_audit(spark: S, d: str) -> DataFrame:
    """Large trades with phase, whether a price was at hand, and the first warning that applies."""
    return _cases(spark, d).select("event_id", "phase", "price_state", "warning")


CASES = f"""{T}, {K}, cases AS (SELECT t.event_id, t.market, t.dy, CASE WHEN t.sec >= {RESOLUTION} THEN 'resolved' WHEN t.sec < {KICKOFF} THEN 'prematch' ELSE 'inplay' END AS phase,
  CASE WHEN k.sec IS NULL OR t.sec - k.sec > 7200 THEN 'unavailable' ELSE 'available' END AS price_state,
  CASE WHEN t.sec >= {RESOLUTION} THEN 'after_resolution' WHEN t.price <= 0.02 OR t.price >= 0.98 THEN 'extreme_price' WHEN value = floor(value) THEN 'whole_number' ELSE 'none' END AS warning
FROM t ASOF LEFT JOIN k ON k.market = t.market AND t.sec > k.sec WHERE value >= 120)"""
CASE_AUDIT = f"WITH {CASES} SELECT event_id, phase, price_state, warning FROM cases"
DISPOSITIONS = {3: "exclude", 2: "review", 1: "note", 0: "clear"}


def disposition_rollup(spark: S, d: str) -> DataFrame:
    """Per market and day the gravest disposition of its cases."""
    name = F.element_at(F.create_map(*[F.lit(x) for kv in DISPOSITIONS.items() for x in kv]), F.max("severity"))
    return _cases(spark, d).groupBy("market", "dy").agg(name.alias("disposition"), F.count("*").alias("cases"))


DISPOSITION_ROLLUP = f"""WITH {CASES}, s AS (SELECT market, dy, max(CASE warning WHEN 'after_resolution' THEN 3 WHEN 'extreme_price' THEN 2 WHEN 'whole_number' THEN 1 ELSE 0 END) AS s, count(*) AS cases FROM cases GROUP BY ALL)
SELECT market, dy, CASE s WHEN 3 THEN 'exclude' WHEN 2 THEN 'review' WHEN 1 THEN 'note' ELSE 'clear' END AS disposition, cases FROM s"""


def prioritised_union(spark: S, d: str) -> DataFrame:
    """Per market: hours in the top 15 by gross and by net, then the top 25 by gross, then the next 10 by net among the rest."""
    p = agg.panel(trades(spark, d)).select("market", "bucket", F.round("gross", 6).alias("gross"), F.round(F.abs("net"), 6).alias("net"))
    place = lambda c: F.row_number().over(Window.partitionBy("market").orderBy(F.desc(c), "bucket"))
    at = p.withColumns({"_g": place("gross"), "_n": place("net")})
    tier = F.when((F.col("_g") <= 15) & (F.col("_n") <= 15), 1).when(F.col("_g") <= 25, 2)
    at = at.withColumn("tier", tier)
    rest = at.where("tier is null").withColumn("_r", place("net")).where("_r <= 10").withColumn("tier", F.lit(3)).drop("_r")
    return at.where("tier is not null").unionByName(rest).select("market", "bucket", "tier")


PRIORITISED_UNION = f"""WITH {T}, {PANEL}, g AS (SELECT market, bucket, round(gross, 6) AS gross, round(abs(net), 6) AS net FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY gross DESC, bucket) AS a, row_number() OVER (PARTITION BY market ORDER BY net DESC, bucket) AS b FROM g),
s AS (SELECT *, CASE WHEN a <= 15 AND b <= 15 THEN 1 WHEN a <= 25 THEN 2 END AS tier FROM r)
SELECT market, bucket, tier FROM s WHERE tier IS NOT NULL UNION ALL SELECT market, bucket, 3 FROM (SELECT * FROM s WHERE tier IS NULL QUALIFY row_number() OVER (PARTITION BY market ORDER BY net DESC, bucket) <= 10)"""


def set_scores(spark: S, d: str) -> DataFrame:
    """Precision, recall and Jaccard of yesterday's heavy wallets as a guess of today's, per day."""
    heavy = trades(spark, d).groupBy("dy", "wallet").agg(F.sum("value").alias("v")).where("v >= 100")
    guess = heavy.select((F.col("dy") + 1).alias("dy"), "wallet", F.lit(1).alias("g"))
    both = heavy.select("dy", "wallet", F.lit(1).alias("t")).join(guess, ["dy", "wallet"], "full")
    hit, said, true = (F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("g").isNotNull() & F.col("t").isNotNull(), F.col("g").isNotNull(), F.col("t").isNotNull()))
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 9)
    return both.groupBy("dy").agg(ratio(hit, said).alias("precision"), ratio(hit, true).alias("recall"), ratio(hit, F.count("*")).alias("jaccard"))


SET_SCORES = f"""WITH {T}, h AS (SELECT dy, wallet FROM t GROUP BY ALL HAVING sum(value) >= 100), b AS (SELECT dy, wallet, h.wallet IS NOT NULL AS t, true AS x FROM h),
f AS (SELECT coalesce(a.dy, g.dy) AS dy, a.dy IS NOT NULL AS t, g.dy IS NOT NULL AS g FROM h a FULL JOIN (SELECT dy + 1 AS dy, wallet FROM h) g ON a.dy = g.dy AND a.wallet = g.wallet)
SELECT dy, round(count(*) FILTER (t AND g) / nullif(count(*) FILTER (g), 0), 9) AS precision, round(count(*) FILTER (t AND g) / nullif(count(*) FILTER (t), 0), 9) AS recall, round(count(*) FILTER (t AND g) / count(*), 9) AS jaccard
FROM f GROUP BY ALL"""


def reversal_fraction(spark: S, d: str) -> DataFrame:
    """Share of a large trade's first price move that was gone by a later time, where it moved its way."""
    ticks_ = temporal.last_per_second(ticks(spark, d))
    at = temporal.asof(trades(spark, d).where("value >= 150").select("event_id", "market", "sec", "direction"), ticks_, strict=True, prefix="p0")
    for i, h in ((1, HORIZON), (2, 6 * HORIZON)):
        at = temporal.asof(at.withColumn(f"t{i}", F.col("sec") + h), ticks_, at=f"t{i}", prefix=f"p{i}")
    first, later = (F.col("direction") * (F.col(f"p{i}_price") - F.col("p0_price")) for i in (1, 2))
    return at.withColumns({"first": first, "later": later}).where("first > 0.001 and later is not null").select("event_id", F.round(1 - F.col("later") / F.col("first"), 6).alias("fraction"))


REVERSAL_FRACTION = f"""WITH {T}, {K}, j AS (SELECT t.event_id, direction * (a.price - z.price) AS first, direction * (b.price - z.price) AS later FROM t
ASOF LEFT JOIN k z ON z.market = t.market AND t.sec > z.sec ASOF LEFT JOIN k a ON a.market = t.market AND t.sec + {HORIZON} >= a.sec
ASOF LEFT JOIN k b ON b.market = t.market AND t.sec + {6 * HORIZON} >= b.sec WHERE t.value >= 150)
SELECT event_id, round(1 - later / first, 6) AS fraction FROM j WHERE first > 0.001 AND later IS NOT NULL"""
BANDS = [86_400, 3 * 86_400, 7 * 86_400, 14 * 86_400]


def band_dummies(spark: S, d: str) -> DataFrame:
    """Dummies of the time bands before kickoff and their products with flow, summed per market and day."""
    at = trades(spark, d).where(F.col("sec") < KICKOFF).withColumn("band", m.time_band(KICKOFF - F.col("sec"), BANDS))
    own = lambda b: F.when(F.col("band") == b, 1).otherwise(0)
    flow = F.col("value") * F.col("direction")
    return at.groupBy("market", "dy").agg(*[F.sum(own(b)).alias(f"band{b}") for b in range(5)], *[F.round(F.sum(own(b) * flow), 5).alias(f"flow_band{b}") for b in range(5)])


_BAND = f"CASE {' '.join(f'WHEN {KICKOFF} - sec <= {e} THEN {i}' for i, e in enumerate(BANDS))} ELSE {len(BANDS)} END"
BAND_DUMMIES = f"""WITH {T}, b AS (SELECT *, {_BAND} AS band FROM t WHERE sec < {KICKOFF})
SELECT market, dy, {", ".join(f"count(*) FILTER (band = {b}) AS band{b}" for b in range(5))}, {", ".join(f"round(coalesce(sum(value * direction) FILTER (band = {b}), 0), 5) AS flow_band{b}" for b in range(5))} FROM b GROUP BY ALL"""


def varied_groups(spark: S, d: str) -> DataFrame:
    """Wallets of a market whose trades go both ways; the others are left out."""
    by = trades(spark, d).groupBy("market", "wallet").agg(F.min("direction").alias("a"), F.max("direction").alias("b"), F.count("*").alias("n"))
    return by.where("a <> b").select("market", "wallet", "n")


VARIED_GROUPS = f"WITH {T} SELECT market, wallet, count(*) AS n FROM t GROUP BY ALL HAVING min(direction) <> max(direction)"
SAMPLES = {"prematch": f"sec < {KICKOFF}", "inplay": f"sec >= {KICKOFF} and sec < {RESOLUTION}", "large": "value >= 120", "cheap": "price < 0.1"}


def tagged_samples(spark: S, d: str) -> DataFrame:
    """All samples in one pass: each row under the tag of every sample that it belongs to."""
    tags = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(tag)) for tag, rule in SAMPLES.items()]))
    return trades(spark, d).select(F.explode(tags).alias("sample"), "market", "value").groupBy("sample", "market").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("gross"))


TAGGED_SAMPLES = f"WITH {T} " + " UNION ALL ".join(f"SELECT '{tag}' AS sample, market, count(*) AS n, round(sum(value), 4) AS gross FROM t WHERE {rule} GROUP BY ALL" for tag, rule in SAMPLES.items())
#: Widths of the windows that are halved while they hold too many rows, and how many they may hold.
WIDEST, HALVINGS, PAGE_ROWS = 1 << 21, 8, 500


def saturated_windows(spark: S, d: str) -> DataFrame:
    """Windows per market, halved until each holds at most a page of rows (or is as narrow as it gets)."""
    return windows.bisected(trades(spark, d), "market", "sec", WIDEST, HALVINGS, PAGE_ROWS)


_LEVELS = ", ".join(f"w{i} AS (SELECT market, sec // {WIDEST >> i} AS slot, count(*) AS n FROM t GROUP BY ALL)" for i in range(HALVINGS + 1))
SATURATED_WINDOWS = f"WITH {T}, {_LEVELS} " + " UNION ALL ".join(
    f"SELECT w{i}.market, w{i}.slot * {WIDEST >> i} AS begin, w{i}.slot * {WIDEST >> i} + {WIDEST >> i} AS finish, w{i}.n FROM w{i}"
    + (f" JOIN w{i - 1} u ON u.market = w{i}.market AND u.slot = w{i}.slot // 2 AND u.n > {PAGE_ROWS}" if i else "") + ("" if i == HALVINGS else f" WHERE w{i}.n <= {PAGE_ROWS}")
    for i in range(HALVINGS + 1)
)
ALIASES = {"UNITED STATES": "USA", "UNITED KINGDOM": "UK", "RUSSIA": "RUS"}


def aliased_teams(spark: S, d: str) -> DataFrame:
    """Customers' countries resolved against spelled variants through an alias table, the exact balance sign preferred."""
    alias = spark.createDataFrame(list(ALIASES.items()), "name string, short string")
    tidy = lambda c: F.regexp_replace(F.upper(F.trim(c)), r"\s+", " ")
    nation = table(spark, d, "nation").select("n_nationkey", tidy(F.concat(F.lit(" "), F.lower("n_name"))).alias("name")).join(F.broadcast(alias), "name", "left")
    keyed = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.coalesce("short", "name").alias("team"))
    at = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(keyed, "c_nationkey")
    best = F.min_by("c_custkey", F.struct((F.col("c_acctbal") < 0).cast("int"), "c_custkey"))
    return at.groupBy("team").agg(F.count("*").alias("n"), best.alias("preferred"))


ALIASED_TEAMS = f"""SELECT CASE upper(n_name) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items())} ELSE upper(n_name) END AS team, count(*) AS n,
  coalesce(min(c_custkey) FILTER (c_acctbal >= 0), min(c_custkey)) AS preferred FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""

def nearest_fixtures(spark: S, d: str) -> DataFrame:
    """Listings of two teams in either order, resolved to the fixture of the pair whose day is nearest (ties to the earlier), per pair.

    Orders stand for fixtures, lines for listings; team names go through the alias table.
    """
    alias = spark.createDataFrame(list(ALIASES.items()), "name string, short string")
    teams = table(spark, d, "nation").select("n_nationkey", F.upper(F.trim("n_name")).alias("name")).join(F.broadcast(alias), "name", "left")
    teams = F.broadcast(teams.select("n_nationkey", F.coalesce("short", "name").alias("team")))  # one row per nation
    named = lambda rows, key, to: rows.join(teams.select(F.col("n_nationkey").alias(key), F.col("team").alias(to)), key).drop(key)
    pair = F.array_join(F.array_sort(F.array("a", "b")), " v ")
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("ka")), "o_custkey")
    orders = orders.select("ka", (F.col("o_orderkey") % 25).cast("int").alias("kb"), day("o_orderdate").alias("sec"), "o_orderkey")
    fixtures = named(named(orders, "ka", "a"), "kb", "b").where("a <> b").groupBy(pair.alias("market"), "sec").agg(F.min("o_orderkey").cast("double").alias("price"))
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("ka")), "l_suppkey")
    lines = lines.select("ka", (F.col("l_partkey") % 25).cast("int").alias("kb"), day("l_shipdate").alias("sec"))
    listings = named(named(lines, "ka", "a"), "kb", "b").where("a <> b").select(pair.alias("market"), "sec")
    at = temporal.asof(temporal.asof(listings, fixtures, prefix="before", bucket=180), fixtures, prefix="after", forward=True, bucket=180)
    early = F.col("after_sec").isNull() | (F.col("sec") - F.col("before_sec") <= F.col("after_sec") - F.col("sec"))
    best = F.when(F.col("before_sec").isNotNull() & early, F.struct(F.col("before_price").alias("id"), (F.col("sec") - F.col("before_sec")).alias("gap"))).otherwise(
        F.struct(F.col("after_price").alias("id"), (F.col("after_sec") - F.col("sec")).alias("gap"))
    )
    return at.select("market", best.alias("f")).groupBy(F.col("market").alias("pair")).agg(
        F.count("*").alias("listings"), F.count("f.id").alias("resolved"), F.sum("f.gap").alias("days_off"), F.sum(F.col("f.id").cast("long")).alias("id_sum")
    )


_TEAM = f"CASE upper(trim(n_name)) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items())} ELSE upper(trim(n_name)) END"
NEAREST_FIXTURES = f"""WITH n AS (SELECT n_nationkey AS k, {_TEAM} AS team FROM nation),
f AS (
  SELECT least(x.team, y.team) || ' v ' || greatest(x.team, y.team) AS pair, datediff('day', DATE '1970-01-01', o_orderdate::DATE) AS d, min(o_orderkey) AS id
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN n x ON x.k = c_nationkey JOIN n y ON y.k = o_orderkey % 25 WHERE x.team <> y.team GROUP BY ALL),
l AS (
  SELECT least(x.team, y.team) || ' v ' || greatest(x.team, y.team) AS pair, datediff('day', DATE '1970-01-01', l_shipdate::DATE) AS d
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN n x ON x.k = s_nationkey JOIN n y ON y.k = l_partkey % 25 WHERE x.team <> y.team),
m AS (
  SELECT l.pair, l.d, b.d AS bd, b.id AS bid, a.d AS ad, a.id AS aid FROM l ASOF LEFT JOIN f b ON b.pair = l.pair AND l.d >= b.d ASOF LEFT JOIN f a ON a.pair = l.pair AND l.d <= a.d),
r AS (SELECT pair, CASE WHEN bd IS NOT NULL AND (ad IS NULL OR d - bd <= ad - d) THEN bid ELSE aid END AS id, CASE WHEN bd IS NOT NULL AND (ad IS NULL OR d - bd <= ad - d) THEN d - bd ELSE ad - d END AS gap FROM m)
SELECT pair, count(*) AS listings, count(id) AS resolved, sum(gap)::BIGINT AS days_off, sum(id)::BIGINT AS id_sum FROM r GROUP BY pair"""

NAMES = (
    "two_threshold_panel executed_price_asof boundary_flags z_weighted_flow median_split paired_cells version_rewrite whole_join cluster_representatives numbered_cases planted_reconciliation "
    "count_conservation fingerprint_gate dict_remap link_functions roc_auc case_audit disposition_rollup prioritised_union set_scores reversal_fraction band_dummies varied_groups tagged_samples "
    "saturated_windows aliased_teams nearest_fixtures"
).split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLES = {n: globals()[n.upper()] for n in NAMES}
