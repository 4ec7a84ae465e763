"""Constants of the registered queries, and the DuckDB side of the trade binding."""

#: 20 and 28 January 2024, seconds since 1970.
KICKOFF, RESOLUTION = 1_705_708_800, 1_706_400_000
FIRST_DAY = 19_723
#: Values that history must hold before a threshold counts.
LEAST_HISTORY = 100
HORIZON = 3_600

_BASE = "event_type AS market, user_id AS wallet, floor(epoch(ts))::BIGINT AS sec, (floor(epoch(ts))::BIGINT // 86400) AS dy, value, value / 500 AS price"
T = f"""t AS (
  SELECT event_id, {_BASE}, CASE WHEN event_id % 3 <> 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN user_id % 2 = 0 THEN 'YES' ELSE 'NO' END AS outcome,
    CASE WHEN (event_id % 3 <> 0) = (user_id % 2 = 0) THEN 1 ELSE -1 END AS direction
  FROM events)"""
K = f"""k AS (
  SELECT market, sec, arg_max(price, event_id) AS price FROM (SELECT event_id, {_BASE} FROM events) GROUP BY market, sec)"""
A = """a AS (
  SELECT market, wallet, wallet || '-' || (sec // 21600) AS action, min(sec) AS sec, sum(value * direction) AS net, sum(value) AS gross,
    sum(value * price) / sum(value) AS price, count(*) AS n_trades, sign(sum(value * direction))::INT AS direction
  FROM t GROUP BY ALL HAVING sum(value * direction) <> 0)"""
