"""Column expressions of the trade domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def direction(side: str, outcome: str) -> Column:
    """+1 if the trade bets on YES, else -1; any other pair of values fails the job."""
    known = F.col(side).isin("BUY", "SELL") & F.col(outcome).isin("YES", "NO")
    sign = F.when((F.col(side) == "BUY") == (F.col(outcome) == "YES"), 1).otherwise(-1)
    return F.when(known, sign).otherwise(F.raise_error(F.lit("unknown side or outcome")).cast("int"))


def yes_price(price: str, outcome: str) -> Column:
    return F.when(F.col(outcome) == "YES", F.col(price)).otherwise(1 - F.col(price))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def phase(sec: Column, kickoff: int, resolution: int) -> Column:
    """The order matters: what is resolved is neither before nor in play."""
    return F.when(sec >= resolution, "resolved").when(sec < kickoff, "prematch").otherwise("inplay")


def price_decile(price: Column) -> Column:
    return F.least(F.lit(9), F.greatest(F.lit(0), F.floor(price * 10))).cast("int")


def time_band(seconds_to: Column, edges: list[int]) -> Column:
    """0 for up to the first edge, then 1 and so on; the last band is open."""
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(seconds_to <= edges[i], i).otherwise(out)
    return out


def movement_label(sign: Column, change: Column) -> Column:
    return (
        F.when(change.isNull(), "unavailable").when(change == 0, "no_movement").when(sign * change > 0, "momentum").otherwise("contrarian")
    )


def brier_improvement(before: Column, after: Column, won: Column) -> Column:
    return (before - won) * (before - won) - (after - won) * (after - won)


def tri_state(text: Column, yes: list[str], no: list[str]) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin(*yes), True).when(low.isin(*no), False)


def first_failing(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first predicate that does not hold (null counts as not), or null."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(F.lit(name))
    return out


def unordered_pair(a: Column, b: Column) -> Column:
    """A key that is the same for both orders of two names, blanks and case aside."""
    tidy = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.array_join(F.array_sort(F.array(tidy(a), tidy(b))), "|")


def clipped(p: Column, edge: float = 1e-6) -> Column:
    return F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def cloglog(p: Column) -> Column:
    return F.log(-F.log(1 - p))
