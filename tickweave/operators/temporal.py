"""Joins in time: as-of lookups and interval pairs, without a task that holds a whole key.

Both cut time into buckets. An as-of lookup runs a window within each (key, bucket) and falls
back to the last row of the nearest earlier bucket, which comes from a table of one row per
bucket. An interval join meets each left row with the buckets its interval touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_second(ticks: DataFrame, key: str = "market", order: str = "source_row") -> DataFrame:
    """Of ticks with the same key and second the last in source order stays."""
    return ticks.groupBy(key, "sec").agg(F.max_by("price", order).alias("price"))


def asof(
    left: DataFrame, ticks: DataFrame, at: str = "sec", key: str = "market", strict: bool = False, forward: bool = False,
    most_gap: int | None = None, bucket: int = 86_400, prefix: str = "asof",
) -> DataFrame:
    """``left`` with ``<prefix>_sec`` and ``<prefix>_price`` of the nearest tick on one side.

    ``ticks`` holds at most one row per key and second. Backward takes ticks at or before
    ``at`` (``strict``: before), forward at or after (after). A tick further off than
    ``most_gap`` seconds is none. Rows without a tick, key or time get nulls.
    """
    sign = -1 if forward else 1
    time = lambda c: F.col(c) * sign
    own = left.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), time(at).alias("_t"), F.lit(None).cast("struct<t:bigint,price:double>").alias("_tick"))
    seen = ticks.select(
        F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), F.col(key).alias("_key"), time("sec").alias("_t"),
        F.struct(time("sec").alias("t"), F.col("price").cast("double").alias("price")).alias("_tick"),
    )
    both = own.unionByName(seen).withColumn("_bucket", F.floor(F.col("_t") / bucket))
    within = Window.partitionBy("_key", "_bucket").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    near = both.withColumn("_near", F.last("_tick", ignorenulls=True).over(within)).where("_row is not null")
    ends = both.groupBy("_key", "_bucket").agg(F.max_by("_tick", F.when(F.col("_tick").isNotNull(), F.col("_t"))).alias("_last"))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    found = near.join(carried, ["_key", "_bucket"], "left").withColumn("_found", F.coalesce("_near", "_carried"))
    gap = F.col("_t") - F.col("_found.t")
    usable: Column = F.col("_found").isNotNull() if most_gap is None else gap <= most_gap
    return found.select(
        "_row.*", F.when(usable, F.col("_found.t") * sign).alias(f"{prefix}_sec"), F.when(usable, F.col("_found.price")).alias(f"{prefix}_price")
    )


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], after: int, until: int, at: str = "sec", right_at: str = "r_sec") -> DataFrame:
    """Pairs whose times differ by ``after < right - left <= until``; right columns must have names of their own.

    Each left row is copied to the one or two buckets of the interval's width that it
    touches, so the join is on equality and grows with the matches.
    """
    width = max(1, until - after)
    low, high = F.floor((F.col(at) + after + 1) / width), F.floor((F.col(at) + until) / width)
    spread = left.withColumn("_bucket", F.explode(F.sequence(low, high)))
    dealt = right.withColumn("_bucket", F.floor(F.col(right_at) / width))
    gap = F.col(right_at) - F.col(at)
    return spread.join(dealt, [*keys, "_bucket"]).where((gap > after) & (gap <= until)).drop("_bucket")


def interval_sums(left: DataFrame, right: DataFrame, keys: list[str], after: int, until: int, sums: dict[str, str], at: str = "sec", right_at: str = "r_sec") -> DataFrame:
    """``left`` with sums of right columns over the rows with equal keys and ``after < right - left <= until``; 0 where there is none.

    ``sums`` maps new columns to the summed ones. No pairs are made: in buckets of the
    interval's width, an interval is what its first bucket holds behind its start and what the
    next one holds up to its end, both from one running sum over a bucket's distinct times.
    """
    width = until - after
    start, bucket = F.col("_from"), F.floor(F.col("_from") / width)
    ends = F.explode(F.array(F.struct(bucket.alias("_bucket"), start.alias("_t"), F.lit(False).alias("_end")), F.struct((bucket + 1).alias("_bucket"), (start + width).alias("_t"), F.lit(True).alias("_end"))))
    dealt = left.withColumn("_from", F.col(at) + after)
    marks = dealt.select(*keys, "_from").dropna().distinct().select(*keys, "_from", ends.alias("_e")).select(*keys, "_from", "_e.*")
    steps = right.groupBy(*keys, F.col(right_at).alias("_t")).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).withColumn("_bucket", F.floor(F.col("_t") / width))
    whole = Window.partitionBy(*keys, "_bucket")
    so_far = whole.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    part = {n: F.when(F.col("_end"), F.sum(n).over(so_far)).otherwise(F.sum(n).over(whole) - F.coalesce(F.sum(n).over(so_far), F.lit(0))) for n in sums}
    read = steps.unionByName(marks, allowMissingColumns=True).select(*keys, "_from", *[p.alias(n) for n, p in part.items()]).where("_from is not null")
    found = read.groupBy(*keys, "_from").agg(*[F.sum(n).alias(n) for n in sums])
    out = dealt.join(found, [*keys, "_from"], "left")
    return out.select(*left.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in sums])


def distinct_within(left: DataFrame, right: DataFrame, keys: list[str], who: str, span: int, name: str, at: str = "sec", right_at: str = "r_sec") -> DataFrame:
    """``left`` with the number of distinct ``who`` among right rows with equal keys and ``0 < right - left <= span``.

    A row of ``who`` is its first behind a time from that of the row before it on (or ``span``
    seconds before), up to its own. So each row is a step up and a step down, and the number is
    the running sum of steps; those open at the start of a bucket of ``span`` stand there again.
    """
    t, begin, of = F.col(right_at), F.col("_begin"), lambda c: F.floor(c / span)
    before = F.lag(right_at).over(Window.partitionBy(*keys, who).orderBy(right_at))
    rows = right.select(*keys, who, right_at).dropna().distinct().withColumn("_begin", F.greatest(F.coalesce(before, t - span), t - span))
    step = lambda c, b, n: F.struct(b.alias("_bucket"), c.alias("_t"), F.lit(n).alias("_n"))
    up_down = F.array(step(begin, of(begin), 1), step(t, of(t), -1))
    steps = F.when(of(begin) < of(t), F.concat(up_down, F.array(step(of(t) * span, of(t), 1)))).otherwise(up_down)
    cells = rows.select(*keys, F.explode(steps).alias("_s")).select(*keys, "_s.*").groupBy(*keys, "_bucket", "_t").agg(F.sum("_n").alias("_n"))
    marks = left.select(*keys, F.col(at).alias("_at")).dropna().distinct().withColumns({"_t": F.col("_at"), "_bucket": of(F.col("_at"))})
    so_far = Window.partitionBy(*keys, "_bucket").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    read = cells.unionByName(marks, allowMissingColumns=True).select(*keys, "_at", F.sum("_n").over(so_far).alias(name)).where("_at is not null")
    out = left.withColumn("_at", F.col(at)).join(read, [*keys, "_at"], "left")
    return out.select(*left.columns, F.coalesce(name, F.lit(0)).alias(name))
