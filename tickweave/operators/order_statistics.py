"""Exact quantiles without a task that holds a key, and past-only ones without copies of rows for later days.

What is asked for are ranks among a key's values of earlier days. A cell is a range of a
key's values; a running histogram over days says which of a cell's parts holds a rank on a
day, so only rows of parts that hold one go on. Cells are parted until each has few enough
rows for one task, which then reads off the values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Rows of a cell (one per day and distinct value) that a task reads off, and parts of a larger one.
CELL, PARTS = 50_000, 64


def _parted(cells: DataFrame, big: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the large cells, with ``parent`` and the ``cell`` of their part; the least value is a part of its own."""
    at = [i / PARTS for i in range(1, PARTS)]
    edges = F.array_sort(F.array_union(F.array(F.min("value")), F.percentile_approx("value", at, F.lit(20 * PARTS))))
    spread = cells.join(big, [*keys, "cell"], "left_semi").groupBy(*keys, "cell").agg(edges.alias("edges"))
    part = F.size(F.filter("edges", lambda e: e < F.col("value")))
    return cells.join(spread, [*keys, "cell"]).select(*keys, F.col("cell").alias("parent"), (F.col("cell") * (PARTS + 2) + part + 1).alias("cell"), "day", "value", "n")


def _placed(binned: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Targets of parted cells in the part that holds their rank, the rank counted within it."""
    asked = targets.select(*keys, F.col("cell").alias("parent"), F.col("day").alias("until")).distinct()
    parts = binned.groupBy(*keys, "parent", "cell", "day").agg(F.sum("n").alias("n"))
    marks = binned.select(*keys, "parent", "cell").distinct().join(asked, [*keys, "parent"])
    both = parts.select(*keys, "parent", "cell", F.col("day").alias("t"), F.lit(1).alias("kind"), "n").unionByName(
        marks.select(*keys, "parent", "cell", F.col("until").alias("t"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
    )
    # one row per part and day, and one per part and day asked for; a mark comes before its own day's values
    so_far = Window.partitionBy(*keys, "parent", "cell").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("held", F.sum("n").over(so_far)).where("kind = 0").select(*keys, "parent", "cell", F.col("t").alias("day"), "held")
    lower = Window.partitionBy(*keys, "parent", "day").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS + 2 rows
    ranges = held.withColumn("low", F.coalesce(F.sum("held").over(lower), F.lit(0)))
    old = targets.select(*keys, F.col("cell").alias("parent"), "day", "slot", "rank")
    found = old.join(ranges, [*keys, "parent", "day"]).where((F.col("low") <= F.col("rank")) & (F.col("rank") < F.col("low") + F.col("held")))
    return found.select(*keys, "cell", "day", "slot", (F.col("rank") - F.col("low")).alias("rank"))


def values_at(counts: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, day, slot, value``: for each target the value of its rank (from 0) among those of days before ``day``.

    ``counts`` has ``keys, day, value, n``: how often a value came on a day; ``targets`` has
    ``keys, day, slot, rank``, each rank below the number of values before its day.
    """
    cells = cut(counts.select(*keys, F.lit(0).cast("long").alias("cell"), "day", "value", "n"))
    targets = cut(targets.select(*keys, F.lit(0).cast("long").alias("cell"), "day", "slot", "rank"))
    while True:
        sizes = cells.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        big = cut(sizes.where((F.col("m") > CELL) & (F.col("lo") < F.col("hi"))).select(*keys, "cell"))
        if not big.limit(1).count():
            break
        binned = cut(_parted(cells, big, keys))
        moved = _placed(binned, targets.join(big, [*keys, "cell"], "left_semi"), keys)
        targets = cut(targets.join(big, [*keys, "cell"], "left_anti").unionByName(moved))
        kept = binned.join(targets.select(*keys, "cell").distinct(), [*keys, "cell"], "left_semi").drop("parent")
        cells = cut(cells.join(big, [*keys, "cell"], "left_anti").unionByName(kept))
    kinds = {f.name: f.dataType.simpleString() for f in targets.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"day {kinds['day']}", f"slot {kinds['slot']}", "value double"])
    group = [*keys, "cell"]
    return targets.groupBy(*group).cogroup(cells.groupBy(*group)).applyInPandas(_read_off(keys), schema)


def _read_off(keys: list[str]):
    def run(asked, rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("value")
        value, day, n = rows["value"].to_numpy(), rows["day"].to_numpy(), rows["n"].to_numpy()
        out = np.empty(len(asked))
        for until, at in asked.groupby("day").indices.items():
            early = day < until
            places = np.searchsorted(np.cumsum(n[early]), asked["rank"].to_numpy()[at], side="right")
            out[at] = value[early][places]
        return pd.DataFrame({**{k: asked[k] for k in keys}, "day": asked["day"], "slot": asked["slot"], "value": out})

    return run


def _between(found: DataFrame, sizes: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """Linear interpolation of the two values around each quantile."""
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"_v{i}") for i in range(2 * len(qs))])
    out = sizes.join(wide, keys, "left")
    for i, q in enumerate(qs):
        at = q * (F.col("history") - 1)
        out = out.withColumn(f"q{i}", F.col(f"_v{2 * i}") + (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}")) * (at - F.floor(at)))
    return out.drop(*[f"_v{i}" for i in range(2 * len(qs))])


def _targets(sizes: DataFrame, qs: list[float]) -> DataFrame:
    ranks = [f(q * (F.col("history") - 1)).cast("long") for q in qs for f in (F.floor, F.ceil)]
    return sizes.select("*", F.posexplode(F.array(*ranks)).alias("slot", "rank"))


def expanding_quantiles(rows: DataFrame, qs: list[float], least: int, key: str, day: str, value: str) -> DataFrame:
    """Per key and day with rows: ``history`` (values on earlier days) and ``q0, q1, ...`` of them, null below ``least`` values.

    Null values count for nothing; rows without key or day are left out.
    """
    own = rows.select(F.col(key).alias("key"), F.col(day).alias("day"), F.col(value).cast("double").alias("value")).where("key is not null and day is not null")
    counts = cut(own.groupBy("key", "day", "value").agg(F.count("value").alias("n")))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per key and day
    sizes = counts.groupBy("key", "day").agg(F.sum("n").alias("n")).select("key", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("history"))
    sizes = cut(sizes)
    found = values_at(counts.where("value is not null"), _targets(sizes.where(F.col("history") >= max(1, least)), qs), ["key"])
    out = _between(found, sizes, ["key", "day"], qs)
    return out.select(F.col("key").alias(key), F.col("day").alias(day), "history", *[f"q{i}" for i in range(len(qs))])


def exact_quantiles(rows: DataFrame, column: str, qs: list[float], keys: list[str] | None = None) -> DataFrame:
    """``keys, history, q0, q1, ...``: interpolated quantiles of the column's values that are not null, and their number.

    Without ``keys`` there is one row, unless there is no value.
    """
    keys = keys or []
    own = rows.where(F.col(column).isNotNull()).select(*keys, F.lit(0).alias("_all"), F.lit(0).alias("day"), F.col(column).cast("double").alias("value"))
    counts = cut(own.groupBy(*keys, "_all", "day", "value").agg(F.count(F.lit(1)).alias("n")))
    sizes = cut(counts.groupBy(*keys, "_all").agg(F.sum("n").alias("history")).withColumn("day", F.lit(1)))
    found = values_at(counts, _targets(sizes, qs), [*keys, "_all"])
    return _between(found, sizes, [*keys, "_all"], qs).drop("_all", "day")
