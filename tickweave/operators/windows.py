"""Past-only thresholds, ranks and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .order_statistics import expanding_quantiles


def past_only_quantiles(
    rows: DataFrame, qs: list[float], least: int, days: int | None = None, key: str = "market", day: str = "dy", value: str = "value"
) -> DataFrame:
    """Per key and day: ``history`` (values on earlier days) and ``q0, q1, ...`` of them.

    ``days`` limits the history to so many days before. Quantiles interpolate linearly and
    are null for fewer than ``least`` values. An expanding history goes by running histograms,
    which copy no row; in a limited one a day's values meet at most ``days`` later days as
    counts per distinct value.
    """
    if days is None:
        return expanding_quantiles(rows, qs, least, key, day, value)
    evaluated = rows.select(key, day).distinct()
    counts = rows.groupBy(key, day, value).agg(F.count(F.lit(1)).alias("_n"))
    spread = counts.withColumn("_at", F.explode(F.sequence(F.col(day) + 1, F.col(day) + days)))
    at = ", ".join(map(repr, qs))
    found = spread.groupBy(key, F.col("_at").alias(day)).agg(F.sum("_n").alias("history"), F.expr(f"percentile({value}, array({at}), _n)").alias("_q"))
    out = evaluated.join(found, [key, day], "left").withColumn("history", F.coalesce("history", F.lit(0)).cast("long"))
    return out.select(key, day, "history", *[F.when(F.col("history") >= least, F.col("_q")[i]).alias(f"q{i}") for i in range(len(qs))])


#: Rank error of the approximate quantile that limits what is sorted, as one over this.
ACCURACY = 1_000


def top_percent(rows: DataFrame, percent: float, by: str, tie: str, within: list[str]) -> DataFrame:
    """Exactly ``max(1, ceil(n * percent / 100))`` rows of each group, largest first, ties by ``tie``.

    Only rows above an approximate quantile are sorted: it lies low enough for its rank error
    (three times ``1 / ACCURACY``; it is exact for small groups), so none of the rows asked for
    is left out and a window holds little more than them. Rows whose group is null are left out.
    """
    low = F.percentile_approx(by, F.lit(max(0.0, 1 - percent / 100 - 3 / ACCURACY)), F.lit(ACCURACY))
    sizes = rows.groupBy(*within).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * percent / 100)).alias("_most"), low.alias("_low"))
    place = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(by), F.asc(tie)))
    near = rows.join(sizes, within).where(F.col(by) >= F.col("_low"))
    return near.withColumn("place", place).where("place <= _most").select(*rows.columns, "place")


def trailing_sum(value: str, key: str, at: str, seconds: int) -> Column:
    """Sum over the ``seconds`` before a row, its own time excluded; 0 where there is none."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0))


def daily_past_totals(rows: DataFrame, days: int | None, key: str = "wallet", day: str = "dy", value: str = "value") -> DataFrame:
    """``key, day, past, actions``: per day of the span, each key's total over the days before.

    Keys are known from their first day on; with ``days`` only those active in that many days
    before stay. Wallet-days are pre-aggregated, so the window runs over at most one row per
    key and day. An expanding total holds from a day after one of the key's days to its next
    one, and only then is it written out by day.
    """
    daily = rows.groupBy(key, day).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
    if days is None:
        last = rows.agg(F.max(day)).first()[0]
        w = Window.partitionBy(key).orderBy(day)
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        held = daily.select(
            key, day, F.coalesce(F.lead(day).over(w), F.lit(last)).alias("_until"), F.sum("_v").over(so_far).alias("past"), F.sum("_n").over(so_far).alias("actions"), F.count(F.lit(1)).over(so_far).alias("active_days")
        ).where(F.col(day) < F.col("_until"))
        return held.withColumn(day, F.explode(F.sequence(F.col(day) + 1, F.col("_until")))).drop("_until")
    spread = daily.withColumn("_at", F.explode(F.sequence(F.col(day) + 1, F.col(day) + days)))
    return spread.groupBy(key, F.col("_at").alias(day)).agg(F.sum("_v").alias("past"), F.sum("_n").alias("actions"), F.count(F.lit(1)).alias("active_days"))


def next_opposite(rows: DataFrame, keys: list[str], order: list[str], sign: str, time: str) -> DataFrame:
    """``next_opposite_sec``: time of the first later row of the other sign, in one pass from the end."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    later = {s: F.last(F.when(F.col(sign) == s, F.col(time)), ignorenulls=True).over(w) for s in (1, -1)}
    return rows.withColumn("next_opposite_sec", F.when(F.col(sign) == 1, later[-1]).otherwise(later[1]))


def first_opposite(rows: DataFrame, keys: list[str], sign: str, time: str, name: str) -> DataFrame:
    """``first_opposite``: ``time`` and ``name`` of the first row of the other sign at a later time, ties to the smaller name.

    One window from the end holds the least later row of each sign; no pairs are made.
    """
    w = Window.partitionBy(*keys).orderBy(-F.col(time)).rangeBetween(Window.unboundedPreceding, -1)
    later = {s: F.min(F.when(F.col(sign) == s, F.struct(F.col(time).alias("time"), F.col(name).alias("name")))).over(w) for s in (1, -1)}
    return rows.withColumn("first_opposite", F.when(F.col(sign) == 1, later[-1]).otherwise(later[1]))


def sequences(rows: DataFrame, keys: list[str], order: list[str], sign: str, time: str, gap: int) -> DataFrame:
    """``sequence``: number of the run a row belongs to; a run ends on a change of sign or a longer gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    starts = F.lag(time).over(w).isNull() | (F.lag(sign).over(w) != F.col(sign)) | (F.col(time) - F.lag(time).over(w) > gap)
    return rows.withColumn("_starts", starts.cast("long")).withColumn("sequence", F.sum("_starts").over(w)).drop("_starts")


#: Length of a block of time in gaps.
BLOCK_GAPS = 64


def thinned(rows: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """Rows at least ``gap`` after the last one that stayed, per key, from the first on.

    What stays depends on what stayed before. Time is cut into blocks of ``BLOCK_GAPS`` gaps;
    a walk through a block can only begin at one of its times up to a gap after its start, or
    at the next one, and leaves at a bound that looks up the time in a later block at which
    the walk goes on. So each block is a table from ways in to ways out, a task holds the
    distinct times of one block, and which ways in are taken follows from the first by
    pointer doubling, in as many rounds as the blocks of a key have binary digits. Rows
    without key or time are left out.
    """
    import numpy as np
    import pyarrow as pa

    width = max(1, gap) * BLOCK_GAPS
    block = F.floor(F.col("_t") / width)
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    times = cut(rows.select(*keys, F.col(time).cast("long").alias("_t")).where(known).distinct().withColumn("_block", block))
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def same(table: pa.Table, n: int) -> dict:
        return {k: pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in keys}

    def ways(table: pa.Table) -> pa.Table:
        t = np.sort(table.column("_t").to_numpy())
        onward = np.searchsorted(t, t + gap)
        leave = t + gap
        for i in np.flatnonzero(onward < len(t))[::-1]:  # from the end: a way in leaves where its next time does
            leave[i] = leave[onward[i]]
        into = int(np.searchsorted(t, table.column("_block")[0].as_py() * width + gap, side="right")) + 1
        return pa.table({**same(table, len(t[:into])), "_in": t[:into], "_bound": leave[:into]})

    heads = times.groupBy(*keys, "_block").applyInArrow(ways, f"{kinds}, _in long, _bound long")
    jumps = cut(_first_from(heads, times, keys, width))
    first = times.groupBy(*keys).agg(F.min("_t").alias("_in"))
    reached = cut(first)
    while True:
        step = jumps.where("_out is not null").select(*keys, "_in", "_out")
        ahead = reached.join(step, [*keys, "_in"]).select(*keys, F.col("_out").alias("_in"))
        more = cut(reached.unionByName(ahead).distinct())
        if more.count() == reached.count():
            break
        reached = more
        twice = step.select(*keys, F.col("_in").alias("_out"), F.col("_out").alias("_far"))
        jumps = cut(step.join(twice, [*keys, "_out"], "left").select(*keys, "_in", F.col("_far").alias("_out")))

    def walk(table: pa.Table) -> pa.Table:
        t, at, kept = np.sort(table.column("_t").to_numpy()), table.column("_in")[0].as_py(), []
        place = int(np.searchsorted(t, at))
        while place < len(t):
            kept.append(place)
            place = int(np.searchsorted(t, t[place] + gap))
        return pa.table({**same(table, len(kept)), time: t[kept]})

    entered = times.join(reached.select(*keys, "_in", F.floor(F.col("_in") / width).alias("_block")), [*keys, "_block"])
    kept = entered.groupBy(*keys, "_block").applyInArrow(walk, f"{kinds}, {time} long")
    return rows.join(kept, [*keys, time], "left_semi")


def _first_from(heads: DataFrame, times: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys, _in, _out``: the key's first time at or after ``_bound``, which lies in the way in's own block or the one behind it."""
    import numpy as np
    import pyarrow as pa

    def look_up(asked: pa.Table, there: pa.Table) -> pa.Table:
        t, bound = np.sort(there.column("_t").to_numpy()), asked.column("_bound").to_numpy()
        at = np.searchsorted(t, bound)
        out = pa.array([int(t[i]) if i < len(t) else None for i in at], pa.int64())
        return pa.table({**{k: asked.column(k) for k in keys}, "_bound": bound, "_out": out})

    kinds = ", ".join(f"{k} {heads.schema[k].dataType.simpleString()}" for k in keys)
    heads = cut(heads).withColumn("_block", F.floor(F.col("_bound") / width))
    asked = heads.select(*keys, "_bound", "_block").distinct().groupBy(*keys, "_block")
    found = asked.cogroup(times.groupBy(*keys, "_block")).applyInArrow(look_up, f"{kinds}, _bound long, _out long")
    w = Window.partitionBy(*keys).orderBy("_own")  # one row per key and block
    blocks = times.groupBy(*keys, F.col("_block").alias("_own")).agg(F.min("_t").alias("_least")).select(
        *keys, "_own", F.lead("_own").over(w).alias("_then"), F.lead("_least").over(w).alias("_one_on"), F.lead("_least", 2).over(w).alias("_two_on")
    )
    at = heads.withColumn("_own", F.floor(F.col("_in") / width)).join(blocks, [*keys, "_own"]).join(found, [*keys, "_bound"])
    behind = F.when(F.col("_then") == F.col("_block"), F.col("_two_on")).otherwise(F.col("_one_on"))
    return at.select(*keys, "_in", F.coalesce("_out", behind).alias("_out"))


def numbered(rows: DataFrame, blocks: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 in the order of ``blocks``, then ``order``.

    Blocks are numbered within themselves; where a block begins comes from the counts, one row
    per block, so no task sorts the whole table.
    """
    counts = rows.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n"))
    begin = F.coalesce(F.sum("_n").over(Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy(*blocks).orderBy(*order))
    return rows.withColumn("_place", within).join(counts.withColumn("_before", begin).drop("_n"), blocks).withColumn(name, F.col("_before") + F.col("_place")).drop("_before", "_place")


def bisected(rows: DataFrame, key: str, time: str, widest: int, halvings: int, most: int) -> DataFrame:
    """``key, begin, finish, n``: windows of ``widest`` seconds, halved (at most so often) while they hold more than ``most`` rows.

    All levels are counted from the narrowest, so rows are shuffled once.
    """
    narrow = widest >> halvings
    cells = rows.groupBy(key, F.floor(F.col(time) / narrow).alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("_slot", halvings - i).alias("slot")) for i in range(halvings + 1)]))
    counts = cells.select(key, "_n", levels.alias("_l")).groupBy(key, "_l.level", "_l.slot").agg(F.sum("_n").alias("n"))
    full = counts.where(F.col("n") > most).select(key, (F.col("level") + 1).alias("level"), F.col("slot").alias("_up"))
    found = counts.withColumn("_up", F.shiftright("slot", 1)).join(full.withColumn("_open", F.lit(True)), [key, "level", "_up"], "left")
    width = narrow * F.pow(F.lit(2), F.lit(halvings) - F.col("level")).cast("long")
    stays = ((F.col("level") == 0) | F.col("_open").isNotNull()) & ((F.col("n") <= most) | (F.col("level") == halvings))
    return found.where(stays).select(key, (F.col("slot") * width).alias("begin"), ((F.col("slot") + 1) * width).alias("finish"), "n")


def running(cells: DataFrame, order: str, sums: dict[str, str], descending: bool = False, blocks: int = 64) -> DataFrame:
    """``cells`` with running sums over the rows before each in the order of one numeric column.

    ``sums`` maps new columns to the summed ones. The column's range is cut into blocks at
    approximate quantiles; a window runs within a block, and what earlier blocks hold comes
    from their totals, so no task has all rows. Values of ``order`` must differ.
    """
    cuts = sorted(set(cells.approxQuantile(order, [i / blocks for i in range(1, blocks)], 0.1 / blocks)))
    block = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    sign = -1 if descending else 1
    at = cells.withColumn("_block", block * sign)
    key = F.desc(order) if descending else F.asc(order)
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    totals = at.groupBy("_block").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    carried = totals.select("_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums])
    own = at.withColumns({f"_w_{n}": F.coalesce(F.sum(v).over(within), F.lit(0)) for n, v in sums.items()})
    return own.join(F.broadcast(carried), "_block").withColumns({n: F.col(f"_w_{n}") + F.col(f"_c_{n}") for n in sums}).select(*cells.columns, *sums)
