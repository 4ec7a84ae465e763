"""Periodic runs of words by the runs theorem.

Every maximal repetition has a root that is the longest Lyndon word at its place under an
order of the words or under the reverse of it (Bannai et al., "The runs theorem"). A text is
closed by a word of its own that is least under the first order and so greatest under the
second; suffixes then compare under the second exactly the other way round, and one suffix
array serves both:

* the longest Lyndon word at a place ends before the next smaller value of the inverse suffix
  array (for the reverse order, the next greater one);
* a root extends to the right by the longest common prefix of its suffix and the next root's,
  the minimum of the LCP array between their ranks, answered from a sparse table; to the left
  by the same on the reversed text.

A run of three periods or more holds two whole roots, so roots that do not repeat once go
before anything else is asked of them. The suffix arrays of all texts of a slice are built
at once: a suffix is ranked by its text first, so texts do not mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .word_arrays import WordIds, group_starts, numbered, order_of, slices

RUN = "struct<start: bigint, length: bigint, period: bigint>"
#: Rounds of leaps to the next smaller value before places are done one by one.
LEAPS = 24
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_ranks(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rank of each suffix by text and then by symbols, by prefix doubling on what is not yet told apart.

    Each text ends in a symbol 0 that it holds nowhere else.
    """
    n = len(symbols)
    keys = owner * (int(symbols.max()) + 1) + symbols
    order = order_of(keys)
    start = group_starts(keys[order])
    rank = np.empty(n, np.int64)
    rank[order] = start
    open_ = order[np.bincount(start, minlength=n)[start] > 1]
    step = 1
    while len(open_):
        # equal so far, so no closing symbol among the first ``step``: the suffix behind them exists
        keys = rank[open_] * n + rank[open_ + step]
        order = order_of(keys)
        open_, keys = open_[order], keys[order]
        old = rank[open_]
        start = group_starts(keys)
        rank[open_] = old + start - group_starts(old)
        open_ = open_[np.bincount(start, minlength=len(start))[start] > 1]
        step *= 2
    return rank


def lcp_array(symbols: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By rank, the longest common prefix with the suffix one rank below (0 at a closing symbol).

    Only suffixes whose left neighbours differ are compared word by word, in all about
    n log n steps; any other value is its left neighbour's less one.
    """
    n = len(symbols)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    below = np.empty(n, np.int64)
    below[suffix] = np.roll(suffix, 1)
    closing = symbols == 0
    own = (np.roll(symbols, 1) != symbols[below - 1]) | closing
    length = np.zeros(n, np.int64)
    at = np.flatnonzero(own & ~closing)
    other, width = below[at], 1
    while len(at):
        reach = length[at][:, None] + np.arange(width)
        same = symbols[np.minimum(at[:, None] + reach, n - 1)] == symbols[np.minimum(other[:, None] + reach, n - 1)]
        whole = same.all(axis=1)
        length[at] += np.where(whole, width, same.argmin(axis=1))
        at, other = at[whole], other[whole]
        width = min(64, 2 * width)
    from_ = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return (length[from_] - (np.arange(n) - from_))[suffix]


def common_prefixes(rank: np.ndarray, lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefix of the suffixes at ``a`` and ``b`` (of one text, not the same).

    A range minimum by two overlapping powers of two; a level of the sparse table answers
    its questions as soon as it is built, so one level is held at a time.
    """
    low, high = np.minimum(rank[a], rank[b]) + 1, np.maximum(rank[a], rank[b]) + 1
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    table = lcp
    for now in range(int(level.max()) + 1 if len(a) else 0):
        if now:
            half = 1 << (now - 1)
            table = np.minimum(table[:-half], table[half:])
        ask = np.flatnonzero(level == now)
        out[ask] = np.minimum(table[low[ask]], table[high[ask] - (1 << now)])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next place with a smaller value, or the end (values are not negative).

    All places leap at once from the next candidate to that one's own; where long descending
    stretches make the leaps many, the places left are done one by one.
    """
    closed = np.append(values, -1)
    out = np.arange(1, len(closed))
    open_ = np.flatnonzero(closed[out] > values)
    for _ in range(LEAPS):
        if not len(open_):
            return out
        out[open_] = out[out[open_]]
        open_ = open_[closed[out[open_]] > values[open_]]
    found, value = out.tolist(), closed.tolist()
    for at in open_[::-1].tolist():  # from the right, so each leap is over a finished stretch
        ahead = found[at]
        while value[ahead] > value[at]:
            ahead = found[ahead]
        found[at] = ahead
    return np.array(found, np.int64)


def runs_of(symbols: np.ndarray, begins: np.ndarray, least: int, times: int) -> tuple[np.ndarray, ...]:
    """``text, start, length, period`` of all runs of a slice, in order of text, start and period.

    ``symbols`` are word numbers from 1, each text closed by a 0; ``begins`` says where texts
    begin. A run is at least ``least`` words long and ``times`` (2 or more) periods.
    """
    sizes = np.diff(begins)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    end = (begins[1:] - 1)[owner]
    rank = suffix_ranks(symbols, owner)
    place = np.arange(len(symbols))
    first, period = [], []
    for values in (rank, len(symbols) - rank):
        span = np.minimum(next_smaller(values), end + 1) - place
        # two roots fit before the end; where runs are shorter than three roots, one and a word must do
        fits = np.flatnonzero(place + (2 if times > 2 else 1) * span + (times == 2) <= end)
        fits = fits[symbols[fits] == symbols[fits + span[fits]]]
        first.append(fits)
        period.append(span[fits])
    at, period = np.concatenate(first), np.concatenate(period)
    empty = np.empty(0, np.int64)
    if not len(at):
        return empty, empty, empty, empty
    right = common_prefixes(rank, lcp_array(symbols, rank), at, at + period)
    if times > 2:
        at, period, right = (x[right >= period] for x in (at, period, right))
    if not len(at):
        return empty, empty, empty, empty
    left = _left_extensions(symbols, begins, owner, at, period)
    start, length = at - left, left + period + right
    good = length >= np.maximum(least, times * period)
    found = np.unique(np.stack([start[good], period[good], length[good]]), axis=1)
    text = owner[found[0]]
    return text, found[0] - begins[text], found[2], found[1]


def _left_extensions(symbols, begins, owner, at, period) -> np.ndarray:
    """How far each root's period goes on to its left, from the reversed texts that hold a root."""
    texts, new = np.unique(owner[at], return_inverse=True)
    parts = [np.append(symbols[begins[t] : begins[t + 1] - 1][::-1], 0) for t in texts.tolist()]
    symbols = np.concatenate(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    last = np.cumsum(sizes) - 2  # of each reversed text, its first word
    rank = suffix_ranks(symbols, np.repeat(np.arange(len(sizes)), sizes))
    a = last[new] - (at - 1 - begins[texts][new])
    out = np.zeros(len(at), np.int64)
    inner = at > begins[texts][new]
    out[inner] = common_prefixes(rank, lcp_array(symbols, rank), a[inner], a[inner] - period[inner])
    return out


def _detect(least: int, times: int):
    def run(batches):
        ids = WordIds()
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                texts = [t.split() if t else [] for t in part]
                symbols, begins = numbered(texts, ids)
                text, start, length, period = runs_of(symbols, begins, least, times)
                # +1 where a run's words behind its first period begin, -1 where they end
                change = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(change, begins[text] + start + period, 1)
                np.add.at(change, begins[text] + start + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                for t in np.unique(text).tolist():
                    texts[t] = [texts[t][i] for i in np.flatnonzero(keep[begins[t] : begins[t + 1] - 1])]
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(text, np.arange(len(part) + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN)),
                )
                collapsed = pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(part)), pa.array(np.diff(begins) - 1, pa.int64()), runs, collapsed], names=["id", "n_words", "runs", "collapsed"]
                )
                at += len(part)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, runs, collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, as they stand. ``runs`` are all maximal stretches of at
    least ``least`` words and ``times`` (2 or more) smallest periods, as structs ``start,
    length, period`` in words from 0, ordered by start, then period. ``collapsed`` is the text
    without the words that any run holds behind its first period, joined by one space.

    A null or empty text has no words, no runs and an empty ``collapsed``; a row without id
    keeps its null; repeated rows are judged each; other columns are ignored and may have any
    name; an empty table gives an empty result. A text is worked on as a whole in one task, in
    memory of about 200 bytes a word and time n log n.
    """
    if least < 1 or times < 2:
        raise ValueError("runs need at least one word and two periods")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = rows.mapInArrow(_detect(least, times), f"id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def runs_text(runs):
    """Every run as ``start,length,period`` and a line feed."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def strongest(runs):
    """The run of greatest length over period; of equal ones that with the least start, then period."""
    none = F.lit(None).cast(RUN)
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
