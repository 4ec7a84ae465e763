"""Sequences of actions over a stream whose rows come late and out of order, by keyed state and timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

OUT = "market string, wallet long, sequence long, begin long, finish long, n_actions long, gross double, direction int"
#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Groups of wallets that share a state, unless told otherwise.
GROUPS = 64
_WAITING = {"market": str, "wallet": "int64", "sec": "int64", "action": str, "direction": "int64", "gross": "float64"}
_OPEN = {"market": str, "wallet": "int64", "sequence": "int64", "begin": "int64", "finish": "int64", "n_actions": "int64", "gross": "float64", "direction": "int64"}


def _schema(columns: dict) -> str:
    kinds = {str: "string", "int64": "long", "float64": "double"}
    return ", ".join(f"{name} array<{kinds[kind]}>" for name, kind in columns.items())


class _Sequences(StatefulProcessor):
    """Per group of wallets: actions that the watermark has not passed, and the sequences that are still open, as columns."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", _schema(_WAITING))
        self.open = handle.getValueState("open", _schema(_OPEN))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        new = [part.loc[part["known"] & (part["sec"] * 1000 >= mark), list(_WAITING)] for part in rows]
        yield from self._settle(pd.concat([self._held(self.waiting, _WAITING), *new], ignore_index=True), mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(self._held(self.waiting, _WAITING), timerValues.getCurrentWatermarkInMs())

    @staticmethod
    def _held(state, columns: dict) -> pd.DataFrame:
        import pandas as pd

        kept = state.get() if state.exists() else [[] for _ in columns]
        return pd.DataFrame({name: pd.Series(list(values), dtype=object if kind is str else kind) for (name, kind), values in zip(columns.items(), kept)})

    @staticmethod
    def _keep(state, rows: pd.DataFrame, columns: dict) -> None:
        if len(rows):
            state.update(tuple(rows[name].tolist() for name in columns))
        else:
            state.clear()

    def _settle(self, held: pd.DataFrame, mark: int) -> Iterator[pd.DataFrame]:
        """Actions before the watermark are final, in order of time and action; a sequence is when none can join it."""
        import numpy as np
        import pandas as pd

        final = held["sec"] * 1000 < mark
        rest = held[~final]
        acts = held[final].sort_values(["sec", "action", "direction", "gross"])
        acts = acts.assign(sequence=1, begin=acts["sec"], finish=acts["sec"], n_actions=1)[list(_OPEN)]
        # the open sequence of a wallet comes before its actions
        at = pd.concat([self._held(self.open, _OPEN), acts], ignore_index=True).sort_values(["market", "wallet"], kind="stable", ignore_index=True)
        if len(at):
            before = at.shift()
            same = (at["market"] == before["market"]) & (at["wallet"] == before["wallet"])
            joins = same & (before["n_actions"] > 0) & (at["direction"] == before["direction"]) & (at["begin"] - before["finish"] <= self.gap)
            first = np.flatnonzero(~joins)
            last = np.append(first[1:], len(at)) - 1
            runs = at.iloc[first].assign(
                finish=at["finish"].to_numpy()[last], n_actions=np.add.reduceat(at["n_actions"].to_numpy(), first), gross=np.add.reduceat(at["gross"].to_numpy(), first),
            )
            starts = ~same.to_numpy()[first]  # of a wallet, whose sequences are numbered from its open one
            lead = np.flatnonzero(starts)[np.cumsum(starts) - 1]
            runs["sequence"] = runs["sequence"].to_numpy()[lead] + np.arange(len(runs)) - lead
            newest = np.append(starts[1:], True)
            ended = ~newest | ((runs["finish"].to_numpy() + self.gap) * 1000 < mark)
            out = runs[ended & (runs["n_actions"].to_numpy() > 0)]
            if len(out):
                yield out
            runs.loc[ended, ["n_actions", "gross", "direction"]] = 0  # only the number goes on
            at = runs[newest]
        self._keep(self.open, at, _OPEN)
        self._keep(self.waiting, rest, _WAITING)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [*rest["sec"], *(at["finish"] + self.gap)[at["n_actions"] > 0]]
        if due:
            self.handle.registerTimer(int(min(due)) * 1000 + 1)

    def close(self) -> None:
        pass


def sequences(actions: DataFrame, gap: int, late: str, groups: int = GROUPS) -> DataFrame:
    """Closed sequences of a stream ``market, wallet, sec, action, direction, gross`` with an event time ``at``.

    A sequence ends on a change of direction or a gap of more than ``gap`` seconds, and is
    written once, when the watermark says that nothing can join it any more. Rows may come in
    any order within ``late``; later ones are left out. State holds the rows of the last
    ``late`` and one open sequence per market and wallet, whose number goes on for good. Rows
    without market or wallet only move the watermark.

    Wallets are dealt into ``groups``, and a batch reads and writes the state of a group as a
    whole, so calls go with groups and not with wallets; a task holds a group's state.
    """
    known = F.col("market").isNotNull() & F.col("wallet").isNotNull()  # a filter would go below the watermark
    dealt = actions.withWatermark("at", late).withColumns({
        "known": known, "group": F.pmod(F.xxhash64("market", "wallet"), F.lit(groups)), "market": F.coalesce("market", F.lit("")), "wallet": F.coalesce("wallet", F.lit(0)),
    })
    return dealt.groupBy("group").transformWithStateInPandas(_Sequences(gap), OUT, "append", "EventTime")
