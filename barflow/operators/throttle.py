"""Greedy throttle: an event is kept if at least ``gap`` has passed since the last kept event.

Which events are kept depends on the whole past of the key, yet all that a time chunk needs from it
is the last kept time. Three steps, none of which holds a whole key:

1. per (symbol, chunk): for every event that could be the first one kept in the chunk (those within
   one gap of the chunk's first event), where the kept path ends; neighbours with equal ends merge,
2. per symbol: walk those few rows from chunk to chunk, giving each chunk its entry state,
3. per (symbol, chunk): emit the kept events.

Steps 1 and 3 run over sorted partitions, many chunks per numpy call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.functions.frames import group_starts, whole_groups

NEVER = -(2 ** 60)


class Paths:
    """Times of many groups laid end to end on one axis, so that one binary search serves all."""

    def __init__(self, times: np.ndarray, starts: np.ndarray, gap: int):
        self.starts, self.gap = starts, gap
        self.ends = np.append(starts[1:], len(times))
        self.group = np.repeat(np.arange(len(starts)), self.ends - starts)
        first, last = times[starts], times[self.ends - 1]
        room = np.append(0, np.cumsum(last - first + 2 * gap + 2)[:-1])
        self.shift = room - first
        self.axis = times + self.shift[self.group]
        self.jump = self.at_or_after(self.axis + gap, self.group)

    def at_or_after(self, where: np.ndarray, group: np.ndarray) -> np.ndarray:
        """First event at or after an axis position, or the end of the group."""
        found = np.searchsorted(self.axis, where, side="left")
        return np.clip(found, self.starts[group], self.ends[group])


def _path_ends(gap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches):
            times = pdf["_us"].to_numpy()
            paths = Paths(times, group_starts(pdf), gap)
            # candidates of each group: up to and including the first event one gap after its first
            reach = np.minimum(paths.jump[paths.starts] + 1, paths.ends)
            begin = np.flatnonzero(np.arange(len(times)) < reach[paths.group])
            end, stop = begin.copy(), paths.ends[paths.group[begin]]
            while True:
                ahead = paths.jump[end]
                moving = ahead < stop
                if not moving.any():
                    break
                end[moving] = ahead[moving]
            group = paths.group[begin]
            keep = np.ones(len(begin), bool)
            keep[:-1] = (end[:-1] != end[1:]) | (group[:-1] != group[1:])
            rows = begin[keep]
            yield pd.DataFrame({
                "symbol": pdf["symbol"].to_numpy()[rows], "chunk": pdf["chunk"].to_numpy()[rows],
                "first_us": times[rows], "exit_us": times[end[keep]]})

    return run


def _entries(gap: int):
    """Streams path rows sorted by (symbol, chunk, first_us) and yields each chunk's entry state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol = chunk = None
        last, leaves, found = NEVER, NEVER, False
        for batch in batches:
            out = []
            columns = batch[["symbol", "chunk", "first_us", "exit_us"]]
            for s, c, first, leave in columns.itertuples(index=False):
                if s != symbol:
                    symbol, chunk, leaves = s, None, NEVER
                if c != chunk:
                    chunk, last, found = c, leaves, False
                    out.append((s, c, last))
                if not found and first >= last + gap:
                    leaves, found = leave, True
            yield pd.DataFrame(out, columns=["symbol", "chunk", "_entry"])

    return run


def _kept(gap: int, columns: list[str]):
    """Sorted groups whose first row carries the entry state; yields the kept event rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches):
            head = group_starts(pdf)
            events = np.ones(len(pdf), bool)
            events[head] = False
            entry = pdf["_entry"].to_numpy()[head].astype("int64")
            rows = pdf[events].reset_index(drop=True)
            paths = Paths(rows["_us"].to_numpy(), group_starts(rows), gap)
            group = np.arange(len(paths.starts))
            at = paths.at_or_after(entry + gap + paths.shift, group)
            picked = []
            while True:
                live = at < paths.ends[group]
                if not live.any():
                    break
                at, group = at[live], group[live]
                picked.append(at)
                at = paths.jump[at]
            if picked:
                yield rows.iloc[np.sort(np.concatenate(picked))][columns]

    return run


def throttle(events: DataFrame, gap_s: int = 900, chunk_s: int = 14_400, tie: str | None = None,
             ts: str = "ts") -> DataFrame:
    """Events of ``symbol`` kept by the greedy throttle; ``tie`` orders equal times.

    ``chunk_s`` is the time one group of rows covers; lower it for symbols with very dense events.
    """
    gap = gap_s * 1_000_000
    base = events.withColumns({
        "_us": F.unix_micros(ts), "chunk": F.floor(F.unix_seconds(ts) / chunk_s)})
    paths = (
        base.select("symbol", "chunk", "_us").repartition("symbol", "chunk")
        .sortWithinPartitions("symbol", "chunk", "_us")
        .mapInPandas(_path_ends(gap),
                     "symbol string, chunk bigint, first_us bigint, exit_us bigint")
    )
    entries = (
        paths.repartition("symbol").sortWithinPartitions("symbol", "chunk", "first_us")
        .mapInPandas(_entries(gap), "symbol string, chunk bigint, _entry bigint")
    )
    order = ["symbol", "chunk", "_us"] + ([tie] if tie else [])
    headed = base.withColumn("_entry", F.lit(None).cast("bigint")).unionByName(
        entries.withColumn("_us", F.lit(NEVER)), allowMissingColumns=True)
    return (
        headed.repartition("symbol", "chunk").sortWithinPartitions(*order)
        .mapInPandas(_kept(gap, events.columns), events.schema)
    )
