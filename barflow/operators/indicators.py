"""Recursive indicators over a bounded lookback, without a recursion per row.

Smoothing ``y = (1-a)*y + a*x`` over the last ``span`` values is a fixed weighting of them: a seed
(mean of the first ``n``) that decays, plus geometric weights. With q = 1-a, the running sums of
x*q**-pos and of x over a chunk give every row's value by subtraction, so one row costs O(1) for any
lookback and stays in JVM window expressions. Only the trend index (ADX) is not linear in its
inputs; it is folded step by step over numpy vectors.

Columns ``idx``, ``chunk``, ``pos`` come from ``series.with_row_index`` and ``series.halo_chunks``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.functions.frames import group_starts, whole_groups

CHUNK_ROWS = 4096


def bar_window(key: str = "symbol") -> Window:
    return Window.partitionBy(key, "chunk").orderBy("pos")


@dataclass(frozen=True)
class Smooth:
    """One bounded recursive smoothing.

    x: input column; n: period; alpha: step; span: number of x values in the lookback slice;
    first: index of the first row that has an x (1 for differences); seed: ``sma`` (mean of the
    first n values), ``first`` (first value) or ``weighted`` (normalized geometric weights).
    """

    out: str
    x: str
    n: int
    alpha: float
    span: int
    first: int = 0
    seed: str = "sma"


def ema(out: str, x: str, n: int, lookback: int, seed: str = "sma") -> Smooth:
    return Smooth(out, x, n, 2.0 / (n + 1), lookback, 0, seed)


def wilder(out: str, x: str, n: int, lookback: int, seed: str = "sma") -> Smooth:
    """Wilder smoothing of a difference series: ``lookback`` bars hold ``lookback - 1`` values."""
    return Smooth(out, x, n, 1.0 / n, lookback - 1, 1, seed)


_W = "OVER (PARTITION BY symbol, chunk ORDER BY pos"
UPTO = f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def with_smooths(df: DataFrame, smooths: list[Smooth], rows: int = CHUNK_ROWS) -> DataFrame:
    """Add every smoothing; all window steps share one partitioning and one order."""
    sums, seeds, results = [], [], []
    for s in smooths:
        q = 1.0 - s.alpha
        if (rows + s.span) * abs(math.log(q)) > 600:
            raise ValueError("chunk too long for the weights of " + s.out)
        p, t, n0 = f"_p_{s.out}", f"_t_{s.out}", {"sma": s.n, "first": 1, "weighted": 0}[s.seed]
        power = f"power({q!r}D, CAST({{}} AS DOUBLE))"
        sums += [f"coalesce(sum({s.x} * {power.format('-pos')}) {UPTO}, 0D) AS {p}",
                 f"coalesce(sum({s.x}) {UPTO}, 0D) AS {t}"]
        # both sums at the last seed row: a fixed lag for a full slice, the series head otherwise
        head = f"max(CASE WHEN idx = {s.first + n0 - 1} THEN {{0}} END) {UPTO}"
        full = f"idx - {s.first} + 1 >= {s.span}"
        at_seed = f"CASE WHEN {full} THEN lag({{0}}, {s.span - n0}) {_W}) ELSE {head} END"
        seeds += [f"coalesce({at_seed.format(p)}, 0D) AS _ps_{s.out}",
                  f"{at_seed.format(t)} - CASE WHEN {full} THEN coalesce(lag({t}, {s.span}) {_W}), "
                  f"0D) ELSE 0D END AS _ts_{s.out}"]
        have = f"idx - {s.first} + 1"
        m = f"least({have}, {s.span})"
        fresh = f"({p} - _ps_{s.out}) * {power.format('pos')} * {s.alpha!r}D"
        if n0:
            value = f"{power.format(f'{m} - {n0}')} * _ts_{s.out} / {n0} + {fresh}"
        else:
            value = f"({fresh}) / (1 - {power.format(m)})"
        results.append(f"CASE WHEN {have} >= {s.n} THEN {value} END AS {s.out}")
    return df.selectExpr("*", *sums).selectExpr("*", *seeds).selectExpr(*df.columns, *results)


def with_differences(df: DataFrame) -> DataFrame:
    """Gain, loss and true range against the previous bar; null on the first bar of a series."""
    prev = f"lag(c) {_W})"
    return df.selectExpr("*", f"{prev} AS _pc").selectExpr(
        *df.columns,
        "CASE WHEN _pc IS NOT NULL THEN greatest(c - _pc, 0D) END AS gain",
        "CASE WHEN _pc IS NOT NULL THEN greatest(_pc - c, 0D) END AS loss",
        "CASE WHEN _pc IS NOT NULL THEN greatest(h - l, abs(h - _pc), abs(l - _pc)) END "
        "AS true_range")


def with_rsi(df: DataFrame, lookback: int = 100, n: int = 14, out: str = "rsi",
             seed: str = "sma") -> DataFrame:
    """Relative strength of the last ``lookback`` bars; needs ``gain`` and ``loss``."""
    up, down = f"_up_{out}", f"_down_{out}"
    smoothed = with_smooths(df, [wilder(up, "gain", n, lookback, seed),
                                 wilder(down, "loss", n, lookback, seed)])
    return smoothed.selectExpr(*df.columns, rsi_of(up, down) + f" AS {out}")


def rsi_of(up: str, down: str) -> str:
    """Subtraction can leave a sum of zeros a few ulps off, so both means are floored at zero."""
    u, d = f"greatest({up}, 0D)", f"greatest({down}, 0D)"
    return f"try_divide({u} * 100, {u} + {d})"


def with_atr(df: DataFrame, lookback: int = 100, n: int = 14, out: str = "atr",
             seed: str = "sma") -> DataFrame:
    return with_smooths(df, [wilder(out, "true_range", n, lookback, seed)])


def adx_of_rows(high: np.ndarray, low: np.ndarray, rows: np.ndarray, starts: np.ndarray,
                 n: int) -> np.ndarray:
    """ADX at positions ``rows``, each over its own slice from ``starts``.

    Directional moves are smoothed from a mean of n values, the index from a mean of its first n
    values. Step j handles the j-th bar of all slices at once. Slices with fewer than 2n bars give 0.
    """
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus = np.where((up > down) & (up > 0), up, 0.0)
    minus = np.where((down > up) & (down > 0), down, 0.0)
    length = rows - starts
    p, m, total, adx = (np.zeros(len(rows)) for _ in range(4))
    for j in range(1, int(length.max(initial=0)) + 1):
        live = np.flatnonzero(j <= length)
        at = starts[live] + j
        if j <= n:
            p[live] += plus[at] / n
            m[live] += minus[at] / n
        else:
            p[live] += (plus[at] - p[live]) / n
            m[live] += (minus[at] - m[live]) / n
        if j >= n:
            both = p[live] + m[live]
            dx = 100.0 * np.abs(p[live] - m[live]) / np.where(both > 0, both, 1.0)
            if j < 2 * n:
                total[live] += dx
                if j == 2 * n - 1:
                    adx[live] = total[live] / n
            else:
                adx[live] += (dx - adx[live]) / n
    return np.where(length >= 2 * n - 1, adx, 0.0)


def with_adx(df: DataFrame, lookback: int = 100, n: int = 14, out: str = "adx",
             only: Column | None = None, placed: bool = True) -> DataFrame:
    """Bounded-lookback ADX. With ``only`` the fold, and the result, hold just the rows it marks.
    Halo rows leave no output.

    Works on partitions sorted by (symbol, chunk, pos), many chunks per numpy call. Input straight
    from ``features.prepared`` and window columns over it is placed that way already; the sort below
    then costs nothing. Other input needs ``placed=False``.
    """
    want = "NOT is_halo" if only is None else None
    marked = df.selectExpr("*", f"{want} AS _want") if want else df.withColumn(
        "_want", F.coalesce(only, F.lit(False)) & ~F.col("is_halo"))
    if not placed:
        marked = marked.repartition("symbol", "chunk")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches):
            heads = group_starts(pdf)
            rows = np.flatnonzero(pdf.pop("_want").to_numpy(bool))
            begin = heads[np.searchsorted(heads, rows, side="right") - 1]
            values = adx_of_rows(pdf["h"].to_numpy(), pdf["l"].to_numpy(), rows,
                                 np.maximum(rows - lookback + 1, begin), n)
            yield pdf.iloc[rows].assign(**{out: values})

    return marked.sortWithinPartitions("symbol", "chunk", "pos").mapInPandas(fold, schema)
