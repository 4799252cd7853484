"""Bar features read at the newest bar of each slice: one window per (symbol, chunk)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.operators import indicators as ind
from barflow.operators import series

LOOKBACK = 100
DAY_BARS = 96


def prepared(bars: DataFrame, lookback: int = LOOKBACK, rows: int = ind.CHUNK_ROWS) -> DataFrame:
    """Bars with row index, halo chunks and differences; input of everything below.

    The rows of a chunk are brought together here, once; every window over (symbol, chunk) and the
    trend index reuse that placement.
    """
    chunks = series.halo_chunks(series.with_row_index(bars), rows, lookback)
    return ind.with_differences(chunks.repartition("symbol", "chunk"))


def percent_change(now, then) -> Column:
    return (F.try_divide(now, then) - 1) * 100


_W = "OVER (PARTITION BY symbol, chunk ORDER BY pos"


def _frame(lo: int, hi: int = 0) -> str:
    end = "CURRENT ROW" if hi == 0 else f"{hi} PRECEDING"
    return f"{_W} ROWS BETWEEN {lo} PRECEDING AND {end})"


def with_volume(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean volume of n bars (null until n), ratio to it (0 if the mean is not positive), and
    whether the last three bars traded less than it."""
    return df.selectExpr(
        "*", f"CASE WHEN idx >= {n - 1} THEN avg(v) {_frame(n - 1)} END AS vol_mean",
        f"avg(v) {_frame(2)} AS _v3",
    ).selectExpr(
        *df.columns, "vol_mean", "CASE WHEN vol_mean > 0 THEN v / vol_mean ELSE 0D END AS vol_ratio",
        "coalesce(vol_mean > 0 AND _v3 < vol_mean, false) AS vol_faded")


def with_structure(df: DataFrame) -> DataFrame:
    """Break above the highs of lags 9..2, and a green bar opening below a red bar's close."""
    return df.selectExpr(
        "*", f"coalesce(c > max(h) {_frame(9, 2)}, false) AS msb",
        f"coalesce(lag(c) {_W}) < lag(o) {_W}) AND c > o AND o < lag(c) {_W}), false) AS engulf")


def with_moves(df: DataFrame) -> DataFrame:
    """Rise over 12 and 24 bars (from the first bar of a short series) and distance to the day's
    high, in percent."""
    head = f"first(c) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rise = f"(try_divide(c, coalesce(lag(c, {{}}) {_W}), {head})) - 1) * 100"
    return df.selectExpr(
        "*", f"{rise.format(12)} AS pump_3h", f"{rise.format(24)} AS pump_6h",
        f"max(h) {_frame(DAY_BARS - 1)} AS _top",
    ).selectExpr(
        *df.columns, "pump_3h", "pump_6h",
        "CASE WHEN _top > 0 THEN (_top - c) / _top * 100 ELSE 0D END AS high_distance")


def with_closed_confirm(df: DataFrame) -> DataFrame:
    """Previous bar green with more volume than the current mean volume (needs ``vol_mean``)."""
    return df.selectExpr("*", f"CAST(coalesce(lag(c) {_W}) > lag(o) {_W}) AND lag(v) {_W}) > "
                              "vol_mean, false) AS INT) AS closed_confirm")


def with_ema_distance(df: DataFrame, ema: str, out: str, price: str = "c") -> DataFrame:
    """Percent distance of the price from an average; 0 where the average is not positive."""
    return df.withColumn(out, F.when(F.col(ema) > 0, percent_change(F.col(price), F.col(ema)))
                         .otherwise(0.0))


def hourly_trend(hourly: DataFrame, lookback: int = 50, n: int = 20) -> DataFrame:
    """Per hourly bar: EMA over the slice that ends there (``ema_1h``) and, for slices whose last
    bar is still open, the EMA over one bar less (``ema_1h_before``). With n - 1 bars that EMA has no
    value yet, but with the open bar there are n: ``first_sum`` adds up the n - 1."""
    df = ind.with_smooths(prepared(hourly, lookback), [
        ind.ema("ema_1h", "c", n, lookback), ind.ema("ema_1h_before", "c", n, lookback - 1)])
    first = F.sum("c").over(ind.bar_window().rowsBetween(-(n - 2), 0))
    df = df.withColumn("first_sum", F.when(F.col("idx") == n - 2, first))
    return series.drop_halo(df).select("symbol", "ts", "ema_1h", "ema_1h_before", "first_sum")


def with_hourly_trend(bars: DataFrame, trend: DataFrame, mode: str = "closed",
                      n: int = 20) -> DataFrame:
    """Attach the hourly EMA(20) known at the close of each 15-minute bar.

    ``closed``: the last hour that has ended by then. ``live``: the running hour counts as a bar
    whose close is the current price, so its EMA is one step on from the hours before it, or the mean
    of the first n hours, itself the last of them.
    """
    closes = bars.withColumn("_at", F.col("ts") + F.expr("INTERVAL 15 MINUTES"))
    if mode == "closed":
        known = trend.withColumn("known_at", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
        return series.asof(closes, known.select("symbol", "known_at", "ema_1h"), ["ema_1h"],
                           left_ts="_at", right_ts="known_at").drop("_at")
    if mode != "live":
        raise ValueError("mode is 'closed' or 'live'")
    # hours that ended before the hour this bar belongs to
    known = trend.withColumn("known_at", F.col("ts") + F.expr("INTERVAL 1 HOUR")).drop("ts")
    alpha = 2.0 / (n + 1)
    return (
        series.asof(closes.drop("_at"), known, ["ema_1h_before", "first_sum"], right_ts="known_at")
        .withColumn("ema_1h", F.coalesce(F.col("c") * alpha + F.col("ema_1h_before") * (1 - alpha),
                                         (F.col("first_sum") + F.col("c")) / n))
        .drop("ema_1h_before", "first_sum")
    )


def bar_features(bars: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """All 15-minute features that need neither other symbols nor other timeframes, except ADX."""
    df = ind.with_smooths(prepared(bars, lookback), [
        ind.wilder("_up", "gain", 14, lookback), ind.wilder("_down", "loss", 14, lookback),
        ind.wilder("atr", "true_range", 14, lookback), ind.ema("ema_15m", "c", 20, lookback)])
    df = with_closed_confirm(with_moves(with_structure(with_volume(df))))
    return df.selectExpr(
        "*", ind.rsi_of("_up", "_down") + " AS rsi",
        "CASE WHEN ema_15m > 0 THEN (c / ema_15m - 1) * 100 ELSE 0D END AS ema_15m_distance",
        "try_divide(atr, c) * 100 AS atr_pct").drop("_up", "_down")
