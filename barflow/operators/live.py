"""Signals while a bar is still open: the closed bars' running values, one step on with the open bar.

A live signal sees the last ``lookback`` bars of which the newest is not complete. So each bar gets, once, what the
bars before it leave to it: smoothed means over one bar less, sums and extremes of the frames without the bar
itself. The open bar at any moment is then one row, and every feature is a step from that state: no
slice is rebuilt for a moment, and moments of one bar share its state. Closed mode never reads an open bar; here none but
the open bar's own moment is read, so a signal can vanish again before its bar closes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.config import Rules
from barflow.operators import features, series, signals
from barflow.operators import indicators as ind
from barflow.session import stored

BAR_S = 900


def open_bars(ticks: DataFrame, every_s: int = 60) -> DataFrame:
    """The open 15-minute bar of each symbol at the end of every slot of ``every_s`` seconds that has ticks: ``ts`` (the
    bar's start), ``at`` (the slot's end) and o, h, l, c, v so far.

    Ticks combine to one row per slot before the shuffle; a bar has ``900 / every_s`` of them at most.
    """
    if BAR_S % every_s:
        raise ValueError("slots have to fill a bar")
    second = F.unix_seconds("ts")
    slots = ticks.groupBy("symbol", F.floor(second / every_s).alias("_slot")).agg(
        F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"),
        F.max_by("price", "ts").alias("c"), F.sum("qty").alias("v"))
    slots = slots.withColumn("ts", F.timestamp_seconds(F.floor(F.col("_slot") * every_s / BAR_S) * BAR_S))
    so_far = Window.partitionBy("symbol", "ts").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    return slots.select(
        "symbol", "ts", F.timestamp_seconds((F.col("_slot") + 1) * every_s).alias("at"),
        F.first("o").over(so_far).alias("o"), F.max("h").over(so_far).alias("h"), F.min("l").over(so_far).alias("l"),
        "c", F.sum("v").over(so_far).alias("v"))


def states_before(bars: DataFrame, lookback: int = features.LOOKBACK) -> DataFrame:
    """Per bar, under its ``ts``, what the bars before it leave: columns with names from ``p_``.

    The bar itself counts only as a place in the series, so it may be the open one.
    """
    less = lookback - 1
    df = ind.with_smooths(features.prepared(bars, lookback), [
        ind.wilder("_up", "gain", 14, less), ind.wilder("_down", "loss", 14, less),
        ind.wilder("_atr", "true_range", 14, less), ind.ema("_ema", "c", 20, less)])
    w = "OVER (PARTITION BY symbol, chunk ORDER BY pos"

    def frame(lo: int, hi: int = 1) -> str:
        return f"{w} ROWS BETWEEN {lo} PRECEDING AND {hi} PRECEDING)"

    df = df.selectExpr(
        "symbol", "ts", "idx", "chunk", "is_halo", "pos",
        *[f"lag({c}) {w}) AS p{c}" for c in ("_up", "_down", "_atr", "_ema")],
        *[f"lag({c}) {w}) AS p_{c}" for c in "ocv"],
        f"max(h) {frame(9, 2)} AS p_top8", f"max(h) {frame(features.DAY_BARS - 1)} AS p_top",
        f"CASE WHEN idx >= 13 THEN sum(v) {frame(13)} END AS p_volume",
        f"lag(c, 12) {w}) AS p_c12", f"lag(c, 24) {w}) AS p_c24")
    return series.drop_halo(df).drop("chunk")


def step(rows: DataFrame) -> DataFrame:
    """Features of open bars (o, h, l, c, v) from the state before them. Null until the state has what a feature needs."""
    mean = "CASE WHEN p_volume IS NOT NULL THEN (p_volume + v) / 14 END"
    return rows.selectExpr(
        "*", "p_up + (greatest(c - p_c, 0D) - p_up) / 14 AS _up", "p_down + (greatest(p_c - c, 0D) - p_down) / 14 AS _down",
        "p_atr + (greatest(h - l, abs(h - p_c), abs(l - p_c)) - p_atr) / 14 AS atr",
        "p_ema + (c - p_ema) * 2 / 21 AS _ema", f"{mean} AS vol_mean",
    ).selectExpr(
        *rows.columns, "atr", "vol_mean", ind.rsi_of("_up", "_down") + " AS rsi", "try_divide(atr, c) * 100 AS atr_pct",
        "CASE WHEN vol_mean > 0 THEN v / vol_mean ELSE 0D END AS vol_ratio",
        "coalesce(c > p_top8, false) AS msb", "coalesce(p_c < p_o AND c > o AND o < p_c, false) AS engulf",
        "(try_divide(c, p_c12) - 1) * 100 AS pump_3h", "(try_divide(c, p_c24) - 1) * 100 AS pump_6h",
        "CASE WHEN greatest(p_top, h) > 0 THEN (greatest(p_top, h) - c) / greatest(p_top, h) * 100 ELSE 0D END"
        " AS high_distance",
        "CASE WHEN _ema > 0 THEN (c / _ema - 1) * 100 ELSE 0D END AS ema_15m_distance",
        "CAST(coalesce(p_c > p_o AND p_v > vol_mean, false) AS INT) AS closed_confirm",
    ).drop(*[c for c in rows.columns if c.startswith("p_")])


def live_signals(ticks: DataFrame, bars: DataFrame, hourly: DataFrame, rules: Rules = Rules(),
                 every_s: int = 60) -> DataFrame:
    """Signals at every moment ``at`` that has one, by the rules and features of ``signals.find_signals`` without the trend
    index. ``bars`` and ``hourly`` may hold bars that are still open.

    The states meet the moments of their own bar in an equi-join; the hourly join sees only moments that pass the rules.
    """
    rows = step(open_bars(ticks, every_s).join(states_before(bars), ["symbol", "ts"]))
    hits = rows.where(F.coalesce(signals.rules_ok(rules) & (F.col("idx") + 1 >= rules.min_bars), F.lit(False)))
    trend = stored(features.hourly_trend(hourly), "trend")
    hits = features.with_hourly_trend(stored(hits, "live-hits"), trend, "live")
    return hits.where(signals.trend_ok(rules)).withColumns({
        "signal": F.when(F.col("msb"), "MSB").otherwise("Engulf"), "is_whale": signals.whale(rules),
        "cash": F.when(signals.whale(rules), rules.whale_cash).otherwise(rules.normal_cash),
        "ema_1h_distance": features.percent_change(F.col("c"), F.col("ema_1h"))})
