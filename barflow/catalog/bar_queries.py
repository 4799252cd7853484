"""Bars, indicators, features and market context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.catalog.adapters import (
    BENCHMARK, bars, flags, micros, rounded, sql_bars, sql_round, sql_smooth, sql_ticks, ticks,
)
from barflow.config import Rules
from barflow.operators import bars as bar_ops
from barflow.operators import features, regime, series
from barflow.operators import indicators as ind
from barflow.session import stored

# the given values are independent draws, not a price path: wider bands make all branches occur
CONTEXT_RULES = Rules(flash_drop=0.90, hysteresis=0.4, adx_trend=12.0)


def q_bars_15m(spark: SparkSession, d: str) -> DataFrame:
    built = bar_ops.build_bars(ticks(spark, d), "15m")
    return built.select("symbol", micros(), "o", "h", "l", "c", "v")


def q_bars_1h(spark, d):
    built = bar_ops.coarsen(bar_ops.build_bars(ticks(spark, d), "15m"), "1h")
    return built.select("symbol", micros(), "o", "h", "l", "c", "v")


def q_tail_bars(spark, d):
    kept = bar_ops.newest_bars(bar_ops.build_bars(ticks(spark, d)), 25)
    return kept.select("symbol", micros(), "c", "v", "age")


def q_latest_bar(spark, d):
    return bar_ops.latest_bar(bar_ops.build_bars(ticks(spark, d))).select(
        "symbol", micros(), "o", "h", "l", "c", "v")


def _prepared(spark, d, lookback):
    return features.prepared(bars(spark, d), lookback)


def q_ema_bounded(spark, d):
    df = ind.with_smooths(_prepared(spark, d, 300), [
        ind.ema("ema_20_50", "c", 20, 50), ind.ema("ema_20_100", "c", 20, 100),
        ind.ema("ema_200_300", "c", 200, 300)])
    return series.drop_halo(df).select(
        "symbol", micros(), *rounded("ema_20_50", "ema_20_100", "ema_200_300"))


def q_rsi_bounded(spark, d):
    df = ind.with_rsi(_prepared(spark, d, 100), 100)
    return series.drop_halo(df).where("idx >= 14").select("symbol", micros(), *rounded("rsi"))


def q_overheated(spark, d):
    df = series.drop_halo(ind.with_rsi(_prepared(spark, d, 100), 25, out="rsi_25"))
    return df.where("idx >= 14").select(
        "symbol", micros(), *rounded("rsi_25"),
        (F.col("rsi_25") >= Rules().overheated_rsi).cast("int").alias("overheated"))


def q_atr_bounded(spark, d):
    df = ind.with_atr(_prepared(spark, d, 100), 100)
    return series.drop_halo(df).where("idx >= 14").select(
        "symbol", micros(), *rounded("atr"), F.round(F.col("atr") / F.col("c") * 100, 6)
        .alias("atr_pct"))


def q_adx_bounded(spark, d):
    df = ind.with_adx(_prepared(spark, d, 100), 100)
    return series.drop_halo(df).select("symbol", micros(), *rounded("adx"))


def q_volume_ratio(spark, d):
    df = series.drop_halo(features.with_volume(_prepared(spark, d, 100)))
    return df.where("idx >= 13").select(
        "symbol", micros(), *rounded("vol_mean", "vol_ratio"), *flags("vol_faded"))


def q_price_structure(spark, d):
    df = series.drop_halo(features.with_structure(_prepared(spark, d, 100)))
    return df.where("idx >= 9").select("symbol", micros(), *flags("msb", "engulf"))


def q_price_moves(spark, d):
    df = series.drop_halo(features.with_moves(_prepared(spark, d, 100)))
    return df.select("symbol", micros(), *rounded("pump_3h", "pump_6h", "high_distance"))


def q_closed_confirm(spark, d):
    df = features.with_closed_confirm(features.with_volume(_prepared(spark, d, 100)))
    return series.drop_halo(df).where("idx >= 13").select("symbol", micros(), "closed_confirm")


def q_mtf_asof(spark, d):
    b = bars(spark, d)
    trend = stored(features.hourly_trend(bar_ops.coarsen(b)), "trend")
    df = features.with_hourly_trend(b, trend)
    df = features.with_ema_distance(df.where(F.col("ema_1h").isNotNull()), "ema_1h",
                                    "ema_1h_distance")
    return df.select("symbol", micros(), *rounded("ema_1h", "ema_1h_distance"))


def q_mtf_live(spark, d):
    b = bars(spark, d)
    trend = stored(features.hourly_trend(bar_ops.coarsen(b)), "trend")
    df = features.with_hourly_trend(b, trend, mode="live")
    return df.where(F.col("ema_1h").isNotNull()).select("symbol", micros(), *rounded("ema_1h"))


def q_benchmark_context(spark, d):
    b = bars(spark, d).where(F.col("symbol") == BENCHMARK)
    df = regime.benchmark_bars(b, CONTEXT_RULES)
    return df.select(micros(), *rounded("ema_200", "btc_1h_change", "btc_ema_distance", "btc_adx"),
                     *flags("flash_crash"))


def _context(spark, d):
    b = bars(spark, d).where(F.col("symbol") == BENCHMARK)
    return regime.market_context(b, CONTEXT_RULES)


def q_regime_state(spark, d):
    return _context(spark, d).select(micros(), *flags("btc_ok", "flash_crash"), "regime",
                                     "market_status")


def q_context_asof(spark, d):
    context = _context(spark, d).select("ts", "btc_ok", "regime", "btc_adx")
    others = bars(spark, d).where(F.col("symbol") != BENCHMARK).select("symbol", "ts", "c")
    df = series.asof_grid(others, stored(context, "context"), ["btc_ok", "regime", "btc_adx"])
    return df.where(F.col("regime").isNotNull()).select(
        "symbol", micros(), *flags("btc_ok"), "regime", *rounded("btc_adx"))


QUERIES = {
    "bars_15m": q_bars_15m, "bars_1h": q_bars_1h, "tail_bars": q_tail_bars,
    "latest_bar": q_latest_bar, "ema_bounded": q_ema_bounded, "rsi_bounded": q_rsi_bounded,
    "overheated": q_overheated, "atr_bounded": q_atr_bounded, "adx_bounded": q_adx_bounded,
    "volume_ratio": q_volume_ratio, "price_structure": q_price_structure,
    "price_moves": q_price_moves, "closed_confirm": q_closed_confirm, "mtf_asof": q_mtf_asof,
    "mtf_live": q_mtf_live, "benchmark_context": q_benchmark_context,
    "regime_state": q_regime_state, "context_asof": q_context_asof,
}

# --- SQL ------------------------------------------------------------------------------------------

BARS = f"WITH RECURSIVE {sql_ticks()}, {sql_bars()}"
W = "(PARTITION BY symbol ORDER BY ts)"


def rows(lo: int, hi: int = 0) -> str:
    """Frame from ``lo`` rows before to ``hi`` rows before the current row."""
    end = "CURRENT ROW" if hi == 0 else f"{hi} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {lo} PRECEDING AND {end})"


N = f"""n AS (
  SELECT *, row_number() OVER {W} - 1 AS idx, lag(c) OVER {W} AS pc, lag(h) OVER {W} AS ph,
         lag(l) OVER {W} AS pl
  FROM bars)"""
D = """d AS (
  SELECT *, greatest(c - pc, 0) AS gain, greatest(pc - c, 0) AS loss,
         greatest(h - l, abs(h - pc), abs(l - pc)) AS tr
  FROM n WHERE idx > 0)"""


def sql_rsi(lookback: int) -> str:
    return f"""{BARS}, {N}, {D}, s AS (
  SELECT symbol, ts, idx, list(gain) OVER {rows(lookback - 2)} AS g,
         list(loss) OVER {rows(lookback - 2)} AS k FROM d), u AS (
  SELECT symbol, ts, idx, {sql_smooth('g', 14, '(1 / 14.0)')} AS up,
         {sql_smooth('k', 14, '(1 / 14.0)')} AS down FROM s)
"""


def sql_adx(lookback: int, source: str = "n") -> str:
    """Steps over each bar's own slice; all bars advance one step per recursion."""
    return f"""moves AS (
  SELECT symbol, idx,
         CASE WHEN h - ph > pl - l AND h - ph > 0 THEN h - ph ELSE 0 END AS plus,
         CASE WHEN pl - l > h - ph AND pl - l > 0 THEN pl - l ELSE 0 END AS minus
  FROM {source} WHERE idx > 0), fold AS (
  SELECT symbol, ts, idx, greatest(idx - {lookback - 1}, 0) AS start,
         least(idx, {lookback - 1}) AS steps, 0 AS j, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m,
         0.0::DOUBLE AS total, 0.0::DOUBLE AS adx
  FROM {source}
  UNION ALL
  SELECT symbol, ts, idx, start, steps, j, p, m,
         total + CASE WHEN j BETWEEN 14 AND 27 THEN dx ELSE 0 END,
         CASE WHEN j = 27 THEN (total + dx) / 14 WHEN j > 27 THEN adx + (dx - adx) / 14
              ELSE adx END
  FROM (SELECT *, CASE WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0 END AS dx
        FROM (SELECT f.symbol, f.ts, f.idx, f.start, f.steps, f.j + 1 AS j, f.total, f.adx,
                     CASE WHEN f.j < 14 THEN f.p + plus / 14 ELSE f.p + (plus - f.p) / 14 END AS p,
                     CASE WHEN f.j < 14 THEN f.m + minus / 14 ELSE f.m + (minus - f.m) / 14 END AS m
              FROM fold f JOIN moves v ON v.symbol = f.symbol AND v.idx = f.start + f.j + 1
              WHERE f.j < f.steps))), adx AS (
  SELECT symbol, ts, idx, CASE WHEN steps >= 27 THEN adx ELSE 0 END AS adx
  FROM fold WHERE j = steps)"""


BENCH = f"""{BARS}, b AS (SELECT * FROM bars WHERE symbol = '{BENCHMARK}'), n AS (
  SELECT *, row_number() OVER {W} - 1 AS idx, lag(h) OVER {W} AS ph, lag(l) OVER {W} AS pl,
         lag(c, 4) OVER {W} AS c4, max(h) OVER {rows(2)} AS top, list(c) OVER {rows(299)} AS cs
  FROM b), {sql_adx(300)}, e AS (
  SELECT n.*, a.adx AS btc_adx, {sql_smooth('cs', 200, '(2 / 201.0)')} AS ema_200,
         (top - c) / top > {CONTEXT_RULES.flash_drop} AS flash
  FROM n JOIN adx a USING (symbol, idx)), st AS (
  SELECT *, CASE WHEN ema_200 IS NULL OR flash THEN 0
                 WHEN c > ema_200 * {1 + CONTEXT_RULES.hysteresis} THEN 1
                 WHEN c < ema_200 * {1 - CONTEXT_RULES.hysteresis} THEN 0 END AS sets
  FROM e), ctx AS (
  SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)
           AS btc_ok,
         CASE WHEN btc_adx >= {CONTEXT_RULES.adx_trend} THEN 'TREND' ELSE 'YATAY' END AS regime
  FROM st)"""

ORACLES = {
    "bars_15m": f"{BARS} SELECT symbol, epoch_us(ts) AS ts, o, h, l, c, v FROM bars",
    "bars_1h": f"WITH {sql_ticks()}, {sql_bars('bars', '1 hour')} "
               "SELECT symbol, epoch_us(ts) AS ts, o, h, l, c, v FROM bars",
    "tail_bars": f"""{BARS}, r AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS age FROM bars)
SELECT symbol, epoch_us(ts) AS ts, c, v, age FROM r WHERE age <= 25""",
    "latest_bar": f"""{BARS}
SELECT symbol, epoch_us(ts) AS ts, o, h, l, c, v FROM bars b
WHERE ts = (SELECT max(ts) FROM bars x WHERE x.symbol = b.symbol)""",
    "ema_bounded": f"""{BARS}, {N}, s AS (
  SELECT symbol, ts, idx, list(c) OVER {rows(49)} AS a, list(c) OVER {rows(99)} AS b,
         list(c) OVER {rows(299)} AS d FROM n), e AS (
  SELECT symbol, ts, {sql_smooth('a', 20, '(2 / 21.0)')} AS ema_20_50,
         {sql_smooth('b', 20, '(2 / 21.0)')} AS ema_20_100,
         {sql_smooth('d', 200, '(2 / 201.0)')} AS ema_200_300 FROM s)
SELECT symbol, epoch_us(ts) AS ts, {sql_round('ema_20_50', 'ema_20_100', 'ema_200_300')} FROM e""",
    "rsi_bounded": f"""{sql_rsi(100)}
SELECT symbol, epoch_us(ts) AS ts, round(100 * up / (up + down), 6) AS rsi FROM u
WHERE idx >= 14""",
    "overheated": f"""{sql_rsi(25)}
SELECT symbol, epoch_us(ts) AS ts, round(100 * up / (up + down), 6) AS rsi_25,
       CAST(100 * up / (up + down) >= 83 AS INTEGER) AS overheated FROM u WHERE idx >= 14""",
    "atr_bounded": f"""{BARS}, {N}, {D}, s AS (
  SELECT symbol, ts, idx, c, list(tr) OVER {rows(98)} AS t FROM d), u AS (
  SELECT symbol, ts, c, {sql_smooth('t', 14, '(1 / 14.0)')} AS atr FROM s WHERE idx >= 14)
SELECT symbol, epoch_us(ts) AS ts, round(atr, 6) AS atr, round(atr / c * 100, 6) AS atr_pct
FROM u""",
    "adx_bounded": f"""{BARS}, {N}, {sql_adx(100)}
SELECT symbol, epoch_us(ts) AS ts, {sql_round('adx')} FROM adx""",
    "volume_ratio": f"""{BARS}, {N}, s AS (
  SELECT symbol, ts, idx, v, avg(v) OVER {rows(13)} AS vol_mean, avg(v) OVER {rows(2)} AS v3
  FROM n)
SELECT symbol, epoch_us(ts) AS ts, {sql_round('vol_mean')},
       round(CASE WHEN vol_mean > 0 THEN v / vol_mean ELSE 0 END, 6) AS vol_ratio,
       CAST(vol_mean > 0 AND v3 < vol_mean AS INTEGER) AS vol_faded
FROM s WHERE idx >= 13""",
    "price_structure": f"""{BARS}, {N}, s AS (
  SELECT *, max(h) OVER {rows(9, 2)} AS top, lag(o) OVER {W} AS po FROM n)
SELECT symbol, epoch_us(ts) AS ts, CAST(c > top AS INTEGER) AS msb,
       CAST(pc < po AND c > o AND o < pc AS INTEGER) AS engulf
FROM s WHERE idx >= 9""",
    "price_moves": f"""{BARS}, {N}, s AS (
  SELECT *, max(h) OVER {rows(95)} AS top, first_value(c) OVER {W} AS c0,
         lag(c, 12) OVER {W} AS c12, lag(c, 24) OVER {W} AS c24 FROM n), m AS (
  SELECT symbol, ts, (c / coalesce(c12, c0) - 1) * 100 AS pump_3h,
         (c / coalesce(c24, c0) - 1) * 100 AS pump_6h, (top - c) / top * 100 AS high_distance
  FROM s)
SELECT symbol, epoch_us(ts) AS ts, {sql_round('pump_3h', 'pump_6h', 'high_distance')} FROM m""",
    "closed_confirm": f"""{BARS}, {N}, s AS (
  SELECT *, avg(v) OVER {rows(13)} AS vm, lag(o) OVER {W} AS po, lag(v) OVER {W} AS pv FROM n)
SELECT symbol, epoch_us(ts) AS ts, CAST(pc > po AND pv > vm AS INTEGER) AS closed_confirm
FROM s WHERE idx >= 13""",
    "mtf_asof": f"""{BARS}, {sql_bars('hours', '1 hour')}, s AS (
  SELECT symbol, ts, list(c) OVER {rows(49)} AS cs FROM hours), e AS (
  SELECT symbol, ts + INTERVAL 1 HOUR AS known, {sql_smooth('cs', 20, '(2 / 21.0)')} AS ema_1h
  FROM s), b AS (SELECT *, ts + INTERVAL 15 MINUTE AS at FROM bars), j AS (
  SELECT b.symbol, b.ts, b.c, e.ema_1h FROM b ASOF JOIN e
  ON b.symbol = e.symbol AND b.at >= e.known)
SELECT symbol, epoch_us(ts) AS ts, {sql_round('ema_1h')},
       round((c / ema_1h - 1) * 100, 6) + 0.0 AS ema_1h_distance
FROM j WHERE ema_1h IS NOT NULL""",
    "mtf_live": f"""{BARS}, {sql_bars('hours', '1 hour')}, h AS (
  SELECT symbol, ts, row_number() OVER {W} AS k, c FROM hours), j AS (
  SELECT b.symbol, b.ts, list_append((SELECT list(c ORDER BY k) FROM h x
           WHERE x.symbol = h.symbol AND x.k BETWEEN h.k - 49 AND h.k - 1), b.c) AS cs
  FROM bars b JOIN h ON h.symbol = b.symbol AND h.ts = time_bucket(INTERVAL '1 hour', b.ts)
  WHERE h.k >= 20), e AS (
  SELECT symbol, ts, {sql_smooth('cs', 20, '(2 / 21.0)')} AS ema_1h FROM j)
SELECT symbol, epoch_us(ts) AS ts, {sql_round('ema_1h')} FROM e""",
    "benchmark_context": f"""{BENCH}
SELECT epoch_us(ts) AS ts, {sql_round('ema_200')},
       round((c / c4 - 1) * 100, 6) + 0.0 AS btc_1h_change,
       CASE WHEN ema_200 > 0 THEN round((c / ema_200 - 1) * 100, 6) + 0.0 ELSE 0.0 END AS btc_ema_distance, {sql_round('btc_adx')},
       CAST(flash AS INTEGER) AS flash_crash
FROM ctx""",
    "regime_state": f"""{BENCH}
SELECT epoch_us(ts) AS ts, btc_ok, CAST(flash AS INTEGER) AS flash_crash, regime,
       CASE WHEN flash THEN 'FLASH_CRASH'
            ELSE (CASE WHEN btc_ok = 1 THEN 'GO' ELSE 'WAIT' END) || ' | ' || regime END
         AS market_status
FROM ctx""",
    "context_asof": f"""{BENCH}, x AS (SELECT symbol, ts FROM bars WHERE symbol <> '{BENCHMARK}')
SELECT x.symbol, epoch_us(x.ts) AS ts, c.btc_ok, c.regime, round(c.btc_adx, 6) AS btc_adx
FROM x ASOF JOIN ctx c ON x.ts >= c.ts""",
}
