"""Market context of the benchmark symbol: trend distance, flash drops, on/off state, regime."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.config import REGIME_FLAT, REGIME_TREND, Rules
from barflow.operators import features, series
from barflow.operators import indicators as ind

BENCH_LOOKBACK = 300


def benchmark_bars(bars: DataFrame, rules: Rules = Rules(),
                   lookback: int = BENCH_LOOKBACK) -> DataFrame:
    """Per benchmark bar: EMA(200), 1h change, EMA distance, ADX, flash-drop flag."""
    df = features.prepared(bars, lookback)
    df = ind.with_smooths(df, [ind.ema("ema_200", "c", 200, lookback)])
    w = ind.bar_window()
    top = F.max("h").over(w.rowsBetween(-2, 0))
    df = df.withColumns({
        "btc_1h_change": features.percent_change(F.col("c"), F.lag("c", 4).over(w)),
        "flash_crash": F.coalesce(F.try_divide(top - F.col("c"), top) > rules.flash_drop,
                                  F.lit(False)),
    })
    df = features.with_ema_distance(df, "ema_200", "btc_ema_distance")
    return series.drop_halo(ind.with_adx(df, lookback, out="btc_adx"))


def band_switch(df: DataFrame, rules: Rules = Rules(), price: str = "c", average: str = "ema_200",
                flash: str = "flash_crash", out: str = "btc_ok") -> DataFrame:
    """On above the band, off below it, off on a flash drop or without an average, unchanged inside.

    Each bar either sets the state or keeps it, so the state is the last set value, off at first.
    """
    avg, px = F.col(average), F.col(price)
    sets = (
        F.when(avg.isNull() | F.col(flash), F.lit(False))
        .when(px > avg * (1 + rules.hysteresis), F.lit(True))
        .when(px < avg * (1 - rules.hysteresis), F.lit(False))
    )
    ran = series.running(df.withColumn("_sets", sets), {out: ("last", "_sets")}, "symbol", "chunk",
                         ["idx"])
    return ran.withColumn(out, F.coalesce(out, F.lit(False))).drop("_sets")


def with_regime(df: DataFrame, rules: Rules = Rules(), adx: str = "btc_adx") -> DataFrame:
    trending = F.coalesce(F.col(adx) >= rules.adx_trend, F.lit(False))
    regime = F.when(trending, F.lit(REGIME_TREND)).otherwise(F.lit(REGIME_FLAT))
    state = F.when(F.col("btc_ok"), "GO").otherwise("WAIT")
    return df.withColumn("regime", regime).withColumn(
        "market_status", F.when(F.col("flash_crash"), F.lit("FLASH_CRASH"))
        .otherwise(F.concat_ws(" | ", state, "regime")))


def known_context(context: DataFrame, width: str = "15 MINUTES") -> DataFrame:
    """The context with, as ``ts``, the close of each row's bar: nothing of it is known before."""
    return context.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {width}"))


def market_context(bars: DataFrame, rules: Rules = Rules(),
                   lookback: int = BENCH_LOOKBACK) -> DataFrame:
    """The context table of one benchmark series, one row per bar."""
    df = with_regime(band_switch(benchmark_bars(bars, rules, lookback), rules), rules)
    return df.select("ts", "c", "ema_200", "btc_ok", "regime", "market_status", "btc_1h_change",
                     "btc_ema_distance", "btc_adx", "flash_crash")
