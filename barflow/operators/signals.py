"""The rule filter over bar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.config import Rules
from barflow.operators import features, series
from barflow.operators import indicators as ind
from barflow.session import stored


def trend_ok(rules: Rules = Rules()) -> Column:
    """Enough history, price not below the hourly average (which must exist), volatility in range."""
    return (
        (F.col("idx") + 1 >= rules.min_bars)
        & F.col("ema_1h").isNotNull() & (F.col("c") >= F.col("ema_1h"))
        & (F.try_divide("atr", "c") <= rules.max_atr_ratio)
    )


def rules_ok(rules: Rules = Rules()) -> Column:
    return (
        (F.col("rsi") > rules.min_rsi) & (F.col("vol_ratio") > rules.min_vol_ratio)
        & (F.col("msb") | F.col("engulf"))
    )


def whale(rules: Rules = Rules()) -> Column:
    return (F.col("vol_ratio") > rules.whale_vol_ratio) & (F.col("rsi") < rules.whale_max_rsi)


def find_signals(bars: DataFrame, hourly: DataFrame, rules: Rules = Rules(), mode: str = "closed",
                 with_trend_index: bool = True) -> DataFrame:
    """Signals with their features.

    Cheap window features come first and the rules cut the rows; the hourly join sees only bars that
    already pass them, and the trend index is folded only for those bars. They are few and stored,
    because the as-of join reads them twice.
    """
    df = features.bar_features(bars)
    df = df.withColumn("_hit", F.coalesce(
        rules_ok(rules) & (F.col("idx") + 1 >= rules.min_bars), F.lit(False)))
    if with_trend_index:
        df = ind.with_adx(df.select(
            "symbol", "ts", "h", "l", "c", "idx", "chunk", "pos", "is_halo", "rsi", "atr",
            "atr_pct", "vol_ratio", "msb", "engulf", "pump_3h", "pump_6h", "high_distance",
            "ema_15m_distance", "closed_confirm", "_hit"), out="sym_adx", only=F.col("_hit"))
    hits = stored(series.drop_halo(df.where(F.col("_hit"))).drop("_hit", "chunk"), "hits")
    trend = stored(features.hourly_trend(hourly), "trend")
    hits = features.with_hourly_trend(hits, trend, mode)
    return hits.where(trend_ok(rules)).withColumns({
        "signal": F.when(F.col("msb"), "MSB").otherwise("Engulf"),
        "is_whale": whale(rules),
        "cash": F.when(whale(rules), rules.whale_cash).otherwise(rules.normal_cash),
        "ema_1h_distance": features.percent_change(F.col("c"), F.col("ema_1h")),
        "hour": F.hour("ts"),
        "weekday": F.weekday("ts"),
    })
