"""Bars from ticks, coarser bars from finer ones, newest bars per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTHS = {"15m": "15 minutes", "1h": "1 hour"}


def _ohlcv(first, high, low, last, volume, ts):
    return [
        F.min_by(first, ts).alias("o"), F.max(high).alias("h"), F.min(low).alias("l"),
        F.max_by(last, ts).alias("c"), F.sum(volume).alias("v"),
    ]


def build_bars(ticks: DataFrame, width: str = "15m") -> DataFrame:
    """OHLCV per (symbol, window) from ``symbol, ts, price, qty``.

    All five aggregates combine before the shuffle: a hot symbol sends one row per window and task.
    """
    return (
        ticks.groupBy("symbol", F.window("ts", WIDTHS.get(width, width)).alias("_w"))
        .agg(*_ohlcv("price", "price", "price", "price", "qty", "ts"))
        .select("symbol", F.col("_w.start").alias("ts"), "o", "h", "l", "c", "v")
    )


def coarsen(bars: DataFrame, width: str = "1h") -> DataFrame:
    """Coarser bars by re-aggregation of finer ones."""
    return (
        bars.groupBy("symbol", F.window("ts", WIDTHS.get(width, width)).alias("_w"))
        .agg(*_ohlcv("o", "h", "l", "c", "v", "ts"))
        .select("symbol", F.col("_w.start").alias("ts"), "o", "h", "l", "c", "v")
    )


def newest_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars per symbol; the rank filter also runs before the shuffle."""
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return bars.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n)


def latest_bar(bars: DataFrame) -> DataFrame:
    """The newest bar per symbol by ``max_by`` (map-side combine, no sort)."""
    row = F.struct("ts", "o", "h", "l", "c", "v")
    return bars.groupBy("symbol").agg(F.max_by(row, "ts").alias("_b")).select("symbol", "_b.*")
