"""Bars, tickers, order books, balances and positions as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow import schemas
from barflow.operators.bars import newest_bars


def read_bars(spark: SparkSession, path: str, tf: str, symbols: list[str] | None = None,
              since: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored bars; symbol, timeframe and time filters reach the scan, ``limit`` keeps the newest
    bars per symbol."""
    df = spark.read.schema(schemas.BARS).parquet(path).where(F.col("tf") == tf)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols))
    if since is not None:
        df = df.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return newest_bars(df, limit).drop("age") if limit else df


def write_bars(bars: DataFrame, path: str, tf: str) -> None:
    """Append bars of one timeframe, partitioned by timeframe and month."""
    bars.withColumns({"tf": F.lit(tf), "month": F.date_format("ts", "yyyy-MM")}).write.mode(
        "append").partitionBy("tf", "month").parquet(path)


def tickers_from_map(snapshots: DataFrame) -> DataFrame:
    """``snapshot_ts`` plus a map symbol to (last, percentage, quoteVolume) as one row per symbol."""
    return snapshots.select("snapshot_ts", F.explode("tickers").alias("symbol", "t")).select(
        "snapshot_ts", "symbol", F.col("t.last").alias("last"),
        F.col("t.percentage").alias("pct"), F.col("t.quoteVolume").alias("quote_volume"))


def held_tickers(tickers: DataFrame, positions: DataFrame) -> DataFrame:
    """Tickers of symbols that are held."""
    return tickers.join(positions.select("symbol"), "symbol", "left_semi")


def books_to_depth(books: DataFrame, depth: int) -> DataFrame:
    return books.withColumns({side: F.slice(side, 1, depth) for side in ("bids", "asks")})


def wallet(balances: DataFrame) -> DataFrame:
    """Balance maps as rows of coins with a positive total."""
    held = F.map_filter("total", lambda _, qty: qty > 0)
    return balances.select("snapshot_ts", "free", F.explode(held).alias("coin", "total")).select(
        "snapshot_ts", "coin", "total",
        F.coalesce(F.try_element_at("free", F.col("coin")), F.lit(0.0)).alias("free"))


def position_state(positions: DataFrame, as_of: str, default_cost: float = 20.0) -> DataFrame:
    """Stored positions with defaults for missing or zero state fields."""
    def default(col, value):
        return F.coalesce(F.nullif(F.col(col), F.lit(0.0)), F.lit(value)).alias(col)

    return positions.select(
        "symbol", "entry_price", default("cost", default_cost),
        F.coalesce("max_ratio", F.lit(0.0)).alias("max_ratio"),
        F.coalesce("half_sold", F.lit(False)).alias("half_sold"),
        F.coalesce("entry_ts", F.lit(as_of).cast("timestamp")).alias("entry_ts"),
        F.coalesce("features_json", F.lit("{}")).alias("features_json"))
