"""Which symbols a cycle looks at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.config import BANNED, Rules


def tradable(symbol: Column, banned: Sequence[str] = BANNED, suffix: str = "/USDT") -> Column:
    """ASCII only, no banned substring anywhere in the symbol, quoted in the given currency."""
    return symbol.endswith(suffix) & ~contains_any(symbol, banned) & symbol.rlike(
        r"^[\x00-\x7F]*$")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of the words occurs, as one pattern: the text is evaluated once and the generated
    code stays small enough to be compiled."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words)) if words else F.lit(False)


def universe(tickers: DataFrame, rules: Rules = Rules(),
             banned: Sequence[str] = BANNED) -> DataFrame:
    """Survivors of the symbol and volume filter; a null change or volume fails it."""
    return tickers.where(
        tradable(F.col("symbol"), banned)
        & (F.col("quote_volume") > rules.min_quote_volume)
        & F.col("pct").isNotNull()
    )


def top_gainers(tickers: DataFrame, rules: Rules = Rules(), cycle: str = "cycle_ts",
                banned: Sequence[str] = BANNED) -> DataFrame:
    """The N strongest symbols per cycle. The rank limit runs in every task before the shuffle, so
    a cycle sends at most N rows per task."""
    order = Window.partitionBy(cycle).orderBy(F.col("pct").desc(), "symbol")
    return (
        universe(tickers, rules, banned)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rules.top_n)
    )
