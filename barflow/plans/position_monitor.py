"""Position side in batch: ticks and entries to sold legs, trade records and expiries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.config import WALLET_NORMAL, WALLET_WHALE, Rules
from barflow.functions.values import stored_exit_label
from barflow.operators import exits, features, positions, series
from barflow.operators import indicators as ind
from barflow.session import stored


def known_bars(bars: DataFrame) -> DataFrame:
    """What the exit rules read from bars, from the moment each bar has closed."""
    df = features.with_volume(ind.with_rsi(features.prepared(bars), 25, out="rsi_25"))
    return series.drop_halo(df).select(
        "symbol", (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("known_at"), "rsi_25",
        "vol_faded")


def sold_legs(entries: DataFrame, ticks: DataFrame, bars: DataFrame | None = None,
              context: DataFrame | None = None, rules: Rules = Rules(), poll_s: int = 2,
              width: str = "hour", until: str | None = None) -> DataFrame:
    """All legs sold for ``entries`` while ``ticks`` run, see ``exits``. ``until`` is a time no
    tick exceeds; with it the ticks are read once."""
    known = None if bars is None else stored(known_bars(bars), "known_bars")
    polls = exits.position_polls(entries, exits.polls_of(ticks, poll_s), known, context, width,
                                 until)
    return exits.exit_legs(exits.poll_vectors(polls, rules), rules)


def trade_rows(legs: DataFrame, entry_features: DataFrame) -> DataFrame:
    """Legs with the entry features of their position (library names of the trade log)."""
    df = legs.join(entry_features.drop("symbol", "entry_price", "cost"), "position_id", "left")
    return df.withColumns({
        "exit_price": F.col("price"),
        "exit_label": stored_exit_label("exit_code", "stop_ratio"),
        "wallet": F.when(F.coalesce("is_whale", F.lit(False)), WALLET_WHALE)
        .otherwise(WALLET_NORMAL)})


def expiries(legs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Cooldown and blacklist after each full exit (stored first: the streaks read it twice)."""
    finals = stored(legs.where("is_final").select("symbol", "ts", "exit_code"), "exits")
    return positions.stop_streaks(finals, rules)
