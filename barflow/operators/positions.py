"""Positions: legs to positions, valuation, wallet reconciliation, streaks and expiries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.config import BANNED, RESERVED_COINS, Rules
from barflow.functions.money import net_ratio
from barflow.functions.values import base_coin, pair_symbol
from barflow.operators import series
from barflow.operators.universe import contains_any

LEG_KEYS = ("symbol", "entry_price", "rsi", "vol_ratio", "atr_pct", "signal")


def collapse_legs(trades: DataFrame, keys: Sequence[str] = LEG_KEYS, net: str = "net",
                  ts: str = "ts") -> DataFrame:
    """One row per position: legs with equal entry data are one position; net adds up, time is the
    first exit. A missing signal is a group of its own; any other missing key drops the leg."""
    known = trades
    if "signal" in keys:
        known = known.withColumn("signal", F.coalesce("signal", F.lit("")))
    return (
        known.na.drop(subset=list(keys)).groupBy(*keys)
        .agg(F.sum(net).alias(net), F.min(ts).alias(ts), F.count(F.lit(1)).alias("n_legs"))
    )


def mark_to_market(positions: DataFrame, tickers: DataFrame, as_of: str,
                   rules: Rules = Rules()) -> DataFrame:
    """Open positions at current prices; without a price the entry price stands in."""
    price = F.coalesce("last", F.col("entry_price"))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("entry_ts")) / 3.6e9
    return positions.join(tickers.select("symbol", "last"), "symbol", "left").select(
        "symbol", "entry_price", price.alias("price"), "cost",
        ((price - F.col("entry_price")) * F.col("cost") / F.col("entry_price"))
        .alias("unrealized"),
        (net_ratio("entry_price", price, rules.fee) * 100).alias("net_pct"),
        age.alias("age_h"),
        (F.coalesce("max_ratio", F.lit(0.0)) * 100).alias("max_pct"),
        F.coalesce("half_sold", F.lit(False)).alias("half_sold"),
        (F.col("cost") > rules.large_cost).alias("large"),
    )


def position_report(positions: DataFrame, tickers: DataFrame, balances: DataFrame, as_of: str,
                    rules: Rules = Rules(), cash_coin: str = "USDT") -> DataFrame:
    """Open positions at current prices, and a line of the wallet's cash (``kind`` CASH, its total as ``value``), which is
    there without positions too, and 0 without a balance. ``sign`` is + or - by the net return."""
    held = mark_to_market(positions, tickers, as_of, rules).select(
        F.lit("POSITION").alias("kind"), "symbol", "entry_price", "price", "cost",
        (F.col("cost") + F.col("unrealized")).alias("value"), "unrealized", "net_pct", "age_h", "max_pct", "half_sold", "large",
        F.when(F.col("net_pct") >= 0, "+").otherwise("-").alias("sign"))
    cash = balances.where(F.col("coin") == cash_coin).agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("value"))
    return held.unionByName(cash.select(F.lit("CASH").alias("kind"), F.lit(cash_coin).alias("symbol"), "value"),
                            allowMissingColumns=True)


def priced_positions(positions: DataFrame, tickers: DataFrame) -> DataFrame:
    """Positions whose symbol has a price; the others are left for the next pass."""
    priced = tickers.where(F.coalesce(F.col("last"), F.lit(0.0)) != 0)
    return positions.join(priced.select("symbol", "last"), "symbol")


def reconcile(balances: DataFrame, positions: DataFrame, tickers: DataFrame,
              rules: Rules = Rules(), banned: Sequence[str] = BANNED) -> DataFrame:
    """Wallet against positions, one row per symbol of either side with ``action``:

    CLOSE_DUST: held, but the wallet's coins are worth next to nothing; ADOPT: in the wallet, not
    held, worth enough and not excluded; UNKNOWN_PRICE: held without a usable price; else KEEP.
    """
    wallet = balances.where(F.col("total") > 0).select(
        "coin", pair_symbol("coin").alias("symbol"), F.col("total").alias("qty"))
    held = positions.select("symbol", F.lit(True).alias("held"))
    both = (
        wallet.join(held, "symbol", "full_outer")
        .join(tickers.select("symbol", "last"), "symbol", "left")
        .withColumns({
            "coin": F.coalesce("coin", base_coin("symbol")),
            "held": F.coalesce("held", F.lit(False)),
            "value": F.coalesce("qty", F.lit(0.0)) * F.coalesce("last", F.lit(0.0)),
        })
    )
    barred = contains_any(F.col("symbol"), banned) | F.col("coin").isin(*RESERVED_COINS)
    priced = F.coalesce(F.col("last") > 0, F.lit(False))
    action = (
        F.when(F.col("held") & ~priced, "UNKNOWN_PRICE")
        .when(F.col("held") & (F.col("value") < rules.dust_value), "CLOSE_DUST")
        .when(~F.col("held") & ~barred & priced & (F.col("value") > rules.orphan_value), "ADOPT")
        .otherwise("KEEP")
    )
    return both.select("symbol", "qty", "last", "held", "value", action.alias("action"))


def adopted_positions(reconciled: DataFrame, as_of: str) -> DataFrame:
    """Positions for adopted coins: entered now, at the current price, without features."""
    return reconciled.where(F.col("action") == "ADOPT").select(
        "symbol", F.col("last").alias("entry_price"), F.col("value").alias("cost"),
        F.lit(as_of).cast("timestamp").alias("entry_ts"), F.lit(0.0).alias("max_ratio"),
        F.lit(False).alias("half_sold"), F.lit(None).cast("string").alias("features_json"))


def stop_streaks(exits: DataFrame, rules: Rules = Rules(), width: str = "day",
                 tie: str | None = None) -> DataFrame:
    """Exits (``symbol, ts, exit_code``) with streak and expiries after each of them.

    A stop adds one, a trend exit or a dust close resets, other exits leave the streak. Every second
    stop of a streak blacklists the symbol and restarts the count, so the count is the number of
    stops since the last reset modulo two: running values per (symbol, day) plus what earlier days
    carry over, instead of a fold per symbol.
    """
    order = ", ".join(["ts"] + ([tie] if tie else []))
    is_stop = F.col("exit_code") == "STOP"
    inside = f"OVER (PARTITION BY symbol, _day ORDER BY {order} {series.UPTO})"
    earlier = f"OVER (PARTITION BY symbol ORDER BY _day {series.EARLIER})"
    # stops so far in the chunk, and how many of them the chunk's last reset has left behind
    local = exits.selectExpr("*", f"date_trunc('{width}', ts) AS _day").selectExpr(
        "*", f"count_if(exit_code = 'STOP') {inside} AS _stops").selectExpr(
        "*", f"max(CASE WHEN exit_code IN ('TREND', 'DUST') THEN _stops END) {inside} AS _base")
    chunks = local.groupBy("symbol", "_day").agg(
        F.max("_stops").alias("_total"), F.max("_base").alias("_last")).selectExpr(
        "symbol", "_day", "_last", f"coalesce(sum(_total) {earlier}, 0) AS _before").selectExpr(
        "symbol", "_day", "_before", f"max(_before + _last) {earlier} AS _base_before")
    df = local.join(chunks, ["symbol", "_day"])
    since = F.expr("_before + _stops - coalesce(_before + _base, _base_before, 0)")
    listed = is_stop & (since > 0) & (since % rules.blacklist_stops == 0)

    def later(seconds: int):
        return F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS")

    return df.withColumns({
        "streak": (since % rules.blacklist_stops).cast("int"),
        "blacklisted": listed,
        "cooldown_until": F.when(F.col("exit_code") != "DUST",
                                 later(rules.cooldown_s)),
        "blacklist_until": F.when(listed, later(rules.blacklist_s)),
    }).select(*exits.columns, "streak", "blacklisted", "cooldown_until", "blacklist_until")


def with_exclusions(candidates: DataFrame, streaks: DataFrame, ts: str = "cycle_ts",
                    width: str = "day") -> DataFrame:
    """Attach what earlier exits say about each candidate: streak, cooling down, blacklisted.

    Every exit counts for the streak, a dust close too, which starts no cooldown of its own and leaves a running one
    as it is. ``streaks`` is read several times: pass a stored table.
    """
    df = series.asof_many(candidates, [
        series.Right(streaks, ["streak"]),
        series.Right(streaks.where("cooldown_until IS NOT NULL"), ["cooldown_until"]),
        series.Right(streaks.where("blacklisted"), ["blacklist_until"]),
    ], left_ts=ts, width=width)
    return df.withColumns({
        "cooling": F.coalesce(F.col("cooldown_until") > F.col(ts), F.lit(False)),
        "blacklisted": F.coalesce(F.col("blacklist_until") > F.col(ts), F.lit(False)),
        "stop_count": F.coalesce("streak", F.lit(0)),
    }).drop("cooldown_until", "blacklist_until", "streak")
