"""From ranked candidates to one decision per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.config import (
    REASON_BALANCE, REASON_MODEL, REASON_ONE_PICK, REASON_REGIME, REGIME_FLAT, Rules,
)
from barflow.functions.money import lot_floor, sellable


def model_rejects(rules: Rules = Rules(), has_model: bool = True) -> Column:
    """No score, a low profit score or a high risk score; never in observe-only mode or without a
    model. A missing risk score does not reject."""
    if rules.observe_only or not has_model:
        return F.lit(False)
    return (
        F.col("ai_score").isNull() | (F.col("ai_score") < rules.min_profit_score)
        | F.coalesce(F.col("risk_score") > rules.max_risk_score, F.lit(False))
    )


def eligible(candidates: DataFrame) -> DataFrame:
    """Candidates of cycles with an open market that are not held, cooling down or blacklisted."""
    return candidates.where(
        F.col("btc_ok") & ~F.col("held") & ~F.col("cooling") & ~F.col("blacklisted"))


def decide(candidates: DataFrame, rules: Rules = Rules(), has_model: bool = True) -> DataFrame:
    """Decision and reason per candidate that passed the rules.

    Needs ``cycle_ts, rank, symbol, ai_score, risk_score, regime, cash, free_cash, ask, lot_step``.
    At most one BUY per cycle: the first by rank that every gate lets through, that the balance
    affords and that fills. Candidates it overtakes are SHADOW with a reason; one whose order would
    be too small is NO_FILL and does not use up the pick. A cycle holds at most ``top_n`` rows, so
    its window is small.
    """
    quantity = lot_floor(F.col("cash") / F.col("ask"), F.col("lot_step"))
    df = candidates.withColumns({
        "_model": model_rejects(rules, has_model),
        "_flat": F.col("regime") == REGIME_FLAT,
        "_affordable": F.col("free_cash") >= F.col("cash") * rules.cash_margin,
        "quantity": quantity,
    }).withColumn("_fills", F.coalesce(sellable("quantity", "ask", rules.min_notional),
                                       F.lit(False)))
    buyable = ~F.col("_model") & ~F.col("_flat") & F.col("_affordable") & F.col("_fills")
    pick = F.min(F.when(buyable, F.col("rank"))).over(Window.partitionBy("cycle_ts"))
    df = df.withColumn("_pick", pick)
    reason = (
        F.when(F.col("_model"), REASON_MODEL)
        .when(F.col("_flat"), REASON_REGIME)
        .when(F.col("rank") > F.col("_pick"), REASON_ONE_PICK)
        .when(~F.col("_affordable"), REASON_BALANCE)
    )
    decision = (
        F.when(F.col("reason").isNotNull(), "SHADOW")
        .when(F.col("rank") == F.col("_pick"), "BUY").otherwise("NO_FILL")
    )
    return df.withColumn("reason", reason).withColumn("decision", decision).drop(
        "_model", "_flat", "_affordable", "_fills", "_pick")


def opened_positions(decisions: DataFrame) -> DataFrame:
    """Position rows of the bought candidates, entry features kept as JSON."""
    features = F.to_json(F.struct("signal", "rsi", "vol_ratio", "atr_pct", "is_whale"))
    return decisions.where(F.col("decision") == "BUY").select(
        "symbol", F.col("ask").alias("entry_price"),
        (F.col("quantity") * F.col("ask")).alias("cost"), F.col("cycle_ts").alias("entry_ts"),
        F.lit(0.0).alias("max_ratio"), F.lit(False).alias("half_sold"),
        features.alias("features_json"))
