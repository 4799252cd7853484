"""Reports over labels, trades and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators.ordering import ranged, with_running_sums


def outcome_by_reason(labeled: DataFrame, result: str = "result_pct") -> DataFrame:
    """What rejected signals would have done, by reason: the cost or benefit of each gate."""
    return labeled.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.avg(result).alias("mean_result"),
        F.avg((F.col(result) > 0).cast("double")).alias("hit_rate"))


def threshold_sweep(labeled: DataFrame, thresholds: list[float], by: str = "btc_adx",
                    result: str = "result_pct") -> DataFrame:
    """Outcome of the signals at or above each threshold, in one pass: every row goes once per
    threshold into a partial aggregate."""
    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    return (
        labeled.select(F.explode(F.filter(levels, lambda t: F.col(by) >= t)).alias("threshold"),
                       result)
        .groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(result).alias("mean_result"))
    )


def pnl_by_exit(trades: DataFrame, exit_col: str = "exit_code", net: str = "net",
                ts: str = "ts") -> DataFrame:
    """Net profit by month and exit type with subtotals."""
    return trades.rollup(F.date_format(ts, "yyyy-MM").alias("month"),
                         F.col(exit_col).alias("exit_type")).agg(
        F.sum(net).alias("net"), F.count(F.lit(1)).alias("n"))


def cumulative_profit(trades: DataFrame, order: list[str], net: str = "net") -> DataFrame:
    """Running total of realized profit in ``order`` over all trades, range-partitioned."""
    return with_running_sums(ranged(trades, order, "profit"), order, {"running_net": net}).drop(
        "part")


def total_profit(trades: DataFrame, net: str = "net") -> DataFrame:
    return trades.agg(F.coalesce(F.sum(net), F.lit(0.0)).alias("total_net"))


def run_metrics(rows: DataFrame, positions: DataFrame, target: str) -> dict:
    """Row, position and positive counts of a run."""
    counted = positions.agg(F.count(F.lit(1)).alias("n"),
                            F.coalesce(F.sum(target), F.lit(0)).alias("pos")).first()
    return {"n_rows": rows.count(), "n_positions": counted.n, "n_positive": counted.pos}
