"""Training job: trade logs to two gated classifiers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from barflow.config import Rules
from barflow.operators import positions, training
from barflow.session import stored
from barflow.sources import logs, sinks


def run(spark: SparkSession, trade_paths: list[str], risk_path: str, profit_path: str,
        rules: Rules = Rules(), since: str | None = None, trees: int = 100) -> dict:
    """Train and store the models that pass the gate; a model that does not leaves the stored one
    alone."""
    trades = logs.read_trades(spark, trade_paths, since)
    if trades is None or trades.isEmpty():
        return {"status": "NO_DATA"}
    collapsed = stored(training.with_targets(positions.collapse_legs(trades), rules), "positions")
    report = {"n_rows": trades.count(), "n_positions": collapsed.count()}
    if report["n_positions"] < rules.min_positions:
        return {**report, "status": "TOO_FEW"}
    jobs = {"risk": (training.RISK_FEATURES, "is_loss", risk_path),
            "profit": (training.PROFIT_FEATURES, "is_profit", profit_path)}
    split = training.split_by_time(collapsed, rules)
    for name, (features, target, path) in jobs.items():
        model, report[name] = training.train_gated(split, features, target, rules, trees)
        if model is not None:
            sinks.save_model(model, path)
    return {**report, "status": "DONE"}
