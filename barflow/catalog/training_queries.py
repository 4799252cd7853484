"""Gated training and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog.adapters import flags, rounded
from barflow.catalog.trade_queries import LEGS_SQL, _legs
from barflow.config import Rules
from barflow.operators import ordering, positions, training
from barflow.session import stored



def _positions(spark, d):
    df = training.with_targets(positions.collapse_legs(_legs(spark, d)))
    return stored(df, "positions")


def q_train_gate(spark, d):
    """Outcome of the gate for both targets: counts, test AUC, status."""
    split = training.split_by_time(training.with_targets(positions.collapse_legs(_legs(spark, d))))
    reports = [
        training.train_gated(split, features, target, Rules())[1]
        for features, target in ((training.RISK_FEATURES, "is_loss"),
                                 (training.PROFIT_FEATURES, "is_profit"))]
    return spark.createDataFrame(
        [(r["target"], r["n_rows"], r["n_positive"], r["auc"], r["status"]) for r in reports],
        "target string, n_rows bigint, n_positive bigint, auc double, status string")


def q_train_counts(spark, d):
    """What both trainings see on either side of the split: rows, positives, classes, weight."""
    split = stored(ordering.chronological_split(_positions(spark, d), training.ORDER,
                                                Rules().test_share), "split")
    loss, profit = (
        split.groupBy("is_test").agg(*training.class_measures(t)).withColumn("target", F.lit(t))
        for t in ("is_loss", "is_profit"))
    return loss.unionByName(profit).select("target", *flags("is_test"), "n", "pos", "classes",
                                           *rounded("weight"))


def q_score(spark, d):
    """Probability of a profit for every position."""
    data = _positions(spark, d)
    counts = training.class_counts(data, "is_profit")
    model = training.fit(data, training.PROFIT_FEATURES, "is_profit", counts)
    return training.score(data, model, "ai_score").select("symbol", "is_profit", "ai_score")


QUERIES = {"train_gate": q_train_gate, "score": q_score, "train_counts": q_train_counts}
ORACLES: dict[str, str] = {"train_counts": f"""WITH {LEGS_SQL}, o AS (
  SELECT *, row_number() OVER (ORDER BY ts, symbol, entry_price, rsi, vol_ratio, atr_pct, signal) - 1 AS place,
         count(*) OVER () AS total FROM tgt), s AS (
  SELECT CAST(place >= total - greatest(1, floor(total * 0.2)) AS INTEGER) AS is_test, t.target, t.y
  FROM o, unnest([{{'target': 'is_loss', 'y': is_loss}}, {{'target': 'is_profit', 'y': is_profit}}]) AS u(t))
SELECT target, is_test, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, count(DISTINCT y) AS classes,
       round(CASE WHEN sum(y) > 0 THEN (count(*) - sum(y)) / sum(y)::DOUBLE ELSE 1 END, 6) AS weight
FROM s GROUP BY ALL"""}
