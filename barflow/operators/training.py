"""Classifiers behind an AUC gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.config import Rules
from barflow.functions.values import is_loss, is_profit, signal_code
from barflow.operators.ordering import average_rank_auc, chronological_split
from barflow.session import shared_dir, stored

RISK_FEATURES = ["rsi", "vol_ratio", "atr_pct"]
PROFIT_FEATURES = [*RISK_FEATURES, "signal_code"]
#: Bins of a feature (the booster's own number), rank error of their cuts, and parts of a cell.
BINS, QUANTILE_ERROR, PARTS = 32, 0.001, 4
ORDER = ["ts", "symbol", "entry_price", "rsi", "vol_ratio", "atr_pct", "signal"]


def with_targets(positions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Loss and profit flags (small results are neither) and the signal's ordinal code."""
    return positions.withColumns({
        "is_loss": is_loss("net", rules), "is_profit": is_profit("net", rules),
        "signal_code": signal_code("signal")})


def class_counts(df: DataFrame, target: str):
    """(rows, positives, distinct classes, weight of the positives), one small row on the driver."""
    return df.agg(*class_measures(target)).first()


def class_measures(target: str) -> list[Column]:
    """Aggregates of ``class_counts``; a positive weighs as the negatives per positive, 1 without any."""
    n, pos = F.count(F.lit(1)), F.coalesce(F.sum(target), F.lit(0))
    weight = F.when(pos > 0, (n - pos) / pos).otherwise(1.0)
    return [n.alias("n"), pos.alias("pos"), F.count_distinct(target).alias("classes"),
            weight.alias("weight")]


def bins(df: DataFrame, features: list[str]) -> Bucketizer:
    """Stage that gives the bin of each feature: at most ``BINS``, cut at quantiles of all rows of ``df``."""
    cuts = df.select(*[F.col(c).cast("double") for c in features]).approxQuantile(
        features, [i / BINS for i in range(1, BINS)], QUANTILE_ERROR)
    ends = float("-inf"), float("inf")
    return Bucketizer(inputCols=features, outputCols=[f"_bin_{c}" for c in features], splitsArray=[
        [ends[0], *sorted(set(own)), ends[1]] for own in cuts])


def pipeline(binned: Bucketizer, target: str, trees: int = 100) -> Pipeline:
    booster = GBTClassifier(
        featuresCol="features", labelCol=target, weightCol="weight", maxIter=trees, maxDepth=3,
        stepSize=0.05, subsamplingRate=0.8, seed=42)
    return Pipeline(stages=[binned, VectorAssembler(inputCols=binned.getOutputCols(), outputCol="features"), booster])


def cells(df: DataFrame, binned: Bucketizer, target: str, weight: Column) -> DataFrame:
    """Rows of ``df`` as (bins, target, part, weight): all that a tree on binned features can tell apart. The rows of a
    cell are dealt to ``PARTS`` parts by hash, so that the booster's sampling leaves out parts of a cell."""
    names, inputs = binned.getOutputCols(), binned.getInputCols()
    part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)).alias("_part")
    # one row for each input's value in its middle of the pipeline: the least of the cell, which lies in the same bin
    return binned.transform(df.withColumn("_weight", weight)).groupBy(*names, target, part).agg(
        F.sum("_weight").alias("weight"), *[F.min(c).alias(c) for c in inputs]).drop(*names, "_part")


def fit(df: DataFrame, features: list[str], target: str, counts, trees: int = 100) -> PipelineModel:
    """The booster over the cells of all rows: its hundreds of passes read at most BINS ** features x 2 x PARTS rows, one
    pass reads the table."""
    weight = F.when(F.col(target) == 1, counts.weight).otherwise(1.0)
    shared_dir(df.sparkSession)  # the booster checkpoints its lineage there
    binned = bins(df, features)
    return pipeline(binned, target, trees).fit(stored(cells(df, binned, target, weight), "cells"))


def score(df: DataFrame, model: PipelineModel | None, out: str) -> DataFrame:
    """Class-1 probability; null without a model or with a missing feature."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    keep = df.columns
    needs = model.stages[0].getInputCols()
    complete = F.lit(True)
    for c in needs:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    filled = df.withColumns({f"_in_{c}": F.col(c) for c in needs}).withColumns(
        {c: F.when(complete, F.col(c)).otherwise(F.lit(0.0)) for c in needs}
        | {"_complete": complete})
    scored = model.transform(filled)
    value = F.when(F.col("_complete"), vector_to_array("probability")[1])
    return scored.select(*[F.col(f"_in_{c}").alias(c) if c in needs else F.col(c) for c in keep],
                         value.alias(out))


def gate(split: DataFrame, target: str, scored: Callable[[DataFrame], DataFrame],
         rules: Rules = Rules()) -> tuple[float | None, str]:
    """(test AUC, status) of scores on the newest rows of a split; ``scored`` adds ``_score`` to them
    and is asked only if both sides hold both classes."""
    in_train, in_test = (class_counts(split.where(side), target)
                         for side in ("NOT is_test", "is_test"))
    if in_train.classes < 2 or in_test.classes < 2:
        return None, "ONE_CLASS"
    auc = average_rank_auc(scored(split.where("is_test")), target, "_score").first().auc
    if auc is None:
        return None, "NO_AUC"
    return auc, "BELOW_GATE" if auc < rules.min_auc else "ACCEPTED"


def split_by_time(positions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Stored positions with ``is_test`` for the newest: the same split for every target."""
    return stored(chronological_split(positions, ORDER, rules.test_share), "split")


def train_gated(positions: DataFrame, features: list[str], target: str, rules: Rules = Rules(),
                trees: int = 100) -> tuple[PipelineModel | None, dict]:
    """Train on the older rows, test on the newest; if the AUC passes, refit on all rows. Positions that were
    split before (``split_by_time``) keep their split.

    Returns (model or None, report). A report's ``status`` says why there is no model.
    """
    split = positions if "is_test" in positions.columns else split_by_time(positions, rules)
    counts = class_counts(split, target)

    def by_older_rows(test: DataFrame) -> DataFrame:
        train = split.where(~F.col("is_test"))
        return score(test, fit(train, features, target, class_counts(train, target), trees), "_score")

    auc, status = gate(split, target, by_older_rows, rules)
    report = {"target": target, "n_rows": counts.n, "n_positive": counts.pos, "auc": auc,
              "status": status}
    if status != "ACCEPTED":
        return None, report
    return fit(split, features, target, counts, trees), report
