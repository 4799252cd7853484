"""One global order over many tasks: range-partitioned tables, ranks, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.session import stored


def ranged(df: DataFrame, order: list[str], name: str = "ranged") -> DataFrame:
    """Store ``df`` range-partitioned by ``order``; ``part`` numbers the ranges in order.

    Range bounds come from sampling, so the table is written once and every later read sees the
    same ranges. All order columns take part: a hot first column splits on the next ones.
    """
    placed = df.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    return stored(placed, name)


def _offsets(table: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Totals of all earlier ranges; one row per range (at most the shuffle partition count)."""
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy("part").agg(*[agg.alias(f"_t_{out}") for out, agg in totals.items()])
    return F.broadcast(sums.select(
        "part",
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}")
          for out in totals],
    ))


def with_position(table: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """0-based global position of each row of a ``ranged`` table."""
    offsets = _offsets(table, {out: F.count(F.lit(1))})
    within = Window.partitionBy("part").orderBy(*order)
    return (
        table.withColumn("_rn", F.row_number().over(within)).join(offsets, "part")
        .withColumn(out, F.col(f"_o_{out}") + F.col("_rn") - 1)
        .drop("_rn", f"_o_{out}")
    )


def with_running_sums(table: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Inclusive global running sums: ``sums`` maps output name to column."""
    offsets = _offsets(table, {out: F.sum(col) for out, col in sums.items()})
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    result = table
    for out, col in sums.items():
        result = result.withColumn(f"_w_{out}", F.sum(col).over(within))
    result = result.join(offsets, "part")
    for out in sums:
        result = result.withColumn(out, F.col(f"_w_{out}") + F.col(f"_o_{out}"))
    return result.drop(*[f"_w_{o}" for o in sums], *[f"_o_{o}" for o in sums])


def average_rank_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties; null when one class is empty.

    Rows shrink to one per distinct score with a map-side combine before anything is ordered.
    Pairs won by the positives = negatives strictly below plus half of the tied negatives.
    """
    per_score = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(F.sum(F.col(label).cast("bigint")).alias("pos"),
             F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))
    )
    summed = with_running_sums(ranged(per_score, ["score"], "auc"), ["score"], {"neg_upto": "neg"})
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0)
    return summed.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
        F.sum(won).alias("_won"),
    ).select(
        "n_pos", "n_neg",
        F.try_divide(F.col("_won"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
    )


def chronological_split(df: DataFrame, order: list[str], test_share: float) -> DataFrame:
    """Mark the last ``max(1, int(share * n))`` rows in ``order`` as test (``is_test``)."""
    table = ranged(df, order, "split")
    rows = table.count()
    held_out = max(1, int(rows * test_share))
    return (
        with_position(table, order)
        .withColumn("is_test", F.col("position") >= rows - held_out)
        .drop("part")
    )
