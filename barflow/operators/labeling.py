"""First-touch barrier labels for signals that were not taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.config import Rules
from barflow.operators import series


def next_bars(signals: DataFrame, bars: DataFrame, n: int = Rules.label_bars,
              width: str = "hour", until: int | str | None = None) -> DataFrame:
    """Attach the first ``n`` bars of the symbol that start after the signal, as array ``window``.

    Bars are numbered per symbol, so gaps in time do not matter. Each block of n bars is stored with
    the block after it (at most 2n bars); the signal finds the number of its last bar by an as-of
    join and then needs a single equi-join on (symbol, block), which splits a hot symbol by time.
    """
    indexed = series.with_row_index(bars).select("symbol", "ts", "idx", "h", "l", "c")
    block = F.floor(F.col("idx") / n)
    blocks = (
        indexed.withColumn("block", F.explode(F.array(block, block - 1)))
        .groupBy("symbol", "block")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "h", "l", "c"))).alias("_bars"))
    )
    placed = series.asof(signals, indexed.select("symbol", "ts", "idx"), ["idx"], width=width,
                         until=until)
    first = F.coalesce(F.col("idx") + 1, F.lit(0))
    # the block's array starts at its own first bar, except that block -1 starts with block 0
    return (
        placed.withColumn("_first", first).withColumn("block", F.floor(F.col("_first") / n))
        .join(blocks, ["symbol", "block"], "left")
        .withColumn("window", F.coalesce(
            F.slice("_bars", (F.col("_first") % n + 1).cast("int"), n),
            F.array().cast("array<struct<idx:bigint,h:double,l:double,c:double>>")))
        .drop("_first", "_bars", "block", "idx")
    )


def barrier_label(entry: Column, window: Column, rules: Rules = Rules()) -> Column:
    """Struct (outcome, result_pct, max_pct, min_pct) of the first barrier touched.

    Extremes include the touching bar; with both barriers inside one bar the stop counts; without a
    touch the last close decides.
    """
    state = F.struct(F.lit(None).cast("string").alias("outcome"), F.lit(0.0).alias("hi"),
                     F.lit(0.0).alias("lo"), F.lit(None).cast("double").alias("last"))

    def step(acc, bar):
        up, down = bar["h"] / entry - 1, bar["l"] / entry - 1
        touched = F.when(down <= rules.stop_loss, "STOP").when(up >= rules.take_profit, "TAKE")
        after = F.struct(touched.alias("outcome"), F.greatest(acc["hi"], up).alias("hi"),
                         F.least(acc["lo"], down).alias("lo"), (bar["c"] / entry - 1).alias("last"))
        return F.when(acc["outcome"].isNotNull(), acc).otherwise(after)

    def finish(acc):
        result = (
            F.when(acc["outcome"] == "STOP", rules.stop_loss)
            .when(acc["outcome"] == "TAKE", rules.take_profit).otherwise(acc["last"])
        )
        return F.struct(
            F.coalesce(acc["outcome"], F.lit("TIME")).alias("outcome"),
            F.round(result * 100, 3).alias("result_pct"),
            F.round(acc["hi"] * 100, 3).alias("max_pct"),
            F.round(acc["lo"] * 100, 3).alias("min_pct"))

    return F.aggregate(window, state, step, finish)


def unlabeled(signals: DataFrame, mark_ms: int, as_of_ms: int, labeled: DataFrame | None = None,
              rules: Rules = Rules()) -> DataFrame:
    """Signals after the mark that are old enough, minus those already labeled on (ts_ms, symbol)."""
    ripe = as_of_ms - int(rules.label_wait_h * 3_600_000)
    due = signals.where(F.col("ts_ms").isNotNull() & (F.col("ts_ms") > mark_ms)
                        & (F.col("ts_ms") <= ripe))
    if labeled is not None:
        due = due.join(labeled.select("ts_ms", "symbol"), ["ts_ms", "symbol"], "left_anti")
    return due


def label_signals(signals: DataFrame, bars: DataFrame, as_of_ms: int,
                  rules: Rules = Rules()) -> DataFrame:
    """Signals (``symbol, ts, price, ...``) with ``status`` and label columns.

    LABELED has all its bars; GIVE_UP still lacks some long after the signal; WAIT is tried again;
    BAD has no usable price. Rows do not block one another. Signals after ``as_of_ms`` are left out.
    """
    past = signals.where(F.unix_millis("ts") <= as_of_ms)
    joined = next_bars(past, bars, rules.label_bars, until=as_of_ms * 1000)
    late = F.unix_millis("ts") < as_of_ms - int(rules.label_give_up_h * 3_600_000)
    status = (
        F.when(F.coalesce(F.col("price") <= 0, F.lit(True)), "BAD")
        .when(F.size("window") >= rules.label_bars, "LABELED")
        .when(late, "GIVE_UP").otherwise("WAIT")
    )
    label = F.when(F.col("status") == "LABELED",
                   barrier_label(F.col("price"), F.col("window"), rules))
    return (
        joined.withColumn("status", status).withColumn("_label", label)
        .select(*[c for c in joined.columns if c != "window"], "status",
                F.size("window").alias("n_bars"), "_label.*")
    )


def next_mark(labeled: DataFrame, mark_ms: int) -> int:
    """New progress mark: just before the oldest row still waiting, else the newest row seen."""
    ms = F.unix_millis("ts")
    row = labeled.agg(
        F.min(F.when(F.col("status") == "WAIT", ms)).alias("waiting"),
        F.max(F.when(F.col("status") != "WAIT", ms)).alias("done")).first()
    if row.waiting is not None:
        return max(mark_ms, row.waiting - 1)
    return max(mark_ms, row.done) if row.done is not None else mark_ms
