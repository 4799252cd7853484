"""Labeling job: signals that were not taken and are old enough get their hypothetical outcome."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.config import Rules
from barflow.operators import labeling
from barflow.session import stored
from barflow.sources import sinks


def label_batch(signals: DataFrame, bars: DataFrame, mark_ms: int, as_of_ms: int,
                labeled: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """Due signals with status and label; bars before the oldest due signal are not read."""
    due = labeling.unlabeled(signals, mark_ms, as_of_ms, labeled, rules)
    since = F.timestamp_millis(F.lit(max(mark_ms, 0)))
    # a signal needs no bar that starts before it, except to number the one it falls into
    recent = bars.where(F.col("ts") > since).drop("idx") if mark_ms > 0 else bars
    return labeling.label_signals(due, recent, as_of_ms, rules)


def known_labels(spark: SparkSession, target: str, mark_ms: int, as_of_ms: int) -> DataFrame | None:
    """Keys of the labels of signals between a mark and now; other months are not read."""
    lo, hi = (dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).date() for ms in (max(mark_ms, 0), as_of_ms))
    return sinks.of_months(spark, target, ["ts_ms", "symbol"], lo, hi)


def append_result(result: DataFrame, columns: list[str], target: str, rejects: str | None) -> None:
    """Labels go to ``target``, rows that never get one (BAD, GIVE_UP) with their status to ``rejects``, by default
    beside the target."""
    done = result.where(F.col("status") == "LABELED").drop("status", "n_bars")
    sinks.append_new(done, target, ["ts_ms", "symbol"])
    never = result.where(F.col("status").isin("BAD", "GIVE_UP")).select(*columns, "status", "n_bars")
    sinks.append_new(never, rejects or f"{target}_rejects", ["ts_ms", "symbol"])


def status_counts(result: DataFrame) -> dict:
    return {r.status: r.n for r in result.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}


def run(spark: SparkSession, signals: DataFrame, bars: DataFrame, target: str, mark_path: str,
        as_of_ms: int, rules: Rules = Rules(), rejects: str | None = None) -> dict:
    """Label, append (only rows the target does not hold), then advance the mark.

    A failure between the steps repeats them, and the appends drop what is there.
    """
    mark = sinks.read_mark(spark, mark_path)
    result = stored(label_batch(signals, bars, mark, as_of_ms, known_labels(spark, target, mark, as_of_ms), rules), "labels")
    append_result(result, signals.columns, target, rejects)
    advanced = labeling.next_mark(result, mark)
    sinks.write_mark(spark, mark_path, advanced)
    return {"mark": advanced, **status_counts(result)}


def run_by_symbol(spark: SparkSession, signals: DataFrame, bars: DataFrame, target: str, marks_path: str,
                  as_of_ms: int, rules: Rules = Rules(), rejects: str | None = None) -> dict:
    """The job with a mark for each symbol: a symbol whose signals arrive late, after others have moved on, is still
    labeled, and one that waits holds back no other. Signals behind their own symbol's mark are not looked at again.

    The marks are one row per symbol; the join with them decides which signals are due.
    """
    marks = sinks.read_marks(spark, marks_path)
    oldest = marks.agg(F.min("mark_ms")).first()[0] or 0
    after = signals.join(marks, "symbol", "left").where(
        F.col("ts_ms") > F.coalesce("mark_ms", F.lit(0))).select(*signals.columns)
    # a symbol without a mark may have signals of any time
    due = stored(labeling.unlabeled(after, 0, as_of_ms, None, rules), "due")
    first = due.agg(F.min("ts_ms")).first()[0]
    if first is None:
        return {"oldest_mark": oldest}
    known = known_labels(spark, target, first, as_of_ms)
    result = stored(labeling.label_signals(labeling.unlabeled(due, 0, as_of_ms, known, rules), bars, as_of_ms, rules), "labels")
    append_result(result, signals.columns, target, rejects)
    waiting = F.min(F.when(F.col("status") == "WAIT", F.col("ts_ms") - 1))
    seen = F.max(F.when(F.col("status") != "WAIT", F.col("ts_ms")))
    sinks.write_marks(spark, marks_path, result.groupBy("symbol").agg(F.coalesce(waiting, seen).alias("mark_ms")).where(
        "mark_ms IS NOT NULL"))
    return {"oldest_mark": oldest, **status_counts(result)}
