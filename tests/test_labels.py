import datetime as dt
import random

import pytest
from data import T0, bars_frame
from pyspark.sql import functions as F

from barflow.config import Rules
from barflow.operators import labeling

BAR = dt.timedelta(minutes=15)


def bars_of(spark, lists, gap_at=None):
    rows = []
    for symbol, bars in lists.items():
        for i, (h, low, c) in enumerate(bars):
            late = dt.timedelta(hours=3) if gap_at is not None and i >= gap_at else dt.timedelta()
            rows.append((symbol, T0 + (i + 1) * BAR + late, c, h, low, c, 1.0))
    return bars_frame(spark, rows)


QUIET = (101.0, 99.0, 100.5)
CASES = {
    "stop": [QUIET] * 3 + [(102.0, 96.0, 97.0)] + [(120.0, 80.0, 90.0)] * 12,
    "take": [QUIET] * 2 + [(104.5, 98.0, 104.0)] + [QUIET] * 13,
    "both": [(105.0, 96.5, 100.0)] + [QUIET] * 15,
    "time": [QUIET] * 15 + [(103.9, 97.1, 102.0)],
    "edge_stop": [(100.0, 97.0, 100.0)] + [QUIET] * 15,
    "short": [QUIET] * 15,
}
WANT = {
    "stop": ("STOP", -3.0, 2.0, -4.0), "take": ("TAKE", 4.0, 4.5, -2.0),
    "both": ("STOP", -3.0, 5.0, -3.5), "time": ("TIME", 2.0, 3.9, -2.9),
    "edge_stop": ("STOP", -3.0, 0.0, -3.0),
}


@pytest.mark.parametrize("gap_at", [None, 5])
def test_every_branch(spark, gap_at):
    signals = spark.createDataFrame([(s, T0, 100.0) for s in CASES] + [("none", T0, 100.0),
                                                                       ("bad", T0, None)],
                                    "symbol string, ts timestamp, price double")
    as_of = int((T0 + dt.timedelta(hours=10)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = {r.symbol: r for r in labeling.label_signals(
        signals, bars_of(spark, CASES, gap_at), as_of).collect()}
    for symbol, want in WANT.items():
        r = rows[symbol]
        assert (r.status, r.outcome, r.result_pct, r.max_pct, r.min_pct) == ("LABELED", *want)
    assert rows["short"].status == "WAIT" and rows["short"].n_bars == 15
    assert rows["none"].status == "WAIT" and rows["bad"].status == "BAD"
    late = labeling.label_signals(signals, bars_of(spark, CASES), as_of + 48 * 3_600_000)
    assert {r.symbol for r in late.where("status = 'GIVE_UP'").collect()} == {"short", "none"}


def test_bar_at_the_signal_time_does_not_count(spark):
    bars = bars_of(spark, {"s": [(200.0, 1.0, 100.0)] + [QUIET] * 16})
    signals = spark.createDataFrame([("s", T0 + BAR, 100.0)],
                                    "symbol string, ts timestamp, price double")
    got = labeling.next_bars(signals, bars).first()
    assert len(got.window) == 16 and {b.h for b in got.window} == {101.0}


def test_windows_equal_brute_force(spark):
    rnd = random.Random(1)
    bars = [("s", T0 + 900 * i * dt.timedelta(seconds=1), 1.0, 1.0 + i, 1.0, 1.0, 1.0)
            for i in sorted(rnd.sample(range(400), 150))]
    times = [T0 + dt.timedelta(seconds=rnd.randint(-5000, 400 * 900)) for _ in range(80)]
    signals = spark.createDataFrame([("s", t, 1.0) for t in times],
                                    "symbol string, ts timestamp, price double")
    for r in labeling.next_bars(signals, bars_frame(spark, bars), 16).collect():
        assert [b.h for b in r.window] == [b[3] for b in bars if b[1] > r.ts][:16]


def test_marks_and_due_rows(spark):
    rows = [("a", 1000), ("b", 1000), ("a", 2000), ("a", None), ("a", 10 ** 14)]
    signals = spark.createDataFrame(rows, "symbol string, ts_ms bigint")
    done = spark.createDataFrame([("a", 1000)], "symbol string, ts_ms bigint")
    due = labeling.unlabeled(signals, 500, 10 ** 9, done)
    assert sorted((r.symbol, r.ts_ms) for r in due.collect()) == [("a", 2000), ("b", 1000)]
    seen = spark.createDataFrame([(1000, "LABELED"), (2000, "WAIT"), (3000, "LABELED")],
                                 "ms bigint, status string")
    seen = seen.withColumn("ts", F.timestamp_millis("ms"))
    assert labeling.next_mark(seen, 0) == 1999  # the waiting row is not passed over
    assert labeling.next_mark(seen.where("status <> 'WAIT'"), 0) == 3000
    assert labeling.next_mark(seen.where("false"), 42) == 42


def test_job_is_repeatable(spark, tmp_path):
    from barflow.plans import labeling_job

    signals = spark.createDataFrame([(s, T0, 100.0) for s in CASES],
                                    "symbol string, ts timestamp, price double")
    signals = signals.withColumn("ts_ms", F.unix_millis("ts"))
    ms = signals.first().ts_ms
    bars = bars_of(spark, CASES)
    target, mark = str(tmp_path / "labels"), str(tmp_path / "mark")
    first = labeling_job.run(spark, signals, bars, target, mark, ms + 6 * 3_600_000)
    assert first["LABELED"] == 5 and first["WAIT"] == 1 and first["mark"] == ms - 1
    again = labeling_job.run(spark, signals, bars, target, mark, ms + 6 * 3_600_000)
    assert "LABELED" not in again and again["WAIT"] == 1
    last = labeling_job.run(spark, signals, bars, target, mark, ms + 60 * 3_600_000)
    assert last["GIVE_UP"] == 1 and last["mark"] == ms
    assert spark.read.parquet(target).count() == 5
    bad = spark.createDataFrame([("z", T0, None, ms)], "symbol string, ts timestamp, price double, ts_ms bigint")
    labeling_job.run(spark, bad, bars, target, str(tmp_path / "other"), ms + 60 * 3_600_000)
    kept = spark.read.parquet(f"{target}_rejects").collect()
    assert sorted(r.status for r in kept) == ["BAD", "GIVE_UP"]
    assert Rules().label_bars == 16
