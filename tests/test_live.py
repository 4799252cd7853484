"""Live signals: a bar at its last moment is the closed bar, and closed mode reads no bar that is open."""

import datetime as dt
import random

import pytest
from data import T0, bars_frame, random_bars
from pyspark.sql import functions as F

from barflow.config import Rules
from barflow.operators import bars as bar_ops
from barflow.operators import features, live, series
from barflow.plans import signal_cycle
from barflow.streaming.live import Series

RULES = Rules(min_rsi=50.0, min_vol_ratio=1.2, max_atr_ratio=5.0)


@pytest.fixture(scope="module")
def ticks(spark):
    rnd, rows = random.Random(5), []
    for s in "ab":
        price, at = 100.0, T0
        for _ in range(2500):
            at += dt.timedelta(seconds=rnd.choice([20, 70, 200]), microseconds=rnd.randrange(900_000))
            price *= 1 + rnd.gauss(0, 0.004)
            rows.append((s, at, price, float(rnd.randint(1, 9))))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, price double, qty double").cache()


def test_the_last_moment_of_a_bar_is_the_closed_bar(ticks):
    bars = bar_ops.build_bars(ticks).cache()
    rows = live.step(live.open_bars(ticks, 60).join(live.states_before(bars), ["symbol", "ts"]))
    last = {(r.symbol, r.ts): r for r in rows.orderBy("at").collect()}  # later moments replace earlier ones
    closed = series.drop_halo(features.bar_features(bars)).where("idx >= 29").collect()
    assert len(closed) > 200
    for r in closed:
        got = last[r.symbol, r.ts]
        assert (got.o, got.h, got.l, got.c, got.v) == (r.o, r.h, r.l, r.c, r.v)
        assert (got.msb, got.engulf, got.closed_confirm) == (r.msb, r.engulf, r.closed_confirm)
        for name in ("rsi", "atr", "atr_pct", "vol_ratio", "pump_3h", "pump_6h", "high_distance", "ema_15m_distance"):
            assert got[name] == pytest.approx(r[name], rel=1e-9, abs=1e-9), name


def test_a_moment_depends_on_nothing_after_it(ticks):
    """Ticks after a moment, of its own bar too, change nothing about it."""
    def found(some):
        b = bar_ops.build_bars(some)
        rows = live.live_signals(some, b, bar_ops.coarsen(b), RULES, 300)
        return {(r.symbol, r.at): tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows.collect()}

    whole = found(ticks)
    assert len(whole) > 10
    for symbol, at in sorted(whole)[3::max(1, len(whole) // 4)]:
        assert found(ticks.where(F.col("ts") < F.lit(at)))[symbol, at] == whole[symbol, at]


def test_closed_mode_reads_no_open_bar(spark):
    rows = random_bars(("A",), 120, gaps=False)
    cut = rows[100][1] + dt.timedelta(minutes=7)  # inside bar 100
    cycle = spark.createDataFrame([("A", cut)], "symbol string, cycle_ts timestamp")
    bars = series.with_row_index(bars_frame(spark, rows))
    (placed,) = signal_cycle.at_newest_bar(cycle, bars).collect()
    assert placed.bar_ts == rows[99][1]
    # the same bar, whatever the open one and those after it look like
    changed = [r if i < 100 else (*r[:2], 1.0, 9e9, 0.1, 5.0, 1e9) for i, r in enumerate(rows)]
    other = signal_cycle.at_newest_bar(cycle, series.with_row_index(bars_frame(spark, changed)))
    assert other.collect() == [placed]
    closed = {r.ts: r for r in series.drop_halo(features.bar_features(bars)).collect()}[placed.bar_ts]
    again = {r.ts: r for r in series.drop_halo(features.bar_features(
        series.with_row_index(bars_frame(spark, changed)))).collect()}[placed.bar_ts]
    assert closed == again
    hours = bar_ops.coarsen(bars_frame(spark, rows))
    hours_changed = bar_ops.coarsen(bars_frame(spark, changed))
    (a,), (b,) = [features.with_hourly_trend(bars_frame(spark, rows[99:100]), features.hourly_trend(h)).collect()
                  for h in (hours, hours_changed)]
    assert a.ema_1h == b.ema_1h is not None


def test_stream_state_has_a_fixed_size():
    series_, rnd, price = Series(), random.Random(1), 50.0
    for slot in range(5000):
        price *= 1 + rnd.gauss(0, 0.01)
        series_.take((slot * 3, price, price, price, price, 1.0), 300)
        series_ = Series(series_.as_state())
    assert len(series_.bars) == 100 and len(series_.hours) == 50 and series_.n_bars == 5000
