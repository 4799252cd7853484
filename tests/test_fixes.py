"""Cases that once gave wrong results: null prices, time zones, numbered bars, carries."""

import datetime as dt

import pandas as pd
import pytest
from data import T0, bars_frame, random_bars

from barflow.operators import exits, labeling, series
from barflow.plans import labeling_job


def test_a_poll_without_a_price_says_nothing():
    held = exits.Held(100.0, 1000.0, 10.0, 0.0, 0.02, 0.03, 0.0, 0.0)
    polls = pd.DataFrame({"t": [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
                          "price": [100.0, None, 112.0, 0.0, 105.0, 104.0],
                          "rsi_25": 50.0, "vol_faded": False, "flat": False})
    gaps = exits.advance(held, polls)
    full = exits.Held(100.0, 1000.0, 10.0, 0.0, 0.02, 0.03, 0.0, 0.0)
    assert gaps == exits.advance(full, polls[polls["price"] > 0])
    assert gaps and held.top == full.top


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_a_signal_after_the_last_bar_waits_in_every_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = random_bars(("A",), 40)
        last = max(r[1] for r in rows)
        late = (last + dt.timedelta(hours=20))
        signals = spark.createDataFrame([("A", late, 100.0)], "symbol string, ts timestamp, price double")
        as_of = int((late + dt.timedelta(hours=1)).timestamp() * 1000)
        (row,) = labeling.label_signals(signals, bars_frame(spark, rows), as_of).collect()
        assert row.status != "LABELED"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_numbered_bars_label_after_a_mark(spark):
    rows = random_bars(("A",), 200, gaps=False)
    bars = bars_frame(spark, rows)
    at = rows[100][1] + dt.timedelta(minutes=1)
    signals = spark.createDataFrame([("A", at, 100.0)], "symbol string, ts timestamp, price double") \
        .selectExpr("*", "unix_millis(ts) AS ts_ms")
    mark = int((rows[90][1]).timestamp() * 1000)
    as_of = int((rows[-1][1]).timestamp() * 1000)
    plain = labeling_job.label_batch(signals, bars, mark, as_of).first()
    numbered = labeling_job.label_batch(signals, series.with_row_index(bars), mark, as_of).first()
    assert plain.status == numbered.status == "LABELED"
    assert plain.outcome == numbered.outcome


def test_carries_end_with_the_last_left_row(spark):
    rows = random_bars(("A", "B"), 50)
    left = spark.createDataFrame([("A", T0 + dt.timedelta(hours=3))], "symbol string, ts timestamp")
    right = bars_frame(spark, rows).select("symbol", "ts", "c")
    until = int((T0 + dt.timedelta(days=3000)).timestamp() * 1_000_000)
    got = series.asof(left, right, ["c"], width="hour", until=until)
    assert got.count() == 1
    past = [r for r in rows if r[0] == "A" and r[1] <= T0 + dt.timedelta(hours=3)]
    assert got.first().c == (max(past, key=lambda r: r[1])[5] if past else None)


def test_context_is_known_at_the_close(spark):
    """A cycle at a bar's start reads the bar before it: the open bar's values change nothing."""
    from barflow.operators import regime, series

    for open_bar in (1.0, 99.0):
        context = spark.createDataFrame(
            [(T0, 5.0), (T0 + dt.timedelta(minutes=15), open_bar)], "ts timestamp, btc_adx double")
        cycle = spark.createDataFrame([(T0 + dt.timedelta(minutes=15),)], "cycle_ts timestamp")
        got = series.asof_grid(cycle, regime.known_context(context), ["btc_adx"], "cycle_ts").first()
        assert got.btc_adx == 5.0


def test_grid_of_ragged_times(spark):
    """Rows inside a slot count from the next slot on, the last one of several."""
    from barflow.operators import series

    at = [T0 + dt.timedelta(seconds=s) for s in (0, 100, 200, 1000)]
    grid = spark.createDataFrame([(t, i) for i, t in enumerate(at)], "ts timestamp, v int")
    left = spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for s in (0, 150, 899, 900, 1800)],
                                 "ts timestamp")
    got = {r.ts: r.v for r in series.asof_grid(left, grid, ["v"]).collect()}
    assert [got[t] for t in sorted(got)] == [0, 0, 0, 2, 3]


def test_live_hour_average_from_the_twentieth_hour(spark):
    from barflow.operators import features
    from barflow.operators.bars import coarsen

    rows = [("a", T0 + dt.timedelta(hours=h), 1.0, 1.0, 1.0, float(h * h % 7), 1.0) for h in range(22)]
    bars = bars_frame(spark, rows)
    got = {r.ts: r.ema_1h for r in features.with_hourly_trend(
        bars, features.hourly_trend(coarsen(bars)), mode="live").collect()}
    closes = [r[5] for r in rows]
    mean = sum(closes[:20]) / 20
    want = [None] * 19 + [mean, mean + (closes[20] - mean) * 2 / 21]
    assert [got[r[1]] for r in rows[:19]] == want[:19]
    assert all(abs(got[rows[i][1]] - want[i]) < 1e-9 for i in (19, 20))


def test_a_dust_close_clears_the_stop_count(spark):
    from barflow.operators import positions

    exits_seen = [("A", 0, "STOP"), ("A", 2, "DUST"), ("B", 0, "STOP"), ("C", 0, "DUST"), ("D", 0, "STOP"), ("D", 0.9, "DUST")]
    streaks = positions.stop_streaks(spark.createDataFrame(
        [(s, T0 + dt.timedelta(hours=h), code) for s, h, code in exits_seen], "symbol string, ts timestamp, exit_code string"))
    seen = [("A", 1), ("A", 3), ("B", 3), ("C", 0.5), ("D", 0.95)]
    rows = positions.with_exclusions(spark.createDataFrame(
        [(s, T0 + dt.timedelta(hours=h)) for s, h in seen], "symbol string, cycle_ts timestamp"), streaks).collect()
    got = {(r.symbol, r.cycle_ts): (r.stop_count, r.cooling) for r in rows}
    assert [got[s, T0 + dt.timedelta(hours=h)] for s, h in seen] == [
        (1, False), (0, False), (1, False), (0, False), (0, True)]
