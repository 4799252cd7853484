import datetime as dt

import pandas as pd
import pytest
from data import T0

from barflow.config import Rules
from barflow.operators import exits

R = Rules()


def price_for(ratio, entry=100.0):
    return entry * (1 + R.fee) * (1 + ratio) / (1 - R.fee)


def held(**kw):
    base = dict(entry_price=100.0, cost=20.0, qty=0.2, lot_step=0.0001, stop_ratio=0.0375,
                first_tier=0.05, entry_t=0.0, clock_t=0.0)
    return exits.Held(**{**base, **kw})


def polls(*steps):
    """Steps of (seconds, net ratio[, rsi[, faded[, flat]]])."""
    rows = [(float(s[0]), price_for(s[1]), s[2] if len(s) > 2 else float("nan"),
             s[3] if len(s) > 3 else False, s[4] if len(s) > 4 else False) for s in steps]
    return pd.DataFrame(rows, columns=exits.POLL_COLUMNS)


def codes(h, *steps):
    return [leg["exit_code"] for leg in exits.advance(h, polls(*steps), R)]


H = 3600.0
FLAT = (float("nan"), True, True)


@pytest.mark.parametrize("steps,want", [
    # stop, and a loss just above it
    ([(2, -0.037), (4, -0.038)], ["STOP"]),
    ([(2, -0.037)], []),
    # profit lock after 2.5 %
    ([(2, 0.026), (4, 0.0101), (6, 0.0099)], ["LOCK"]),
    # first tier: half at -1.5 points, rest at -3 points
    ([(2, 0.06), (4, 0.044), (6, 0.031), (8, 0.0299)], ["PARTIAL", "TREND"]),
    # a fall through both lines in one poll sells half first, the rest at the next poll
    ([(2, 0.06), (4, 0.02), (6, 0.02)], ["PARTIAL", "TREND"]),
    # second and third tier
    ([(2, 0.12), (4, 0.099), (6, 0.0699)], ["PARTIAL", "TREND"]),
    ([(2, 0.25), (4, 0.199), (6, 0.151), (8, 0.149)], ["PARTIAL", "TREND"]),
    # overheated sells half, at most one check a minute
    ([(2, 0.055, 84.0), (4, 0.056, 84.0)], ["OVERHEATED"]),
    ([(2, 0.055, 80.0), (30, 0.056, 99.0), (62, 0.056, 99.0)], []),
    ([(2, 0.055, 80.0), (30, 0.056, 99.0), (63, 0.056, 99.0)], ["OVERHEATED"]),
    # timeout below the expectation; otherwise the clock starts again
    ([(4 * H, 0.004)], ["TIMEOUT"]),
    ([(4 * H, 0.006), (4 * H + 2, 0.001), (8 * H - 2, 0.001)], []),
    ([(4 * H, 0.006), (8 * H, 0.001)], ["TIMEOUT"]),
    # stale: flat market, small band, faded volume, at most one check in ten minutes
    ([(1.5 * H, 0.005, *FLAT)], ["STALE"]),
    ([(1.4 * H, 0.005, *FLAT)], []),
    ([(1.5 * H, 0.011, *FLAT)], []),
    ([(1.5 * H, 0.005, float("nan"), True, False)], []),
    ([(1.5 * H, 0.005, float("nan"), False, True), (1.5 * H + 60, 0.005, *FLAT)], []),
    ([(1.5 * H, 0.005, float("nan"), False, True), (1.5 * H + 601, 0.005, *FLAT)], ["STALE"]),
])
def test_rules(steps, want):
    whole = held()
    assert codes(whole, *steps) == want
    # the same, one poll per call
    single, got = held(), []
    for step in steps:
        got += codes(single, step)
    assert got == want
    assert single.as_row()[8:] == pytest.approx(whole.as_row()[8:])


def test_half_sale_halves_cost_and_safe_exit():
    h = held()
    legs = exits.advance(h, polls((2, 0.055, 90.0), (4, 0.01), (6, 0.005)), R)
    # after the half sale the tier still holds (top 5.5 %): the rest trails it
    assert [leg["exit_code"] for leg in legs] == ["OVERHEATED", "TREND"]
    assert [leg["cost"] for leg in legs] == [10.0, 10.0]
    assert legs[0]["net"] == pytest.approx(10.0 * 0.055 * 1.001)
    safe = held(half=True, top=0.02)
    assert codes(safe, (2, 0.006), (4, 0.005)) == ["SAFE"]
    aged = held(half=True, top=0.02)
    assert codes(aged, (9 * H, 0.006)) == []  # no timeout after a half sale


def test_small_orders_are_not_placed():
    # half is worth too little, the whole is not: the overheated poll falls through to the exits
    h = held(cost=8.0, qty=0.08)
    assert codes(h, (2, 0.06, 90.0), (4, 0.02)) == ["TREND"]
    dust = held(cost=4.0, qty=0.04)
    assert codes(dust, (2, -0.2)) == [] and not dust.closed


def test_batches_are_cut_anywhere(spark):
    """Positions spread over many Arrow batches give the same legs."""
    import random

    from barflow.plans.position_monitor import sold_legs

    rnd, ticks, price = random.Random(4), [], {"a": 50.0, "b": 20.0}
    for i in range(3000):
        for s in price:
            price[s] *= 1 + rnd.gauss(0, 0.004)
            ticks.append((s, T0 + dt.timedelta(seconds=60 * i), price[s]))
    entries = [(f"{s}{k}", s, T0 + dt.timedelta(hours=6 * k, seconds=1), 0.0) for s in price
               for k in range(8)]
    first = {(s, t): p for s, t, p in ticks}
    rows = [(pid, s, t, first[(s, t - dt.timedelta(seconds=1))], 20.0, 20.0 / first[
        (s, t - dt.timedelta(seconds=1))], 0.0001, 2.5, False) for pid, s, t, _ in entries]
    ef = spark.createDataFrame(rows, "position_id string, symbol string, entry_ts timestamp, "
                               "entry_price double, cost double, qty double, lot_step double, "
                               "atr_pct double, is_whale boolean")
    tf = spark.createDataFrame(ticks, "symbol string, ts timestamp, price double")
    want = sorted(sold_legs(ef, tf).collect())
    assert len(want) > 8
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert sorted(sold_legs(ef, tf, until="2026-01-09 00:00:00").collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    finals = {}
    for leg in want:
        finals[leg.position_id] = finals.get(leg.position_id, 0) + leg.is_final
    assert set(finals.values()) <= {0, 1}
