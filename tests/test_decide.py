import datetime as dt

from data import T0

from barflow.config import Rules
from barflow.operators import decide, regime, universe

SCHEMA = ("cycle_ts timestamp, rank int, symbol string, ai_score double, risk_score double, "
          "regime string, cash double, free_cash double, ask double, lot_step double")


def run(spark, rows, rules=Rules(), has_model=True):
    full = [(T0 + dt.timedelta(days=c), r, s, ai, risk, reg, cash, free, ask, step)
            for c, r, s, ai, risk, reg, cash, free, ask, step in rows]
    df = decide.decide(spark.createDataFrame(full, SCHEMA), rules, has_model)
    return {r.symbol: (r.decision, r.reason) for r in df.collect()}


def test_cascade(spark):
    got = run(spark, [
        (0, 1, "low", 0.64, None, "TREND", 20.0, 500.0, 1.0, 0.01),
        (0, 2, "none", None, None, "TREND", 20.0, 500.0, 1.0, 0.01),
        (0, 3, "risky", 0.9, 0.46, "TREND", 20.0, 500.0, 1.0, 0.01),
        (0, 4, "poor", 0.9, 0.45, "TREND", 40.0, 40.3, 1.0, 0.01),
        (0, 5, "tiny", 0.65, None, "TREND", 20.0, 40.3, 30.0, 1.0),
        (0, 6, "first", 0.65, 0.1, "TREND", 20.0, 40.3, 1.0, 0.01),
        (0, 7, "second", 0.9, 0.1, "TREND", 20.0, 40.3, 1.0, 0.01),
        (0, 8, "late_poor", 0.9, 0.1, "TREND", 40.0, 40.3, 1.0, 0.01),
        (1, 1, "flat", 0.9, None, "YATAY", 20.0, 500.0, 1.0, 0.01),
        (1, 2, "flat_low", 0.1, None, "YATAY", 20.0, 500.0, 1.0, 0.01),
    ])
    assert got == {
        "low": ("SHADOW", "AI_RED"), "none": ("SHADOW", "AI_RED"), "risky": ("SHADOW", "AI_RED"),
        "poor": ("SHADOW", "BAKIYE_YETERSIZ"), "tiny": ("NO_FILL", None), "first": ("BUY", None),
        "second": ("SHADOW", "TEK_ALIM_KURALI"), "late_poor": ("SHADOW", "TEK_ALIM_KURALI"),
        "flat": ("SHADOW", "REJIM_YATAY"), "flat_low": ("SHADOW", "AI_RED")}


def test_observe_only_and_no_model_do_not_block(spark):
    row = [(0, 1, "low", 0.1, 0.9, "TREND", 20.0, 500.0, 1.0, 0.01)]
    assert run(spark, row)["low"] == ("SHADOW", "AI_RED")
    assert run(spark, row, Rules(observe_only=True))["low"] == ("BUY", None)
    assert run(spark, row, has_model=False)["low"] == ("BUY", None)


def test_universe(spark):
    rows = [("OK/USDT", 1.0, 2e7), ("币A/USDT", 9.0, 2e7), ("WLDX/USDT", 9.0, 2e7),
            ("A/BTC", 9.0, 2e7), ("THIN/USDT", 9.0, 12_000_000.0), ("NULL/USDT", None, 2e7),
            ("NOVOL/USDT", 9.0, None), ("TIE/USDT", 1.0, 2e7)]
    df = spark.createDataFrame([(T0, *r) for r in rows],
                               "cycle_ts timestamp, symbol string, pct double, quote_volume double")
    got = universe.top_gainers(df).orderBy("rank").collect()
    assert [(r.symbol, r.rank) for r in got] == [("OK/USDT", 1), ("TIE/USDT", 2)]
    assert universe.top_gainers(df, Rules(top_n=1)).count() == 1


def test_band_switch_walk(spark):
    walk = [(99.0, 100.0, False), (100.3, 100.0, False), (100.5, 100.0, False),
            (99.7, 100.0, False), (99.5, 100.0, False), (100.1, 100.0, False),
            (101.0, 100.0, False), (101.0, 100.0, True), (100.2, 100.0, False),
            (101.0, None, False), (100.0, 100.0, False)]
    df = spark.createDataFrame(
        [("b", i, i // 3, *w) for i, w in enumerate(walk)],
        "symbol string, idx int, chunk int, c double, ema_200 double, flash_crash boolean")
    got = regime.band_switch(df).orderBy("idx").collect()
    assert [r.btc_ok for r in got] == [False, False, True, True, False, False, True, False, False,
                                       False, False]
