"""The closed loop: chunks and blocks of any width give one result; what was bought bars, what was sold frees."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from data import T0

from barflow.config import Rules
from barflow.plans import closed_cycle
from barflow.plans.closed_cycle import Account, decide_cycle

HOUR = 3600.0


def row(symbol, rank=1, **more):
    return SimpleNamespace(**{"symbol": symbol, "rank": rank, "btc_ok": True, "red": False, "flat": False, "fills": True,
                              "cash": 20.0, "ask": 2.0, "quantity": 10.0, "legs": [], **more})


def leg(t, code, cost, net, final=True):
    return {"t": t, "exit_code": code, "cost": cost, "net": net, "is_final": final}


def test_one_pick_and_its_reasons():
    account = Account(45.0, held={"H"}, cooling={"C": 9.0}, listed={"L": 9.0})
    rows = [row("X", btc_ok=False), row("H"), row("C"), row("L"), row("R", red=True), row("F", flat=True),
            row("E", cash=60.0), row("N", fills=False), row("B"), row("A"), row("G", cash=60.0)]
    assert decide_cycle(account, rows, Rules()) == [
        ("CLOSED", None), ("HELD", None), ("COOLING", None), ("BLACKLISTED", None), ("SHADOW", "AI_RED"),
        ("SHADOW", "REJIM_YATAY"), ("SHADOW", "BAKIYE_YETERSIZ"), ("NO_FILL", None), ("BUY", None),
        ("SHADOW", "TEK_ALIM_KURALI"), ("SHADOW", "TEK_ALIM_KURALI")]
    assert account.cash == pytest.approx(45 - 20 * 1.001) and account.held == {"H", "B"}


def test_money_and_symbol_come_back():
    rules, account = Rules(), Account(30.0)
    bought = row("A", legs=[leg(100.0, "PARTIAL", 10.0, 1.0, False), leg(200.0, "STOP", 10.0, -2.0)])
    assert decide_cycle(account, [bought], rules) == [("BUY", None)]
    account.settle(150.0, rules)
    assert account.cash == pytest.approx(30 - 20.02 + 11.01) and account.held == {"A"}
    account.settle(200.0, rules)
    assert account.cash == pytest.approx(30 - 0.0 - 1.0) and not account.held
    assert account.barred("A") == "COOLING" and account.stops == {"A": 1}
    account.settle(200.0 + HOUR, rules)
    assert account.barred("A") is None
    account.buy("A", 20.02, [leg(9000.0, "STOP", 20.0, -1.0)], rules.fee)
    account.settle(9000.0, rules)
    assert account.listed == {"A": 9000.0 + rules.blacklist_s} and account.stops == {}


def test_a_trend_exit_clears_the_stops_and_others_do_not():
    account = Account(0.0, legs=[(1.0, "A", "STOP", 0.0, True), (2.0, "A", "LOCK", 0.0, True)])
    account.settle(3.0, Rules())
    assert account.stops == {"A": 1}
    account.legs = [(4.0, "A", "TREND", 0.0, True)]
    account.settle(5.0, Rules())
    assert account.stops == {}


def test_state_survives_its_text():
    account = Account(1.5, [(3.0, "A", "STOP", 2.0, True)], {"A"}, {"B": 4.0}, {"C": 5.0}, {"A": 1})
    assert closed_cycle.restored(closed_cycle.saved(account)) == account


@pytest.fixture(scope="module")
def market(spark):
    rnd, polls, candidates = random.Random(12), [], []
    for s in "abc":
        price = 100.0
        for i in range(0, 5 * 1440, 7):
            price *= 1 + rnd.gauss(0, 0.006)
            at = T0 + dt.timedelta(minutes=i)
            polls.append((s, at.timestamp(), price, rnd.choice([None, 90.0, 40.0]), rnd.random() < 0.5, rnd.random() < 0.3))
            if i % 210 == 0:
                for account in (1, 2):
                    candidates.append((account, at, len(candidates) % 7, s, 20.0, price, 0.0001, rnd.random() < 0.9,
                                       rnd.choice(["TREND", "TREND", "YATAY", None]), rnd.choice([None, 0.9, 0.8, 0.7]),
                                       rnd.choice([None, 0.1, 0.6]), 2.0, False))
    # d has no polls at all: what is bought is never sold
    candidates += [(2, T0 + dt.timedelta(days=d), 0, "d", 20.0, 10.0, 0.0, True, "TREND", 0.9, None, 2.0, False)
                   for d in range(5)]
    return (spark.createDataFrame(candidates, "account int, cycle_ts timestamp, rank int, symbol string, cash double, ask double,"
                                  " lot_step double, btc_ok boolean, regime string, ai_score double, risk_score double,"
                                  " atr_pct double, is_whale boolean"),
            spark.createDataFrame(polls, "symbol string, t double, price double, rsi_25 double, vol_faded boolean, flat boolean"),
            spark.createDataFrame([(1, 50.0), (2, 1000.0), (3, 10.0)], "account int, cash double"))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_chunks_and_blocks_of_any_width(market):
    whole = rows_of(closed_cycle.run(*market, chunk="month"))
    assert len(whole) == market[0].count()
    assert rows_of(closed_cycle.run(*market, chunk="day", block_s=6 * 3600)) == whole
    found = closed_cycle.run(*market)
    by = {(r.account, r.decision): r["count"] for r in found.groupBy("account", "decision").count().collect()}
    assert by[1, "BUY"] > 3 and by[2, "BUY"] > by[1, "BUY"] and by[1, "HELD"] and by[2, "COOLING"]
    d = [r.decision for r in found.where("symbol = 'd'").orderBy("cycle_ts").collect()]
    assert d[0] == "BUY" and set(d[1:]) == {"HELD"}


def test_positions_side_by_side_are_followed_each_on_its_own(spark, market):
    """Each position alone gives the legs it gives among all others."""
    rows = closed_cycle.gated(market[0])
    entries = closed_cycle.positions_to_follow(rows).limit(12).cache()
    together = rows_of(closed_cycle.followed(entries, market[1], 3600))
    alone = []
    for e in entries.limit(3).collect():
        alone += rows_of(closed_cycle.followed(spark.createDataFrame([e], entries.schema), market[1]))
    assert set(alone) <= set(together) and len(together) > len(alone) > 0


def test_no_candidates_and_no_such_account(market):
    candidates, polls, accounts = market
    assert closed_cycle.run(candidates.limit(0), polls, accounts).collect() == []
    assert closed_cycle.run(candidates.where("account = 1"), polls, accounts.where("account = 3")).collect() == []
