import datetime as dt
import random

import pytest
from data import OVERFLOW_LINE, T0, TRADE_LINES, V2_LINES

from barflow import schemas
from barflow.config import Rules
from barflow.functions import book, money, values
from barflow.operators import ordering, positions, reports
from barflow.sources import logs, sinks


@pytest.fixture(scope="module")
def trades(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("trades") / "log.csv"
    path.write_text(TRADE_LINES, encoding="utf-8")
    return logs.read_trades(spark, [str(path), str(path) + ".missing"])


def test_scan_drops_headers_and_damage_and_skips_missing_files(spark, trades):
    assert trades.count() == 6
    assert logs.read_trades(spark, ["/nowhere/at/all.csv"]) is None
    assert logs.clean_trades(logs.filed(trades.selectExpr(*[f"CAST({c} AS STRING) AS {c}"
                                                            for c in trades.columns]),
                                        schemas.TRADE_NAMES), "2026-09-21 01:00:00").count() == 3


def test_stored_net_ratio_is_reproduced(trades):
    for r in trades.withColumn("again", money.net_ratio("entry_price", "exit_price") * 100).collect():
        assert r.again == pytest.approx(r.net_pct, abs=1e-12)


def test_legs_collapse_to_positions(trades):
    rows = {r.symbol: r for r in positions.collapse_legs(trades).collect()}
    assert len(rows) == 5 and rows["AAA/USDT"].n_legs == 2
    legs = [(x * 0.999 - 2.0 * 1.001) / (2.0 * 1.001) * 10.0 for x in (2.06, 2.05)]
    assert rows["AAA/USDT"].net == pytest.approx(sum(legs))
    assert rows["AAA/USDT"].ts == dt.datetime(2026, 9, 21, 0, 35, 0, 250000)


def test_collapse_keeps_a_missing_signal_and_drops_a_missing_key(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0, 1.0, 1.0, None, 2.0, T0), ("a", 1.0, 1.0, 1.0, 1.0, None, 3.0, T0),
         ("a", 1.0, None, 1.0, 1.0, "MSB", 9.0, T0)],
        "symbol string, entry_price double, rsi double, vol_ratio double, atr_pct double, "
        "signal string, net double, ts timestamp")
    (row,) = positions.collapse_legs(df).collect()
    assert (row.signal, row.net, row.n_legs) == ("", 5.0, 2)


def test_ragged_rows_go_to_the_layout_that_wrote_them(spark):
    lines = spark.createDataFrame([(x,) for x in V2_LINES] + [(",".join(
        schemas.TRADE_V2_COLUMNS),)], "value string")
    cols = schemas.TRADE_V2_COLUMNS
    clean, bad = logs.repair_ragged(lines, schemas.layouts_of(cols), cols)
    old, new = clean.orderBy("Islem_Zamani").collect()
    assert old.Sym_ADX is None and old.AI_Skor == "0.625" and old.Stop_Sayisi == "1"
    assert (new.Sym_ADX, new.BTC_ADX, new.AI_Skor, new.Filtre_Skor) == (
        "35.5", "22.5", "0.125", "0.875")
    assert new.OB_Oran is None
    (lost,) = bad.collect()
    assert lost.n_fields == 2 and lost.line == V2_LINES[2]


def test_overflow_cell_opens(spark):
    lines = spark.createDataFrame([(OVERFLOW_LINE,)], "value string")
    cols = schemas.LABELED_COLUMNS
    clean, _ = logs.repair_ragged(lines, schemas.layouts_of(cols), cols)
    r = clean.first()
    assert (r.Sym_ADX, r.BTC_ADX, r.AI_Skor, r.Filtre_Skor) == ("18.5", "16.5", "0.125", "0.375")
    assert (r.Sanal_Sonuc_Pct, r.Min_Kar_Pct) == ("2.5", "-1.5")


def test_schema_evolution_and_idempotent_append(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "x")], "k int, gone string")
    new = spark.createDataFrame([(2, 0.5)], "k int, fresh double")
    assert sinks.evolved(old, new).columns == ["k", "gone", "fresh"]
    sinks.append_table(old, path)
    sinks.append_new(new, path, ["k"])
    sinks.append_new(new.unionAll(new), path, ["k"])
    assert sorted(tuple(r) for r in sinks.read_table(spark, path).select(
        "k", "gone", "fresh").collect()) == [(1, "x", None), (2, None, 0.5)]
    assert sinks.reindexed(old, ["fresh", "k"]).columns == ["fresh", "k"]


def test_progress_mark(spark, tmp_path):
    path = str(tmp_path / "mark")
    assert sinks.read_mark(spark, path) == 0
    sinks.write_mark(spark, path, 17)
    sinks.write_mark(spark, path, 5)
    assert sinks.read_mark(spark, path) == 17
    spark.createDataFrame([("not a number",)], "v string").write.mode("overwrite").text(path)
    assert sinks.read_mark(spark, path) == 0


def test_values(spark):
    df = spark.createDataFrame(
        [("1", 1.5), (" 2e3 ", None), ("x", 0.0), ("", 2.0), ("1d", 0.0), ("12.9", 1.0)],
        "t string, d double")
    rows = df.select(values.to_number("t").alias("n"), values.to_epoch_ms("t").alias("ms"),
                     values.or_default(df.d, 7.0).alias("d")).collect()
    assert [r.n for r in rows] == [1.0, 2000.0, None, None, None, 12.9]
    assert [r.ms for r in rows] == [1, 2000, None, None, None, 12]
    assert [r.d for r in rows] == [1.5, 7.0, 7.0, 2.0, 7.0, 1.0]
    label = spark.range(1).selectExpr("'STOP' AS code", "0.025D AS w")
    assert label.select(values.stored_exit_label("code", "w")).first()[0] == "🛑 STOP LOSS (%-2.5)"


def test_fill_price_chain(spark):
    df = spark.createDataFrame(
        [(3.0, [(1.0, 1.0)], 9.0), (0.0, [(1.0, 1.0), (4.0, 2.0)], 9.0), (None, [], 9.0),
         (None, [(5.0, 0.0)], 9.0)],
        "average double, fills array<struct<price:double,amount:double>>, fallback double")
    got = df.select(book.fill_price(df.average, df.fills, df.fallback).alias("p")).collect()
    assert [r.p for r in got] == [3.0, 3.0, 9.0, 9.0]


def test_imbalance_depth_and_empty_side(spark):
    df = spark.createDataFrame(
        [([(2.0, 1.0), (1.0, 5.0)], [(4.0, 1.0)]), ([(1.0, 1.0)], [])],
        "bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    got = df.select(book.imbalance(df.bids, df.asks).alias("r"),
                    book.imbalance(df.bids, df.asks, 1).alias("r1"),
                    book.best_ask(df.asks).alias("a")).collect()
    assert [(r.r, r.r1, r.a) for r in got] == [(1.75, 0.5, 4.0), (0.0, 0.0, None)]


def test_streaks_cross_days(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), T0 + dt.timedelta(hours=5 * i),
             rnd.choice(["STOP", "STOP", "STOP", "TREND", "LOCK", "DUST"])) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, exit_code string")
    got = {(r.symbol, r.ts): r for r in positions.stop_streaks(df).collect()}
    count = {"a": 0, "b": 0}
    for s, t, code in rows:
        r = got[(s, t)]
        if code == "STOP":
            count[s] += 1
        elif code in ("TREND", "DUST"):
            count[s] = 0
        listed = count[s] == 2 and code == "STOP"
        count[s] %= 2
        assert (r.streak, r.blacklisted) == (count[s], listed)
        assert r.blacklist_until == (t + dt.timedelta(days=1) if listed else None)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def test_auc_with_ties_and_one_class(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randint(0, 1), float(rnd.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "y int, s double")
    assert ordering.average_rank_auc(df, "y", "s").first().auc == pytest.approx(brute_auc(pairs))
    assert ordering.average_rank_auc(df.where("y = 1"), "y", "s").first().auc is None


def test_chronological_split_with_a_hot_time(spark):
    rows = [(T0, i) for i in range(90)] + [(T0 + dt.timedelta(days=1), i) for i in range(10)]
    df = spark.createDataFrame(rows, "ts timestamp, k int")
    got = ordering.chronological_split(df, ["ts", "k"], 0.2)
    assert got.where("is_test").count() == 20
    assert {r.k for r in got.where("is_test AND CAST(ts AS DATE) = DATE '2026-01-05'").collect()} == set(range(80, 90))
    assert ordering.chronological_split(df.limit(3), ["ts", "k"], 0.2).where("is_test").count() == 1
    total = reports.cumulative_profit(df, ["ts", "k"], "k").orderBy("ts", "k").collect()
    assert [r.running_net for r in total][-1] == sum(k for _, k in rows)


def test_reconcile_actions(spark):
    wallet = spark.createDataFrame(
        [("AAA", 5.0), ("BBB", 0.001), ("CCC", 100.0), ("EURI", 100.0), ("BNB", 100.0),
         ("DDD", 1.0), ("FFF", 50.0), ("ZERO", 0.0)], "coin string, total double")
    held = spark.createDataFrame([("AAA/USDT",), ("BBB/USDT",), ("GONE/USDT",), ("NOPX/USDT",)],
                                 "symbol string")
    tickers = spark.createDataFrame(
        [(f"{c}/USDT", 1.0) for c in ("AAA", "BBB", "CCC", "EURI", "BNB", "DDD", "GONE")],
        "symbol string, last double")
    got = {r.symbol: r.action for r in positions.reconcile(wallet, held, tickers).collect()}
    assert got == {"AAA/USDT": "KEEP", "BBB/USDT": "CLOSE_DUST", "CCC/USDT": "ADOPT",
                   "EURI/USDT": "KEEP", "BNB/USDT": "KEEP", "DDD/USDT": "KEEP",
                   "FFF/USDT": "KEEP", "GONE/USDT": "CLOSE_DUST", "NOPX/USDT": "UNKNOWN_PRICE"}


def test_report_and_sweep(spark):
    df = spark.createDataFrame(
        [("AI_RED", 4.0, 30.0), ("REJIM_YATAY", -3.0, 18.0), ("REJIM_YATAY", 1.0, 10.0)],
        "reason string, result_pct double, btc_adx double")
    got = {r.reason: (r.n, r.mean_result, r.hit_rate) for r in
           reports.outcome_by_reason(df).collect()}
    assert got == {"AI_RED": (1, 4.0, 1.0), "REJIM_YATAY": (2, -1.0, 0.5)}
    sweep = {r.threshold: r.n for r in reports.threshold_sweep(df, [0, 15, 20]).collect()}
    assert sweep == {0.0: 3, 15.0: 2, 20.0: 1}
    assert Rules().fee == 0.001
