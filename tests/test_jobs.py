import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from data import T0, bars_frame, random_bars

from barflow import schemas
from barflow.config import Rules
from barflow.operators import series, signals, training
from barflow.operators.bars import coarsen
from barflow.plans import signal_cycle, training_job
from barflow.plans.position_monitor import trade_rows
from barflow.sources import logs, market, sinks


def position_rows(n, informative, seed=1):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        rsi = rnd.uniform(55, 90)
        good = (rsi > 72) if informative else rnd.random() < 0.5
        rows.append((f"S{i % 7}", 1.0 + i, rsi, rnd.uniform(2.5, 6), rnd.uniform(0.5, 3),
                     rnd.choice(["MSB", "Engulf", ""]), 0.5 if good else -0.5,
                     T0 + dt.timedelta(minutes=i)))
    return rows


SCHEMA = ("symbol string, entry_price double, rsi double, vol_ratio double, atr_pct double, "
          "signal string, net double, ts timestamp")


def test_gate_accepts_refits_and_scores(spark, tmp_path):
    df = training.with_targets(spark.createDataFrame(position_rows(400, True), SCHEMA))
    model, report = training.train_gated(df, training.PROFIT_FEATURES, "is_profit", trees=3)
    assert report["status"] == "ACCEPTED" and report["auc"] > 0.9 and report["n_rows"] == 400
    path = str(tmp_path / "model")
    assert sinks.load_model(spark, path) is None
    sinks.save_model(model, path)
    again = sinks.load_model(spark, path)
    probe = df.limit(5).unionByName(df.limit(1).selectExpr(
        *["CAST(NULL AS DOUBLE) AS rsi" if c == "rsi" else c for c in df.columns]))
    rows = training.score(probe, again, "ai_score").collect()
    assert rows[-1].ai_score is None and rows[-1].rsi is None
    assert all((r.ai_score > 0.5) == (r.rsi > 72) for r in rows[:-1])
    assert training.score(probe, None, "ai_score").where("ai_score IS NULL").count() == 6


def test_gate_rejects_noise_and_one_class(spark):
    df = training.with_targets(spark.createDataFrame(position_rows(150, False), SCHEMA))
    model, report = training.train_gated(df, training.RISK_FEATURES, "is_loss",
                                         Rules(min_auc=0.99), trees=2)
    assert model is None and report["status"] == "BELOW_GATE"
    one = df.selectExpr(*[("0 AS is_loss" if c == "is_loss" else c) for c in df.columns])
    assert training.train_gated(one, training.RISK_FEATURES, "is_loss")[1]["status"] == "ONE_CLASS"
    ten = spark.range(10).selectExpr("CAST(id < 4 AS INT) AS some", "0 AS none")
    assert training.class_counts(ten, "some").weight == 1.5
    assert training.class_counts(ten, "none").weight == 1.0


def test_training_job(spark, tmp_path):
    text = spark.createDataFrame(position_rows(160, True), SCHEMA)
    for c, v in (("wallet", "'NORMAL'"), ("exit_price", "'1'"), ("net_pct", "'1'"),
                 ("exit_label", "'x'"), ("age_h", "'1'")):
        text = text.selectExpr("*", f"{v} AS {c}")
    path = str(tmp_path / "log")
    sinks.append_csv(logs.filed(text, schemas.TRADE_NAMES), path, schemas.TRADE_COLUMNS)
    risk, profit = str(tmp_path / "risk"), str(tmp_path / "profit")
    report = training_job.run(spark, [path, str(tmp_path / "none")], risk, profit, trees=2)
    assert report["status"] == "DONE" and report["n_positions"] == 160
    assert report["profit"]["status"] == "ACCEPTED" and sinks.load_model(spark, profit)
    few = training_job.run(spark, [path], risk, profit, Rules(min_positions=1000))
    assert few["status"] == "TOO_FEW"
    assert training_job.run(spark, ["/nowhere"], risk, profit)["status"] == "NO_DATA"


def test_shadow_rows_are_thinned_and_filed(spark):
    rows = [("a", T0 + dt.timedelta(minutes=m), "SHADOW", "AI_RED", 1.5, "MSB")
            for m in (0, 14, 15, 29, 31)] + [("a", T0, "BUY", None, 1.5, "MSB")]
    df = spark.createDataFrame(rows, "symbol string, cycle_ts timestamp, decision string, "
                               "reason string, c double, signal string")
    got = signal_cycle.shadow_signals(df)
    assert got.columns == schemas.SHADOW_COLUMNS
    assert sorted((r.Ts // 60_000) % 60 for r in got.collect()) == [0, 15, 31]


def test_trade_records_have_both_layouts(spark):
    legs = spark.createDataFrame(
        [("p", "a", T0, "STOP", 9.0, 10.0, 20.0, -2.0, -10.2, 0.3, 0.025, True)],
        "position_id string, symbol string, ts timestamp, exit_code string, price double, "
        "entry_price double, cost double, net double, net_pct double, age_h double, "
        "stop_ratio double, is_final boolean")
    features = spark.createDataFrame([("p", "MSB", 60.0, True)],
                                     "position_id string, signal string, rsi double, "
                                     "is_whale boolean")
    features = features.selectExpr("*", "'a' AS symbol", "1D AS entry_price", "1D AS cost")
    short, extended = sinks.trade_records(trade_rows(legs, features))
    assert short.columns == schemas.TRADE_COLUMNS
    assert extended.columns == schemas.TRADE_V2_COLUMNS and len(extended.columns) == 29
    r = extended.first()
    assert (r.Kasa_Tipi, r.Cikis_Tipi, r.Giris_RSI, r.AI_Skor) == (
        "BALİNA", "🛑 STOP LOSS (%-2.5)", 60.0, None)


def test_market_tables(spark, tmp_path):
    bars = bars_frame(spark, random_bars(n=40))
    market.write_bars(bars, str(tmp_path / "bars"), "15m")
    df = market.read_bars(spark, str(tmp_path / "bars"), "15m", ["A"], "2026-01-05 02:00:00", 5)
    assert df.count() == 5 and {r.symbol for r in df.collect()} == {"A"}
    plan = market.read_bars(spark, str(tmp_path / "bars"), "15m", ["A"])._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tf" in text and "EqualTo(symbol,A)" in text
    snap = spark.createDataFrame([(T0, {"A/USDT": (1.0, 2.0, 3.0)})],
                                 "snapshot_ts timestamp, tickers map<string, struct<last:double,"
                                 "percentage:double,quoteVolume:double>>")
    t = market.tickers_from_map(snap)
    assert tuple(t.first())[1:] == ("A/USDT", 1.0, 2.0, 3.0)
    held = spark.createDataFrame([("A/USDT",), ("A/USDT",)], "symbol string")
    assert market.held_tickers(t, held).count() == 1
    bal = spark.createDataFrame([(T0, {"A": 2.0, "B": 0.0, "C": 1.0}, {"A": 0.5})],
                                "snapshot_ts timestamp, total map<string,double>, "
                                "free map<string,double>")
    assert sorted(tuple(r)[1:] for r in market.wallet(bal).collect()) == [
        ("A", 2.0, 0.5), ("C", 1.0, 0.0)]


def test_signals_by_mode(spark):
    """Rules over a path with a volume burst on a new high; the live mode may only differ through
    the hourly average."""
    from barflow.operators import signals
    from barflow.operators.bars import coarsen

    rows = [list(r) for r in random_bars(("A", "B"), 400, seed=11, gaps=False)]
    for r in rows[::37]:
        r[6] = 900.0
        r[5] = r[5] * 1.012
        r[3] = max(r[3], r[5])
    bars = bars_frame(spark, [tuple(r) for r in rows])
    rules = Rules(min_rsi=50.0, max_atr_ratio=0.05)
    hourly = coarsen(bars)
    closed = signals.find_signals(bars, hourly, rules).collect()
    live = signals.find_signals(bars, hourly, rules, mode="live").collect()
    assert closed and live
    for r in closed + live:
        assert r.rsi > 50 and r.vol_ratio > 2.5 and (r.msb or r.engulf) and r.c >= r.ema_1h
        assert r.idx >= 29 and r.atr_pct <= 5 and r.cash == (40.0 if r.is_whale else 20.0)
    with pytest.raises(ValueError):
        signals.find_signals(bars, hourly, rules, mode="other")


def test_bars_around_candidates_give_the_same_features(spark):
    rules = Rules(min_rsi=1.0, min_vol_ratio=0.1, max_atr_ratio=9.0)
    bars = series.with_row_index(bars_frame(spark, random_bars(("a", "b"), 900, seed=11)))
    placed = bars.where("idx BETWEEN 128 AND 255 OR idx BETWEEN 640 AND 680").select(
        "symbol", "idx", "ts")
    around = signal_cycle.near(bars, placed)
    assert around.count() == 2 * 512  # blocks 0, 1, 4 and 5 of both symbols
    hourly = coarsen(bars)
    whole = signals.find_signals(bars, hourly, rules).join(placed, ["symbol", "idx", "ts"])
    cut = signals.find_signals(around, hourly, rules).join(placed, ["symbol", "idx", "ts"])
    want, got = (df.orderBy("symbol", "idx").select(sorted(df.columns)).toPandas()
                 for df in (whole, cut))
    assert len(want) > 5
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)


def test_only_blocks_of_candidates_are_read(spark):
    bars = series.with_row_index(bars_frame(spark, random_bars(("a", "b"), 900, seed=11)))
    placed = bars.where("symbol = 'a' AND idx = 600").select("symbol", "idx")
    around = signal_cycle.near(bars, placed).agg(F.min("idx"), F.max("idx"), F.count("*")).first()
    assert tuple(around) == (384, 639, 256)


def test_booster_reads_cells_not_rows(spark):
    """The rows a booster goes over are bounded by the bins; weights and rows in them add up to the table's."""
    df = spark.range(20_000).selectExpr(
        "CAST(id * 7919 % 20000 AS DOUBLE) AS rsi", "CAST(id % 3 AS DOUBLE) AS vol_ratio", "CAST(1 AS DOUBLE) AS atr_pct",
        "CAST(id * 7919 % 20000 >= 10000 AS INT) AS is_loss")
    binned = training.bins(df, training.RISK_FEATURES)
    rows = training.cells(df, binned, "is_loss", F.when(F.col("is_loss") == 1, 2.0).otherwise(1.0))
    got = rows.agg(F.count("*").alias("n"), F.sum("weight").alias("w")).first()
    assert got.w == 30_000 and got.n <= training.BINS * 3 * 2 * training.PARTS
    same = binned.transform(rows.select(*training.RISK_FEATURES)).distinct()
    assert same.select("_bin_rsi").distinct().count() == training.BINS
    model = training.fit(df, training.RISK_FEATURES, "is_loss", training.class_counts(df, "is_loss"), trees=3)
    # the bins that lie on one side of the step are told apart, whatever the number of rows
    wrong = training.score(df, model, "s").where("(s > 0.5) <> (is_loss = 1)").count()
    assert wrong < 20_000 / training.BINS


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import time

    from barflow.session import CLEANUP, stored

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle_")}

    before = shuffles()
    df = stored(spark.range(10_000).repartition(3).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "t")
    end = time.time() + 10
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(CLEANUP) == "false"
    assert sum(r.n for r in df.collect()) == 10_000


def test_cycle_follows_exits_and_bars_of_ranked_symbols_only(spark, monkeypatch):
    from barflow.catalog import queries
    from barflow.catalog.adapters import table

    seen, placed = {}, signal_cycle.at_newest_bar
    keep = signal_cycle.stored

    def store(df, name, *rest):
        df = keep(df, name, *rest)
        seen.setdefault(name, df)  # the first of a name: ranked is stored again when exclusions are known
        return df

    monkeypatch.setattr(signal_cycle, "stored", store)
    monkeypatch.setattr(signal_cycle, "at_newest_bar", lambda ranked, bars: seen.setdefault("bars", bars) and placed(ranked, bars))
    d = "/root/testdata/sf0.001"
    queries()["signal_cycle"](spark, d).collect()
    wanted, every = ({r.symbol for r in df.select("symbol").distinct().collect()} for df in (
        seen["ranked"], table(spark, d, "events").selectExpr("CAST(user_id AS STRING) AS symbol")))
    streaks, bars = ({r.symbol for r in seen[n].select("symbol").distinct().collect()} for n in ("streaks", "bars"))
    assert len(wanted) < len(every) and streaks <= wanted and bars <= wanted and streaks


def test_both_targets_share_a_split(spark, monkeypatch):
    from barflow.catalog import queries

    names, keep = [], training.stored
    monkeypatch.setattr(training, "stored", lambda df, name: names.append(name) or keep(df, name))
    monkeypatch.setattr(training, "fit", lambda *_: None)
    assert len(queries()["train_gate"](spark, "/root/testdata/sf0.001").collect()) == 2
    assert names == ["split"]
