"""Streams cut into several batches give what the batch operators give."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from data import T0, bars_frame, random_bars

from barflow.config import Rules
from barflow.operators import positions, regime
from barflow.operators.bars import build_bars
from barflow.operators.throttle import throttle
from barflow.streaming import keyed
from barflow.streaming.bars import stream_bars
from barflow.streaming.runtime import append_batches, cadence, disorder, drain, in_time_order, read_stream

DAY = dt.timedelta(days=1)


def in_batches(spark, df, order, folder, n, flush=False, shuffled=False, late=()):
    """Write n files in time order, or shuffled, and stream them one per batch. ``flush`` adds a row
    of another symbol a month later, which takes the watermark past all others; ``late`` rows follow
    after it."""
    import os

    rows = df.orderBy(*order).collect()
    size = -(-len(rows) // n)
    parts = [rows[i * size:(i + 1) * size] for i in range(n)]
    if shuffled:
        random.Random(n).shuffle(parts)
    if flush:
        time = order[0]
        month = 30 * DAY if time == "ts" else 30 * 86_400
        parts.append([Row(**{**rows[-1].asDict(), "symbol": "~", time: rows[-1][time] + month})])
        parts += [list(late)] if late else []
    os.makedirs(folder)
    for i, chosen in enumerate(parts):
        part = spark.createDataFrame(chosen, df.schema)
        (table,) = [part.toArrow()]
        import pyarrow.parquet as pq
        path = f"{folder}/{i:03d}.parquet"
        pq.write_table(table, path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return read_stream(spark, folder, df.schema, files_per_batch=1)


@pytest.fixture(scope="module")
def ticks(spark):
    rnd = random.Random(8)
    rows, t = [], {"a": 0.0, "b": 0.0}
    for _ in range(600):
        s = rnd.choice("aab")
        t[s] += rnd.expovariate(1 / 300)
        rows.append((s, T0 + dt.timedelta(microseconds=round(t[s] * 1e6)),
                     100 + rnd.gauss(0, 5), 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, price double, qty double")


def test_throttle(spark, ticks, tmp_path):
    stream = in_batches(spark, ticks, ["ts"], f"{tmp_path}/in", 4, flush=True)
    got = drain(keyed.stream_throttle(stream), "t")
    assert sorted(got.collect()) == sorted(throttle(ticks).collect())


def test_order_of_files_does_not_matter(spark, ticks, tmp_path):
    stream = in_batches(spark, ticks, ["ts"], f"{tmp_path}/in", 9, flush=True, shuffled=True)
    got = drain(keyed.stream_throttle(stream, delay="10 days"), "t")
    assert sorted(got.collect()) == sorted(throttle(ticks).collect())


def test_rows_behind_the_watermark_change_nothing(spark, ticks, tmp_path):
    late = [Row(symbol="a", ts=T0 - DAY, price=1.0, qty=1.0)]
    stream = in_batches(spark, ticks, ["ts"], f"{tmp_path}/in", 3, flush=True, late=late)
    got = drain(keyed.stream_throttle(stream), "t")
    assert sorted(got.collect()) == sorted(throttle(ticks).collect())


def test_rows_wait_for_the_watermark(spark, ticks, tmp_path):
    stream = in_batches(spark, ticks, ["ts"], f"{tmp_path}/in", 4)
    got = drain(keyed.stream_throttle(stream, delay="2 hours"), "t").collect()
    newest = max(r.ts for r in ticks.collect())
    assert sorted(got) == sorted(r for r in throttle(ticks).collect()
                                 if r.ts <= newest - dt.timedelta(hours=2))


def test_bars_closed_mode(spark, ticks, tmp_path):
    stream = in_batches(spark, ticks, ["ts"], f"{tmp_path}/in", 3)
    got = drain(stream_bars(stream), "b").collect()
    want = build_bars(ticks).collect()
    newest = max(r.ts for r in ticks.collect())
    assert sorted(got) == sorted(r for r in want if r.ts + dt.timedelta(minutes=16) <= newest)


def test_expiries(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.choice("ab"), T0 + dt.timedelta(hours=i),
             rnd.choice(["STOP", "STOP", "TREND", "LOCK", "DUST"])) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, exit_code string")
    stream = in_batches(spark, df, ["ts"], f"{tmp_path}/in", 5, flush=True, shuffled=True)
    got = drain(keyed.stream_expiries(stream, delay="10 days"), "e").select(
        *positions.stop_streaks(df).columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, positions.stop_streaks(df).collect()))


def test_expiries_of_many_symbols_share_calls(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "LANES", 3)
    rnd = random.Random(5)
    rows = [(f"s{rnd.randrange(150)}", T0 + dt.timedelta(minutes=i),
             rnd.choice(["STOP", "STOP", "TREND", "LOCK", "DUST"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, exit_code string")
    stream = in_batches(spark, df, ["ts"], f"{tmp_path}/in", 6, flush=True)
    checkpoint = f"{tmp_path}/checkpoint"
    got = drain(keyed.stream_expiries(stream, delay="2 hours"), "e", checkpoint=checkpoint).select(
        *positions.stop_streaks(df).columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, positions.stop_streaks(df).collect()))
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "kept").load()
    assert 0 < state.count() <= 3


def test_context(spark, tmp_path):
    rules = Rules(flash_drop=0.02)
    bars = bars_frame(spark, random_bars(("BTC",), 380, seed=3))
    want = {r.ts: r for r in regime.market_context(bars, rules).collect()}
    stream = in_batches(spark, bars, ["ts"], f"{tmp_path}/in", 8, flush=True, shuffled=True)
    got = drain(keyed.stream_context(stream, rules, delay="10 days"), "c").collect()
    assert len(got) == 380
    for r in got:
        w = want[r.ts]
        assert (r.btc_ok, r.regime, r.flash_crash) == (w.btc_ok, w.regime, w.flash_crash)
        assert r.btc_adx == pytest.approx(w.btc_adx)
    assert len({r.btc_ok for r in got}) == 2


def test_labels(spark, tmp_path):
    from pyspark.sql import functions as F

    from barflow.operators import labeling

    bars = bars_frame(spark, random_bars(("a", "b"), 150, seed=5))
    sig = bars.where("v % 3 = 0").selectExpr("symbol", "ts + INTERVAL 100 SECONDS AS ts",
                                             "c AS price")
    events = bars.selectExpr("symbol", "ts", "false AS is_signal", "CAST(NULL AS DOUBLE) AS price",
                             "h", "l", "c").unionByName(
        sig.selectExpr("*", "true AS is_signal"), allowMissingColumns=True)
    stream = in_batches(spark, events, ["ts"], f"{tmp_path}/in", 6)
    got = drain(keyed.stream_labels(stream), "l").collect()
    newest = max(r.ts for r in events.collect()) - dt.timedelta(minutes=1)
    want = labeling.label_signals(sig, bars, 4_000_000_000_000).where("status = 'LABELED'")
    want = want.select("symbol", "ts", "price", "outcome", "result_pct", "max_pct", "min_pct")
    # what the batch finds among signals whose bars all came in time
    due = {(r.symbol, r.ts): r for r in want.collect() if r.ts + dt.timedelta(hours=5) <= newest}
    ends = {(r.symbol, r.ts): r.window[-1] for r in labeling.next_bars(sig, bars).where(
        F.size("window") == 16).collect()}
    for r in got:
        assert tuple(r) == tuple(due[(r.symbol, r.ts)])
    assert (len(got), len(due)) == (len(due), len(due)) and len(due) <= len(ends)


def test_exits_match_batch(spark, tmp_path):
    from test_exits import price_for

    from pyspark.sql import functions as F
    from barflow.functions.money import first_tier, stop_width
    from barflow.plans.position_monitor import sold_legs

    rnd, ticks = random.Random(6), []
    for s in "abc":
        p = 100.0
        for i in range(900):
            p *= 1 + rnd.gauss(0, 0.006)
            ticks.append((s, T0 + dt.timedelta(seconds=60 * i), p))
    entries = [(f"{s}{k}", s, T0 + dt.timedelta(hours=3 * k, seconds=30), 100.0, 20.0, 0.2, 0.0001,
                2.5, k % 2 == 0) for s in "abc" for k in range(5)]
    tf = spark.createDataFrame(ticks, "symbol string, ts timestamp, price double")
    ef = spark.createDataFrame(entries, "position_id string, symbol string, entry_ts timestamp, "
                               "entry_price double, cost double, qty double, lot_step double, "
                               "atr_pct double, is_whale boolean")
    want = sorted(map(str, sold_legs(ef, tf).collect()))
    t = (F.unix_micros("ts") / 1e6).alias("t")
    polls = tf.select("symbol", t, "price", F.lit(None).cast("double").alias("rsi_25"),
                      F.lit(False).alias("vol_faded"), F.lit(False).alias("flat"),
                      F.lit(False).alias("is_entry"))
    e_t = F.unix_micros("entry_ts") / 1e6
    starts = ef.select("position_id", "symbol", e_t.alias("t"), e_t.alias("entry_t"), "entry_price",
                       "cost", "qty", "lot_step", F.lit(True).alias("is_entry"),
                       stop_width("atr_pct", "is_whale").alias("stop_ratio"),
                       first_tier("atr_pct").alias("first_tier"))
    events = starts.unionByName(polls, allowMissingColumns=True).select(*keyed.EVENT_COLUMNS)
    stream = in_batches(spark, events, ["t", "is_entry"], f"{tmp_path}/in", 8, flush=True,
                        shuffled=True)
    got = drain(keyed.stream_exits(stream, delay="10 days"), "x")
    assert sorted(map(str, got.collect())) == want and len(want) > 8
    assert price_for(0.0) > 100


def test_repeated_batch_adds_nothing(spark, ticks, tmp_path):
    write = append_batches(f"{tmp_path}/out", ["symbol", "ts"])
    write(ticks, 1)
    write(ticks, 1)
    assert spark.read.parquet(f"{tmp_path}/out").count() == ticks.count()
    assert cadence("positions") == {"processingTime": "2 seconds"}


def hourly_files(spark, df, folder, reverse):
    """One file for each hour, changed in time order or against it."""
    import os

    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    table = df.orderBy("ts").toArrow()
    hour = pc.floor_temporal(table["ts"], unit="hour")
    os.makedirs(folder)
    hours = sorted(pc.unique(hour).to_pylist())
    for i, h in enumerate(hours):
        path = f"{folder}/{i:03d}.parquet"
        pq.write_table(table.filter(pc.equal(hour, pa.scalar(h, hour.type))), path, coerce_timestamps="us")
        changed = 1_700_000_000 + (len(hours) - i if reverse else i)
        os.utime(path, (changed, changed))
    return len(hours)


@pytest.mark.parametrize("reverse", [True, False])
def test_many_files_against_time_order(spark, ticks, tmp_path, reverse):
    folder = f"{tmp_path}/in"
    assert hourly_files(spark, ticks, folder, reverse) > 20
    spread = disorder(spark, folder)
    assert (spread > 86_400) == reverse and spread >= 0.001
    # what the last watermark has not passed stays in state: a row of another symbol far ahead takes it along
    late = spark.createDataFrame([("~", T0 + 90 * DAY, 1.0, 1.0)], ticks.schema)
    late.coalesce(1).write.mode("append").parquet(folder)
    want = sorted(throttle(ticks).collect())
    stream = read_stream(spark, folder, ticks.schema, files_per_batch=4)
    got = drain(keyed.stream_throttle(stream, delay=f"{spread} seconds"), "t").where("symbol <> '~'")
    assert sorted(got.collect()) == want
    # or put in time order first, and no delay is needed
    ordered = in_time_order(spark.read.schema(ticks.schema).parquet(folder), "ordered", files=24)
    assert disorder(spark, ordered) <= 0.001
    stream = read_stream(spark, ordered, ticks.schema, files_per_batch=2)
    got = drain(keyed.stream_throttle(stream, delay="1 second"), "t").where("symbol <> '~'")
    assert sorted(got.collect()) == want


def test_state_holds_what_waits(spark, ticks, tmp_path):
    """No entry holds a row that the watermark has passed, and entries are few, not one for each row."""
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/checkpoint"
    hourly_files(spark, ticks, folder, False)
    stream = read_stream(spark, folder, ticks.schema, files_per_batch=3)
    drain(keyed.stream_throttle(stream, delay="2 hours"), "t", checkpoint=checkpoint)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load()
    found = state.selectExpr("key.symbol AS symbol", "user_map_key.first AS first").collect() \
        if "user_map_key" in state.columns else state.selectExpr(
            "key.symbol AS symbol", "explode(map_keys(map_value)).first AS first").collect()
    newest = max(r.ts for r in ticks.collect()).timestamp() * 1e6
    assert found and all(r.first > newest - 7200e6 - 1000 for r in found)
    assert len(found) <= 6
