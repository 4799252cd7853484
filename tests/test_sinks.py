"""Appends by key, the ledger of batches, marks per symbol, and the cash line of the report."""

import datetime as dt

import pytest
from data import T0

from barflow.operators import positions
from barflow.sources import sinks
from barflow.streaming import runtime


def rows(spark, *at):
    return spark.createDataFrame([(s, T0 + dt.timedelta(days=d), float(d)) for s, d in at],
                                 "symbol string, ts timestamp, x double")


def test_only_the_months_of_a_batch_are_compared(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.append_new(rows(spark, ("a", 0), ("a", 40), ("b", 80), ("b", 80)), path, ["symbol", "ts"])
    sinks.append_new(rows(spark, ("a", 40), ("a", 41), ("c", 0)), path, ["symbol", "ts"])
    assert sorted((r.symbol, r.x) for r in sinks.read_table(spark, path).collect()) == [
        ("a", 0), ("a", 40), ("a", 41), ("b", 80), ("c", 0)]
    day = (T0 + dt.timedelta(days=40)).date()
    known = sinks.of_months(spark, path, ["symbol", "ts"], day, day)
    assert {r.symbol for r in known.collect()} == {"a"} and known.count() == 2
    plan = known._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_month" in filters and "ReadSchema: struct<symbol:string,ts:timestamp>" in plan
    files = known.inputFiles()
    assert files and all("event_month=" in f for f in files)


def test_rows_without_a_time_have_a_place_too(spark, tmp_path):
    path, none = f"{tmp_path}/t", None
    df = spark.createDataFrame([("a", none, 1.0), ("b", T0, 2.0)], "symbol string, ts timestamp, x double")
    for _ in range(2):
        sinks.append_new(df, path, ["symbol", "ts"])
    assert sinks.read_table(spark, path).where("symbol = 'b'").count() == 1
    sinks.append_new(df.where("ts IS NULL"), f"{tmp_path}/only-null", ["symbol", "ts"])
    assert sinks.read_table(spark, f"{tmp_path}/only-null").count() == 1


def test_a_batch_in_the_ledger_is_not_looked_at(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    write = runtime.append_batches(path, ["symbol", "ts"], writer="stream-1")
    write(rows(spark, ("a", 0)), 7)
    assert sinks.committed(spark, path, "stream-1", 7) and not sinks.committed(spark, path, "stream-2", 7)
    # before its entry was written: compared, and nothing is added
    runtime.append_batches(path, ["symbol", "ts"], writer="stream-2")(rows(spark, ("a", 0), ("b", 1)), 7)
    assert sinks.read_table(spark, path).count() == 2

    def unwanted(*_):
        raise AssertionError("the table was looked at")

    monkeypatch.setattr(sinks, "append_new", unwanted)
    write(rows(spark, ("a", 0)), 7)
    with pytest.raises(AssertionError):
        write(rows(spark, ("a", 2)), 8)
    assert not sinks.committed(spark, path, "stream-1", 8)


def legs(spark, *of):
    return spark.createDataFrame([(T0 + dt.timedelta(days=d), s, "w", float(d), 1.0, b) for s, d, b in of],
                                 "ts timestamp, symbol string, wallet string, net double, rsi double, book_ratio double")


def test_both_trade_records_are_compared_in_one_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "CELL_ROWS", 2)
    short, long = f"{tmp_path}/short", f"{tmp_path}/long"
    keys = ["Islem_Zamani", "Sembol", "Kasa_Tipi", "Giris_RSI", "Net_Kar_USDT"]
    runtime.trade_batches(short, long, keys, "a")(legs(spark, ("a", 0, 1.0), ("a", 0, 1.0), ("b", 40, 2.0)), 0)
    # a row that only one table holds is added to the other
    sinks.append_new(sinks.trade_records(legs(spark, ("c", 1, 3.0)))[0], short, keys)
    plans = []
    keep = sinks.stored
    monkeypatch.setattr(sinks, "stored", lambda df, name: plans.append(
        df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    again = legs(spark, ("a", 0, 1.0), ("b", 40, 2.0), ("b", 41, 4.0), ("c", 1, 3.0), ("c", 1, 3.0))
    for writer in ("b", "b", "c"):
        runtime.trade_batches(short, long, keys, writer)(again, 0)
    assert len(plans) == 2 and all(p.count("Exchange hashpartitioning") == 1 for p in plans)
    want = [("a", 0.0), ("b", 40.0), ("b", 41.0), ("c", 1.0)]
    for path in (short, long):
        df = sinks.read_table(spark, path)
        assert sorted((r.Sembol, r.Net_Kar_USDT) for r in df.collect()) == want
    assert sorted(r.OB_Oran for r in sinks.read_table(spark, long).collect()) == [1.0, 2.0, 3.0, 4.0]


def test_a_table_without_rows_keeps_its_schema(spark, tmp_path):
    path = f"{tmp_path}/t"
    for _ in range(2):
        sinks.append_new(rows(spark, ("a", 0)).limit(0), path, ["symbol", "ts"])
    assert sinks.read_table(spark, path).count() == 0
    sinks.append_new(rows(spark, ("a", 0), ("b", 40)), path, ["symbol", "ts"])
    assert sorted(r.x for r in sinks.read_table(spark, path).collect()) == [0.0, 40.0]
    keys = ["Islem_Zamani", "Sembol"]
    runtime.trade_batches(f"{tmp_path}/s", f"{tmp_path}/l", keys, "a")(legs(spark, ("a", 0, 1.0)).limit(0), 0)
    assert sinks.read_table(spark, f"{tmp_path}/l").count() == 0


def test_marks_never_go_back(spark, tmp_path):
    path = f"{tmp_path}/marks"

    def marks(*values):
        return spark.createDataFrame(values, "symbol string, mark_ms bigint")

    assert sinks.read_marks(spark, path).collect() == []
    sinks.write_marks(spark, path, marks(("a", 5), ("b", 9)))
    sinks.write_marks(spark, path, marks(("a", 3), ("c", 1)))
    sinks.write_marks(spark, path, marks(("b", 10)))
    assert {tuple(r) for r in sinks.read_marks(spark, path).collect()} == {("a", 5), ("b", 10), ("c", 1)}
    # a version that is not complete is not seen
    (tmp_path / "marks" / "version=9").mkdir()
    assert sinks.mark_versions(spark, path) == [0, 1, 2]
    sinks.write_marks(spark, path, marks(("a", 6)))
    assert {tuple(r) for r in sinks.read_marks(spark, path).collect()} == {("a", 6), ("b", 10), ("c", 1)}


def test_report_has_cash_without_positions(spark):
    held = spark.createDataFrame([], "symbol string, entry_price double, cost double, entry_ts timestamp, max_ratio double,"
                                     " half_sold boolean")
    tickers = spark.createDataFrame([], "symbol string, last double")
    wallet = spark.createDataFrame([("USDT", 12.5), ("ABC", 3.0)], "coin string, total double")
    (row,) = positions.position_report(held, tickers, wallet, "2026-01-05").collect()
    assert (row.kind, row.symbol, row.value, row.net_pct) == ("CASH", "USDT", 12.5, None)
    (row,) = positions.position_report(held, tickers, wallet.where("coin = 'ABC'"), "2026-01-05").collect()
    assert row.value == 0.0


def test_two_triggers_keep_their_distance(spark, tmp_path):
    import time

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    df = rows(spark, ("a", 0), ("b", 1))
    df.coalesce(1).write.parquet(source)
    stream = runtime.read_stream(spark, source, df.schema)
    query = stream.writeStream.foreachBatch(runtime.append_batches(out, ["symbol", "ts"], "t")).option(
        "checkpointLocation", f"{tmp_path}/checkpoint").trigger(**runtime.cadence("positions")).start()
    try:
        end = time.time() + 60
        while time.time() < end and not sinks.committed(spark, out, "t", 0):
            time.sleep(0.2)
        rows(spark, ("c", 2)).coalesce(1).write.mode("append").parquet(source)
        while time.time() < end and not sinks.committed(spark, out, "t", 1):
            time.sleep(0.2)
        progress = []
        while time.time() < end and len(progress) < 2:
            progress = [p for p in query.recentProgress if p["numInputRows"]]
            time.sleep(0.2)
    finally:
        query.stop()
    assert sinks.read_table(spark, out).count() == 3
    starts = [dt.datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00")) for p in progress]
    # triggers stand on a grid of two seconds
    assert len(starts) == 2 and (starts[1] - starts[0]).total_seconds() > 1.5
