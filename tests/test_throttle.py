import datetime as dt
import random

import pytest
from data import T0

from barflow.operators.throttle import throttle


def greedy(times, gap):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


@pytest.mark.parametrize("chunk_s", [300, 1000, 86_400])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_equals_greedy_scan(spark, chunk_s, batch):
    rnd = random.Random(chunk_s)
    times = {"dense": sorted(rnd.uniform(0, 20_000) for _ in range(900)),
             "sparse": sorted(rnd.uniform(0, 400_000) for _ in range(60)), "one": [5.0],
             "edge": [0.0, 899.999, 900.0, 1799.9, 1800.0, 100_000.0]}
    rows = [(k, T0 + dt.timedelta(microseconds=round(t * 1e6)), i)
            for k, ts in times.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, n int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = throttle(df, 900, chunk_s).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in times:
        micros = [(t - T0) // dt.timedelta(microseconds=1) for s, t, _ in rows if s == k]
        assert sorted((r.ts - T0) // dt.timedelta(microseconds=1)
                      for r in got if r.symbol == k) == greedy(micros, 900_000_000)


def test_equal_times_keep_the_first_by_tie(spark):
    df = spark.createDataFrame([("a", T0, 2), ("a", T0, 1)], "symbol string, ts timestamp, n int")
    assert [r.n for r in throttle(df, 900, tie="n").collect()] == [1]
