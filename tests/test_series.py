import bisect
import datetime as dt
import random

import pytest
from data import T0, bars_frame, random_bars

from barflow.operators import series


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(3)
    # key "hot" holds most rows; "late" has no right row before its left rows; "none" has none
    left = [(k, at(rnd.randint(0, 6 * 86_400)), i) for i, k in enumerate(
        rnd.choices(["hot", "cold", "none", "late"], [30, 5, 3, 2], k=400))]
    right = [(k, at(t), float(i)) for i, (k, t) in enumerate(sorted(
        {(rnd.choice(["hot", "hot", "cold"]), rnd.randint(0, 5 * 86_400)) for _ in range(60)}))]
    right.append(("late", at(5 * 86_400 + 7), -1.0))
    left += [(k, t, 1000 + i) for i, (k, t, _) in enumerate(right)]  # equal times
    return (left, right, spark.createDataFrame(left, "symbol string, ts timestamp, n int"),
            spark.createDataFrame(right, "symbol string, rts timestamp, x double"))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("until", [None, "2026-01-12 00:00:00"])
@pytest.mark.parametrize("width", ["hour", "day"])
def test_asof_equals_brute_force(sides, strict, until, width):
    left, right, lf, rf = sides
    got = series.asof_many(lf, [series.Right(rf, ["x"], "rts", strict)], width=width,
                           until=until).collect()
    assert len(got) == len(left)
    times = {}
    for k, t, x in right:
        times.setdefault(k, []).append((t, x))
    for r in got:
        seen = [x for t, x in times.get(r.symbol, []) if (t < r.ts if strict else t <= r.ts)]
        assert r.x == (seen[-1] if seen else None)


def test_asof_against_two_tables(spark, sides):
    left, right, lf, rf = sides
    second = rf.selectExpr("symbol", "rts + INTERVAL 1 DAY AS r2", "x * 2 AS y")
    got = series.asof_many(lf, [series.Right(rf, ["x"], "rts"),
                                series.Right(second, ["y"], "r2")]).collect()
    one = {(r.symbol, r.n): r.x for r in series.asof(lf, rf, ["x"], right_ts="rts").collect()}
    two = {(r.symbol, r.n): r.y for r in series.asof(lf, second, ["y"], right_ts="r2").collect()}
    assert {(r.symbol, r.n): (r.x, r.y) for r in got} == {
        k: (one[k], two[k]) for k in one}


def test_asof_on_a_grid(spark):
    rnd = random.Random(5)
    slots = sorted(rnd.sample(range(2, 9000), 200))
    grid = spark.createDataFrame([(at(900 * s), f"v{s}") for s in slots], "ts timestamp, v string")
    left = [(at(rnd.randint(0, 900 * 9500)), i) for i in range(300)]
    got = series.asof_grid(spark.createDataFrame(left, "ts timestamp, n int"), grid, ["v"])
    for r in got.collect():
        i = bisect.bisect_right(slots, (r.ts - T0).total_seconds() / 900)
        assert r.v == (f"v{slots[i - 1]}" if i else None)
    empty = series.asof_grid(spark.createDataFrame(left, "ts timestamp, n int"),
                             grid.where("false"), ["v"])
    assert empty.where("v IS NULL").count() == 300


def test_row_index_and_halo(spark):
    rows = random_bars(n=150)
    df = series.with_row_index(bars_frame(spark, rows), width="day")
    got = sorted((r.symbol, r.ts, r.idx) for r in df.collect())
    assert [i for s, _, i in got if s == "A"] == list(range(150))
    halo = series.halo_chunks(df, 40, 25)
    for r in halo.groupBy("symbol", "chunk").agg({"pos": "min", "idx": "count"}).collect():
        assert r["count(idx)"] <= 65
    own = halo.where("NOT is_halo")
    assert own.count() == 300 and halo.where("is_halo").count() == 2 * (3 * 25 + 15)


def test_running_values_cross_chunks(spark):
    rnd = random.Random(2)
    rows = [("k", at(3600 * i), rnd.choice([None, float(rnd.randint(-9, 9))]), i)
            for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double, i int")
    df = df.withColumn("day", series.time_chunk())
    got = series.running(df, {"s": ("sum", "x"), "m": ("max", "x"), "l": ("last", "x"),
                              "f": ("first", "x")}, "symbol", "day", ["ts"]).orderBy("i").collect()
    seen = []
    for r, (_, _, x, _) in zip(got, rows):
        seen += [] if x is None else [x]
        assert r.s == sum(seen)
        assert (r.m, r.l, r.f) == ((max(seen), seen[-1], seen[0]) if seen else (None,) * 3)
