import numpy as np
import pytest
from data import bars_frame, random_bars

from barflow.operators import features, series
from barflow.operators import indicators as ind


def naive_smooth(values, n, alpha, seed="sma"):
    if len(values) < n:
        return None
    if seed == "weighted":
        w = (1 - alpha) ** np.arange(len(values) - 1, -1, -1)
        return float((w * values).sum() / w.sum())
    k = n if seed == "sma" else 1
    acc = float(np.mean(values[:k]))
    for x in values[k:]:
        acc += (x - acc) * alpha
    return acc


def naive_adx(h, low, n=14):
    if len(h) < 2 * n:
        return 0.0
    plus, minus = [], []
    for i in range(1, len(h)):
        u, d = h[i] - h[i - 1], low[i - 1] - low[i]
        plus.append(u if u > d and u > 0 else 0.0)
        minus.append(d if d > u and d > 0 else 0.0)
    dx = []
    for j in range(n, len(plus) + 1):
        p, m = naive_smooth(plus[:j], n, 1 / n), naive_smooth(minus[:j], n, 1 / n)
        dx.append(100 * abs(p - m) / (p + m) if p + m else 0.0)
    return naive_smooth(dx, n, 1 / n)


def by_symbol(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {s: np.array([[x[2], x[3], x[4], x[5], x[6]] for x in v]) for s, v in out.items()}


@pytest.mark.parametrize("seed", ["sma", "first", "weighted"])
def test_bounded_smoothing_equals_recursion_for_any_chunking(spark, seed):
    rows = random_bars(n=230)
    bars = bars_frame(spark, rows)
    want = by_symbol(rows)
    for chunk in (64, 4096):
        df = features.prepared(bars, 60, chunk)
        df = ind.with_smooths(df, [ind.ema("ema", "c", 20, 60, seed),
                                   ind.wilder("w", "gain", 14, 50, seed)], chunk)
        got = series.drop_halo(df).select("symbol", "idx", "ema", "w").collect()
        assert len(got) == len(rows)
        for r in got:
            c = want[r.symbol][:, 3]
            e = naive_smooth(c[max(0, r.idx - 59):r.idx + 1], 20, 2 / 21, seed)
            gains = np.maximum(np.diff(c[max(0, r.idx - 49):r.idx + 1]), 0)
            g = naive_smooth(gains, 14, 1 / 14, seed)
            for a, b in ((r.ema, e), (r.w, g)):
                assert (a is None) == (b is None)
                assert a is None or a == pytest.approx(b, rel=1e-9)


def test_trend_index_equals_recursion_and_honours_only(spark):
    rows = random_bars(n=120)
    want = by_symbol(rows)
    df = features.prepared(bars_frame(spark, rows), 50, 64)
    full = ind.with_adx(df, 50).select("symbol", "idx", "adx").collect()
    assert len(full) == len(rows)
    for r in full:
        s = slice(max(0, r.idx - 49), r.idx + 1)
        assert r.adx == pytest.approx(naive_adx(want[r.symbol][s, 1], want[r.symbol][s, 2]))
    some = ind.with_adx(df, 50, only=df.idx % 10 == 0).select("symbol", "idx", "adx").collect()
    assert {(r.symbol, r.idx): r.adx for r in some} == {
        (r.symbol, r.idx): r.adx for r in full if r.idx % 10 == 0}


def test_flat_series(spark):
    rows = [(s, t, 5.0, 5.0, 5.0, 5.0, 0.0) for s, t, *_ in random_bars(("F",), 60)]
    df = series.drop_halo(features.bar_features(bars_frame(spark, rows)))
    last = df.where("idx = 59").first()
    assert last.rsi is None  # no movement: neither gains nor losses
    assert last.atr == 0 and last.vol_ratio == 0 and not last.msb and not last.engulf
    assert last.pump_3h == 0 and last.high_distance == 0
