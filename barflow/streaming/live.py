"""Signals while a bar is open, from a stream of ticks.

Per symbol the state is the last ``lookback`` bars, of which the newest is open, the last hours' closes, and the slot that is not
over yet: a fixed size, however many ticks there are. A slot is over when a tick after it has come.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from barflow.config import Rules
from barflow.operators.features import DAY_BARS, LOOKBACK
from barflow.operators.live import BAR_S
from barflow.streaming.keyed import in_event_time

HOURS = 50
SCHEMA = ("symbol string, ts timestamp, at timestamp, price double, signal string, cash double, rsi double, vol_ratio double, "
          "atr_pct double, pump_3h double, pump_6h double, high_distance double, ema_1h_distance double, "
          "ema_15m_distance double, is_whale boolean, closed_confirm int")
STATE = ("n_bars long, bar_t array<long>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>, "
         "hour_t long, hours array<double>, n_hours long, slot long, so double, sh double, sl double, sc double, sv double")


def smoothed(x: np.ndarray, n: int, alpha: float) -> float:
    """Mean of the first n values, decayed by the rest, plus the rest's geometric weights; NaN for fewer than n values."""
    if len(x) < n:
        return np.nan
    rest = x[n:]
    weights = (1 - alpha) ** np.arange(len(rest) - 1, -1, -1)
    return float((1 - alpha) ** len(rest) * x[:n].mean() + alpha * (weights @ rest))


def percent(now: float, then: float) -> float:
    return (now / then - 1) * 100


class Series:
    """A symbol's bars and hours up to a moment."""

    def __init__(self, state=None):
        (self.n_bars, t, o, h, lo, c, v, self.hour_t, hours, self.n_hours, *slot) = state or (
            0, [], [], [], [], [], [], -1, [], 0, None, None, None, None, None, None)
        self.bars = [list(b) for b in zip(t, o, h, lo, c, v)]
        self.hours, self.slot = list(hours), tuple(slot) if slot[0] is not None else None

    def as_state(self) -> tuple:
        columns = [list(x) for x in zip(*self.bars)] if self.bars else [[]] * 6
        return (self.n_bars, *columns, self.hour_t, self.hours, self.n_hours, *(self.slot or (None,) * 6))

    def take(self, slot: tuple, every_s: int) -> None:
        """A slot that is over: into the open bar, or a new one."""
        number, o, h, lo, c, v = slot
        t = int(number) * every_s // BAR_S * BAR_S
        if self.bars and self.bars[-1][0] == t:
            bar = self.bars[-1]
            bar[2:] = [max(bar[2], h), min(bar[3], lo), c, bar[5] + v]
        else:
            self.bars = [*self.bars[1 - LOOKBACK:], [t, o, h, lo, c, v]]
            self.n_bars += 1
        hour = t // 3600
        if hour == self.hour_t:
            self.hours[-1] = c
        else:
            self.hours, self.hour_t, self.n_hours = [*self.hours[1 - HOURS:], c], hour, self.n_hours + 1

    def signal(self, rules: Rules) -> tuple | None:
        """Features of the newest bar, if it is a signal as it stands."""
        if self.n_bars < rules.min_bars or self.n_hours < 20:
            return None
        _, o, h, lo, c, v = np.array(self.bars, float).T
        mean = v[-14:].mean()
        ratio = v[-1] / mean if mean > 0 else 0.0
        msb = bool(len(c) > 2 and c[-1] > h[-10:-2].max())
        engulf = bool(c[-2] < o[-2] and c[-1] > o[-1] and o[-1] < c[-2])
        if not (ratio > rules.min_vol_ratio and (msb or engulf)):
            return None
        move = np.diff(c)
        up, down = smoothed(np.maximum(move, 0), 14, 1 / 14), smoothed(np.maximum(-move, 0), 14, 1 / 14)
        span = np.maximum(h[1:] - lo[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(lo[1:] - c[:-1])))
        atr, trend = smoothed(span, 14, 1 / 14), smoothed(np.array(self.hours), 20, 2 / 21)
        if up + down <= 0 or atr / c[-1] > rules.max_atr_ratio or c[-1] < trend:
            return None
        rsi = 100 * up / (up + down)
        if not rsi > rules.min_rsi:
            return None
        top, ema = h[-DAY_BARS:].max(), smoothed(c, 20, 2 / 21)
        whale = bool(ratio > rules.whale_vol_ratio and rsi < rules.whale_max_rsi)
        return ("MSB" if msb else "Engulf", rules.whale_cash if whale else rules.normal_cash, rsi, ratio,
                atr / c[-1] * 100, percent(c[-1], c[-13]), percent(c[-1], c[-25]), (top - c[-1]) / top * 100,
                percent(c[-1], trend), percent(c[-1], ema), whale, int(c[-2] > o[-2] and v[-2] > mean))


def stream_live_signals(ticks: DataFrame, rules: Rules = Rules(), every_s: int = 60, delay: str = "1 minute") -> DataFrame:
    """The rows of ``live.live_signals`` from a stream of ticks (``symbol, ts, price, qty``), each once its slot is over."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def follow(symbol, pdf, state):
        series, out = Series(state), []
        slots = (pdf["event_us"] // (every_s * 1_000_000)).to_numpy()
        price, qty = pdf["price"].to_numpy(float), pdf["qty"].to_numpy(float)
        cuts = np.flatnonzero(np.diff(slots)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(slots)]):
            p, held = price[a:b], series.slot
            part = (int(slots[a]), p[0], p.max(), p.min(), p[-1], qty[a:b].sum())
            if held is not None and held[0] == part[0]:
                part = (part[0], held[1], max(held[2], part[2]), min(held[3], part[3]), part[4], held[5] + part[5])
            elif held is not None:
                series.take(held, every_s)
                found = series.signal(rules)
                if found:
                    out.append((symbol, series.bars[-1][0], (held[0] + 1) * every_s, held[4], *found))
            series.slot = tuple(float(x) if i else x for i, x in enumerate(part))
        frame = pd.DataFrame(out, columns=names)
        for c in ("ts", "at"):
            frame[c] = pd.to_datetime(frame[c].astype("int64"), unit="s")
        return series.as_state(), frame

    return in_event_time(ticks, follow, SCHEMA, STATE, ["event_us"], delay)
