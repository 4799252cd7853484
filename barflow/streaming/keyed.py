"""Operators with state per symbol, in event time.

Rows wait in the symbol's state until the watermark has passed them and are then taken in time order,
so the result does not depend on how rows are spread over files and batches. Rows behind the watermark are dropped by
Spark, which counts them (``numRowsDroppedByWatermark``): ``delay`` has to cover the disorder of the source, see
``runtime.disorder``, or the source is put in order first, see ``runtime.in_time_order``.

State is kept in RocksDB. A symbol's waiting rows of one micro-batch are an entry of at most ``ENTRY_ROWS`` rows under the time of
its first one, with a timer at that time, so a batch writes its own rows once and reads the entries that the watermark has
reached, not all that waits; what is left of those becomes entries anew. A call holds these entries or the symbol's rows of one micro-batch,
which the source's batch limit bounds.

Each call of a state processor costs a few milliseconds, whatever it holds. Where symbols may be many and a rule can be written over
arrays, a call takes a lane instead: all symbols of a hash, of ``LANES``, with one small table of their states.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from barflow.config import REGIME_FLAT, REGIME_TREND, Rules
from barflow.operators import exits
from barflow.operators.indicators import adx_of_rows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Most rows of an entry of waiting rows.
ENTRY_ROWS = 50_000
#: Groups of symbols that share a call.
LANES = 512


def _times(seconds) -> pd.Series:
    return pd.to_datetime((np.asarray(seconds, float) * 1e6).round().astype("int64"), unit="us")


def _packed(pdf: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(pdf, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_all().to_pandas()


def _ms(us: int) -> int:
    return int(-(-us // 1000))


class InTimeOrder(StatefulProcessor):
    """Calls ``take`` with a symbol's rows in time order, as the watermark passes them."""

    def __init__(self, take: Callable, state_schema: str, by: list[str]):
        self.take, self.state_schema, self.by = take, state_schema, by

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.state_schema)
        self.waiting = handle.getMapState("waiting", "first long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # rows of a batch are newer than its watermark: they wait, and what waits is looked at first
        yield from self.passed(key, timerValues.getCurrentWatermarkInMs() * 1000)
        frames = [f for f in rows if not f.empty]
        if frames:
            self.wait(pd.concat(frames, ignore_index=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.passed(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def wait(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("event_us", ignore_index=True)
        for start in range(0, len(pdf), ENTRY_ROWS):
            part = pdf.iloc[start:start + ENTRY_ROWS]
            first = int(part["event_us"].iloc[0])
            if self.waiting.containsKey((first,)):
                part = pd.concat([_unpacked(self.waiting.getValue((first,))[0]), part], ignore_index=True)
            self.waiting.updateValue((first,), (_packed(part),))
            self.handle.registerTimer(_ms(first))

    def passed(self, key, now: int) -> Iterator[pd.DataFrame]:
        """Take the rows up to ``now``."""
        due = [int(k[0]) for k in self.waiting.keys() if int(k[0]) <= now] if self.waiting.exists() else []
        if not due:
            return
        pdf = pd.concat([_unpacked(self.waiting.getValue((at,))[0]) for at in due], ignore_index=True)
        for at in due:
            self.waiting.removeKey((at,))
        ready = pdf["event_us"].to_numpy() <= now
        if not ready.all():
            self.wait(pdf[~ready])
        old = tuple(self.kept.get()) if self.kept.exists() else None
        new, out = self.take(key[0], pdf[ready].sort_values(self.by, ignore_index=True), old)
        if new is not None:
            self.kept.update(new)
        elif old is not None:
            self.kept.clear()
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def _by_symbol(rows: DataFrame, processor: StatefulProcessor, schema, delay: str, key: str = "symbol") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # a commit writes what has changed, not a copy of the whole store
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return (
        rows.where("ts IS NOT NULL").withWatermark("ts", delay).withColumn("event_us", F.unix_micros("ts")).groupBy(key)
        .transformWithStateInPandas(processor, schema, "Append", "EventTime")
    )


def in_event_time(rows: DataFrame, take: Callable, schema, state_schema: str, by: list[str],
                  delay: str) -> DataFrame:
    """Run ``take(symbol, sorted rows, state or None) -> (state or None, output or None)`` over each
    symbol's rows in time order, as the watermark (newest ``ts`` minus ``delay``) passes them."""
    return _by_symbol(rows, InTimeOrder(take, state_schema, by), schema, delay)


def in_lanes(rows: DataFrame, take: Callable, schema, delay: str) -> DataFrame:
    """Like ``in_event_time`` for many symbols at a time: ``take(rows sorted by symbol and time, states) -> (states, output)``
    with the states (``symbol``, ...; None at first) of all symbols of a lane. A symbol without a row there has no state."""

    def packed(lane, pdf, state):
        states, out = take(pdf, _unpacked(state[0]) if state else None)
        return ((_packed(states),) if len(states) else None), out

    lanes = rows.withColumn("lane", F.pmod(F.xxhash64("symbol"), F.lit(LANES)).cast("int"))
    return _by_symbol(lanes, InTimeOrder(packed, "states binary", ["symbol", "event_us"]), schema, delay, "lane")


# --- throttle ----------------------------------------------------------------------------------------


def stream_throttle(events: DataFrame, gap_s: int = 900, delay: str = "1 minute") -> DataFrame:
    """Greedy throttle; the state of a symbol is the time of its last kept event."""
    gap = gap_s * 1_000_000
    columns = events.columns

    def keep(symbol, pdf, state):
        times = pdf["event_us"].to_numpy()
        at = int(np.searchsorted(times, state[0] + gap)) if state else 0
        kept = []
        while at < len(times):
            kept.append(at)
            at = int(np.searchsorted(times, times[at] + gap))
        if not kept:
            return state, None
        return (int(times[kept[-1]]),), pdf.iloc[kept][columns]

    return in_event_time(events, keep, events.schema, "last_us long", ["event_us"], delay)


# --- expiries after exits ----------------------------------------------------------------------------


def stream_expiries(exit_rows: DataFrame, rules: Rules = Rules(),
                    delay: str = "1 minute") -> DataFrame:
    """Streak, cooldown and blacklist after each exit (``symbol, ts, exit_code``)."""
    schema = ("symbol string, ts timestamp, exit_code string, streak int, blacklisted boolean, "
              "cooldown_until timestamp, blacklist_until timestamp")

    def follow(pdf, states):
        """Running counts over all symbols of the lane, less what each symbol's first row finds."""
        code, symbol = pdf["exit_code"].to_numpy(), pdf["symbol"].to_numpy()
        first = np.append(True, symbol[1:] != symbol[:-1])
        number, own = np.cumsum(first) - 1, symbol[first]
        held = pd.Series(dtype="int64") if states is None else states.set_index("symbol")["stops"]
        carried = held.reindex(own, fill_value=0).to_numpy("int64")
        is_stop = code == "STOP"
        counted = np.cumsum(is_stop)
        stops = counted - (counted - is_stop)[first][number] + carried[number]
        # resets of earlier symbols lie a whole span below
        span = number * (len(code) + int(carried.max()) + 1)
        base = np.maximum.accumulate(span + np.where(np.isin(code, ["TREND", "DUST"]), stops, 0)) - span
        streak = (stops - base) % rules.blacklist_stops
        listed = is_stop & (streak == 0)
        cooled = pdf["ts"] + pd.Timedelta(seconds=rules.cooldown_s)
        barred = pdf["ts"] + pd.Timedelta(seconds=rules.blacklist_s)
        left = pd.concat([held.drop(own, errors="ignore"), pd.Series(streak[np.append(first[1:], True)], own)])
        left = left[left > 0].rename_axis("symbol").rename("stops").reset_index()
        return left, pdf[["symbol", "ts", "exit_code"]].assign(
            streak=streak.astype("int32"), blacklisted=listed,
            cooldown_until=cooled.where(pdf["exit_code"].notna() & (code != "DUST")), blacklist_until=barred.where(listed))

    return in_lanes(exit_rows.select("symbol", "ts", "exit_code"), follow, schema, delay)


# --- market context ----------------------------------------------------------------------------------


def stream_context(bars: DataFrame, rules: Rules = Rules(), lookback: int = 300,
                   n: int = 200, delay: str = "1 minute") -> DataFrame:
    """Market context per benchmark bar; state: the bars of one lookback and the on/off switch."""
    schema = ("symbol string, ts timestamp, ema_200 double, btc_adx double, flash_crash boolean, "
              "btc_ok boolean, regime string")
    alpha = 2.0 / (n + 1)

    def average(close: np.ndarray) -> float:
        """Seed of the first n values decayed by the rest, plus geometric weights of the rest."""
        if len(close) < n:
            return np.nan
        rest = close[n:]
        weights = (1 - alpha) ** np.arange(len(rest) - 1, -1, -1)
        return (1 - alpha) ** len(rest) * close[:n].mean() + alpha * float(weights @ rest)

    def follow(symbol, pdf, state):
        hi, lo, cl, on = state or ([], [], [], False)
        old = len(cl)
        high, low, close = (np.concatenate([np.array(a, float), pdf[c].to_numpy(float)])
                            for a, c in ((hi, "h"), (lo, "l"), (cl, "c")))
        rows = np.arange(old, len(close))
        starts = np.maximum(rows - lookback + 1, 0)
        adx = adx_of_rows(high, low, rows, starts, 14)
        ema = np.array([average(close[s:r + 1]) for s, r in zip(starts, rows)])
        top = np.array([high[max(r - 2, 0):r + 1].max() for r in rows])
        now = close[rows]
        flash = (top - now) / top > rules.flash_drop
        off = np.isnan(ema) | flash | (now < ema * (1 - rules.hysteresis))
        sets = pd.Series(np.where(off, 0.0, np.where(now > ema * (1 + rules.hysteresis), 1.0,
                                                     np.nan)))
        ok = sets.ffill().fillna(float(on)).astype(bool).to_numpy()
        tail = slice(max(len(close) - lookback + 1, 0), None)
        kept = (high[tail].tolist(), low[tail].tolist(), close[tail].tolist(), bool(ok[-1]))
        return kept, pd.DataFrame({
            "symbol": pdf["symbol"], "ts": pdf["ts"], "ema_200": ema, "btc_adx": adx,
            "flash_crash": flash, "btc_ok": ok,
            "regime": np.where(adx >= rules.adx_trend, REGIME_TREND, REGIME_FLAT)})

    return in_event_time(
        bars, follow, schema, "h array<double>, l array<double>, c array<double>, btc_ok boolean",
        ["event_us"], delay)


# --- exits -------------------------------------------------------------------------------------------

EVENT_COLUMNS = ["position_id", "symbol", "t", "price", "rsi_25", "vol_faded", "flat", "entry_t",
                 "entry_price", "cost", "qty", "lot_step", "stop_ratio", "first_tier", "is_entry"]


def stream_exits(events: DataFrame, rules: Rules = Rules(), delay: str = "1 minute") -> DataFrame:
    """Exit monitor over a stream of entries and polls (EVENT_COLUMNS; polls need only the symbol,
    time, price and context). State: the symbol's open position. Same rule function as in batch."""

    def follow(symbol, pdf, state):
        pid, held = None, None
        if state:
            pid, *values = state
            held = exits.Held(*values)
        legs = []
        segment = pdf["is_entry"].cumsum()
        for _, rows in pdf.groupby(segment, sort=True):
            if rows["is_entry"].iloc[0]:
                entry, rows = rows.iloc[0], rows.iloc[1:]
                pid, held = entry["position_id"], exits.held_from(entry)
            if held is not None:
                sold = exits.advance(held, rows, rules)
                if sold:
                    legs.append(exits.legs_frame(sold, pid, symbol))
        left = (pid, *held.as_row()) if held is not None and not held.closed else None
        return left, pd.concat(legs, ignore_index=True) if legs else None

    timed = events.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("bigint")))
    return in_event_time(timed, follow, exits.LEG_SCHEMA, "position_id string, "
                         + exits.HELD_SCHEMA, ["t", "is_entry"], delay)


# --- labels ------------------------------------------------------------------------------------------


def stream_labels(events: DataFrame, rules: Rules = Rules(), delay: str = "1 minute") -> DataFrame:
    """Delayed labels over a stream of signals and bars (``symbol, ts, is_signal, price, h, l, c``).

    A signal waits until the watermark is past its waiting time and its bars are there; past the
    give-up time it is dropped. State: pending signals, and the bars that they may still need.
    """
    schema = ("symbol string, ts timestamp, price double, outcome string, result_pct double, "
              "max_pct double, min_pct double")
    wait, give_up = rules.label_wait_h * 3600, rules.label_give_up_h * 3600
    state_schema = ("sig_t array<double>, sig_price array<double>, bar_t array<double>, "
                    "h array<double>, l array<double>, c array<double>")

    def outcome(price: float, h: np.ndarray, low: np.ndarray, c: np.ndarray) -> tuple:
        up, down = h / price - 1, low / price - 1
        stop, take = down <= rules.stop_loss, up >= rules.take_profit
        touched = np.flatnonzero(stop | take)
        seen = touched[0] + 1 if len(touched) else len(h)
        if len(touched):
            hit_stop = bool(stop[touched[0]])
            name = "STOP" if hit_stop else "TAKE"
            result = rules.stop_loss if hit_stop else rules.take_profit
        else:
            name, result = "TIME", c[-1] / price - 1
        return (name, result * 100, max(0.0, up[:seen].max()) * 100,
                min(0.0, down[:seen].min()) * 100)

    class Labels(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getValueState("held", state_schema)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frames = [f for f in rows if not f.empty]
            yield from self.follow(key, pd.concat(frames, ignore_index=True) if frames else None, timerValues)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield from self.follow(key, None, timerValues)

        def follow(self, key, pdf, timerValues) -> Iterator[pd.DataFrame]:
            held = self.held.get() if self.held.exists() else ([],) * 6
            sig_t, sig_p, bar_t, h, low, c = (np.array(x, float) for x in held)
            if pdf is not None:
                t = pdf["event_us"] / 1e6
                signal = pdf["is_signal"].to_numpy(bool)
                sig_t, sig_p = np.append(sig_t, t[signal]), np.append(sig_p, pdf["price"][signal])
                bar_t, h, low, c = (np.append(a, b[~signal]) for a, b in (
                    (bar_t, t), (h, pdf["h"]), (low, pdf["l"]), (c, pdf["c"])))
            by_time = np.argsort(bar_t, kind="stable")
            bar_t, h, low, c = bar_t[by_time], h[by_time], low[by_time], c[by_time]
            now = timerValues.getCurrentWatermarkInMs() / 1000
            first = np.searchsorted(bar_t, sig_t, side="right")
            ready = (sig_t + wait <= now) & (first + rules.label_bars <= len(bar_t))
            out = [(key[0], t, p, *outcome(p, *(a[f:f + rules.label_bars] for a in (h, low, c))))
                   for t, p, f in zip(sig_t[ready], sig_p[ready], first[ready])]
            pending = ~ready & (sig_t + give_up > now)
            sig_t, sig_p = sig_t[pending], sig_p[pending]
            # bars older than every pending signal and than any signal that may still come
            needed = bar_t > min(sig_t.min(initial=np.inf), max(now, 0))
            self.held.update(tuple(x.tolist() for x in (
                sig_t, sig_p, bar_t[needed], h[needed], low[needed], c[needed])))
            if len(sig_t):
                due = sig_t + wait
                upcoming = due[due > now].min(initial=now + 900)
                self.handle.registerTimer(int(max(upcoming, now + 1) * 1000) + 1)
            if out:
                frame = pd.DataFrame(out, columns=["symbol", "_t", "price", "outcome", "result_pct",
                                                   "max_pct", "min_pct"])
                frame.insert(1, "ts", _times(frame.pop("_t")))
                yield frame

        def close(self) -> None:
            pass

    labels = _by_symbol(events, Labels(), schema, delay)
    # rounded by Spark, as in batch
    return labels.withColumns({c: F.round(c, 3) for c in ("result_pct", "max_pct", "min_pct")})
