"""Exit rules of an open position over a sequence of price polls.

Most polls change nothing but the running maximum. So each batch of a position's polls becomes numpy
vectors (net return, running maximum, thresholds), the next poll where any rule could act is searched
in them, and only that poll is judged. State goes in and out, so the same function serves the batch
job (sorted partitions, constant memory) and the stream (keyed state).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.config import REGIME_FLAT, Rules
from barflow.functions.money import first_tier, stop_width
from barflow.operators import series

NEVER = -1e18

LEG_SCHEMA = (
    "position_id string, symbol string, ts timestamp, exit_code string, price double, "
    "entry_price double, cost double, net double, net_pct double, age_h double, stop_ratio double, "
    "is_final boolean"
)
LEG_COLUMNS = [c.split()[0] for c in LEG_SCHEMA.split(", ")]
POLL_COLUMNS = ["t", "price", "rsi_25", "vol_faded", "flat"]


@dataclass
class Held:
    """State of one position."""

    entry_price: float
    cost: float
    qty: float
    lot_step: float
    stop_ratio: float
    first_tier: float
    entry_t: float
    clock_t: float
    top: float = 0.0
    half: bool = False
    rsi_checked_t: float = NEVER
    stale_checked_t: float = NEVER
    closed: bool = False

    def as_row(self) -> tuple:
        return tuple(asdict(self).values())


HELD_SCHEMA = ", ".join(
    f"{f.name} {'boolean' if f.type == 'bool' else 'double'}" for f in fields(Held))


def _thresholds(top: np.ndarray, held: Held, rules: Rules):
    """Per poll: give-back level of a half sale, and of a full exit before and after one."""
    base = np.where(top >= rules.lock_from, rules.lock_at, -held.stop_ratio)
    half_at, full_at, full_after_half = np.full(len(top), np.inf), base.copy(), np.full(
        len(top), rules.half_floor)
    for start, half_back, full_back in reversed(rules.tiers):
        inside = top >= (held.first_tier if start is None else start)
        half_at = np.where(inside, top - half_back, half_at)
        trailing = np.maximum(base, top - full_back)
        full_at = np.where(inside, trailing, full_at)
        full_after_half = np.where(inside, trailing, full_after_half)
    return half_at, full_at, full_after_half


def _half_lot(held: Held) -> float:
    half = held.qty / 2
    return np.floor(half / held.lot_step) * held.lot_step if held.lot_step > 0 else half


def advance(held: Held, polls: pd.DataFrame, rules: Rules = Rules()) -> list[dict]:
    """Apply time-ordered polls (``t, price, rsi_25, vol_faded, flat``) to ``held`` in place and
    return the legs sold."""
    legs: list[dict] = []
    polls = polls[polls["price"].to_numpy(float) > 0]  # a poll without a price says nothing
    if held.closed or polls.empty:
        return legs
    t, price = polls["t"].to_numpy(float), polls["price"].to_numpy(float)
    rsi = polls["rsi_25"].to_numpy(float)
    faded = polls["vol_faded"].to_numpy(bool)
    flat = polls["flat"].to_numpy(bool)
    paid = held.entry_price * (1 + rules.fee)
    ratio = (price * (1 - rules.fee) - paid) / paid
    top = np.maximum(np.maximum.accumulate(ratio), held.top)
    half_at, full_at, full_after_half = _thresholds(top, held, rules)
    tiered = top >= held.first_tier

    def sell(i: int, code: str, share: float, quantity: float, final: bool) -> None:
        spent = held.cost * share
        net = spent / held.entry_price * (
            price[i] * (1 - rules.fee) - held.entry_price * (1 + rules.fee))
        legs.append({
            "t": t[i], "exit_code": code, "price": price[i], "entry_price": held.entry_price,
            "cost": spent, "net": net, "net_pct": ratio[i] * 100,
            "age_h": round((t[i] - held.clock_t) / 3600, 2), "stop_ratio": held.stop_ratio,
            "is_final": final})
        held.cost -= spent
        held.qty -= quantity
        held.half, held.closed = held.half or not final, final

    i, n = 0, len(t)
    while i < n and not held.closed:
        rest = slice(i, n)
        # polls whose order would be too small act only where they change the state
        sells = held.qty * price[rest] > rules.min_notional
        beyond = ratio[rest] <= (full_after_half if held.half else full_at)[rest]
        acts = beyond & sells
        if not held.half:
            age = (t[rest] - held.clock_t) / 3600
            acts |= (ratio[rest] >= rules.overheated_ratio) & (
                t[rest] - held.rsi_checked_t > rules.overheated_every_s)
            acts |= tiered[rest] & (ratio[rest] <= half_at[rest]) & (
                _half_lot(held) * price[rest] > rules.min_notional)
            acts |= ~beyond & (age >= rules.max_age_h) & (
                sells | (ratio[rest] >= rules.min_expectation))
            acts |= ~beyond & flat[rest] & (age >= rules.stale_age_h) & (
                np.abs(ratio[rest]) < rules.stale_band) & (
                t[rest] - held.stale_checked_t > rules.stale_every_s)
        found = np.flatnonzero(acts)
        if not len(found):
            break
        i += int(found[0])
        _judge(held, i, t[i], price[i], ratio[i], top[i], rsi[i], faded[i], flat[i], half_at[i],
               (full_after_half if held.half else full_at)[i], rules, sell)
        i += 1
    held.top = float(top[-1])
    return legs


def _judge(held, i, now, price, ratio, top, rsi, faded, flat, half_line, exit_line, rules, sell):
    """The rules at one poll, first match wins; an order below the minimum value is not placed."""
    half_lot = _half_lot(held)
    hot = False
    if (not held.half and ratio >= rules.overheated_ratio
            and now - held.rsi_checked_t > rules.overheated_every_s):
        held.rsi_checked_t = now
        hot = bool(rsi >= rules.overheated_rsi)
    gave_back = not hot and top >= held.first_tier and ratio <= half_line
    if not held.half and (hot or gave_back) and half_lot * price > rules.min_notional:
        return sell(i, "OVERHEATED" if hot else "PARTIAL", 0.5, half_lot, False)

    code = None
    age = (now - held.clock_t) / 3600
    if ratio <= exit_line:
        reached = [("TREND", top >= held.first_tier), ("SAFE", held.half),
                   ("LOCK", top >= rules.lock_from), ("STOP", True)]
        code = next(name for name, hit in reached if hit)
    elif not held.half and age >= rules.max_age_h:
        if ratio < rules.min_expectation:
            code = "TIMEOUT"
        else:
            held.clock_t = now
    elif (not held.half and flat and age >= rules.stale_age_h and abs(ratio) < rules.stale_band
          and now - held.stale_checked_t > rules.stale_every_s):
        held.stale_checked_t = now
        code = "STALE" if faded else None
    if code and held.qty * price > rules.min_notional:
        sell(i, code, 1.0, held.qty, True)
    return None


def polls_of(ticks: DataFrame, seconds: int = 2) -> DataFrame:
    """Last price per symbol and polling interval: bounds a position's rows by time, not by the
    symbol's share of ticks, and combines before the shuffle."""
    slot = F.floor(F.unix_seconds("ts") / seconds)
    return (
        ticks.groupBy("symbol", slot.alias("_slot"))
        .agg(F.max("ts").alias("ts"), F.max_by("price", "ts").alias("price"))
        .drop("_slot")
    )


POSITION = ["position_id", "entry_ts", "entry_price", "cost", "qty", "lot_step", "atr_pct",
            "is_whale"]


def position_polls(entries: DataFrame, polls: DataFrame, bars_known: DataFrame | None = None,
                   context: DataFrame | None = None, width: str = "hour",
                   until: str | None = None) -> DataFrame:
    """Each poll with the symbol's latest position entered before it and what the rules read
    besides the price.

    ``entries``: symbol and POSITION; a symbol holds one position at a time, so a poll belongs to
    at most one. ``bars_known``: symbol, known_at, rsi_25, vol_faded. ``context``: regime and,
    as ts, the time from which it is known.
    """
    rights = [series.Right(entries, POSITION, "entry_ts", strict=True)]
    if bars_known is not None:
        rights.append(series.Right(bars_known, ["rsi_25", "vol_faded"], "known_at"))
    df = series.asof_many(polls, rights, width=width, until=until).where("position_id IS NOT NULL")
    if bars_known is None:
        df = df.selectExpr("*", "CAST(NULL AS DOUBLE) AS rsi_25", "false AS vol_faded")
    if context is None:
        return df.selectExpr("*", "false AS flat")
    df = series.asof_grid(df, context, ["regime"])
    return df.selectExpr("*", f"coalesce(regime = '{REGIME_FLAT}', false) AS flat")


def poll_vectors(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Columns the rule function needs, thresholds of the position resolved; polls without a
    price are left out."""
    return df.where("price > 0").select(
        F.col("position_id").cast("string").alias("position_id"), "symbol",
        (F.unix_micros("ts") / 1e6).alias("t"), "price", "rsi_25",
        F.coalesce("vol_faded", F.lit(False)).alias("vol_faded"), "flat",
        (F.unix_micros("entry_ts") / 1e6).alias("entry_t"), "entry_price", "cost", "qty",
        F.coalesce("lot_step", F.lit(0.0)).alias("lot_step"),
        stop_width("atr_pct", "is_whale", rules).alias("stop_ratio"),
        first_tier("atr_pct", rules).alias("first_tier"),
    )


def held_from(row) -> Held:
    return Held(float(row.entry_price), float(row.cost), float(row.qty), float(row.lot_step),
                float(row.stop_ratio), float(row.first_tier), float(row.entry_t),
                float(row.entry_t))


def legs_frame(legs: list[dict], position_id: str, symbol: str) -> pd.DataFrame:
    frame = pd.DataFrame(legs)
    frame.insert(0, "position_id", position_id)
    frame.insert(1, "symbol", symbol)
    frame["ts"] = pd.to_datetime((frame.pop("t") * 1e6).round().astype("int64"), unit="us")
    return frame[LEG_COLUMNS]


def exit_legs(vectors: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Legs sold per position.

    Partitions are sorted by (position, time) and streamed batch by batch; only the state of the
    position in hand is kept, so a long position needs no more memory than a short one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, None
        for batch in batches:
            out = []
            for pid, polls in batch.groupby("position_id", sort=False):
                if pid != current:
                    current, held = pid, held_from(polls.iloc[0])
                legs = advance(held, polls, rules)
                if legs:
                    out.append(legs_frame(legs, pid, polls["symbol"].iloc[0]))
            if out:
                yield pd.concat(out, ignore_index=True)

    return (
        vectors.repartition("position_id").sortWithinPartitions("position_id", "t")
        .mapInPandas(run, LEG_SCHEMA)
    )
