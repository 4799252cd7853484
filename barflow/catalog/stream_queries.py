"""Streaming twins: the same results from streams over the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog.adapters import (
    BENCHMARK, bars, flags, micros, rounded, sql_bars, sql_ticks, table, ticks_of,
)
from barflow.catalog.bar_queries import BENCH, CONTEXT_RULES, W
from barflow.catalog.exit_queries import EXIT_RULES, _entries, _regimes, price_path
from barflow.catalog.exit_queries import ORACLES as EXIT_ORACLES
from barflow.catalog.signal_queries import ORACLES as SIGNAL_ORACLES
from barflow.catalog.loop_queries import LIVE_S
from barflow.catalog.loop_queries import ORACLES as LOOP_ORACLES
from barflow.catalog.signal_queries import LABEL_RULES, SIGNAL_RULES
from barflow.catalog.trade_queries import EXIT_SQL
from barflow.catalog.trade_queries import ORACLES as TRADE_ORACLES
from barflow.functions.money import first_tier, stop_width
from barflow.operators import exits, series
from barflow.operators.bars import build_bars
from barflow.plans.position_monitor import known_bars
from barflow.session import stored
from barflow.streaming import keyed
from barflow.streaming.bars import stream_bars
from barflow.streaming.live import stream_live_signals
from barflow.streaming.runtime import drain, in_time_order, read_stream


#: Parts of a replayed table, and how many of them a micro-batch takes.
PARTS, PER_BATCH = 8, 2


def _restream(df, name, ts="ts"):
    """A table as a stream in event time, in several micro-batches."""
    path = in_time_order(df, name, ts, PARTS)
    return read_stream(df.sparkSession, path, df.schema, files_per_batch=PER_BATCH)


def _event_stream(spark, d):
    return _restream(table(spark, d, "events"), "events")


def q_stream_bars(spark, d):
    out = drain(stream_bars(ticks_of(_event_stream(spark, d))), "stream_bars")
    return out.select("symbol", micros(), "o", "h", "l", "c", "v")


def q_stream_throttle(spark, d):
    events = ticks_of(_event_stream(spark, d)).select("symbol", "ts", "price")
    return drain(keyed.stream_throttle(events, 900), "stream_throttle").select(
        "symbol", micros(), "price")


def q_stream_expiries(spark, d):
    rows = _event_stream(spark, d).select(
        F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr(EXIT_SQL).alias("exit_code"))
    out = drain(keyed.stream_expiries(rows), "stream_expiries")
    return out.select("symbol", micros(), "exit_code", "streak", *flags("blacklisted"),
                      F.coalesce(F.unix_micros("cooldown_until"), F.lit(0)).alias("cooldown_until"),
                      F.coalesce(F.unix_micros("blacklist_until"), F.lit(0))
                      .alias("blacklist_until"))


def q_stream_context(spark, d):
    bench = bars(spark, d).where(F.col("symbol") == BENCHMARK).select("symbol", "ts", "h", "l", "c")
    out = drain(keyed.stream_context(_restream(bench, "bench"), CONTEXT_RULES), "stream_context")
    return out.select(micros(), *flags("btc_ok", "flash_crash"), "regime", *rounded("btc_adx"))


def q_stream_exits(spark, d):
    path = stored(price_path(spark, d), "path")
    known = stored(known_bars(stored(build_bars(path.select("symbol", "ts", "price", "qty")),
                                     "bars")), "known")
    polls = exits.polls_of(path.select("symbol", "ts", "price"))
    polls = series.asof(polls, known, ["rsi_25", "vol_faded"], right_ts="known_at")
    polls = series.asof_grid(polls, _regimes(spark, d), ["regime"]).select(
        "symbol", (F.unix_micros("ts") / 1e6).alias("t"), "price", "rsi_25",
        F.coalesce("vol_faded", F.lit(False)).alias("vol_faded"),
        F.coalesce(F.col("regime") == "YATAY", F.lit(False)).alias("flat"),
        F.lit(False).alias("is_entry"))
    entry_t = (F.unix_micros("entry_ts") / 1e6)
    entries = _entries(path).select(
        "position_id", "symbol", entry_t.alias("t"), entry_t.alias("entry_t"), "entry_price",
        "cost", "qty", "lot_step", stop_width("atr_pct", "is_whale").alias("stop_ratio"),
        first_tier("atr_pct").alias("first_tier"), F.lit(True).alias("is_entry"))
    events = entries.unionByName(polls, allowMissingColumns=True).select(*keyed.EVENT_COLUMNS)
    legs = drain(keyed.stream_exits(_restream(events, "exit_events", "t"), EXIT_RULES), "stream_exits")
    return legs.select("position_id", "symbol", micros(), "exit_code",
                       *rounded("price", "cost", "net", "net_pct", "stop_ratio"),
                       "age_h", *flags("is_final"))


def q_stream_labels(spark, d):
    """Every bar's close is a signal one second before the bar ends."""
    b = bars(spark, d)
    shared = b.select("symbol", "ts", F.lit(False).alias("is_signal"),
                      F.lit(None).cast("double").alias("price"), "h", "l", "c")
    sig = b.select("symbol", (F.col("ts") + F.expr("INTERVAL 899 SECONDS")).alias("ts"),
                   F.lit(True).alias("is_signal"), F.col("c").alias("price"))
    events = _restream(shared.unionByName(sig, allowMissingColumns=True), "label_events")
    out = drain(keyed.stream_labels(events, LABEL_RULES), "stream_labels")
    return out.select("symbol", micros(), "price", "outcome",
                      *rounded("result_pct", "max_pct", "min_pct", digits=3))


def q_stream_live_signals(spark, d):
    out = drain(stream_live_signals(ticks_of(_event_stream(spark, d)), SIGNAL_RULES, LIVE_S), "stream_live")
    return out.select(
        "symbol", micros("ts"), micros("at"), "price", "signal", "cash",
        *rounded("rsi", "vol_ratio", "atr_pct", "pump_3h", "pump_6h", "high_distance", "ema_1h_distance",
                 "ema_15m_distance"), *flags("is_whale"), "closed_confirm")


QUERIES = {
    "stream_live_signals": q_stream_live_signals,
    "stream_bars": q_stream_bars, "stream_throttle": q_stream_throttle,
    "stream_expiries": q_stream_expiries, "stream_context": q_stream_context,
    "stream_exits": q_stream_exits, "stream_labels": q_stream_labels,
}

def _passed(sql: str, end: str) -> str:
    """Rows of ``sql`` that the last watermark (a minute before the newest event, in whole
    milliseconds) has passed."""
    return f"SELECT q.* FROM ({sql}) q, ({end}) e WHERE q.ts <= (e.t // 1000 - 60000) * 1000"


TICK_END = "SELECT max(epoch_us(ts)) AS t FROM events WHERE value > 0"

# a slot is over for the stream when the watermark has passed the symbol's next tick
_SLOT_END = f"""SELECT q.* FROM ({LOOP_ORACLES['live_signals']}) q JOIN (
  SELECT symbol, (slot + 1) * {LIVE_S * 1_000_000} AS seen_at, lead(t) OVER (PARTITION BY symbol ORDER BY slot) AS next_t FROM (
    SELECT event_type AS symbol, epoch_us(ts) // {LIVE_S * 1_000_000} AS slot, min(epoch_us(ts)) AS t
    FROM events WHERE value > 0 GROUP BY 1, 2)) s ON s.symbol = q.symbol AND s.seen_at = q."at", ({TICK_END}) e
WHERE next_t <= (e.t // 1000 - 60000) * 1000"""

ORACLES = {
    "stream_live_signals": _SLOT_END,
    # a bar leaves the stream when the watermark (newest tick minus a minute) has passed its end
    "stream_bars": f"""WITH {sql_ticks()}, {sql_bars()}
SELECT symbol, epoch_us(ts) AS ts, o, h, l, c, v FROM bars
WHERE ts + INTERVAL 15 MINUTE <= (SELECT max(ts) FROM ticks) - INTERVAL 1 MINUTE""",
    "stream_throttle": _passed(SIGNAL_ORACLES["throttle"], TICK_END),
    "stream_expiries": _passed(TRADE_ORACLES["stop_streak"],
                               "SELECT max(epoch_us(ts)) AS t FROM events"),
    "stream_context": _passed(f"""{BENCH}
SELECT epoch_us(ts) AS ts, btc_ok, CAST(flash AS INTEGER) AS flash_crash, regime,
       round(btc_adx, 6) AS btc_adx FROM ctx""", f"""SELECT max(epoch_us(time_bucket(
  INTERVAL '15 minutes', ts))) AS t FROM events WHERE value > 0 AND event_type = '{BENCHMARK}'"""),
    "stream_exits": _passed(EXIT_ORACLES["exit_monitor"], TICK_END),
    "stream_labels": f"""WITH {sql_ticks()}, {sql_bars()}, b AS (
  SELECT *, row_number() OVER {W} AS k, ts + INTERVAL 899 SECOND AS sig FROM bars), j AS (
  SELECT s.symbol, s.sig, s.c AS price, b.k - s.k AS k, b.h / s.c - 1 AS up, b.l / s.c - 1 AS down,
         b.c / s.c - 1 AS last
  FROM b s JOIN b ON b.symbol = s.symbol AND b.k BETWEEN s.k + 1 AND s.k + 16
  WHERE s.sig + INTERVAL 5 HOUR <= (SELECT max(sig) FROM b) - INTERVAL 1 MINUTE), t AS (
  SELECT symbol, sig, price, min(k) FILTER (down <= {LABEL_RULES.stop_loss}) AS sl,
         min(k) FILTER (up >= {LABEL_RULES.take_profit}) AS tp, list(up ORDER BY k) AS ups,
         list(down ORDER BY k) AS downs, arg_max(last, k) AS last
  FROM j GROUP BY ALL HAVING count(*) = 16), l AS (
  SELECT *, CASE WHEN sl IS NOT NULL AND sl <= coalesce(tp, 99) THEN 'STOP'
                 WHEN tp IS NOT NULL THEN 'TAKE' ELSE 'TIME' END AS outcome,
         least(coalesce(sl, 16), coalesce(tp, 16)) AS upto FROM t)
SELECT symbol, epoch_us(sig) AS ts, price, outcome,
       round(CASE outcome WHEN 'STOP' THEN {LABEL_RULES.stop_loss * 100}
               WHEN 'TAKE' THEN {LABEL_RULES.take_profit * 100} ELSE last * 100 END, 3) + 0.0
         AS result_pct,
       round(greatest(0, list_max(ups[1:upto])) * 100, 3) + 0.0 AS max_pct,
       round(least(0, list_min(downs[1:upto])) * 100, 3) + 0.0 AS min_pct
FROM l""",
}
