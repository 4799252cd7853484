"""Position exits over price paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.catalog.adapters import flags, micros, rounded, sql_smooth, sql_ticks, ticks
from barflow.catalog.bar_queries import W, rows
from barflow.config import Rules
from barflow.operators import exits, regime, reports, series
from barflow.operators import indicators as ind
from barflow.operators.bars import build_bars
from barflow.plans import position_monitor
from barflow.session import stored

# a mean of draws moves less than a draw but more than a price between polls: lower trigger levels
# for the rare rules, so that each of them occurs
EXIT_RULES = Rules(overheated_rsi=58.0, stale_band=0.02)
PATH_TICKS = 50


def price_path(spark: SparkSession, d: str, n: int = PATH_TICKS) -> DataFrame:
    """Ticks whose price is the mean of the symbol's last n values: a path without wild jumps."""
    indexed = series.halo_chunks(series.with_row_index(ticks(spark, d), width="hour"), 65_536, n)
    mean = F.avg("price").over(ind.bar_window().rowsBetween(-(n - 1), 0))
    return series.drop_halo(indexed.withColumn("price", mean)).where(F.col("idx") >= n - 1).select(
        "symbol", "ts", "price", "qty", "idx")


def _entries(path: DataFrame) -> DataFrame:
    """A position per symbol and day, entered at the day's first tick."""
    first = path.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(
        F.min("ts").alias("entry_ts"), F.min_by("price", "ts").alias("entry_price"),
        F.min_by("qty", "ts").alias("k"))
    cost = F.when(F.col("k") % 4 == 0, 40.0).otherwise(20.0)
    return first.select(
        F.concat_ws("@", "symbol", F.date_format("day", "yyyy-MM-dd")).alias("position_id"),
        "symbol", "entry_ts", "entry_price", cost.alias("cost"),
        F.when(F.col("k") % 9 == 0, 0.15).otherwise(cost / F.col("entry_price")).alias("qty"),
        F.lit(0.0001).alias("lot_step"), (F.col("k") / 25).alias("atr_pct"),
        (F.col("k") % 4 == 0).alias("is_whale"), F.col("k"))


def _regimes(spark, d):
    """Hourly regime from the parity of the benchmark's hourly quantity, known when the hour ends."""
    hours = build_bars(ticks(spark, d).where("symbol = 'view'"), "1h")
    return regime.known_context(hours.select("ts", F.when(F.col("v") % 2 == 0, "YATAY")
                                             .otherwise("TREND").alias("regime")), "1 HOUR")


def _legs(spark, d):
    path = stored(price_path(spark, d), "path")
    known = stored(build_bars(path.select("symbol", "ts", "price", "qty")), "bars")
    entries = stored(_entries(path), "entries")
    until = str(path.agg(F.max("ts").cast("string")).first()[0])
    legs = position_monitor.sold_legs(entries, path.select("symbol", "ts", "price"), known,
                                      _regimes(spark, d), EXIT_RULES, until=until)
    return legs, entries


def q_exit_monitor(spark, d):
    legs, _ = _legs(spark, d)
    return legs.select("position_id", "symbol", micros(), "exit_code",
                       *rounded("price", "cost", "net", "net_pct", "stop_ratio"),
                       "age_h", *flags("is_final"))


def q_exit_report(spark, d):
    """Realized profit by exit rule, from the trade rows with their entry features."""
    legs, entries = _legs(spark, d)
    trades = position_monitor.trade_rows(legs, entries.select(
        "position_id", "symbol", "entry_price", "cost", "is_whale", "atr_pct"))
    return trades.groupBy("exit_label", "wallet").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("net"), 6).alias("net"))


def q_exit_expiries(spark, d):
    legs, _ = _legs(spark, d)
    df = position_monitor.expiries(legs)
    return df.select("symbol", micros(), "exit_code", "streak", *flags("blacklisted"))


def q_realized_total(spark, d):
    legs, _ = _legs(spark, d)
    return reports.total_profit(legs).select(F.round("total_net", 6).alias("total_net"))


QUERIES = {"exit_monitor": q_exit_monitor, "exit_report": q_exit_report,
           "exit_expiries": q_exit_expiries, "realized_total": q_realized_total}

# --- SQL: every position advances one poll per recursion ---------------------------------------------

R = EXIT_RULES
LEGS_SQL = f"""WITH RECURSIVE {sql_ticks()}, raw AS (
  SELECT symbol, ts, qty, avg(price) OVER {rows(PATH_TICKS - 1)} AS price,
         row_number() OVER {W} - 1 AS idx FROM ticks), path AS (
  SELECT symbol, ts, qty, price FROM raw WHERE idx >= {PATH_TICKS - 1}), entries AS (
  SELECT symbol || '@' || strftime(day, '%Y-%m-%d') AS pid, symbol, entry_ts, e,
         CASE WHEN k % 4 = 0 THEN 40.0::DOUBLE ELSE 20 END AS cost, k,
         CASE WHEN k % 9 = 0 THEN 0.15::DOUBLE
              ELSE CASE WHEN k % 4 = 0 THEN 40.0::DOUBLE ELSE 20 END / e END AS qty,
         k / 25 AS atr_pct, k % 4 = 0 AS whale
  FROM (SELECT symbol, date_trunc('day', ts) AS day, min(ts) AS entry_ts, arg_min(price, ts) AS e,
               arg_min(qty, ts) AS k FROM path GROUP BY 1, 2)), slots AS (
  SELECT symbol, max(ts) AS ts, arg_max(price, ts) AS price
  FROM path GROUP BY symbol, epoch_us(ts) // 2000000), bars AS (
  SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_max(price, ts) AS c,
         sum(qty) AS v FROM path GROUP BY 1, 2), n AS (
  SELECT *, row_number() OVER {W} - 1 AS idx, c - lag(c) OVER {W} AS dc,
         avg(v) OVER {rows(13)} AS vm, avg(v) OVER {rows(2)} AS v3 FROM bars), g AS (
  SELECT *, list(greatest(dc, 0)) FILTER (dc IS NOT NULL) OVER {rows(23)} AS ups,
         list(greatest(-dc, 0)) FILTER (dc IS NOT NULL) OVER {rows(23)} AS downs FROM n), kb AS (
  SELECT symbol, ts + INTERVAL 15 MINUTE AS known, idx >= 13 AND v3 < vm AS faded,
         {sql_smooth('ups', 14, '(1 / 14.0)')} AS u, {sql_smooth('downs', 14, '(1 / 14.0)')} AS w
  FROM g), reg AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR AS ts, sum(qty) % 2 = 0 AS flat
  FROM ticks WHERE symbol = 'view' GROUP BY 1), p1 AS (
  SELECT s.symbol, s.ts, s.price, e.* EXCLUDE (symbol)
  FROM slots s ASOF JOIN entries e ON s.symbol = e.symbol AND s.ts > e.entry_ts), p2 AS (
  SELECT p1.*, 100 * u / (u + w) AS rsi, coalesce(faded, false) AS faded
  FROM p1 ASOF LEFT JOIN kb ON p1.symbol = kb.symbol AND p1.ts >= kb.known), polls AS (
  SELECT p2.*, coalesce(flat, false) AS flat, epoch_us(p2.ts) / 1e6 AS t,
         row_number() OVER (PARTITION BY pid ORDER BY p2.ts) AS j,
         (p2.price * 0.999 - e * 1.001) / (e * 1.001) AS r,
         CASE WHEN whale THEN 0.02 ELSE greatest(0.025, least(0.055, atr_pct * 1.5 / 100)) END AS st,
         greatest(0.03, least(0.06, atr_pct * 2.0 / 100)) AS ft
  FROM p2 ASOF LEFT JOIN reg ON p2.ts >= reg.ts), fold AS (
  SELECT pid, 0 AS j, 0.0::DOUBLE AS m, false AS half, cost, qty,
         epoch_us(entry_ts) / 1e6 AS clock, -1e18::DOUBLE AS rsi_t, -1e18::DOUBLE AS stale_t,
         NULL::VARCHAR AS sold, 0.0::DOUBLE AS part, false AS closed, 0.0::DOUBLE AS age
  FROM entries
  UNION ALL
  SELECT pid, j, m, half OR coalesce(sold IN ('OVERHEATED', 'PARTIAL'), false),
         CASE WHEN sold IS NULL THEN cost WHEN sold IN ('OVERHEATED', 'PARTIAL') THEN cost / 2
              ELSE 0 END,
         CASE WHEN sold IN ('OVERHEATED', 'PARTIAL') THEN qty - lot ELSE qty END,
         CASE WHEN sold IS NULL AND NOT out AND NOT half AND age >= 4 AND r >= 0.005 THEN t
              ELSE clock END,
         CASE WHEN due THEN t ELSE rsi_t END,
         CASE WHEN stale THEN t ELSE stale_t END, sold,
         CASE WHEN sold IS NULL THEN 0 WHEN sold IN ('OVERHEATED', 'PARTIAL') THEN cost / 2
              ELSE cost END,
         coalesce(sold NOT IN ('OVERHEATED', 'PARTIAL'), false), age
  FROM (
    SELECT *, CASE
        WHEN (hot OR part) AND lot * price > 5.1 THEN
          CASE WHEN hot THEN 'OVERHEATED' ELSE 'PARTIAL' END
        WHEN qty * price <= 5.1 THEN NULL
        WHEN out THEN CASE WHEN m >= ft THEN 'TREND' WHEN half THEN 'SAFE'
                           WHEN m >= 0.025 THEN 'LOCK' ELSE 'STOP' END
        WHEN NOT half AND age >= 4 THEN CASE WHEN r < 0.005 THEN 'TIMEOUT' END
        WHEN stale AND faded THEN 'STALE' END AS sold
    FROM (
      SELECT *, NOT hot AND NOT half AND m >= ft AND r <= CASE
               WHEN m >= 0.2 THEN m - 0.05 WHEN m >= 0.1 THEN m - 0.02 ELSE m - 0.015 END AS part,
             NOT ((hot OR (NOT half AND m >= ft AND r <= CASE
               WHEN m >= 0.2 THEN m - 0.05 WHEN m >= 0.1 THEN m - 0.02 ELSE m - 0.015 END))
               AND lot * price > 5.1) AND NOT out AND NOT half AND age < 4 AND flat AND age >= 1.5
             AND abs(r) < {R.stale_band} AND t - stale_t > 600 AS stale
      FROM (
        SELECT *, due AND coalesce(rsi >= {R.overheated_rsi}, false) AS hot, r <= CASE
                 WHEN m >= 0.2 THEN greatest(base, m - 0.1) WHEN m >= 0.1 THEN greatest(base, m - 0.05)
                 WHEN m >= ft THEN greatest(base, m - 0.03) WHEN half THEN 0.005 ELSE base END AS out
        FROM (
          SELECT *, NOT half AND r >= 0.05 AND t - rsi_t > 60 AS due, (t - clock) / 3600 AS age,
                 CASE WHEN m >= 0.025 THEN 0.01 ELSE -st END AS base,
                 floor(qty / 2 / 0.0001::DOUBLE) * 0.0001::DOUBLE AS lot
          FROM (
            SELECT f.pid, p.j, greatest(f.m, p.r) AS m, f.half, f.cost, f.qty, f.clock, f.rsi_t,
                   f.stale_t, p.t, p.r, p.price, p.rsi, p.faded, p.flat, p.st, p.ft
            FROM fold f JOIN polls p ON p.pid = f.pid AND p.j = f.j + 1
            WHERE NOT f.closed)))))), legs AS (
  SELECT pid, symbol, ts, sold AS exit_code, price, part AS cost,
         part / e * (price * 0.999 - e * 1.001) AS net, r * 100 AS net_pct, age,
         st AS stop_ratio, closed AS is_final, whale, k
  FROM (SELECT f.*, p.symbol, p.ts, p.price, p.e, p.r, p.st, p.whale, p.k
        FROM fold f JOIN polls p ON p.pid = f.pid AND p.j = f.j WHERE f.sold IS NOT NULL))"""

ORACLES = {
    "exit_monitor": f"""{LEGS_SQL}
SELECT pid AS position_id, symbol, epoch_us(ts) AS ts, exit_code, round(price, 6) AS price,
       round(cost, 6) AS cost, round(net, 6) + 0.0 AS net, round(net_pct, 6) + 0.0 AS net_pct,
       round(stop_ratio, 6) AS stop_ratio, CAST(printf('%.2f', age) AS DOUBLE) AS age_h,
       CAST(is_final AS INTEGER) AS is_final
FROM legs""",
    "exit_report": f"""{LEGS_SQL}
SELECT CASE exit_code WHEN 'OVERHEATED' THEN '🚀 MOON BAG (%50 VURKAÇ)'
         WHEN 'PARTIAL' THEN 'DİNAMİK KISMİ KÂR' WHEN 'TREND' THEN '📈 TREND TAKİPLİ ÇIKIŞ'
         WHEN 'SAFE' THEN '🛡️ GÜVENLİ ÇIKIŞ' WHEN 'LOCK' THEN '🔒 KÂR KİLİDİ (+%1)'
         WHEN 'STOP' THEN '🛑 STOP LOSS (%-' || printf('%.1f', stop_ratio * 100) || ')'
         WHEN 'TIMEOUT' THEN '⏳ ZAMAN AŞIMI' ELSE '💤 MOMENTUM ÖLDÜ (YATAY REJİM)' END
         AS exit_label,
       CASE WHEN whale THEN 'BALİNA' ELSE 'NORMAL' END AS wallet, count(*) AS n,
       round(sum(net), 6) + 0.0 AS net
FROM legs GROUP BY 1, 2""",
    "exit_expiries": f"""{LEGS_SQL}, ex AS (
  SELECT symbol, ts, exit_code, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS q
  FROM legs WHERE is_final), sk AS (
  SELECT symbol, ts, exit_code, q, CAST(exit_code = 'STOP' AS INTEGER) AS streak,
         false AS blacklisted FROM ex WHERE q = 1
  UNION ALL
  SELECT e.symbol, e.ts, e.exit_code, e.q,
         CASE WHEN e.exit_code = 'STOP' THEN (s.streak + 1) % 2 WHEN e.exit_code = 'TREND' THEN 0
              ELSE s.streak END, e.exit_code = 'STOP' AND s.streak = 1
  FROM sk s JOIN ex e ON e.symbol = s.symbol AND e.q = s.q + 1)
SELECT symbol, epoch_us(ts) AS ts, exit_code, streak, CAST(blacklisted AS INTEGER) AS blacklisted
FROM sk""",
    "realized_total": f"{LEGS_SQL} SELECT round(sum(net), 6) + 0.0 AS total_net FROM legs",
}
