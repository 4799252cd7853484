"""The closed loop over hourly cycles of the given ticks, and signals while their bar is open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.catalog.adapters import bars, flags, micros, rounded, sql_bars, sql_smooth, sql_ticks, table, ticks
from barflow.catalog.bar_queries import W, rows
from barflow.catalog.exit_queries import EXIT_RULES, LEGS_SQL, _regimes, price_path
from barflow.catalog.signal_queries import MODEL_SQL, SIGNAL_RULES
from barflow.operators import bars as bar_ops
from barflow.operators import exits, live, series
from barflow.operators.bars import build_bars
from barflow.plans import closed_cycle, position_monitor
from barflow.session import stored

LOT = 0.0001
LIVE_S = 300


def poll_rows(spark: SparkSession, d: str, path: DataFrame) -> DataFrame:
    """Polls of a price path with what the exit rules read besides the price."""
    known = stored(position_monitor.known_bars(stored(build_bars(path.select("symbol", "ts", "price", "qty")), "bars")),
                   "known")
    polls = exits.polls_of(path.select("symbol", "ts", "price"))
    polls = series.asof(polls, known, ["rsi_25", "vol_faded"], right_ts="known_at")
    return series.asof_grid(polls, _regimes(spark, d), ["regime"]).select(
        "symbol", (F.unix_micros("ts") / 1e6).alias("t"), "price", "rsi_25",
        F.coalesce("vol_faded", F.lit(False)).alias("vol_faded"),
        F.coalesce(F.col("regime") == "YATAY", F.lit(False)).alias("flat"))


def cycle_candidates(spark: SparkSession, d: str, path: DataFrame) -> DataFrame:
    """Every hour's symbols at the hour's end, ranked by the hour's gain, for an account per region."""
    hours = build_bars(path.select("symbol", "ts", "price", "qty"), "1h")
    gain = Window.partitionBy("ts").orderBy(F.desc(F.col("c") / F.col("o")), "symbol")
    v = F.col("v").cast("bigint")
    df = hours.select(
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("cycle_ts"), "symbol", F.col("c").alias("ask"),
        F.row_number().over(gain).alias("rank"), F.when(v % 3 == 0, 40.0).otherwise(20.0).alias("cash"),
        F.when(v % 10 > 0, 0.5 + (v % 50) / 100.0).alias("ai_score"),
        F.when(v % 7 > 1, (v % 60) / 100.0).alias("risk_score"), ((v % 9) / 2.0).alias("atr_pct"),
        (v % 3 == 0).alias("is_whale"), F.lit(LOT).alias("lot_step"))
    df = series.asof_grid(stored(df, "candidates"), _regimes(spark, d), ["regime"], "cycle_ts")
    return df.withColumns({
        "btc_ok": F.hour("cycle_ts") != 5,
        "account": F.explode(F.sequence(F.lit(0), F.lit(4)))})


def q_closed_cycle(spark, d):
    path = stored(price_path(spark, d), "path")
    accounts = table(spark, d, "region").select(
        F.col("r_regionkey").cast("int").alias("account"), (F.col("r_regionkey") * 41.7 + 33.3).alias("cash"))
    df = closed_cycle.run(cycle_candidates(spark, d, path), poll_rows(spark, d, path), accounts, EXIT_RULES)
    return df.select("account", micros("cycle_ts"), "rank", "symbol", "decision",
                     F.coalesce("reason", F.lit("-")).alias("reason"), *rounded("free_cash", digits=5), "n_held",
                     "stop_count")


def q_live_signals(spark, d):
    """Signals at every five minutes of the bars that are open then."""
    b = bars(spark, d)
    df = live.live_signals(ticks(spark, d), b, bar_ops.coarsen(b), SIGNAL_RULES, every_s=LIVE_S)
    return df.select(
        "symbol", micros("ts"), micros("at"), F.col("c").alias("price"), "signal", "cash",
        *rounded("rsi", "vol_ratio", "atr_pct", "pump_3h", "pump_6h", "high_distance", "ema_1h_distance",
                 "ema_15m_distance"), *flags("is_whale"), "closed_confirm")


QUERIES = {"closed_cycle": q_closed_cycle, "live_signals": q_live_signals}

# --- SQL: one recursion over the cycles, after one over the polls of every possible position ------------

_POSITIONS = f"""creg AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR AS ts, sum(qty) % 2 = 0 AS flat
  FROM ticks WHERE symbol = 'view' GROUP BY 1), hrs AS (
  SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS h, arg_max(price, ts) AS c, arg_min(price, ts) AS o,
         CAST(sum(qty) AS BIGINT) AS v FROM path GROUP BY 1, 2), ranked AS (
  SELECT h + INTERVAL 1 HOUR AS cycle_ts, symbol, c AS ask, v,
         row_number() OVER (PARTITION BY h ORDER BY c / o DESC, symbol) AS rank,
         CASE WHEN v % 3 = 0 THEN 40.0::DOUBLE ELSE 20 END AS cash,
         CASE WHEN v % 10 > 0 THEN 0.5::DOUBLE + (v % 50) / 100.0::DOUBLE END AS ai,
         CASE WHEN v % 7 > 1 THEN (v % 60) / 100.0::DOUBLE END AS risk FROM hrs), gates AS (
  SELECT r.*, coalesce(creg.flat, false) AS flat, {MODEL_SQL} AS red, hour(cycle_ts) <> 5 AS ok,
         floor(cash / ask / {LOT}::DOUBLE) * {LOT}::DOUBLE AS quantity
  FROM ranked r ASOF LEFT JOIN creg ON r.cycle_ts >= creg.ts), cand AS (
  SELECT *, coalesce(quantity * ask > 5.1, false) AS fills, symbol || '@' || epoch_us(cycle_ts) AS pid FROM gates), entries AS (
  SELECT pid, symbol, cycle_ts AS entry_ts, ask AS e, quantity * ask AS cost, v AS k, quantity AS qty,
         (v % 9) / 2.0::DOUBLE AS atr_pct, v % 3 = 0 AS whale
  FROM cand WHERE ok AND NOT red AND NOT flat AND fills), """
_LEG = "STRUCT(symbol VARCHAR, t DOUBLE, money DOUBLE, code VARCHAR, final BOOLEAN, streak INTEGER, listed DOUBLE)"
_FOLDED = """list_reduce(list_prepend({{'symbol': '', 't': -1e18::DOUBLE, 'money': 0.0::DOUBLE, 'code': '', 'final': false,
    'streak': 0, 'listed': -1e18::DOUBLE}}, list_sort({legs})), lambda a, x: {{'symbol': x.symbol, 't': x.t, 'money': 0.0::DOUBLE,
    'code': x.code, 'final': true, 'streak': CASE WHEN x.code = 'STOP' THEN (a.streak + 1) % 2
      WHEN x.code = 'TREND' THEN 0 ELSE a.streak END,
    'listed': CASE WHEN x.code = 'STOP' AND a.streak = 1 THEN x.t ELSE a.listed END}})"""


def _loop_sql() -> str:
    text = LEGS_SQL
    start, stop = text.index("entries AS ("), text.index("slots AS (")
    text = text[:start] + _POSITIONS + text[stop:]
    text = text.replace("""FROM slots s ASOF JOIN entries e ON s.symbol = e.symbol AND s.ts > e.entry_ts)""",
                        """FROM slots s JOIN entries e ON s.symbol = e.symbol AND s.ts > e.entry_ts)""")
    finals = _FOLDED.format(legs="list_transform(list_filter(l.legs, lambda x: x.symbol = c.symbol AND x.final"
                                 " AND x.t <= y.t), lambda x: {'symbol': '', 't': x.t, 'money': 0.0::DOUBLE,"
                                 " 'code': x.code, 'final': true, 'streak': 0, 'listed': -1e18::DOUBLE})")
    return text + f""", sold AS (
  SELECT pid, list({{'symbol': symbol, 't': epoch_us(ts) / 1e6, 'money': cost * 1.001::DOUBLE + net, 'code': exit_code,
           'final': is_final, 'streak': 0, 'listed': -1e18::DOUBLE}}) AS sales, bool_or(is_final) AS ends
  FROM legs GROUP BY 1), full_cand AS (
  SELECT cand.*, quantity * ask * 1.001::DOUBLE AS paid, list_concat(coalesce(sales, []), CASE WHEN coalesce(ends, false) THEN []
           ELSE [{{'symbol': cand.symbol, 't': 1e18::DOUBLE, 'money': 0.0::DOUBLE, 'code': '', 'final': true, 'streak': 0,
                  'listed': -1e18::DOUBLE}}] END)::{_LEG}[] AS sales
  FROM cand LEFT JOIN sold USING (pid)), cyc AS (
  SELECT cycle_ts, epoch_us(cycle_ts) / 1e6 AS t, row_number() OVER (ORDER BY cycle_ts) AS i
  FROM (SELECT DISTINCT cycle_ts FROM cand)), lp AS (
  SELECT CAST(r_regionkey AS INTEGER) AS account, r_regionkey * 41.7::DOUBLE + 33.3::DOUBLE AS cash, 0::BIGINT AS i,
         []::{_LEG}[] AS legs, []::STRUCT(pid VARCHAR)[] AS buys FROM region
  UNION ALL
  SELECT account, cash - coalesce(paid, 0), i, list_concat(legs, coalesce(sales, [])),
         CASE WHEN pid IS NULL THEN buys ELSE list_append(buys, {{'pid': pid}}) END
  FROM (
    SELECT account, i, any_value(l_cash) AS cash, any_value(legs) AS legs, any_value(buys) AS buys,
           arg_min(pid, rank) FILTER (good) AS pid, arg_min(paid, rank) FILTER (good) AS paid,
           arg_min(sales, rank) FILTER (good) AS sales
    FROM (
      SELECT account, i, l_cash, legs, buys, pid, rank, paid, sales,
             ok AND NOT held AND NOT coalesce(s.t + 3600 > t, false) AND NOT coalesce(s.listed + 86400 > t, false) AND NOT red AND NOT flat AND fills
             AND free >= cash * 1.01::DOUBLE AS good
      FROM (
        SELECT l.account, y.i, y.t, l.cash AS l_cash, l.legs, l.buys, c.*,
               l.cash + coalesce(list_sum(list_transform(list_filter(l.legs, lambda x: x.t <= y.t), lambda x: x.money)), 0) AS free,
               len(list_filter(l.legs, lambda x: x.symbol = c.symbol AND x.final AND x.t > y.t)) > 0 AS held,
               {finals} AS s
        FROM lp l JOIN cyc y ON y.i = l.i + 1 JOIN full_cand c ON c.cycle_ts = y.cycle_ts))
    GROUP BY account, i)), states AS (
  SELECT l.account, y.t, y.cycle_ts, l.cash, l.legs, n.buys AS bought
  FROM lp l JOIN cyc y ON y.i = l.i + 1 JOIN lp n ON n.account = l.account AND n.i = y.i), seen AS (
  SELECT l.account, c.*, list_contains(list_transform(l.bought, lambda x: x.pid), c.pid) AS taken,
         l.cash + coalesce(list_sum(list_transform(list_filter(l.legs, lambda x: x.t <= l.t), lambda x: x.money)), 0) AS free,
         len(list_filter(l.legs, lambda x: x.symbol = c.symbol AND x.final AND x.t > l.t)) > 0 AS held,
         len(list_filter(l.legs, lambda x: x.final AND x.t > l.t)) AS n_held, l.t,
         {finals.replace('y.t', 'l.t')} AS s
  FROM states l JOIN full_cand c ON c.cycle_ts = l.cycle_ts), picked AS (
  SELECT *, min(CASE WHEN taken THEN rank END) OVER (PARTITION BY account, cycle_ts) AS pick FROM seen)
"""


ORACLES = {
    "closed_cycle": _loop_sql() + """
SELECT account, epoch_us(cycle_ts) AS cycle_ts, rank, symbol,
       CASE WHEN NOT ok THEN 'CLOSED' WHEN held THEN 'HELD' WHEN s.t + 3600 > t THEN 'COOLING'
            WHEN s.listed + 86400 > t THEN 'BLACKLISTED' WHEN red OR flat OR rank > pick THEN 'SHADOW'
            WHEN free < cash * 1.01::DOUBLE THEN 'SHADOW' WHEN NOT fills THEN 'NO_FILL' ELSE 'BUY' END AS decision,
       CASE WHEN NOT ok OR held OR s.t + 3600 > t OR s.listed + 86400 > t THEN '-' WHEN red THEN 'AI_RED'
            WHEN flat THEN 'REJIM_YATAY' WHEN rank > pick THEN 'TEK_ALIM_KURALI'
            WHEN free < cash * 1.01::DOUBLE THEN 'BAKIYE_YETERSIZ' ELSE '-' END AS reason,
       round(free, 5) + 0.0 AS free_cash, CAST(n_held AS INTEGER) AS n_held, s.streak AS stop_count
FROM picked""",
    # every moment's slice is put together anew: the bars before, and the open one at its end
    "live_signals": f"""WITH {sql_ticks()}, {sql_bars()}, n AS (
  SELECT *, row_number() OVER {W} - 1 AS idx, lag(c) OVER {W} AS pc, lag(o) OVER {W} AS po, lag(v) OVER {W} AS pv,
         lag(h) OVER {W} AS ph FROM bars), d AS (
  SELECT symbol, idx, greatest(c - pc, 0) AS gain, greatest(pc - c, 0) AS loss,
         greatest(h - l, abs(h - pc), abs(l - pc)) AS tr FROM n WHERE idx > 0), e AS (
  SELECT symbol, idx, list(gain) OVER z AS g, list(loss) OVER z AS k, list(tr) OVER z AS t FROM d
  WINDOW z AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 98 PRECEDING AND 1 PRECEDING)), f AS (
  SELECT symbol, ts, idx, pc, po, pv, max(h) OVER {rows(9, 2)} AS top8, max(h) OVER {rows(95, 1)} AS top95,
         sum(v) OVER {rows(13, 1)} AS v13, lag(c, 12) OVER {W} AS c12, lag(c, 24) OVER {W} AS c24,
         list(c) OVER {rows(99, 1)} AS cs FROM n), slots AS (
  SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, epoch_us(ts) // {LIVE_S * 1_000_000} AS slot,
         arg_min(price, ts) AS o, max(price) AS h, min(price) AS l, arg_max(price, ts) AS c, sum(qty) AS v
  FROM ticks GROUP BY 1, 2, 3), ob AS (
  SELECT symbol, ts, (slot + 1) * {LIVE_S * 1_000_000} AS seen_at, first_value(o) OVER s AS o, max(h) OVER s AS h,
         min(l) OVER s AS l, c, sum(v) OVER s AS v FROM slots
  WINDOW s AS (PARTITION BY symbol, ts ORDER BY slot ROWS UNBOUNDED PRECEDING)), x AS (
  SELECT ob.*, f.* EXCLUDE (symbol, ts), list_append(e.g, greatest(c - pc, 0)) AS gs,
         list_append(e.k, greatest(pc - c, 0)) AS ks, list_append(e.t, greatest(h - l, abs(h - pc), abs(l - pc))) AS trs,
         list_append(cs, c) AS closes, (v13 + v) / 14 AS vm
  FROM ob JOIN f USING (symbol, ts) JOIN e USING (symbol, idx) WHERE idx + 1 >= 30), y AS (
  SELECT *, {sql_smooth('gs', 14, '(1 / 14.0)')} AS up, {sql_smooth('ks', 14, '(1 / 14.0)')} AS down,
         {sql_smooth('trs', 14, '(1 / 14.0)')} AS atr, {sql_smooth('closes', 20, '(2 / 21.0)')} AS ema,
         CASE WHEN vm > 0 THEN v / vm ELSE 0 END AS vol_ratio, c > top8 AS msb, pc < po AND c > o AND o < pc AS eng
  FROM x), q AS (
  SELECT *, 100 * up / (up + down) AS rsi FROM y
  WHERE 100 * up / (up + down) > {SIGNAL_RULES.min_rsi} AND vol_ratio > {SIGNAL_RULES.min_vol_ratio} AND (msb OR eng)
    AND atr / c <= {SIGNAL_RULES.max_atr_ratio}), {sql_bars('hours', '1 hour')}, hn AS (
  SELECT symbol, ts AS hour, row_number() OVER {W} AS k, list(c) OVER {rows(49, 1)} AS before FROM hours), r AS (
  SELECT q.*, list_append(hn.before, q.c) AS hs FROM q JOIN hn ON hn.symbol = q.symbol
    AND hn.hour = time_bucket(INTERVAL '1 hour', q.ts) WHERE hn.k >= 20), u AS (
  SELECT *, {sql_smooth('hs', 20, '(2 / 21.0)')} AS ema_1h, vol_ratio > {SIGNAL_RULES.whale_vol_ratio}
         AND rsi < {SIGNAL_RULES.whale_max_rsi} AS is_whale FROM r)
SELECT symbol, epoch_us(ts) AS ts, seen_at AS "at", c AS price, CASE WHEN msb THEN 'MSB' ELSE 'Engulf' END AS signal,
       CASE WHEN is_whale THEN 40.0::DOUBLE ELSE 20 END AS cash, round(rsi, 6) AS rsi, round(vol_ratio, 6) AS vol_ratio,
       round(atr / c * 100, 6) AS atr_pct, round((c / c12 - 1) * 100, 6) + 0.0 AS pump_3h,
       round((c / c24 - 1) * 100, 6) + 0.0 AS pump_6h,
       round((greatest(top95, h) - c) / greatest(top95, h) * 100, 6) + 0.0 AS high_distance,
       round((c / ema_1h - 1) * 100, 6) + 0.0 AS ema_1h_distance, round((c / ema - 1) * 100, 6) + 0.0 AS ema_15m_distance,
       CAST(is_whale AS INTEGER) AS is_whale, CAST(pc > po AND pv > vm AS INTEGER) AS closed_confirm
FROM u WHERE c >= ema_1h""",
}
