"""Universe, signals, decisions, throttle, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.catalog.adapters import (
    BENCHMARK, bars, flags, micros, rounded, sql_bars, sql_smooth, sql_ticks, table, ticks,
)
from barflow.catalog.bar_queries import (
    BENCH, CONTEXT_RULES, W, D, N, rows, sql_adx,
)
from barflow.catalog.trade_queries import BANNED_SQL, EXIT_SQL, STREAK_SQL
from barflow.config import Rules
from barflow.operators import bars as bar_ops
from barflow.operators import decide, labeling, positions, regime, reports, signals, universe
from barflow.operators.throttle import throttle
from barflow.plans import signal_cycle

# looser thresholds: the given values are independent draws, far more volatile than a price
SIGNAL_RULES = Rules(min_rsi=50.0, min_vol_ratio=1.3, max_atr_ratio=5.0, whale_vol_ratio=2.0,
                     whale_max_rsi=60.0)
LABEL_RULES = Rules(take_profit=4.0, stop_loss=-0.985)
CYCLE_RULES = Rules(min_rsi=45.0, min_vol_ratio=0.6, max_atr_ratio=9.0, whale_vol_ratio=1.5,
                    whale_max_rsi=60.0, min_quote_volume=1000.0)

# --- universe ----------------------------------------------------------------------------------------


def _pair(user: str = "symbol"):
    """The symbol of a user number: most are pairs of the universe, some are banned or quoted otherwise."""
    number = F.col(user).cast("int")
    return F.concat(F.when(number % 17 == 0, "EUR").when(number % 19 == 0, "币").otherwise("U"),
                    F.col(user).cast("string"),
                    F.when(number % 23 == 0, "/BTC").otherwise("/USDT"))


def _day_tickers(spark: SparkSession, d: str) -> DataFrame:
    """Per day and user: last price, change since the day's first price, traded value."""
    t = ticks(spark, d, "user_id").withColumn("day", F.date_trunc("day", "ts"))
    per_day = t.groupBy("day", "symbol").agg(
        F.max_by("price", "ts").alias("last"), F.min_by("price", "ts").alias("first"),
        F.sum(F.col("price") * F.col("qty")).alias("quote_volume"))
    return per_day.select(
        F.col("day"), F.col("symbol").alias("user"), _pair().alias("symbol"), "last", ((F.col("last") / F.col("first") - 1) * 100).alias("pct"), "quote_volume")


def q_universe_top10(spark, d):
    t = _day_tickers(spark, d).withColumn("cycle_ts", F.col("day"))
    df = universe.top_gainers(t, CYCLE_RULES)
    return df.select(micros("cycle_ts"), "symbol", F.round("pct", 6).alias("pct"), "rank")


def q_universe_text(spark, d):
    part = table(spark, d, "part").select(
        "p_partkey", F.upper(F.concat("p_name", F.lit("/USDT"))).alias("symbol"))
    kept = part.where(universe.tradable(F.col("symbol"), ["BLUE", "RING", "GREEN W"]))
    return kept.select("p_partkey", "symbol")


# --- signals -----------------------------------------------------------------------------------------


def _found(spark, d, with_trend_index=True):
    b = bars(spark, d)
    return signals.find_signals(b, bar_ops.coarsen(b), SIGNAL_RULES,
                                with_trend_index=with_trend_index)


def q_signals(spark, d):
    return _found(spark, d).select(
        "symbol", micros(), F.col("c").alias("price"), "signal", "cash", "hour", "weekday",
        *rounded("rsi", "vol_ratio", "atr_pct", "sym_adx", "pump_3h", "pump_6h", "high_distance",
                 "ema_1h_distance", "ema_15m_distance"),
        *flags("is_whale"), "closed_confirm")


# --- decisions ---------------------------------------------------------------------------------------


def _candidates(spark, d):
    """Top symbols per day with scores, cash and gates taken from the day's values."""
    t = _day_tickers(spark, d).withColumn("cycle_ts", F.col("day"))
    top = universe.top_gainers(t, CYCLE_RULES)
    cents = F.round(F.col("last") * 100).cast("bigint")
    balances = table(spark, d, "customer").select(
        F.col("c_custkey").alias("day_no"), (F.abs("c_acctbal") / 100).alias("free_cash"))
    return top.withColumn("day_no", F.dayofyear("cycle_ts").cast("bigint")).join(
        balances, "day_no").select(
        "cycle_ts", "rank", "symbol",
        F.when(cents % 10 > 0, 0.5 + (cents % 50) / 100).alias("ai_score"),
        F.when(cents % 7 > 1, (cents % 60) / 100).alias("risk_score"),
        F.when(F.col("day_no") % 4 == 0, "YATAY").otherwise("TREND").alias("regime"),
        F.when(cents % 3 == 0, 40.0).otherwise(20.0).alias("cash"), "free_cash",
        F.col("last").alias("ask"), F.lit(1.0).alias("lot_step"))


def q_decision_cascade(spark, d):
    df = decide.decide(_candidates(spark, d), Rules())
    return df.select(micros("cycle_ts"), "rank", "symbol", "decision",
                     F.coalesce("reason", F.lit("-")).alias("reason"))


def q_one_pick(spark, d):
    """Without models: the first affordable candidate of each cycle."""
    df = decide.decide(_candidates(spark, d), Rules(), has_model=False)
    return df.where(F.col("decision") == "BUY").select(
        micros("cycle_ts"), "rank", "symbol", F.round("quantity", 6).alias("quantity"))


def q_signal_cycle(spark, d):
    """The whole cycle: tickers, exclusions, context, signals at the newest bar, decision."""
    t = _day_tickers(spark, d).withColumn("cycle_ts", F.col("day") + F.expr("INTERVAL 1 DAY"))
    b = bars(spark, d, by="user_id").withColumn("symbol", _pair())
    bench = bars(spark, d).where(F.col("symbol") == BENCHMARK)
    held = table(spark, d, "customer").where(F.col("c_acctbal") < 0).select(
        _pair("c_custkey").alias("symbol"))
    balances = table(spark, d, "customer").select(
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(c_custkey AS INT))")
        .alias("cycle_ts"), (F.abs("c_acctbal") / 100).alias("free_cash"))
    exits = table(spark, d, "events").select(
        _pair("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.expr(EXIT_SQL).alias("exit_code"))
    cents = F.round(F.col("last") * 100).cast("bigint")
    inputs = signal_cycle.CycleInputs(
        tickers=t.withColumn("lot_step", F.lit(0.01)), bars=b, hourly=bar_ops.coarsen(b),
        context=regime.market_context(bench, CONTEXT_RULES), balances=balances, held=held,
        exits=exits)
    df = signal_cycle.decisions(inputs, CYCLE_RULES, scores=(
        F.when(cents % 10 > 0, 0.5 + (cents % 50) / 100),
        F.when(cents % 7 > 1, (cents % 60) / 100)))
    return df.select(micros("cycle_ts"), "rank", "symbol", "signal", "regime", "stop_count",
                     *rounded("rsi", "vol_ratio", "sym_adx", "btc_adx"), "decision",
                     F.coalesce("reason", F.lit("-")).alias("reason"))


def q_shadow_log(spark, d):
    """Rejected candidates as rows of the shadow file, at most one per symbol in three days."""
    decided = decide.decide(_candidates(spark, d), Rules()).withColumns({
        "c": F.col("ask"), "signal": F.lit("MSB")})
    log = signal_cycle.shadow_signals(decided, Rules(throttle_s=259_200))
    return log.select("Ts", "Sembol", "Sebep", "Fiyat",
                      F.coalesce("AI_Skor", F.lit(-1.0)).alias("AI_Skor"))


# --- throttle ----------------------------------------------------------------------------------------


def q_throttle(spark, d):
    df = throttle(ticks(spark, d).select("symbol", "ts", "price"), 900)
    return df.select("symbol", micros(), "price")


def q_throttle_daily(spark, d):
    df = throttle(ticks(spark, d, "user_id").select("symbol", "ts"), 86_400, chunk_s=259_200)
    return df.select("symbol", micros())


# --- labels ------------------------------------------------------------------------------------------


def _shadow(spark, d):
    """Every tick is a signal that was not taken; its reason comes from its quantity."""
    reason = (F.when(F.col("qty") % 3 == 0, "AI_RED").when(F.col("qty") % 3 == 1, "REJIM_YATAY")
              .otherwise("TEK_ALIM_KURALI"))
    return ticks(spark, d).select("symbol", "ts", "price", reason.alias("reason"),
                                  F.col("qty").alias("btc_adx"))


AS_OF_SQL = "2024-01-28 00:00:00"
AS_OF_MS = 1_706_400_000_000


def _labeled(spark, d, as_of_ms=1_800_000_000_000):
    return labeling.label_signals(_shadow(spark, d), bars(spark, d), as_of_ms, LABEL_RULES)


def q_barrier_labels(spark, d):
    df = _labeled(spark, d).where(F.col("status") == "LABELED")
    return df.select("symbol", micros(), "price", "outcome",
                     *rounded("result_pct", "max_pct", "min_pct", digits=3))


def q_label_status(spark, d):
    """Which signals are due at a point in time, and what becomes of them."""
    shadow = _shadow(spark, d).withColumn("ts_ms", F.unix_millis("ts"))
    mark = AS_OF_MS - 10 * 86_400_000
    due = labeling.unlabeled(shadow, mark, AS_OF_MS, None, LABEL_RULES)
    seen = bars(spark, d).where(F.col("ts") < F.lit(AS_OF_SQL).cast("timestamp"))
    df = labeling.label_signals(due, seen, AS_OF_MS, LABEL_RULES)
    return df.select("symbol", "ts_ms", "status", "n_bars")


def q_label_report(spark, d):
    df = reports.outcome_by_reason(_labeled(spark, d).where(F.col("status") == "LABELED"))
    return df.select("reason", "n", *rounded("mean_result", "hit_rate"))


def q_adx_sweep(spark, d):
    df = reports.threshold_sweep(_labeled(spark, d).where(F.col("status") == "LABELED"),
                                 [0, 15, 20, 25, 50, 75])
    return df.select("threshold", "n", *rounded("mean_result"))


QUERIES = {
    "universe_top10": q_universe_top10, "universe_text": q_universe_text, "signals": q_signals,
    "decision_cascade": q_decision_cascade, "one_pick": q_one_pick,
    "signal_cycle": q_signal_cycle, "shadow_log": q_shadow_log, "throttle": q_throttle, "throttle_daily": q_throttle_daily,
    "barrier_labels": q_barrier_labels, "label_status": q_label_status,
    "label_report": q_label_report, "adx_sweep": q_adx_sweep,
}

# --- SQL ---------------------------------------------------------------------------------------------



def sql_pair(user: str) -> str:
    n = f"CAST({user} AS INTEGER)"
    return (f"(CASE WHEN {n} % 17 = 0 THEN 'EUR' WHEN {n} % 19 = 0 THEN '币' ELSE 'U' END || {user} "
            f"|| CASE WHEN {n} % 23 = 0 THEN '/BTC' ELSE '/USDT' END)")


DAY_SQL = f"""days AS (
  SELECT day, symbol AS usr, {sql_pair('symbol')} AS symbol, last,
         (last / first - 1) * 100 AS pct, quote_volume
  FROM (SELECT date_trunc('day', ts) AS day, symbol, arg_max(price, ts) AS last, arg_min(price, ts) AS first,
               sum(price * qty) AS quote_volume
        FROM uticks GROUP BY 1, 2)), top AS (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY pct DESC, symbol) AS rank FROM days
  WHERE regexp_full_match(symbol, '[\\x00-\\x7F]*') AND symbol LIKE '%/USDT'
    AND len(list_filter({BANNED_SQL}, lambda b: contains(symbol, b))) = 0
    AND quote_volume > {CYCLE_RULES.min_quote_volume}
  QUALIFY rank <= 10)"""
UTICKS = sql_ticks("user_id").replace("ticks AS", "uticks AS", 1)


def sql_hits(rules: Rules, ticks_name: str = "ticks") -> str:
    """Bars that pass the rules with their features; expects ``bars``, ``n``, ``d``."""
    return f"""hours AS (
  SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_max(price, ts) AS c
  FROM {ticks_name} GROUP BY 1, 2), hs AS (
  SELECT symbol, ts, list(c) OVER {rows(49)} AS cs FROM hours), he AS (
  SELECT symbol, ts + INTERVAL 1 HOUR AS known, {sql_smooth('cs', 20, '(2 / 21.0)')} AS ema_1h
  FROM hs), dl AS (
  SELECT symbol, idx, list(gain) OVER {rows(98)} AS g, list(loss) OVER {rows(98)} AS k,
         list(tr) OVER {rows(98)} AS t FROM d), ds AS (
  SELECT symbol, idx, {sql_smooth('g', 14, '(1 / 14.0)')} AS up,
         {sql_smooth('k', 14, '(1 / 14.0)')} AS down, {sql_smooth('t', 14, '(1 / 14.0)')} AS atr
  FROM dl), f AS (
  SELECT *, avg(v) OVER {rows(13)} AS vm, max(h) OVER {rows(9, 2)} AS top8,
         max(h) OVER {rows(95)} AS top96, lag(o) OVER {W} AS po, lag(v) OVER {W} AS pv,
         first_value(c) OVER {W} AS c0, lag(c, 12) OVER {W} AS c12, lag(c, 24) OVER {W} AS c24,
         list(c) OVER {rows(99)} AS cs, ts + INTERVAL 15 MINUTE AS at
  FROM n), x AS (
  SELECT f.*, 100 * up / (up + down) AS rsi, atr, atr / c * 100 AS atr_pct,
         CASE WHEN vm > 0 THEN v / vm ELSE 0 END AS vol_ratio, c > top8 AS msb,
         pc < po AND c > o AND o < pc AS eng, {sql_smooth('cs', 20, '(2 / 21.0)')} AS ema_15m
  FROM f JOIN ds USING (symbol, idx)), y AS (
  SELECT x.*, he.ema_1h FROM x ASOF JOIN he ON x.symbol = he.symbol AND x.at >= he.known), hits AS (
  SELECT *, CASE WHEN msb THEN 'MSB' ELSE 'Engulf' END AS signal,
         vol_ratio > {rules.whale_vol_ratio} AND rsi < {rules.whale_max_rsi} AS is_whale
  FROM y WHERE idx + 1 >= 30 AND rsi > {rules.min_rsi} AND vol_ratio > {rules.min_vol_ratio}
    AND (msb OR eng) AND c >= ema_1h AND atr / c <= {rules.max_atr_ratio})"""


CAND_SQL = f"""WITH {UTICKS}, {DAY_SQL}, c AS (
  SELECT *, CAST(round(last * 100) AS BIGINT) AS cents, dayofyear(day) AS day_no FROM top), k AS (
  SELECT day AS cycle_ts, rank, symbol,
         CASE WHEN cents % 10 > 0 THEN 0.5::DOUBLE + (cents % 50) / 100.0::DOUBLE END AS ai,
         CASE WHEN cents % 7 > 1 THEN (cents % 60) / 100.0::DOUBLE END AS risk,
         day_no % 4 = 0 AS flat, CASE WHEN cents % 3 = 0 THEN 40.0::DOUBLE ELSE 20 END AS cash,
         abs(c_acctbal) / 100 AS free, last AS ask
  FROM c JOIN customer ON c_custkey = day_no), g AS (
  SELECT *, {{model}} AS red, free >= cash * 1.01::DOUBLE AS afford,
         floor(cash / ask) AS quantity FROM k), p AS (
  SELECT *, min(CASE WHEN NOT red AND NOT flat AND afford AND quantity * ask > 5.1 THEN rank END)
              OVER (PARTITION BY cycle_ts) AS pick FROM g), dec AS (
  SELECT *, CASE WHEN red THEN 'AI_RED' WHEN flat THEN 'REJIM_YATAY'
                 WHEN rank > pick THEN 'TEK_ALIM_KURALI' WHEN NOT afford THEN 'BAKIYE_YETERSIZ' END
              AS reason FROM p)"""
MODEL_SQL = "(ai IS NULL OR ai < 0.65::DOUBLE OR coalesce(risk > 0.45::DOUBLE, false))"

LABEL_SQL = f"""WITH {sql_ticks()}, {sql_bars()}, b AS (
  SELECT *, row_number() OVER {W} - 1 AS idx FROM bars {{upto}}), s AS (
  SELECT symbol, ts, price, CASE qty % 3 WHEN 0 THEN 'AI_RED' WHEN 1 THEN 'REJIM_YATAY'
           ELSE 'TEK_ALIM_KURALI' END AS reason, qty AS btc_adx FROM ticks {{due}}), p AS (
  SELECT s.*, coalesce((SELECT max(idx) FROM b WHERE b.symbol = s.symbol AND b.ts <= s.ts), -1)
           AS at FROM s), j AS (
  SELECT p.*, b.idx - p.at AS k, b.h / price - 1 AS up, b.l / price - 1 AS down,
         b.c / price - 1 AS last
  FROM p LEFT JOIN b ON b.symbol = p.symbol AND b.idx BETWEEN p.at + 1 AND p.at + 16), t AS (
  SELECT symbol, ts, price, reason, btc_adx, count(k) AS n_bars,
         min(k) FILTER (down <= {LABEL_RULES.stop_loss}) AS sl,
         min(k) FILTER (up >= {LABEL_RULES.take_profit}) AS tp,
         list(up ORDER BY k) AS ups, list(down ORDER BY k) AS downs, arg_max(last, k) AS last
  FROM j GROUP BY ALL), l AS (
  SELECT *, CASE WHEN sl IS NOT NULL AND sl <= coalesce(tp, 99) THEN 'STOP'
                 WHEN tp IS NOT NULL THEN 'TAKE' ELSE 'TIME' END AS outcome,
         least(coalesce(sl, 16), coalesce(tp, 16)) AS upto FROM t), r AS (
  SELECT *, round(CASE outcome WHEN 'STOP' THEN {LABEL_RULES.stop_loss * 100}
                    WHEN 'TAKE' THEN {LABEL_RULES.take_profit * 100} ELSE last * 100 END, 3) + 0.0
              AS result_pct,
         round(greatest(0, list_max(ups[1:upto])) * 100, 3) + 0.0 AS max_pct,
         round(least(0, list_min(downs[1:upto])) * 100, 3) + 0.0 AS min_pct
  FROM l)"""
ALL_LABELS = LABEL_SQL.format(upto="", due="")

THROTTLE_SQL = """RECURSIVE e AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM ticks), fold AS (
  SELECT symbol, ts, price, k, ts AS kept FROM e WHERE k = 1
  UNION ALL
  SELECT e.symbol, e.ts, e.price, e.k,
         CASE WHEN e.ts - f.kept >= INTERVAL '{gap} seconds' THEN e.ts ELSE f.kept END
  FROM fold f JOIN e ON e.symbol = f.symbol AND e.k = f.k + 1)"""

ORACLES = {
    "universe_top10": f"""WITH {UTICKS}, {DAY_SQL}
SELECT epoch_us(day) AS cycle_ts, symbol, round(pct, 6) + 0.0 AS pct, rank FROM top""",
    "universe_text": """
SELECT p_partkey, upper(p_name || '/USDT') AS symbol FROM part
WHERE NOT regexp_matches(upper(p_name || '/USDT'), 'BLUE|RING|GREEN W')""",
    "signals": f"""WITH RECURSIVE {sql_ticks()}, {sql_bars()}, {N}, {D}, {sql_adx(100)},
{sql_hits(SIGNAL_RULES)}
SELECT symbol, epoch_us(ts) AS ts, c AS price, signal,
       CASE WHEN is_whale THEN 40.0::DOUBLE ELSE 20 END AS cash, hour(ts) AS hour,
       isodow(ts) - 1 AS weekday, round(rsi, 6) AS rsi, round(vol_ratio, 6) AS vol_ratio,
       round(atr_pct, 6) AS atr_pct, round(adx, 6) AS sym_adx,
       round((c / coalesce(c12, c0) - 1) * 100, 6) + 0.0 AS pump_3h,
       round((c / coalesce(c24, c0) - 1) * 100, 6) + 0.0 AS pump_6h,
       round((top96 - c) / top96 * 100, 6) + 0.0 AS high_distance,
       round((c / ema_1h - 1) * 100, 6) + 0.0 AS ema_1h_distance,
       round((c / ema_15m - 1) * 100, 6) + 0.0 AS ema_15m_distance,
       CAST(is_whale AS INTEGER) AS is_whale, CAST(pc > po AND pv > vm AS INTEGER) AS closed_confirm
FROM hits JOIN (SELECT symbol, idx, adx FROM adx) USING (symbol, idx)""",
    "decision_cascade": f"""{CAND_SQL.format(model=MODEL_SQL)}
SELECT epoch_us(cycle_ts) AS cycle_ts, rank, symbol,
       CASE WHEN reason IS NOT NULL THEN 'SHADOW' WHEN rank = pick THEN 'BUY' ELSE 'NO_FILL' END
         AS decision, coalesce(reason, '-') AS reason
FROM dec""",
    "one_pick": f"""{CAND_SQL.format(model='false')}
SELECT epoch_us(cycle_ts) AS cycle_ts, rank, symbol, round(quantity, 6) AS quantity
FROM dec WHERE rank = pick""",
    "shadow_log": CAND_SQL.format(model=MODEL_SQL).replace("WITH", "WITH RECURSIVE", 1) + """, e AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cycle_ts) AS k
  FROM dec WHERE reason IS NOT NULL), fold AS (
  SELECT symbol, cycle_ts, reason, ask, ai, k, cycle_ts AS kept FROM e WHERE k = 1
  UNION ALL
  SELECT e.symbol, e.cycle_ts, e.reason, e.ask, e.ai, e.k,
         CASE WHEN e.cycle_ts - f.kept >= INTERVAL '259200 seconds' THEN e.cycle_ts ELSE f.kept END
  FROM fold f JOIN e ON e.symbol = f.symbol AND e.k = f.k + 1)
SELECT epoch_us(cycle_ts) // 1000 AS Ts, symbol AS Sembol, reason AS Sebep, ask AS Fiyat,
       coalesce(ai, -1) AS AI_Skor
FROM fold WHERE kept = cycle_ts""",
    "throttle": f"""WITH {THROTTLE_SQL.format(gap=900).replace('RECURSIVE', 'RECURSIVE ' + sql_ticks()
                                                              + ',', 1)}
SELECT symbol, epoch_us(ts) AS ts, price FROM fold WHERE kept = ts""",
    "throttle_daily": f"""WITH {THROTTLE_SQL.format(gap=86400).replace(
        'RECURSIVE', 'RECURSIVE ' + sql_ticks('user_id') + ',', 1)}
SELECT symbol, epoch_us(ts) AS ts FROM fold WHERE kept = ts""",
    "barrier_labels": f"""{ALL_LABELS}
SELECT symbol, epoch_us(ts) AS ts, price, outcome, result_pct, max_pct, min_pct
FROM r WHERE n_bars = 16""",
    "label_status": LABEL_SQL.format(
        upto=f"WHERE ts < TIMESTAMP '{AS_OF_SQL}'",
        due=f"WHERE (epoch_us(ts) // 1000) > {AS_OF_MS - 10 * 86_400_000} "
            f"AND (epoch_us(ts) // 1000) <= {AS_OF_MS - 5 * 3_600_000}") + f"""
SELECT symbol, (epoch_us(ts) // 1000) AS ts_ms, CASE WHEN n_bars = 16 THEN 'LABELED'
         WHEN (epoch_us(ts) // 1000) < {AS_OF_MS - 48 * 3_600_000} THEN 'GIVE_UP' ELSE 'WAIT' END AS status,
       n_bars FROM r""",
    "label_report": f"""{ALL_LABELS}
SELECT reason, count(*) AS n, round(avg(result_pct), 6) + 0.0 AS mean_result,
       round(avg(CAST(result_pct > 0 AS INTEGER)), 6) AS hit_rate
FROM r WHERE n_bars = 16 GROUP BY 1""",
    "adx_sweep": f"""{ALL_LABELS}
SELECT t AS threshold, count(*) AS n, round(avg(result_pct), 6) + 0.0 AS mean_result
FROM r JOIN (SELECT unnest([0.0, 15, 20, 25, 50, 75]::DOUBLE[]) AS t) ON btc_adx >= t
WHERE n_bars = 16 GROUP BY 1""",
}

_USER_SERIES = f"""ubars AS (
  SELECT {sql_pair('symbol')} AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts,
         arg_min(price, ts) AS o, max(price) AS h, min(price) AS l, arg_max(price, ts) AS c,
         sum(qty) AS v FROM uticks GROUP BY 1, 2), un AS (
  SELECT *, row_number() OVER {W} - 1 AS idx, lag(c) OVER {W} AS pc, lag(h) OVER {W} AS ph,
         lag(l) OVER {W} AS pl FROM ubars), d AS (
  SELECT *, greatest(c - pc, 0) AS gain, greatest(pc - c, 0) AS loss,
         greatest(h - l, abs(h - pc), abs(l - pc)) AS tr FROM un WHERE idx > 0), named AS (
  SELECT {sql_pair('symbol')} AS symbol, ts, price FROM uticks)"""
_ADX_U = reduce(lambda s, p: s.replace(*p), [
    ("moves AS", "umoves AS"), ("fold AS", "ufold AS"), ("FROM fold", "FROM ufold"),
    ("JOIN moves", "JOIN umoves"), ("), adx AS", "), uadx AS")], sql_adx(100, "un"))
_HITS_U = sql_hits(CYCLE_RULES, "named").replace("FROM n)", "FROM un)")
_EXITS_U = reduce(lambda s, p: s.replace(*p), [
    ("RECURSIVE ", ""), ("fold", "streaks"), ("CAST(user_id AS VARCHAR)", sql_pair("user_id"))],
    STREAK_SQL)

ORACLES["signal_cycle"] = f"""{BENCH}, {UTICKS},
{DAY_SQL}, {_USER_SERIES}, {_ADX_U}, {_HITS_U},
{_EXITS_U}, cand AS (
  SELECT day + INTERVAL 1 DAY AS cycle_ts, rank, symbol, last FROM top
  WHERE symbol NOT IN (SELECT {sql_pair('c_custkey')} FROM customer WHERE c_acctbal < 0)), c0 AS (
  SELECT c.*, coalesce(e.streak, 0) AS stop_count
  FROM cand c ASOF LEFT JOIN streaks e ON c.symbol = e.symbol AND c.cycle_ts >= e.ts), c1 AS (
  SELECT c.*, e.ts AS last_exit
  FROM c0 c ASOF LEFT JOIN (SELECT * FROM streaks WHERE exit_code <> 'DUST') e ON c.symbol = e.symbol AND c.cycle_ts >= e.ts), c2 AS (
  SELECT c1.*, e.ts AS listed FROM c1 ASOF LEFT JOIN (SELECT * FROM streaks WHERE blacklisted) e
  ON c1.symbol = e.symbol AND c1.cycle_ts >= e.ts), c3 AS (
  SELECT c2.*, btc_ok, regime, btc_adx FROM c2 ASOF JOIN ctx
  ON c2.cycle_ts >= ctx.ts + INTERVAL 15 MINUTE
  WHERE NOT coalesce(last_exit + INTERVAL 1 HOUR > cycle_ts, false)
    AND NOT coalesce(listed + INTERVAL 24 HOUR > cycle_ts, false)), c4 AS (
  SELECT c3.*, b.ts AS bar_ts FROM c3 ASOF JOIN (SELECT *, ts + INTERVAL 15 MINUTE AS known FROM ubars) b
  ON c3.symbol = b.symbol AND c3.cycle_ts >= b.known WHERE btc_ok = 1), c5 AS (
  SELECT c4.*, h.signal, h.rsi, h.vol_ratio, a.adx AS sym_adx, h.is_whale,
         CAST(round(last * 100) AS BIGINT) AS cents,
         CASE WHEN h.is_whale THEN 40.0::DOUBLE ELSE 20 END AS cash
  FROM c4 JOIN hits h ON h.symbol = c4.symbol AND h.ts = c4.bar_ts
  JOIN uadx a ON a.symbol = h.symbol AND a.idx = h.idx), k AS (
  SELECT *, CASE WHEN cents % 10 > 0 THEN 0.5::DOUBLE + (cents % 50) / 100.0::DOUBLE END AS ai,
         CASE WHEN cents % 7 > 1 THEN (cents % 60) / 100.0::DOUBLE END AS risk,
         regime = 'YATAY' AS flat, coalesce(abs(c_acctbal) / 100, 0) AS free
  FROM c5 LEFT JOIN customer
  ON cycle_ts = TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey AS INTEGER))), g AS (
  SELECT *, {MODEL_SQL} AS red, free >= cash * 1.01::DOUBLE AS afford,
         floor(cash / last / 0.01::DOUBLE) * 0.01::DOUBLE AS quantity FROM k), p AS (
  SELECT *, min(CASE WHEN NOT red AND NOT flat AND afford AND quantity * last > 5.1 THEN rank END)
              OVER (PARTITION BY cycle_ts) AS pick FROM g), dec AS (
  SELECT *, CASE WHEN red THEN 'AI_RED' WHEN flat THEN 'REJIM_YATAY'
                 WHEN rank > pick THEN 'TEK_ALIM_KURALI' WHEN NOT afford THEN 'BAKIYE_YETERSIZ' END
              AS reason FROM p)
SELECT epoch_us(cycle_ts) AS cycle_ts, rank, symbol, signal, regime, stop_count,
       round(rsi, 6) AS rsi, round(vol_ratio, 6) AS vol_ratio, round(sym_adx, 6) AS sym_adx,
       round(btc_adx, 6) AS btc_adx,
       CASE WHEN reason IS NOT NULL THEN 'SHADOW' WHEN rank = pick THEN 'BUY' ELSE 'NO_FILL' END
         AS decision, coalesce(reason, '-') AS reason
FROM dec"""
