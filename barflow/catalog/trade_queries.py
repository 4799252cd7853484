"""Trade logs, positions, money, order books, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.catalog.adapters import flags, micros, rounded, sql_ticks, table, ticks
from barflow.config import BANNED, Rules
from barflow.functions import book, money, values
from barflow.operators import ordering, positions, reports, series, training
from barflow.session import scratch_path, stored
from barflow.sources import logs, market, sinks

RULES = Rules()
BANNED_SQL = "[" + ", ".join(f"'{b}'" for b in BANNED) + "]"

# --- trade legs: order lines of an order are the legs of one position ------------------------------

LEG_NET = "l_extendedprice * (0.05 - l_discount) / 1000"


def _legs(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("symbol"),
        F.col("o_totalprice").alias("entry_price"),
        F.col("o_custkey").cast("double").alias("rsi"),
        F.length("o_orderpriority").cast("double").alias("vol_ratio"),
        (F.col("o_custkey") % 7).cast("double").alias("atr_pct"),
        F.when(F.col("o_orderstatus") == "F", "MSB").when(F.col("o_orderstatus") == "O", "Engulf")
        .alias("signal"),
        F.expr(LEG_NET).alias("net"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_returnflag") == "R", "STOP").when(F.col("l_returnflag") == "A", "TREND")
        .otherwise("TIMEOUT").alias("exit_code"),
    )


def q_legs_to_positions(spark, d):
    df = training.with_targets(positions.collapse_legs(_legs(spark, d)))
    return df.select("symbol", "entry_price", "rsi", "vol_ratio", "atr_pct", "signal",
                     F.round("net", 8).alias("net"), micros(), "n_legs", "is_loss", "is_profit",
                     "signal_code")


def q_class_balance(spark, d):
    df = training.with_targets(positions.collapse_legs(_legs(spark, d)))
    counts = df.groupBy("signal").agg(*training.class_measures("is_loss"),
                                      F.sum("is_profit").alias("n_profit"))
    return counts.select("signal", "n", F.col("pos").alias("n_loss"), "n_profit", "classes",
                         *rounded("weight"))


def q_trade_pnl(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("e"),
        (F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount")))
        .alias("x"), "l_quantity", "l_tax", "l_discount")
    whale = F.col("l_quantity") > 45
    return lines.select(
        "l_orderkey", "l_linenumber",
        F.round(money.net_pnl("e", "x", "l_quantity"), 6).alias("net"),
        F.round(money.net_ratio("e", "x") * 100, 6).alias("net_pct"),
        F.round(money.lot_floor(F.col("l_quantity") / 7, 0.01), 6).alias("lots"),
        F.round(money.stop_width(F.col("l_discount") * 50, whale), 6).alias("stop_ratio"),
        F.round(money.first_tier(F.col("l_discount") * 50), 6).alias("first_tier"))


def q_vwap(spark, d):
    fills = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("amount"))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") / 100)
        .when(F.col("o_orderstatus") == "O", 0.0).alias("average"),
        F.col("o_totalprice").alias("fallback"))
    prices = book.fill_prices(fills, orders).join(orders.select("order_id", "fallback"), "order_id")
    return prices.select("order_id", F.round(F.col("fill_price") / F.col("fallback"), 9)
                         .alias("fill_ratio"))


def _books(spark, d):
    """Positive entries of the vector are bids, negative ones asks; the position is the price."""
    def side(sign):
        levels = F.transform("embedding", lambda x, i: F.struct(
            (i + 1).cast("double").alias("price"), (x.cast("double") * sign).alias("qty")))
        return F.filter(levels, lambda lv: lv["qty"] > 0)

    return table(spark, d, "embeddings").select("vec_id", side(1).alias("bids"),
                                                side(-1).alias("asks"))


def q_imbalance(spark, d):
    return _books(spark, d).select(
        "vec_id", F.round(book.imbalance(F.col("bids"), F.col("asks"), 20), 5).alias("book_ratio"),
        book.best_ask(F.col("asks")).alias("best_ask"))


def q_book_depth(spark, d):
    cut = market.books_to_depth(_books(spark, d), 5)
    return cut.select("vec_id", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"),
                      F.round(book.notional(F.col("asks"), 5), 5).alias("ask_notional"))


# --- wallet and positions --------------------------------------------------------------------------

COIN_SQL = ("CASE WHEN c_nationkey = 3 THEN 'EUR' WHEN c_nationkey = 5 THEN 'BNB' "
            "ELSE 'C' END || CASE WHEN c_nationkey = 5 AND c_custkey % 2 = 0 THEN '' "
            "ELSE CAST(c_custkey AS {text}) END")


def _wallet(spark, d):
    """One coin per customer; the few equal names add up. Negative balances are no holdings."""
    customers = table(spark, d, "customer").withColumn(
        "coin", F.expr(COIN_SQL.format(text="string")))
    return customers.groupBy("coin").agg(F.sum("c_acctbal").alias("total"),
                                         F.min("c_custkey").alias("c_custkey"),
                                         F.min("c_nationkey").alias("nation"))


def _wallet_tickers(spark, d):
    return _wallet(spark, d).where(F.col("nation") != 7).select(
        F.concat("coin", F.lit("/USDT")).alias("symbol"),
        ((F.col("nation") - 2) / 1000.0).alias("last"))


def _held(spark, d):
    orders = table(spark, d, "orders").where(F.col("o_orderstatus") == "P")
    return orders.groupBy("o_custkey").agg(
        F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("price"),
        F.max("o_orderdate").alias("entry_ts")
    ).join(_wallet(spark, d), F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat("coin", F.lit("/USDT")).alias("symbol"),
        (F.col("price") / 1e7).alias("entry_price"),
        F.when(F.col("o_custkey") % 3 == 0, 40.0).otherwise(20.0).alias("cost"),
        F.col("entry_ts").cast("timestamp").alias("entry_ts"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("price") / 1e6).alias("max_ratio"),
        (F.col("o_custkey") % 5 == 0).alias("half_sold"))


def q_reconcile(spark, d):
    df = positions.reconcile(_wallet(spark, d), _held(spark, d), _wallet_tickers(spark, d))
    return df.select("symbol", F.round("value", 6).alias("value"), *flags("held"), "action")


def q_wallet_scan(spark, d):
    """Wallet coins that are neither held nor excluded nor reserved."""
    df = positions.reconcile(_wallet(spark, d), _held(spark, d), _wallet_tickers(spark, d))
    return df.where(F.col("action") == "ADOPT").select("symbol", F.round("value", 6).alias("value"))


AS_OF = "2002-01-01 00:00:00"


def q_mark_to_market(spark, d):
    df = positions.mark_to_market(_held(spark, d), _wallet_tickers(spark, d), AS_OF)
    return df.select("symbol", *rounded("entry_price", "price", "cost", "unrealized", "net_pct",
                                        "age_h", "max_pct"), *flags("half_sold", "large"))


def q_position_report(spark, d):
    """Positions and cash: customers of one nation keep theirs in the cash coin."""
    cash = table(spark, d, "customer").select(
        F.when(F.col("c_nationkey") == 3, "USDT").otherwise("-").alias("coin"), F.col("c_acctbal").alias("total"))
    df = positions.position_report(_held(spark, d), _wallet_tickers(spark, d), cash, AS_OF)
    return df.select("kind", "symbol", F.coalesce("sign", F.lit("")).alias("sign"), F.round("value", 4).alias("value"),
                     *[F.round(F.coalesce(c, F.lit(-1.0)), 5).alias(c) for c in ("price", "net_pct", "max_pct")],
                     F.coalesce(F.col("half_sold").cast("int"), F.lit(-1)).alias("half_sold"))


def q_position_state(spark, d):
    """Stored positions with defaults for what is missing or zero."""
    raw = _held(spark, d).withColumns({
        "cost": F.when(F.col("half_sold"), 0.0).otherwise(F.col("cost")),
        "features_json": F.lit(None).cast("string")})
    return market.position_state(raw, AS_OF).select(
        "symbol", *rounded("cost", "max_ratio"), *flags("half_sold"), micros("entry_ts"),
        "features_json")


def q_priced_positions(spark, d):
    return positions.priced_positions(_held(spark, d), _wallet_tickers(spark, d)).select(
        "symbol", "last", F.round(money.net_ratio("entry_price", "last"), 6).alias("net_ratio"))


def q_held_tickers(spark, d):
    return market.held_tickers(_wallet_tickers(spark, d), _held(spark, d)).select("symbol", "last")


def q_cumulative_profit(spark, d):
    trades = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ts"),
        (F.col("o_totalprice") / 1000 - 250).alias("net"))
    df = reports.cumulative_profit(trades, ["ts", "o_orderkey"])
    return df.select("o_orderkey", F.round("running_net", 5).alias("running_net"))


def q_running_top(spark, d):
    """Running maximum of the net return since the symbol's first tick, never below zero."""
    t = ticks(spark, d, "user_id").withColumn("day", series.time_chunk("ts"))
    # the return grows with the price, so its running maximum is that of the highest price
    t = series.running(t, {"entry": ("first", "price"), "highest": ("max", "price")}, "symbol",
                       "day", ["ts"])
    top = F.greatest(money.net_ratio("entry", "highest"), F.lit(0.0))
    return t.select("symbol", micros(), F.round(top, 6).alias("top"))


def q_pnl_rollup(spark, d):
    df = reports.pnl_by_exit(_legs(spark, d))
    return df.select(F.coalesce("month", F.lit("ALL")).alias("month"),
                     F.coalesce("exit_type", F.lit("ALL")).alias("exit_type"),
                     F.round("net", 7).alias("net"), "n")


def q_chrono_split(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    df = ordering.chronological_split(orders, ["ts", "o_orderkey"], RULES.test_share)
    return df.select("o_orderkey", "position", *flags("is_test"))


def q_auc(spark, d):
    scored = table(spark, d, "documents").select("doc_id", "n_chars").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    df = ordering.average_rank_auc(scored, "quality", "n_chars")
    return df.select("n_pos", "n_neg", F.round("auc", 9).alias("auc"))


# --- exits, streaks --------------------------------------------------------------------------------

EXIT_OF = {"error": "STOP", "view": "STOP", "purchase": "TREND", "click": "TIMEOUT",
           "signup": "DUST"}
EXIT_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in EXIT_OF.items()) + " END"


def exits_by_user(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr(EXIT_SQL).alias("exit_code"))


def q_stop_streak(spark, d):
    df = positions.stop_streaks(exits_by_user(spark, d))
    return df.select("symbol", micros(), "exit_code", "streak", *flags("blacklisted"),
                     F.coalesce(F.unix_micros("cooldown_until"), F.lit(0)).alias("cooldown_until"),
                     F.coalesce(F.unix_micros("blacklist_until"), F.lit(0))
                     .alias("blacklist_until"))


def q_exclusions(spark, d):
    """Every tick is a candidate: which are barred by the exits before it."""
    candidates = ticks(spark, d, "user_id").select(
        "symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("cycle_ts"))
    streaks = stored(positions.stop_streaks(exits_by_user(spark, d)), "streaks")
    df = positions.with_exclusions(candidates, streaks)
    return df.select("symbol", micros("cycle_ts"), *flags("cooling", "blacklisted"), "stop_count")


# --- text: cleaning, evolution, repair ---------------------------------------------------------------

K = "CAST(get_json_object(props, '$.k') AS INT)"


def _trade_text(spark, d):
    """Event rows in the text layout of a trade log, with damage by rule."""
    e = table(spark, d, "events").withColumn("k", F.expr(K))
    return e.select(
        F.when(F.col("k") % 13 == 0, "Islem_Zamani")
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("Islem_Zamani"),
        F.col("event_type").alias("Sembol"),
        F.when(F.col("k") % 3 == 0, "MSB").when(F.col("k") % 3 == 1, "Engulf").alias("Sinyal"),
        F.lit("NORMAL").alias("Kasa_Tipi"),
        F.when(F.col("k") % 11 == 0, "n/a").otherwise(F.col("k").cast("string"))
        .alias("Giris_RSI"),
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("Giris_Vol_Oran"),
        F.when(F.col("k") % 17 == 0, "").otherwise(F.concat(F.col("k").cast("string"),
                                                            F.lit("e-1"))).alias("Giris_ATR_Pct"),
        F.col("value").cast("string").alias("Giris_Fiyat"),
        F.col("value").cast("string").alias("Cikis_Fiyat"),
        F.lit("0.0").alias("Kar_Orani"),
        F.concat(F.lit("-"), F.col("k").cast("string")).alias("Net_Kar_USDT"),
        F.lit("STOP").alias("Cikis_Tipi"), F.lit("1").alias("Sure_Saat"))


def q_coerce_clean(spark, d):
    df = logs.clean_trades(_trade_text(spark, d), since="2024-01-05 00:00:00")
    return df.select("symbol", micros(), F.coalesce("signal", F.lit("")).alias("signal"), "rsi",
                     "vol_ratio", F.round("atr_pct", 6).alias("atr_pct"), "entry_price", "net",
                     values.signal_code("signal").alias("signal_code"))


def q_evolve_union(spark, d):
    """History without the newer columns, new rows without an older one: nothing is lost."""
    orders = table(spark, d, "orders")
    day = F.col("o_orderdate")
    history = orders.where(day < "1998-01-01").select("o_orderkey", "o_totalprice", "o_orderstatus")
    fresh = orders.where(day >= "1998-01-01").select("o_orderkey", "o_totalprice",
                                                     "o_orderpriority")
    df = sinks.evolved(history, fresh)
    return df.select("o_orderkey", "o_totalprice",
                     F.coalesce("o_orderstatus", F.lit("-")).alias("o_orderstatus"),
                     F.coalesce("o_orderpriority", F.lit("-")).alias("o_orderpriority"))


RAGGED = ["event_id", "event_type", "value", "k", "user_id", "score_a", "score_b"]
RAGGED_LAYOUTS = {7: RAGGED, 5: ["event_id", "event_type", "value", "score_a", "score_b"]}


def _ragged_lines(spark, d):
    """Lines by three versions of a writer, one of which overflows into a list cell, plus damage."""
    e = table(spark, d, "events").withColumn("k", F.expr(K))
    head = [F.col("event_id").cast("string"), F.concat(F.lit('"'), "event_type", F.lit(',x"')),
            F.col("k").cast("string")]
    tail = [F.lit("a"), F.lit("b")]
    extra = [F.col("k").cast("string"), F.col("user_id").cast("string")]
    return e.select(
        F.when(F.col("k") % 4 == 0, F.concat_ws(",", *head, *tail))
        .when(F.col("k") % 4 == 1, F.concat_ws(",", *head, *extra, *tail))
        .when(F.col("k") % 4 == 2, F.concat_ws(",", *head, *extra, F.lit("\"['a', 'b']\"")))
        .when(F.col("k") == 3, F.lit("event_id,event_type,value,k,user_id,score_a,score_b"))
        .otherwise(F.concat_ws(",", *head)).alias("value"))


def _ragged_file(spark, d):
    """The lines as a text file, read as the tolerant reader does: (clean, quarantine)."""
    path = scratch_path(spark, "ragged")
    _ragged_lines(spark, d).write.text(path)
    return logs.read_ragged(spark, path, RAGGED, RAGGED_LAYOUTS)


def q_ragged_repair(spark, d):
    clean, _ = _ragged_file(spark, d)
    return clean.select(*[F.coalesce(c, F.lit("-")).alias(c) for c in RAGGED])


def q_ragged_quarantine(spark, d):
    _, bad = _ragged_file(spark, d)
    return bad.groupBy("n_fields").agg(F.count(F.lit(1)).alias("n"))


def q_entry_features(spark, d):
    """Features kept as JSON text, some of it unreadable."""
    e = table(spark, d, "events").withColumn("k", F.expr(K))
    text = (
        F.when(F.col("k") % 5 == 0, "{broken")
        .when(F.col("k") % 5 == 1, F.to_json(F.struct(F.col("k").cast("double").alias("atr_pct"))))
        .when(F.col("k") % 5 == 2, F.to_json(F.struct(
            (F.col("k") > 50).alias("is_whale"), F.col("event_type").alias("signal"))))
    )
    df = e.withColumn("_json", text).select(
        "event_id", values.entry_features("_json").alias("f"))
    return df.select("event_id", F.coalesce("f.signal", F.lit("")).alias("signal"),
                     F.col("f.atr_pct").alias("atr_pct"),
                     F.col("f.is_whale").cast("int").alias("is_whale"))


QUERIES = {
    "legs_to_positions": q_legs_to_positions, "class_balance": q_class_balance,
    "trade_pnl": q_trade_pnl, "vwap": q_vwap, "imbalance": q_imbalance,
    "book_depth": q_book_depth, "reconcile": q_reconcile, "wallet_scan": q_wallet_scan,
    "mark_to_market": q_mark_to_market, "position_report": q_position_report, "position_state": q_position_state, "priced_positions": q_priced_positions,
    "held_tickers": q_held_tickers, "cumulative_profit": q_cumulative_profit,
    "running_top": q_running_top, "pnl_rollup": q_pnl_rollup, "chrono_split": q_chrono_split,
    "auc": q_auc, "stop_streak": q_stop_streak, "exclusions": q_exclusions,
    "coerce_clean": q_coerce_clean, "evolve_union": q_evolve_union,
    "ragged_repair": q_ragged_repair, "ragged_quarantine": q_ragged_quarantine,
    "entry_features": q_entry_features,
}

# --- SQL ---------------------------------------------------------------------------------------------

LEGS_SQL = f"""legs AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS symbol, o_totalprice AS entry_price,
         CAST(o_custkey AS DOUBLE) AS rsi, CAST(length(o_orderpriority) AS DOUBLE) AS vol_ratio,
         CAST(o_custkey % 7 AS DOUBLE) AS atr_pct,
         CASE o_orderstatus WHEN 'F' THEN 'MSB' WHEN 'O' THEN 'Engulf' ELSE '' END AS signal,
         {LEG_NET} AS net, l_shipdate AS ts,
         CASE l_returnflag WHEN 'R' THEN 'STOP' WHEN 'A' THEN 'TREND' ELSE 'TIMEOUT' END
           AS exit_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey), pos AS (
  SELECT symbol, entry_price, rsi, vol_ratio, atr_pct, signal, sum(net) AS net, min(ts) AS ts,
         count(*) AS n_legs
  FROM legs GROUP BY ALL), tgt AS (
  SELECT *, CAST(net < -0.1 AS INTEGER) AS is_loss, CAST(net > 0.1 AS INTEGER) AS is_profit
  FROM pos)"""

WALLET_SQL = f"""wallet AS (
  SELECT {COIN_SQL.format(text='VARCHAR')} AS coin, sum(c_acctbal) AS total,
         min(c_custkey) AS c_custkey, min(c_nationkey) AS nation
  FROM customer GROUP BY 1), tickers AS (
  SELECT coin || '/USDT' AS symbol, (nation - 2) / 1000.0::DOUBLE AS last
  FROM wallet WHERE nation <> 7), held AS (
  SELECT coin || '/USDT' AS symbol, price / 1e7 AS entry_price,
         CASE WHEN o_custkey % 3 = 0 THEN 40.0::DOUBLE ELSE 20.0 END AS cost, entry_ts,
         CASE WHEN o_custkey % 2 = 0 THEN price / 1e6 END AS max_ratio,
         o_custkey % 5 = 0 AS half_sold
  FROM (SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price,
               max(o_orderdate) AS entry_ts
        FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) JOIN wallet ON o_custkey = c_custkey)"""

RECON_SQL = f"""{WALLET_SQL}, recon AS (
  SELECT symbol, held, value, CASE
      WHEN held AND NOT priced THEN 'UNKNOWN_PRICE'
      WHEN held AND value < 1 THEN 'CLOSE_DUST'
      WHEN NOT held AND priced AND value > 10 AND coin NOT IN ('USDT', 'BNB')
           AND len(list_filter({BANNED_SQL}, lambda b: contains(symbol, b))) = 0 THEN 'ADOPT'
      ELSE 'KEEP' END AS action
  FROM (SELECT coalesce(w.symbol, h.symbol) AS symbol,
               coalesce(w.coin, split_part(h.symbol, '/', 1)) AS coin, h.symbol IS NOT NULL AS held,
               coalesce(w.total, 0) * coalesce(t.last, 0) AS value,
               coalesce(t.last > 0, false) AS priced
        FROM (SELECT coin, coin || '/USDT' AS symbol, total FROM wallet WHERE total > 0) w
        FULL JOIN held h ON w.symbol = h.symbol
        LEFT JOIN tickers t ON t.symbol = coalesce(w.symbol, h.symbol)))"""

RATIO = "((({x}) * 0.999 - ({e}) * 1.001) / (({e}) * 1.001))"

STREAK_SQL = f"""RECURSIVE ex AS (
  SELECT CAST(user_id AS VARCHAR) AS symbol, ts, {EXIT_SQL} AS exit_code,
         row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k
  FROM events), fold AS (
  SELECT symbol, ts, exit_code, k, CAST(exit_code = 'STOP' AS INTEGER) AS streak,
         false AS blacklisted
  FROM ex WHERE k = 1
  UNION ALL
  SELECT e.symbol, e.ts, e.exit_code, e.k,
         CASE WHEN e.exit_code = 'STOP' THEN (f.streak + 1) % 2
              WHEN e.exit_code IN ('TREND', 'DUST') THEN 0 ELSE f.streak END,
         e.exit_code = 'STOP' AND f.streak = 1
  FROM fold f JOIN ex e ON e.symbol = f.symbol AND e.k = f.k + 1)"""

K_SQL = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

ORACLES = {
    "legs_to_positions": f"""WITH {LEGS_SQL}
SELECT symbol, entry_price, rsi, vol_ratio, atr_pct, signal, round(net, 8) + 0.0 AS net,
       epoch_us(ts) AS ts, n_legs, is_loss, is_profit,
       CASE signal WHEN 'MSB' THEN 1 WHEN 'Engulf' THEN 2 ELSE 0 END AS signal_code
FROM tgt""",
    "class_balance": f"""WITH {LEGS_SQL}
SELECT signal, count(*) AS n, CAST(sum(is_loss) AS BIGINT) AS n_loss,
       CAST(sum(is_profit) AS BIGINT) AS n_profit, count(DISTINCT is_loss) AS classes,
       round(CASE WHEN sum(is_loss) > 0 THEN (count(*) - sum(is_loss)) / sum(is_loss)::DOUBLE
                  ELSE 1 END, 6) AS weight
FROM tgt GROUP BY 1""",
    "trade_pnl": f"""WITH t AS (
  SELECT *, l_extendedprice / l_quantity AS e,
         l_extendedprice / l_quantity * (1 + l_tax - l_discount) AS x FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round(l_quantity / e * (x * 0.999 - e * 1.001), 6) + 0.0 AS net,
       round({RATIO.format(x='x', e='e')} * 100, 6) + 0.0 AS net_pct,
       round(floor(l_quantity / 7 / 0.01::DOUBLE) * 0.01::DOUBLE, 6) AS lots,
       round(CASE WHEN l_quantity > 45 THEN 0.02
                  ELSE greatest(0.025, least(0.055, l_discount * 50 * 1.5 / 100)) END, 6)
         AS stop_ratio,
       round(greatest(0.03, least(0.06, l_discount * 50 * 2.0 / 100)), 6) AS first_tier
FROM t""",
    "vwap": """WITH f AS (
  SELECT l_orderkey, sum(l_extendedprice) / sum(l_quantity) AS w
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_id,
       round(coalesce(CASE WHEN o_orderstatus = 'P' THEN nullif(o_totalprice / 100, 0) END,
                      nullif(w, 0), o_totalprice) / o_totalprice, 9) AS fill_ratio
FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""",
    "imbalance": """WITH b AS (
  SELECT vec_id, list_zip(range(1, len(embedding) + 1), embedding) AS z FROM embeddings), s AS (
  SELECT vec_id, list_filter(z, lambda x: x[2] > 0) AS bids,
         list_filter(z, lambda x: x[2] < 0) AS asks FROM b), n AS (
  SELECT vec_id, asks,
         list_sum(list_transform(bids[1:20], lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS bid,
         list_sum(list_transform(asks[1:20], lambda x: -x[1]::DOUBLE * x[2]::DOUBLE)) AS ask
  FROM s)
SELECT vec_id, round(CASE WHEN ask > 0 THEN bid / ask ELSE 0 END, 5) AS book_ratio,
       CAST(asks[1][1] AS DOUBLE) AS best_ask
FROM n""",
    "book_depth": """WITH b AS (
  SELECT vec_id, list_zip(range(1, len(embedding) + 1), embedding) AS z FROM embeddings), s AS (
  SELECT vec_id, list_filter(z, lambda x: x[2] > 0)[1:5] AS bids,
         list_filter(z, lambda x: x[2] < 0)[1:5] AS asks FROM b)
SELECT vec_id, len(bids) AS n_bids, len(asks) AS n_asks,
       round(list_sum(list_transform(asks, lambda x: -x[1]::DOUBLE * x[2]::DOUBLE)), 5)
         AS ask_notional
FROM s""",
    "reconcile": f"""WITH {RECON_SQL}
SELECT symbol, round(value, 6) + 0.0 AS value, CAST(held AS INTEGER) AS held, action FROM recon""",
    "wallet_scan": f"""WITH {RECON_SQL}
SELECT symbol, round(value, 6) + 0.0 AS value FROM recon WHERE action = 'ADOPT'""",
    "mark_to_market": f"""WITH {WALLET_SQL}, p AS (
  SELECT h.*, coalesce(t.last, h.entry_price) AS price
  FROM held h LEFT JOIN tickers t USING (symbol))
SELECT symbol, round(entry_price, 6) AS entry_price, round(price, 6) + 0.0 AS price,
       round(cost, 6) AS cost,
       round((price - entry_price) * cost / entry_price, 6) + 0.0 AS unrealized,
       round({RATIO.format(x='price', e='entry_price')} * 100, 6) + 0.0 AS net_pct,
       round((epoch(TIMESTAMP '{AS_OF}') - epoch(entry_ts)) / 3600, 6) AS age_h,
       round(coalesce(max_ratio, 0) * 100, 6) AS max_pct, CAST(half_sold AS INTEGER) AS half_sold,
       CAST(cost > 30 AS INTEGER) AS large
FROM p""",
    "position_report": f"""WITH {WALLET_SQL}, p AS (
  SELECT h.*, coalesce(t.last, h.entry_price) AS price,
         {RATIO.format(x='coalesce(t.last, h.entry_price)', e='entry_price')} * 100 AS net_pct
  FROM held h LEFT JOIN tickers t USING (symbol))
SELECT 'POSITION' AS kind, symbol, CASE WHEN net_pct >= 0 THEN '+' ELSE '-' END AS sign,
       round(cost + (price - entry_price) * cost / entry_price, 4) + 0.0 AS value, round(price, 5) + 0.0 AS price,
       round(net_pct, 5) + 0.0 AS net_pct, round(coalesce(max_ratio, 0) * 100, 5) AS max_pct,
       CAST(half_sold AS INTEGER) AS half_sold
FROM p
UNION ALL
SELECT 'CASH', 'USDT', '', round(coalesce(sum(c_acctbal), 0), 4) + 0.0, -1, -1, -1, -1
FROM customer WHERE c_nationkey = 3""",
    "position_state": f"""WITH {WALLET_SQL}
SELECT symbol, CASE WHEN half_sold THEN 20.0::DOUBLE ELSE cost END AS cost,
       round(coalesce(max_ratio, 0), 6) AS max_ratio, CAST(half_sold AS INTEGER) AS half_sold,
       epoch_us(entry_ts) AS entry_ts, '{{}}' AS features_json
FROM held""",
    "priced_positions": f"""WITH {WALLET_SQL}
SELECT symbol, t.last, round({RATIO.format(x='t.last', e='entry_price')}, 6) + 0.0 AS net_ratio
FROM held JOIN tickers t USING (symbol) WHERE t.last <> 0""",
    "held_tickers": f"""WITH {WALLET_SQL}
SELECT symbol, last FROM tickers WHERE symbol IN (SELECT symbol FROM held)""",
    "cumulative_profit": """
SELECT o_orderkey, round(sum(o_totalprice / 1000 - 250) OVER (
         ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS running_net
FROM orders""",
    "running_top": f"""WITH {sql_ticks('user_id')}, e AS (
  SELECT *, first_value(price) OVER (PARTITION BY symbol ORDER BY ts) AS entry FROM ticks)
SELECT symbol, epoch_us(ts) AS ts, round(greatest(0, max({RATIO.format(x='price', e='entry')})
         OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS top
FROM e""",
    "pnl_rollup": f"""WITH {LEGS_SQL}
SELECT coalesce(strftime(ts, '%Y-%m'), 'ALL') AS month, coalesce(exit_code, 'ALL') AS exit_type,
       round(sum(net), 7) + 0.0 AS net, count(*) AS n
FROM legs GROUP BY ROLLUP (strftime(ts, '%Y-%m'), exit_code)""",
    "chrono_split": """WITH o AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position,
         count(*) OVER () AS n FROM orders)
SELECT o_orderkey, position,
       CAST(position >= n - greatest(1, floor(n * 0.2)) AS INTEGER) AS is_test FROM o""",
    "auc": """WITH s AS (
  SELECT quality AS y, n_chars AS x FROM documents JOIN labels USING (doc_id)), r AS (
  SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM s)
SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
       round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2)
             / (sum(y)::DOUBLE * sum(1 - y)), 9) AS auc
FROM r""",
    "stop_streak": f"""WITH {STREAK_SQL}
SELECT symbol, epoch_us(ts) AS ts, exit_code, streak, CAST(blacklisted AS INTEGER) AS blacklisted,
       CASE WHEN exit_code <> 'DUST' THEN epoch_us(ts + INTERVAL 1 HOUR) ELSE 0 END
         AS cooldown_until,
       CASE WHEN blacklisted THEN epoch_us(ts + INTERVAL 24 HOUR) ELSE 0 END AS blacklist_until
FROM fold""",
    "exclusions": f"""WITH {STREAK_SQL}, {sql_ticks('user_id')}, c AS (
  SELECT symbol, ts + INTERVAL 1 HOUR AS cycle_ts FROM ticks), i AS (
  SELECT c.symbol, c.cycle_ts, f.streak
  FROM c ASOF LEFT JOIN fold f ON c.symbol = f.symbol AND c.cycle_ts >= f.ts), j AS (
  SELECT i.*, f.ts AS cooled_at
  FROM i ASOF LEFT JOIN (SELECT * FROM fold WHERE exit_code <> 'DUST') f
  ON i.symbol = f.symbol AND i.cycle_ts >= f.ts)
SELECT j.symbol, epoch_us(cycle_ts) AS cycle_ts,
       CAST(coalesce(cooled_at + INTERVAL 1 HOUR > cycle_ts, false) AS INTEGER) AS cooling,
       CAST(coalesce(b.ts + INTERVAL 24 HOUR > cycle_ts, false) AS INTEGER) AS blacklisted,
       coalesce(j.streak, 0) AS stop_count
FROM j ASOF LEFT JOIN (SELECT * FROM fold WHERE blacklisted) b
  ON j.symbol = b.symbol AND j.cycle_ts >= b.ts""",
    "coerce_clean": f"""WITH e AS (SELECT *, {K_SQL} AS k FROM events)
SELECT event_type AS symbol, epoch_us(ts) AS ts,
       CASE k % 3 WHEN 0 THEN 'MSB' WHEN 1 THEN 'Engulf' ELSE '' END AS signal,
       CAST(k AS DOUBLE) AS rsi, CAST(user_id AS DOUBLE) AS vol_ratio,
       round(k / 10.0::DOUBLE, 6) AS atr_pct, value AS entry_price, CAST(-k AS DOUBLE) + 0.0 AS net,
       CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS signal_code
FROM e WHERE k % 13 <> 0 AND k % 11 <> 0 AND k % 17 <> 0 AND ts >= TIMESTAMP '2024-01-05'""",
    "evolve_union": """
SELECT o_orderkey, o_totalprice, coalesce(o_orderstatus, '-') AS o_orderstatus,
       coalesce(o_orderpriority, '-') AS o_orderpriority
FROM (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderdate < '1998-01-01'
      UNION ALL BY NAME
      SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
      WHERE o_orderdate >= '1998-01-01')""",
    "ragged_repair": f"""WITH e AS (SELECT *, {K_SQL} AS n FROM events)
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type || ',x' AS event_type,
       CAST(n AS VARCHAR) AS value, CASE WHEN n % 4 = 0 THEN '-' ELSE CAST(n AS VARCHAR) END AS k,
       CASE WHEN n % 4 = 0 THEN '-' ELSE CAST(user_id AS VARCHAR) END AS user_id, 'a' AS score_a,
       'b' AS score_b
FROM e WHERE n % 4 < 3""",
    "ragged_quarantine": f"""WITH e AS (SELECT *, {K_SQL} AS n FROM events)
SELECT 3 AS n_fields, count(*) AS n FROM e WHERE n % 4 = 3 AND n <> 3 HAVING count(*) > 0""",
    "entry_features": f"""WITH e AS (SELECT *, {K_SQL} AS k FROM events)
SELECT event_id, CASE WHEN k % 5 = 2 THEN event_type ELSE '' END AS signal,
       CASE WHEN k % 5 = 1 THEN CAST(k AS DOUBLE) ELSE 2.5 END AS atr_pct,
       CAST(k % 5 = 2 AND k > 50 AS INTEGER) AS is_whale
FROM e""",
}
