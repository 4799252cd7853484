"""Files, marks, jobs and stream sinks: the given rows are written in a stored layout and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow import schemas
from barflow.catalog.adapters import bars, flags, micros, rounded, sql_bars, sql_ticks, table, ticks
from barflow.catalog.signal_queries import (
    CAND_SQL, LABEL_RULES, LABEL_SQL, _candidates,
)
from barflow.catalog.trade_queries import (
    K, K_SQL, LEG_NET, LEGS_SQL, RECON_SQL, ORACLES as TRADE_ORACLES, _held, _legs, _trade_text,
    _wallet, _wallet_tickers,
)
from barflow.config import Rules
from barflow.operators import decide, ordering, positions, reports, training
from barflow.plans import labeling_job
from barflow.session import scratch_path, stored
from barflow.sources import logs, market, sinks
from barflow.streaming import runtime

# --- logs -------------------------------------------------------------------------------------------


def q_trade_log_files(spark: SparkSession, d: str) -> DataFrame:
    """Two trade logs and one that does not exist, read as one table."""
    root = scratch_path(spark, "trade-logs")
    text = _trade_text(spark, d)
    old = F.col("Giris_Vol_Oran").cast("int") % 2 == 0
    for name, part in (("old", old), ("new", ~old)):
        sinks.append_csv(text.where(part), f"{root}/{name}", schemas.TRADE_COLUMNS)
    df = logs.read_trades(spark, [f"{root}/{name}" for name in ("old", "missing", "new")],
                          since="2024-01-05 00:00:00")
    return df.select("symbol", micros(), F.coalesce("signal", F.lit("")).alias("signal"), "rsi",
                     "vol_ratio", F.round("atr_pct", 6).alias("atr_pct"), "entry_price", "net")


def q_shadow_log_files(spark, d):
    """A shadow log in two appends, some keys and values damaged, most columns absent."""
    path = scratch_path(spark, "shadow-log")
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    k = F.col("k")
    rows = table(spark, d, "events").withColumn("k", F.expr(K)).select(
        F.col("ts").alias("_ts"),
        F.when(k % 19 == 0, "?").when(k % 7 == 0, F.concat(ms, F.lit(".0"))).otherwise(ms)
        .alias("Ts"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Sinyal_Zamani"),
        F.concat("event_type", F.lit(", \"x\"")).alias("Sembol"),
        F.when(k % 2 == 0, "AI_RED").alias("Sebep"), F.col("value").cast("string").alias("Fiyat"),
        F.when(k % 5 == 0, "none").otherwise(k.cast("string")).alias("Giris_RSI"),
        F.lit("left out").alias("note"))
    early = F.col("_ts") < F.lit("2024-01-16").cast("timestamp")
    for part in (early, ~early):
        sinks.append_csv(rows.where(part), path, schemas.SHADOW_COLUMNS)
    df = logs.read_shadow(spark, path)
    return df.select("symbol", "ts_ms", micros("signal_time"),
                     F.coalesce("reason", F.lit("-")).alias("reason"), "price",
                     F.coalesce("rsi", F.lit(-1.0)).alias("rsi"),
                     F.col("ai_score").isNull().cast("int").alias("no_score"))


def q_shadow_layouts(spark, d):
    """A shadow log whose columns grew twice, with a column renamed in between, read as one table."""
    path = scratch_path(spark, "shadow-layouts")
    k = F.col("k")
    rows = table(spark, d, "events").withColumn("k", F.expr(K)).select(
        "k", F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("Ts"),
        F.concat("event_type", F.lit(", \"x\"")).alias("Sembol"), F.col("value").cast("string").alias("Fiyat"),
        k.cast("string").alias("Giris_RSI"), (k + 1).cast("string").alias("Sym_ADX"), (k + 2).cast("string").alias("BTC_ADX"),
        (k + 3).cast("string").alias("OB_Oran"), (k + 4).cast("string").alias("AI_Skor"),
        (k + 5).cast("string").alias("Filtre_Skor"))
    known = schemas.layouts_of(schemas.SHADOW_COLUMNS)
    oldest = ["Price" if c == "Fiyat" else c for c in known[21]]
    sinks.append_csv(rows.where("k % 4 = 0").withColumnRenamed("Fiyat", "Price"), path, oldest)
    sinks.append_csv(rows.where("k % 4 = 1"), path, known[23], renamed={"Fiyat": "Price"})
    sinks.append_csv(rows.where("k % 4 = 2"), path, known[25])
    sinks.append_csv(rows.where("k % 4 = 3").withColumnRenamed("Fiyat", "Price"), path, oldest)
    df = logs.read_shadow(spark, path)
    return df.select("symbol", "ts_ms", "price", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in (
        "rsi", "sym_adx", "btc_adx", "book_ratio", "ai_score", "risk_score", "pump_3h")])


# --- bars and maps ----------------------------------------------------------------------------------


def q_bar_files(spark, d):
    """Newest fifty bars of each symbol in the last ten days, from a table of two timeframes."""
    path = scratch_path(spark, "bar-files")
    for tf in ("15m", "1h"):
        market.write_bars(bars(spark, d, tf).drop("idx"), path, tf)
    newest = bars(spark, d, "1h").agg(F.max("ts").alias("at"))
    since = newest.select(F.date_trunc("day", F.col("at") - F.expr("INTERVAL 10 DAYS")).cast("string")).first()[0]
    df = market.read_bars(spark, path, "1h", since=since, limit=50)
    return df.select("symbol", "tf", micros(), *rounded("o", "h", "l", "c", "v"))


def _maps(spark, d, entry):
    """Customers in blocks of a hundred, each block one snapshot with maps by coin."""
    block = F.floor(F.col("c_custkey") / 100)
    return table(spark, d, "customer").groupBy(
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=block.cast("int")))
        .alias("snapshot_ts")).agg(*entry)


def q_wallet_maps(spark, d):
    coin = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    pair = F.collect_list(F.struct(coin, "c_acctbal"))
    free = F.collect_list(F.when(F.col("c_custkey") % 3 > 0, F.struct(
        coin, (F.col("c_acctbal") / 2).alias("half"))))
    snapshots = _maps(spark, d, [F.map_from_entries(pair).alias("total"),
                                 F.map_from_entries(free).alias("free")])
    return market.wallet(snapshots).select(micros("snapshot_ts"), "coin", "total", "free")


def q_ticker_maps(spark, d):
    values = F.struct(F.col("c_acctbal").alias("last"), (F.col("c_acctbal") / 100).alias("percentage"),
                      F.col("c_nationkey").cast("double").alias("quoteVolume"))
    name = F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("/USDT"))
    snapshots = _maps(spark, d, [
        F.map_from_entries(F.collect_list(F.struct(name, values))).alias("tickers")])
    return market.tickers_from_map(snapshots).select(
        micros("snapshot_ts"), "symbol", "last", *rounded("pct"), "quote_volume")


# --- stream sinks and marks ---------------------------------------------------------------------------


def q_trade_dual_write(spark, d):
    """Both trade records of a stream of legs that another stream delivers again, and the first once more from its
    checkpoint."""
    root = scratch_path(spark, "dual-write")
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    legs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_orderkey").cast("string").alias("symbol"),
        F.col("l_linenumber").cast("string").alias("wallet"), F.expr(LEG_NET).alias("net"),
        F.col("l_quantity").alias("rsi"), F.col("l_discount").alias("book_ratio"))
    legs.write.parquet(f"{root}/legs")
    half = -(-len(spark.read.schema(legs.schema).parquet(f"{root}/legs").inputFiles()) // 2)
    keys = [schemas.TRADE_NAMES[c] for c in ("ts", "symbol", "wallet", "rsi", "net")]
    for attempt in ("first", "again", "first"):
        sink = runtime.trade_batches(f"{root}/short", f"{root}/long", keys, writer=attempt)
        stream = runtime.read_stream(spark, f"{root}/legs", legs.schema, files_per_batch=max(half, 1))
        stream.writeStream.foreachBatch(sink).option(
            "checkpointLocation", f"{root}/{attempt}").trigger(availableNow=True).start(
        ).awaitTermination()
    columns = [micros("Islem_Zamani").alias("ts"), "Sembol", "Kasa_Tipi", "Giris_RSI",
               F.round("Net_Kar_USDT", 8).alias("net")]
    short = sinks.read_table(spark, f"{root}/short").select(
        *columns, F.lit("short").alias("copy"), F.lit(0.0).alias("book_ratio"))
    extended = sinks.read_table(spark, f"{root}/long").select(
        *columns, F.lit("long").alias("copy"), F.col("OB_Oran").alias("book_ratio"))
    return short.unionByName(extended)


def q_reconcile_stream(spark, d):
    """The wallet scan once per trigger that brings tickers: two files, two scans."""
    root = scratch_path(spark, "wallet-scan")
    tickers = stored(_wallet_tickers(spark, d), "tickers")
    tickers.repartition(2).write.parquet(f"{root}/tickers")
    sink = runtime.reconcile_batches(
        lambda: positions.reconcile(_wallet(spark, d), _held(spark, d), tickers), f"{root}/scans")
    stream = runtime.read_stream(spark, f"{root}/tickers", tickers.schema, files_per_batch=1)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/progress").trigger(
        availableNow=True).start().awaitTermination()
    df = spark.read.parquet(f"{root}/scans")
    return df.select("batch", "symbol", F.round("value", 6).alias("value"), *flags("held"),
                     "action")


def q_progress_mark(spark, d):
    """The mark after each of three writes: it never goes back."""
    path = scratch_path(spark, "mark")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    newest = table(spark, d, "events").agg(F.max(ms).alias("newest"), F.min(ms).alias("oldest")).first()
    middle = (newest.newest + newest.oldest) // 2
    seen = [(0, sinks.read_mark(spark, path))]
    for step, mark in enumerate((middle, newest.oldest, newest.newest), 1):
        sinks.write_mark(spark, path, mark)
        seen.append((step, sinks.read_mark(spark, path)))
    return spark.createDataFrame(seen, "step int, mark bigint")


# --- the labeling job ---------------------------------------------------------------------------------

JOB_RULES = Rules(take_profit=LABEL_RULES.take_profit, stop_loss=LABEL_RULES.stop_loss,
                  label_give_up_h=168.0)
RUNS = ("2024-01-15 00:00:00", "2024-01-28 00:00:00")
RUN_MS = (1_705_276_800_000, 1_706_400_000_000)


def _label_twice(spark, d):
    """Target and rejects of two runs over one mark; each sees the bars of its time."""
    root = scratch_path(spark, "labeling")
    shadow = ticks(spark, d, "user_id").select(
        "symbol", "ts", F.unix_millis("ts").alias("ts_ms"),
        F.when(F.col("qty") % 10 > 0, F.col("price")).alias("price"))
    known = bars(spark, d, by="user_id")
    for at, at_ms in zip(RUNS, RUN_MS):
        labeling_job.run(spark, shadow, known.where(F.col("ts") < F.lit(at).cast("timestamp")),
                         f"{root}/labels", f"{root}/mark", at_ms, JOB_RULES, f"{root}/rejects")
    return sinks.read_table(spark, f"{root}/labels"), sinks.read_table(spark, f"{root}/rejects")


def q_label_incremental(spark, d):
    labels, _ = _label_twice(spark, d)
    return labels.select("symbol", "ts_ms", "outcome",
                         *rounded("result_pct", "max_pct", "min_pct", digits=3))


def q_label_quarantine(spark, d):
    _, rejects = _label_twice(spark, d)
    return rejects.select("symbol", "ts_ms", "status", "n_bars")


def q_label_by_symbol(spark, d):
    """Two runs with a mark for each symbol: half of the symbols' signals arrive only after the first run, whose time has
    passed all of them."""
    root = scratch_path(spark, "labels-by-symbol")
    shadow = ticks(spark, d, "user_id").select("symbol", "ts", F.unix_millis("ts").alias("ts_ms"), "price")
    early = F.col("symbol").cast("int") % 2 == 0
    known = bars(spark, d, by="user_id")
    for at, at_ms, part in zip(RUNS, RUN_MS, (early, F.lit(True))):
        labeling_job.run_by_symbol(
            spark, shadow.where(part), known.where(F.col("ts") < F.lit(at).cast("timestamp")), f"{root}/labels",
            f"{root}/marks", at_ms, JOB_RULES, f"{root}/rejects")
    marks = sinks.read_marks(spark, f"{root}/marks")
    return sinks.read_table(spark, f"{root}/labels").join(marks, "symbol").select(
        "symbol", "ts_ms", "outcome", *rounded("result_pct", digits=3), "mark_ms")


# --- training contract --------------------------------------------------------------------------------


def q_run_metrics(spark, d):
    legs = stored(_legs(spark, d), "legs")
    data = training.with_targets(positions.collapse_legs(legs))
    m = reports.run_metrics(legs, data, "is_loss")
    return spark.createDataFrame([(m["n_rows"], m["n_positions"], m["n_positive"])],
                                 "n_rows bigint, n_positions bigint, n_positive bigint")


def q_gate_branches(spark, d):
    """The gate on the newest fifth for given scores: one that ranks well, its reverse, and a
    target of one class."""
    data = training.with_targets(positions.collapse_legs(_legs(spark, d))).withColumn(
        "never", F.lit(0))
    split = stored(ordering.chronological_split(data, training.ORDER, Rules().test_share), "split")
    out = []
    for name, target, sign in (("good", "is_profit", 1), ("bad", "is_profit", -1),
                               ("one_class", "never", 1)):
        auc, status = training.gate(
            split, target, lambda rows: rows.withColumn("_score", sign * F.col("net")), Rules())
        out.append((name, auc, status))
    return spark.createDataFrame(out, "name string, auc double, status string").select(
        "name", F.round(F.coalesce("auc", F.lit(-1.0)), 9).alias("auc"), "status")


def q_score_contract(spark, d):
    """Scores by a stored model: null where a feature is missing, else a probability."""
    data = stored(training.with_targets(positions.collapse_legs(_legs(spark, d))), "positions")
    path = scratch_path(spark, "model")
    counts = training.class_counts(data, "is_profit")
    sinks.save_model(training.fit(data, training.PROFIT_FEATURES, "is_profit", counts), path)
    holes = data.withColumn("rsi", F.when(F.col("rsi") % 5 > 0, F.col("rsi")))
    scored = training.score(holes, sinks.load_model(spark, path), "s")
    return scored.select("symbol", F.col("s").isNotNull().cast("int").alias("scored"),
                         F.coalesce(F.col("s").between(0, 1), F.lit(True)).cast("int").alias("valid"))


def q_observe_only(spark, d):
    """Observe-only mode: scores are kept, but no model rejects."""
    df = decide.decide(_candidates(spark, d), Rules(observe_only=True))
    return df.select(micros("cycle_ts"), "rank", "symbol", "decision",
                     F.coalesce("reason", F.lit("-")).alias("reason"),
                     F.coalesce("ai_score", F.lit(-1.0)).alias("ai_score"))


QUERIES = {
    "trade_log_files": q_trade_log_files, "shadow_log_files": q_shadow_log_files,
    "shadow_layouts": q_shadow_layouts,
    "bar_files": q_bar_files, "wallet_maps": q_wallet_maps, "ticker_maps": q_ticker_maps,
    "trade_dual_write": q_trade_dual_write, "reconcile_stream": q_reconcile_stream,
    "progress_mark": q_progress_mark, "label_incremental": q_label_incremental,
    "label_quarantine": q_label_quarantine, "label_by_symbol": q_label_by_symbol, "run_metrics": q_run_metrics,
    "gate_branches": q_gate_branches, "score_contract": q_score_contract,
    "observe_only": q_observe_only,
}

# --- SQL ---------------------------------------------------------------------------------------------

BLOCK_US = "epoch_us(TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey // 100 AS INTEGER)))"


def _sql_labels(run: int) -> str:
    """Signals due at a run with their number of bars known then."""
    return LABEL_SQL.replace(sql_ticks(), sql_ticks("user_id")).replace(
        "SELECT symbol, ts, price, CASE qty", "SELECT symbol, ts, CASE WHEN qty % 10 > 0 THEN price END"
        " AS price, CASE qty").format(
        upto=f"WHERE ts < TIMESTAMP '{RUNS[run]}'",
        due=f"WHERE epoch_us(ts) // 1000 <= {RUN_MS[run] - 5 * 3_600_000}") + f"""
SELECT symbol, epoch_us(ts) // 1000 AS ts_ms, outcome, result_pct, max_pct, min_pct, n_bars,
       CASE WHEN price IS NULL THEN 'BAD' WHEN n_bars = 16 THEN 'LABELED'
            WHEN epoch_us(ts) // 1000 < {RUN_MS[run] - 168 * 3_600_000} THEN 'GIVE_UP'
            ELSE 'WAIT' END AS status FROM r"""


BOTH_RUNS = f"""WITH a AS (SELECT * FROM ({_sql_labels(0)})), b AS (SELECT * FROM ({_sql_labels(1)})),
fates AS (
  SELECT * FROM a WHERE status <> 'WAIT'
  UNION ALL
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.symbol = b.symbol AND a.ts_ms = b.ts_ms
                                    AND a.status <> 'WAIT'))"""

ORACLES = {
    "trade_log_files": TRADE_ORACLES["coerce_clean"].replace(
        """ + 0.0 AS net,
       CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS signal_code""", " + 0.0 AS net"),
    "shadow_log_files": f"""WITH e AS (SELECT *, {K_SQL} AS k FROM events)
SELECT event_type || ', "x"' AS symbol, epoch_us(ts) // 1000 AS ts_ms,
       epoch_us(date_trunc('second', ts)) AS signal_time,
       CASE WHEN k % 2 = 0 THEN 'AI_RED' ELSE '-' END AS reason, value AS price,
       CASE WHEN k % 5 = 0 THEN -1.0::DOUBLE ELSE k END AS rsi, 1 AS no_score
FROM e WHERE k % 19 <> 0""",
    "shadow_layouts": f"""WITH e AS (SELECT *, {K_SQL} AS k FROM events)
SELECT event_type || ', "x"' AS symbol, epoch_us(ts) // 1000 AS ts_ms, value AS price,
       CAST(k AS DOUBLE) AS rsi, CASE WHEN k % 4 IN (1, 2) THEN k + 1.0::DOUBLE ELSE -1 END AS sym_adx,
       CASE WHEN k % 4 IN (1, 2) THEN k + 2.0::DOUBLE ELSE -1 END AS btc_adx,
       CASE WHEN k % 4 = 2 THEN k + 3.0::DOUBLE ELSE -1 END AS book_ratio, k + 4.0::DOUBLE AS ai_score,
       k + 5.0::DOUBLE AS risk_score, -1.0::DOUBLE AS pump_3h
FROM e""",
    "bar_files": f"""WITH {sql_ticks()}, {sql_bars(width='1 hour')}
SELECT symbol, '1h' AS tf, epoch_us(ts) AS ts, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l,
       round(c, 6) AS c, round(v, 6) AS v
FROM bars WHERE ts >= (SELECT date_trunc('day', max(ts) - INTERVAL 10 DAY) FROM bars)
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50""",
    "wallet_maps": f"""
SELECT {BLOCK_US} AS snapshot_ts, 'C' || c_custkey AS coin, c_acctbal AS total,
       CASE WHEN c_custkey % 3 > 0 THEN c_acctbal / 2 ELSE 0 END AS free
FROM customer WHERE c_acctbal > 0""",
    "ticker_maps": f"""
SELECT {BLOCK_US} AS snapshot_ts, 'C' || c_custkey || '/USDT' AS symbol, c_acctbal AS last,
       round(c_acctbal / 100, 6) + 0.0 AS pct, CAST(c_nationkey AS DOUBLE) AS quote_volume
FROM customer""",
    "trade_dual_write": f"""
SELECT DISTINCT ON (l_shipdate, l_orderkey, l_linenumber, l_quantity, {LEG_NET}, copy)
       epoch_us(CAST(l_shipdate AS TIMESTAMP)) AS ts, CAST(l_orderkey AS VARCHAR) AS "Sembol",
       CAST(l_linenumber AS VARCHAR) AS "Kasa_Tipi", CAST(l_quantity AS DOUBLE) AS "Giris_RSI",
       round({LEG_NET}, 8) + 0.0 AS net, copy,
       CASE copy WHEN 'long' THEN l_discount ELSE 0.0::DOUBLE END AS book_ratio
FROM lineitem JOIN orders ON l_orderkey = o_orderkey, unnest(['short', 'long']) AS u(copy)""",
    "reconcile_stream": f"""WITH {RECON_SQL}
SELECT batch, symbol, round(value, 6) + 0.0 AS value, CAST(held AS INTEGER) AS held, action
FROM recon, unnest([0, 1]) AS u(batch)""",
    "progress_mark": """WITH m AS (
  SELECT max(epoch_us(ts) // 1000) AS hi, min(epoch_us(ts) // 1000) AS lo FROM events)
SELECT step, CASE step WHEN 0 THEN 0 WHEN 3 THEN hi ELSE (hi + lo) // 2 END AS mark
FROM m, unnest([0, 1, 2, 3]) AS u(step)""",
    "label_incremental": f"""{BOTH_RUNS}
SELECT symbol, ts_ms, outcome, result_pct, max_pct, min_pct FROM fates WHERE status = 'LABELED'""",
    "label_quarantine": f"""{BOTH_RUNS}
SELECT symbol, ts_ms, status, n_bars FROM fates WHERE status IN ('BAD', 'GIVE_UP')""",
    "label_by_symbol": """WITH a AS (SELECT * FROM ({one}) WHERE CAST(symbol AS INTEGER) % 2 = 0),
b AS (SELECT * FROM ({two})), m1 AS (
  SELECT symbol, coalesce(min(CASE WHEN status = 'WAIT' THEN ts_ms - 1 END), max(CASE WHEN status <> 'WAIT' THEN ts_ms END)) AS mark
  FROM a GROUP BY 1), second AS (
  SELECT b.* FROM b LEFT JOIN m1 USING (symbol) LEFT JOIN a ON a.symbol = b.symbol AND a.ts_ms = b.ts_ms AND a.status = 'LABELED'
  WHERE b.ts_ms > coalesce(mark, 0) AND a.symbol IS NULL), m2 AS (
  SELECT symbol, coalesce(min(CASE WHEN status = 'WAIT' THEN ts_ms - 1 END), max(CASE WHEN status <> 'WAIT' THEN ts_ms END)) AS mark
  FROM second GROUP BY 1), marks AS (
  SELECT symbol, max(mark) AS mark_ms FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) GROUP BY 1)
SELECT symbol, ts_ms, outcome, result_pct, mark_ms FROM (
  SELECT * FROM a WHERE status = 'LABELED' UNION ALL SELECT * FROM second WHERE status = 'LABELED') JOIN marks USING (symbol)
""".format(one=_sql_labels(0).replace("CASE WHEN qty % 10 > 0 THEN price END AS price", "price"),
           two=_sql_labels(1).replace("CASE WHEN qty % 10 > 0 THEN price END AS price", "price")),
    "run_metrics": f"""WITH {LEGS_SQL}
SELECT CAST(sum(n_legs) AS BIGINT) AS n_rows, count(*) AS n_positions,
       CAST(sum(is_loss) AS BIGINT) AS n_positive FROM tgt""",
    "gate_branches": f"""WITH {LEGS_SQL}, o AS (
  SELECT is_profit AS y, net, row_number() OVER (
           ORDER BY ts, symbol, entry_price, rsi, vol_ratio, atr_pct, signal) - 1 AS place,
         count(*) OVER () AS total FROM tgt), s AS (
  SELECT y, name, CASE name WHEN 'good' THEN net ELSE -net END AS x
  FROM o, unnest(['good', 'bad']) AS u(name)
  WHERE place >= total - greatest(1, floor(total * 0.2))), r AS (
  SELECT name, y, rank() OVER (PARTITION BY name ORDER BY x)
           + (count(*) OVER (PARTITION BY name, x) - 1) / 2.0 AS r FROM s), a AS (
  SELECT name, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2)
                     / (sum(y)::DOUBLE * sum(1 - y)), 9) AS auc FROM r GROUP BY 1)
SELECT name, auc, CASE WHEN auc < {Rules().min_auc} THEN 'BELOW_GATE' ELSE 'ACCEPTED' END AS status
FROM a UNION ALL SELECT 'one_class', -1, 'ONE_CLASS'""",
    "score_contract": f"""WITH {LEGS_SQL}
SELECT symbol, CAST(rsi % 5 > 0 AS INTEGER) AS scored, 1 AS valid FROM tgt""",
    "observe_only": f"""{CAND_SQL.format(model='false')}
SELECT epoch_us(cycle_ts) AS cycle_ts, rank, symbol,
       CASE WHEN reason IS NOT NULL THEN 'SHADOW' WHEN rank = pick THEN 'BUY' ELSE 'NO_FILL' END
         AS decision, coalesce(reason, '-') AS reason, coalesce(ai, -1) AS ai_score
FROM dec""",
}
