"""Signal cycle: tickers and bars to decisions, for any number of cycles in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow import schemas
from barflow.config import Rules
from barflow.functions import book
from barflow.functions.values import signal_code
from barflow.operators import decide, positions, regime, series, signals, training, universe
from barflow.operators.throttle import throttle
from barflow.session import stored
from barflow.sources.logs import filed


@dataclass
class CycleInputs:
    """Tables of the cycle. ``tickers``: cycle_ts, symbol, last, pct, quote_volume, lot_step;
    ``context``: ts (its bar's start), btc_ok, regime, ...; ``balances``: cycle_ts, free_cash; ``books``: cycle_ts,
    symbol, bids, asks; ``held``: symbol; ``exits``: symbol, ts, exit_code."""

    tickers: DataFrame
    bars: DataFrame
    hourly: DataFrame
    context: DataFrame
    balances: DataFrame
    held: DataFrame
    exits: DataFrame
    books: DataFrame | None = None


def of_symbols(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the symbols that ``wanted`` holds."""
    return rows.join(wanted.select("symbol").distinct(), "symbol", "left_semi").select(*rows.columns)


def at_newest_bar(candidates: DataFrame, bars: DataFrame) -> DataFrame:
    """Candidates with time and number of their newest closed bar at the cycle."""
    known = bars.select("symbol", "idx", F.col("ts").alias("bar_ts"),
                        (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("known_at"))
    return series.asof(candidates, known, ["bar_ts", "idx"], left_ts="cycle_ts",
                       right_ts="known_at").where("idx IS NOT NULL")


def near(bars: DataFrame, placed: DataFrame, rows: int = 128) -> DataFrame:
    """Numbered bars in the blocks of ``rows`` that hold a candidate's bar and in the blocks before
    them: every candidate's bar keeps at least ``rows`` bars before it, more than any feature reads.
    """
    block = F.expr(f"idx div {rows}")
    wanted = placed.select("symbol", F.explode(F.array(block, block - 1)).alias("_block"))
    return bars.withColumn("_block", block).join(
        wanted.distinct(), ["symbol", "_block"], "left_semi").drop("_block")


def candidates_with_features(inputs: CycleInputs, rules: Rules = Rules(),
                             mode: str = "closed") -> DataFrame:
    """Top symbols of each cycle that pass exclusions and rules, with every feature.

    The ranking cuts each cycle to a few symbols first; of exits and bars only those of these symbols are
    followed; exclusions come next, features last, from the bars around the candidates only.
    In closed mode a cycle reads no bar, of its symbols or of the benchmark, that is still open.
    """
    ranked = universe.top_gainers(inputs.tickers, rules)
    ranked = stored(ranked.join(inputs.held.select("symbol").distinct(), "symbol", "left_anti"), "ranked")
    streaks = stored(positions.stop_streaks(of_symbols(inputs.exits, ranked), rules), "streaks")
    ranked = positions.with_exclusions(ranked, streaks)
    ranked = ranked.where(~F.col("cooling") & ~F.col("blacklisted"))
    context = inputs.context.select("ts", "btc_ok", "regime", "btc_1h_change", "btc_ema_distance",
                                    "btc_adx")
    if mode == "closed":
        context = regime.known_context(context)
    ranked = series.asof_grid(ranked, stored(context, "context"), context.columns[1:], "cycle_ts")
    ranked = stored(ranked.where(F.coalesce("btc_ok", F.lit(False))), "ranked")
    bars = series.with_row_index(of_symbols(inputs.bars, ranked))
    placed = stored(at_newest_bar(ranked, bars), "placed")
    hourly = of_symbols(inputs.hourly, placed)
    found = signals.find_signals(near(bars, placed), hourly, rules, mode)
    df = placed.drop("idx").join(found.withColumnRenamed("ts", "bar_ts"), ["symbol", "bar_ts"])
    if inputs.books is not None:
        books = inputs.books.select(
            "cycle_ts", "symbol", book.imbalance(F.col("bids"), F.col("asks")).alias("book_ratio"),
            book.best_ask(F.col("asks")).alias("ask"))
        df = df.join(books, ["cycle_ts", "symbol"], "left")
    else:
        df = df.withColumns({"book_ratio": F.lit(0.0), "ask": F.col("last")})
    return df.withColumn("signal_code", signal_code("signal")).withColumn(
        "book_ratio", F.coalesce("book_ratio", F.lit(0.0)))


def decisions(inputs: CycleInputs, rules: Rules = Rules(), profit_model=None, risk_model=None,
              mode: str = "closed", scores: tuple | None = None) -> DataFrame:
    """One row per candidate that passed the rules, with its decision.

    ``scores`` gives ready (ai_score, risk_score) columns instead of models.
    """
    df = candidates_with_features(inputs, rules, mode)
    if scores is not None:
        df = df.withColumns({"ai_score": scores[0], "risk_score": scores[1]})
    else:
        df = training.score(df, profit_model, "ai_score")
        df = training.score(df, risk_model, "risk_score")
    df = df.join(inputs.balances.select("cycle_ts", "free_cash"), "cycle_ts", "left")
    df = df.withColumn("free_cash", F.coalesce("free_cash", F.lit(0.0)))
    return decide.decide(df, rules, has_model=scores is not None or profit_model is not None)


def shadow_signals(decided: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rejected signals, thinned per symbol, in the shadow file's columns."""
    rejected = decided.where(F.col("decision") == "SHADOW").withColumns({
        "ts": F.col("cycle_ts"), "price": F.col("c")})
    kept = throttle(rejected, rules.throttle_s).withColumns({
        "ts_ms": F.unix_millis("ts"),
        "signal_time": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")})
    return filed(kept, schemas.SHADOW_NAMES)
