"""Trade and shadow logs as text tables: tolerant scans, cleaning, repair of drifting rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow import schemas
from barflow.functions.values import to_epoch_ms, to_number, to_time
from barflow.sources import layouts
from barflow.sources.paths import existing

TRADE_NUMBERS = ["rsi", "vol_ratio", "atr_pct", "entry_price", "net"]


def read_text_table(spark: SparkSession, paths: list[str], columns: list[str],
                    header: bool) -> DataFrame | None:
    """All columns as text from every path that exists; None if none does.

    Parts of a table with a history of layouts, and files with a header, are read by the columns they were written with;
    other files by ``columns``, by position.
    """
    found = existing(spark, paths)
    if not found:
        return None
    frames, plain = [], []
    for path in found:
        parts = layouts.read_parts(spark, path, columns)
        frames += parts
        if not parts:
            plain.append(path)
    if plain:
        frames += layouts.read_foreign(spark, plain, columns) if header else [
            layouts.read_csv(spark, plain, columns, header=False)]
    if not frames:
        return spark.createDataFrame([], schemas.text_schema(columns))
    return reduce(DataFrame.unionByName, frames)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """File columns to library names; absent ones become null, unknown ones go."""
    return df.select(*[
        (F.col(old) if old in df.columns else F.lit(None).cast("string")).alias(new)
        for new, old in names.items()])


def filed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Library names to file columns, in file order, with the same treatment."""
    return df.select(*[
        (F.col(new) if new in df.columns else F.lit(None).cast("string")).alias(old)
        for new, old in names.items()])


def typed(df: DataFrame, numbers: list[str], times: list[str]) -> DataFrame:
    """Text to numbers and timestamps; what does not parse becomes null."""
    return df.withColumns({**{c: to_number(c) for c in numbers}, **{c: to_time(c) for c in times}})


def clean_trades(text: DataFrame, since: str | None = None) -> DataFrame:
    """Trades fit for training: header lines and damaged rows fail to parse and drop out."""
    required = [*TRADE_NUMBERS, "ts"]
    numbers = [*TRADE_NUMBERS, "exit_price", "net_pct", "age_h"]
    df = typed(renamed(text, schemas.TRADE_NAMES), numbers, ["ts"]).na.drop(subset=required)
    return df.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else df


def read_trades(spark: SparkSession, paths: list[str], since: str | None = None):
    """Union of all trade logs that exist, cleaned; None if none does."""
    text = read_text_table(spark, paths, schemas.TRADE_COLUMNS, header=False)
    return None if text is None else clean_trades(text, since)


def clean_shadow(text: DataFrame) -> DataFrame:
    """Shadow signals with typed columns and ``ts``; rows without a usable key drop out."""
    names = schemas.SHADOW_NAMES
    numbers = [n for n in names if n not in ("ts_ms", "signal_time", "symbol", "reason", "signal")]
    df = renamed(text, names).withColumn("ts_ms", to_epoch_ms("ts_ms"))
    return typed(df, numbers, ["signal_time"]).where(F.col("ts_ms").isNotNull()).withColumn(
        "ts", F.timestamp_millis("ts_ms"))


def read_shadow(spark: SparkSession, path: str) -> DataFrame | None:
    text = read_text_table(spark, [path], schemas.SHADOW_COLUMNS, header=True)
    return None if text is None else clean_shadow(text)


def fields_of(line: Column) -> Column:
    """Fields of a comma-separated line. Commas inside quotes do not split. A field that holds a
    list in text form, as an overflowing row leaves it, opens into the list's items."""
    outside_quotes = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'
    bare = F.transform(F.split(line, outside_quotes, -1), lambda x: F.when(
        x.startswith('"'), F.regexp_replace(x, r'^"(.*)"$', "$1")).otherwise(x))
    opened = F.transform(bare, lambda x: F.when(
        x.startswith("['"), F.split(F.regexp_replace(x, r"^\['|'\]$", ""), r"',\s*'"))
        .otherwise(F.array(x)))
    # most lines have no quote at all and need no pattern
    fields = F.when(line.contains('"'), F.flatten(opened)).otherwise(F.split(line, ",", -1))
    return F.transform(fields, lambda x: F.nullif(F.trim(x), F.lit("")))


def repair_ragged(lines: DataFrame, known_layouts: dict[int, list[str]], columns: list[str],
                  text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split raw lines into (clean, quarantine).

    A row's field count tells which version of the layout wrote it; its fields go to that layout's
    columns and the others stay null. Header lines vanish; other counts go to quarantine.
    """
    tokens = lines.select(text, fields_of(F.col(text)).alias("_f"))
    first = columns[0]
    is_header = F.coalesce(F.element_at("_f", 1) == first, F.lit(False))
    known = F.size("_f").isin(*known_layouts)
    clean = tokens.where(known & ~is_header).select(*[
        F.coalesce(*[
            F.when(F.size("_f") == n, F.get("_f", F.lit(layout.index(c))))
            for n, layout in known_layouts.items() if c in layout], F.lit(None).cast("string")).alias(c)
        for c in columns])
    quarantine = tokens.where(~known & ~is_header).select(
        F.col(text).alias("line"), F.size("_f").alias("n_fields"))
    return clean, quarantine


def read_ragged(spark: SparkSession, path: str, columns: list[str],
                known_layouts: dict[int, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).text(path)
    return repair_ragged(lines, known_layouts or schemas.layouts_of(columns), columns)
