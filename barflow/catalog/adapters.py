"""The given tables seen as ticks, bars and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.operators.bars import build_bars
from barflow.operators.series import with_row_index
from barflow.session import stored

BENCHMARK = "view"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks_of(events: DataFrame, by: str = "event_type") -> DataFrame:
    return events.where(F.col("value") > 0).select(
        F.col(by).cast("string").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
    )


def ticks(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    return ticks_of(table(spark, sf_dir, "events"), by)


_TABLES: dict[tuple, DataFrame] = {}


def bars(spark: SparkSession, sf_dir: str, width: str = "15m", by: str = "event_type") -> DataFrame:
    """Bars as a stored table with row numbers, written once per session: the ticks are read once,
    however many plans read the bars."""
    key = (spark.sparkContext.applicationId, sf_dir, width, by)
    if key not in _TABLES:
        plain = stored(build_bars(ticks(spark, sf_dir, by), width), "bars")
        _TABLES[key] = stored(with_row_index(plain), "bars")
    return _TABLES[key]


def micros(col: str = "ts") -> Column:
    return F.unix_micros(col).alias(col)


def rounded(*cols: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in cols]


def flags(*cols: str) -> list[Column]:
    return [F.col(c).cast("int").alias(c) for c in cols]


# --- the same in SQL ------------------------------------------------------------------------------

def sql_ticks(by: str = "event_type") -> str:
    return f"""ticks AS (
  SELECT CAST({by} AS VARCHAR) AS symbol, ts, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty
  FROM events WHERE value > 0)"""


def sql_bars(name: str = "bars", width: str = "15 minutes") -> str:
    return f"""{name} AS (
  SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS ts, arg_min(price, ts) AS o,
         max(price) AS h, min(price) AS l, arg_max(price, ts) AS c, sum(qty) AS v
  FROM ticks GROUP BY 1, 2)"""


def sql_round(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in cols)


def sql_smooth(values: str, n: int, alpha: str) -> str:
    """Recursive smoothing of a list, seeded with the mean of its first n values."""
    return (f"CASE WHEN len({values}) >= {n} THEN list_reduce(list_prepend("
            f"list_avg({values}[1:{n}]), {values}[{n + 1}:]), lambda a, x: a + (x - a) * {alpha})"
            " END")
