"""Appends, schema evolution, progress marks and models on shared storage."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow import schemas
from barflow.session import stored
from barflow.sources import layouts
from barflow.sources.logs import filed
from barflow.sources.paths import exists


def reindexed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order: missing ones null, others dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
                       for c in columns])


def evolved(history: DataFrame, new_rows: DataFrame) -> DataFrame:
    """One table under the ordered union of both column sets, compared by name; no column is lost
    and no stored row is rewritten."""
    return history.unionByName(new_rows, allowMissingColumns=True)


def append_table(df: DataFrame, path: str) -> None:
    """Append parquet files. A new column needs no rewrite: ``read_table`` merges schemas."""
    df.write.mode("append").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    if not exists(spark, path):
        return None
    return spark.read.option("mergeSchema", True).parquet(path)


def append_csv(df: DataFrame, path: str, columns: list[str], renamed: dict[str, str] | None = None) -> None:
    """Append as CSV parts under their layout, with ``columns`` in this order, see ``layouts``. Every part
    has a header too. ``renamed`` maps new names of columns to those they had. Quotes in a text are doubled, as the readers
    expect them."""
    layout = layouts.register(df.sparkSession, path, columns, renamed)
    reindexed(df, columns).write.mode("append").option("header", True).option(
        "escape", '"').csv(layouts.part_path(path, layout))


#: Partition column of tables that are appended to by key: the first day of the rows' month.
MONTH = "event_month"
#: Where a table without rows keeps its schema, in an empty file.
NO_MONTH = f"{MONTH}=__HIVE_DEFAULT_PARTITION__"
#: Rows of a month that are compared in one piece.
CELL_ROWS = 500_000


def month_of(df: DataFrame, keys: list[str]) -> Column | None:
    """Month of a row by its first time among the ``keys`` (a time, a date, or milliseconds named ``ts_ms``); None if no key is
    one."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    for key in keys:
        if kinds[key] in ("timestamp", "timestamp_ntz", "date"):
            return F.trunc(F.col(key).cast("date"), "month")
        if key == "ts_ms":
            return F.trunc(F.timestamp_millis(key).cast("date"), "month")
    return None


def of_months(spark: SparkSession, path: str, columns: list[str], lo, hi) -> DataFrame | None:
    """``columns`` of a table's rows of the months from that of ``lo`` to that of ``hi``, of which only those partitions are
    read; the schema comes from one file."""
    if not exists(spark, path):
        return None
    df = spark.read.parquet(path)
    if MONTH in df.columns:
        inside = F.col(MONTH).between(F.trunc(F.lit(lo), "month"), F.trunc(F.lit(hi), "month"))
        df = df.where(F.col(MONTH).isNull() | (F.lit(False) if lo is None else inside))
    return df.select(*columns)


def leave_schema(df: DataFrame, path: str) -> None:
    """Make a table without rows readable, if there is none yet: no month has a file that tells its columns."""
    if not exists(df.sparkSession, path):
        df.limit(0).write.parquet(f"{path}/{NO_MONTH}")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append only rows whose keys the table does not hold: safe to repeat after a failure.

    If a key is a time the table is partitioned by month, and only the months of ``df`` are looked at.
    """
    month, fresh = month_of(df, keys), df.dropDuplicates(keys)
    if month is None:
        known = read_table(df.sparkSession, path)
        known = None if known is None else known.select(*keys)
    else:
        ends = df.agg(F.min(month).alias("lo"), F.max(month).alias("hi"), F.count(F.lit(1)).alias("n")).first()
        if not ends.n:
            leave_schema(df, path)
            return
        known = of_months(df.sparkSession, path, keys, ends.lo, ends.hi)
    if known is not None:
        fresh = fresh.join(known, keys, "left_anti")
    if month is None:
        append_table(fresh, path)
    else:
        # a month's rows together, in several tasks if they are many
        fresh.withColumn(MONTH, month).hint("rebalance", MONTH).write.mode("append").partitionBy(MONTH).parquet(path)


def ledger_entry(path: str, writer: str, batch: int) -> str:
    return f"{path.rstrip('/')}_ledger/{writer}/{batch}"


def committed(spark: SparkSession, path: str, writer: str, batch: int) -> bool:
    """Whether ``writer`` has appended this batch to the table."""
    return exists(spark, ledger_entry(path, writer, batch))


def commit(spark: SparkSession, path: str, writer: str, batch: int) -> None:
    """Note, after the append, that the batch is in the table: one empty file, whose name is all that is ever looked up."""
    entry = spark._jvm.org.apache.hadoop.fs.Path(ledger_entry(path, writer, batch))
    entry.getFileSystem(spark._jsc.hadoopConfiguration()).create(entry, True).close()


def append_batch(df: DataFrame, path: str, keys: list[str], writer: str, batch: int) -> None:
    """Append a numbered batch once: a batch in the ledger is recognised without reading the table, one that failed
    before its entry is appended again by ``append_new``."""
    spark = df.sparkSession
    if not committed(spark, path, writer, batch):
        append_new(df, path, keys)
        commit(spark, path, writer, batch)


def _digests(known: DataFrame, keys: list[str]) -> dict:
    """(rows, two sums of 64-bit hashes of their keys) by month: equal for equal sets of keys."""
    sums = [F.sum(F.xxhash64(F.lit(salt), *keys).cast("decimal(20,0)")) for salt in (1, 2)]
    return {r[0]: tuple(r[1:]) for r in known.groupBy(MONTH).agg(F.count(F.lit(1)), *sums).collect()}


def _known_keys(spark: SparkSession, paths: list[str], names: dict[str, str], keys: list[str], month: Column, lo, hi):
    """Keys that the tables hold from month ``lo`` to ``hi``, with a bit for each table in ``_known``, and rows by month. Months in
    which all tables hold the same keys are read from the first."""
    found = [(i, of_months(spark, path, [names[k] for k in keys], lo, hi)) for i, path in enumerate(paths)]
    tables = [(1 << i, df.toDF(*keys).withColumn(MONTH, month)) for i, df in found if df is not None]
    if not tables:
        return [], {}
    digests = [_digests(df, keys) for _, df in tables]
    sizes = {m: max(d[m][0] for d in digests if m in d) for d in digests for m in d}
    if len(tables) < len(paths):
        return [df.withColumn("_known", F.lit(bit)) for bit, df in tables], sizes
    same = [m for m in sizes if len({d.get(m) for d in digests}) == 1]
    in_all = F.coalesce(F.col(MONTH).isin([m for m in same if m is not None]), F.lit(None in same))
    every = sum(bit for bit, _ in tables)
    parts = [tables[0][1].withColumn("_known", F.when(in_all, every).otherwise(tables[0][0]))]
    if len(same) < len(sizes):
        parts += [df.where(~in_all).withColumn("_known", F.lit(bit)) for bit, df in tables[1:]]
    return parts, sizes


def _fresh(df: DataFrame, known: list[DataFrame], keys: list[str], month: Column, sizes: dict, tables: int) -> DataFrame:
    """One row for each of the keys of ``df`` that not every table holds, its table bits in ``_known``."""
    first = min((m.year * 12 + m.month for m in sizes if m is not None), default=0)
    pieces = {m.year * 12 + m.month - first: -(-n // CELL_ROWS) for m, n in sizes.items() if m is not None}
    of_month = F.lit([pieces.get(i, 1) for i in range(max(pieces, default=0) + 1)])
    at = F.year(MONTH) * 12 + F.month(MONTH) - first
    count = F.coalesce(F.get(of_month, at), F.lit(-(-sizes.get(None, 1) // CELL_ROWS)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), known,
                  df.withColumn(MONTH, month).withColumn("_known", F.lit(0)))
    met = rows.withColumn("_cell", F.pmod(F.xxhash64(*keys), count)).repartition(MONTH, "_cell")
    # firsts without regard to nulls: all of one row
    merged = met.groupBy(MONTH, "_cell", *keys).agg(
        F.bit_or("_known").alias("_bits"), F.min("_known").alias("_least"),
        *[F.expr(f"first(`{c}`) FILTER (WHERE _known = 0)").alias(c) for c in df.columns if c not in keys])
    return merged.where((F.col("_least") == 0) & (F.col("_bits") != (1 << tables) - 1)).withColumnRenamed(
        "_bits", "_known").select(*df.columns, MONTH, "_known")


def append_records(df: DataFrame, records: dict[str, dict[str, str]], keys: list[str], writer: str | None = None,
                   batch: int = 0) -> None:
    """Append the rows of ``df`` (library names) to several tables, to each under its own column names (path to names), without
    the rows whose ``keys``, a time among them, it holds. With ``writer``, a table whose ledger has the batch is left alone.

    The rows and the keys of all tables meet in one shuffle, by month and piece of a month, before they are spread over the
    columns of a record; what is new is stored once and written to each table from there.
    """
    spark = df.sparkSession
    paths = [p for p in records if writer is None or not committed(spark, p, writer, batch)]
    if not paths:
        return
    month = month_of(df, keys)
    sizes = {r[0]: r[1] for r in df.groupBy(month.alias(MONTH)).count().collect()}  # one row a month
    if sizes:
        ends = [m for m in sizes if m is not None]
        known, held = _known_keys(spark, paths, records[paths[0]], keys, month, min(ends, default=None),
                                  max(ends, default=None))
        sizes = {m: n + held.get(m, 0) for m, n in sizes.items()}
        fresh = stored(_fresh(df, known, keys, month, sizes, len(paths)), "fresh")
    for i, path in enumerate(paths):
        if sizes:
            # in order of months while rows are narrow, so that records need not be sorted to be written
            own = fresh.where(F.col("_known").bitwiseAND(F.lit(1 << i)) == 0).sortWithinPartitions(MONTH)
            filed(own, {**records[path], MONTH: MONTH}).write.mode("append").partitionBy(MONTH).parquet(path)
        leave_schema(filed(df, records[path]), path)
        if writer is not None:
            commit(spark, path, writer, batch)


def trade_records(legs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The short and the extended trade record of the same legs (library names in)."""
    names = schemas.TRADE_NAMES
    return filed(legs, names), filed(legs, {**names, **schemas.FEATURE_COLUMNS})


def write_trades(legs: DataFrame, short_path: str, long_path: str) -> None:
    short, extended = trade_records(legs)
    append_table(short, short_path)
    append_table(extended, long_path)


def read_mark(spark: SparkSession, path: str) -> int:
    """Stored progress mark; 0 if there is none or it is unreadable."""
    if not exists(spark, path):
        return 0
    row = spark.read.text(path).agg(
        F.max(F.trim("value").try_cast("bigint")).alias("mark")).first()
    return row.mark or 0


def write_mark(spark: SparkSession, path: str, mark: int) -> None:
    """Persist the mark if it advanced, beside the older ones: a crash leaves the last mark as it is."""
    if mark > read_mark(spark, path):
        spark.range(1).select(F.lit(str(mark)).alias("value")).coalesce(1).write.mode(
            "append").text(path)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """Progress by symbol (symbol, mark_ms) as of the newest complete version; none at first."""
    versions = mark_versions(spark, path)
    if not versions:
        return spark.createDataFrame([], "symbol string, mark_ms bigint")
    return spark.read.schema("symbol string, mark_ms bigint").parquet(f"{path}/version={versions[-1]}")


def mark_versions(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, path):
        return []
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    found = sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))
    return [v for v in found if exists(spark, f"{path}/version={v}/_SUCCESS")]


def write_marks(spark: SparkSession, path: str, marks: DataFrame) -> None:
    """Take in newer marks (symbol, mark_ms): a new version of one row per symbol, which readers see when it is complete. A
    mark never goes back."""
    versions = mark_versions(spark, path)
    every = read_marks(spark, path).unionByName(marks.select("symbol", F.col("mark_ms").cast("bigint")))
    every.groupBy("symbol").agg(F.max("mark_ms").alias("mark_ms")).write.mode("overwrite").parquet(
        f"{path}/version={versions[-1] + 1 if versions else 0}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """Stored model; None if there is none or it cannot be read."""
    if not exists(spark, path):
        return None
    try:
        return PipelineModel.load(path)
    except Exception:  # an unreadable model counts as no model
        return None
