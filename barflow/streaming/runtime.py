"""Starting streams, and sinks that survive a repeated batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow import schemas
from barflow.session import scratch_path
from barflow.sources import sinks

# Seconds between passes of the signal cycle, the position monitor and the wallet scan.
CADENCE_S = {"signals": 15, "positions": 2, "wallet": 1800}


def cadence(name: str) -> dict:
    """Trigger argument of a continuous run: ``stream.writeStream.trigger(**cadence("signals"))``."""
    return {"processingTime": f"{CADENCE_S[name]} seconds"}


def read_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None,
                files_per_batch: int = 16) -> DataFrame:
    """Parquet files as a stream, a bounded number of them per micro-batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def in_time_order(df: DataFrame, name: str, ts: str = "ts", files: int = 8) -> str:
    """Folder with the rows of ``df`` in ``files`` parts of time after time, which a stream reads in that order.

    Streams take files by their time of change, so the parts get ascending ones; a file system that does not keep
    them is refused.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.repartitionByRange(files, ts).sortWithinPartitions(ts).write.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    start = int(time.time() * 1000) - 1000 * len(parts)
    for i, part in enumerate(parts):
        fs.setTimes(part, start + 1000 * i, -1)
    changed = [fs.getFileStatus(p).getModificationTime() for p in parts]
    if any(b <= a for a, b in zip(changed, changed[1:])):
        raise RuntimeError(f"{path}: the file system keeps no times of change, give the stream a delay instead")
    return path


def disorder(spark: SparkSession, folder: str, ts: str = "ts") -> float:
    """Seconds of ``delay`` with which a stream of ``folder`` keeps every row, whatever the number of files in a batch: what
    a file's rows may be older than rows of files read before it, and a millisecond."""
    files = spark.read.parquet(folder).groupBy(F.col("_metadata.file_modification_time").alias("changed"),
                                               F.col("_metadata.file_path").alias("file")).agg(
        F.min(F.unix_micros(ts)).alias("lo"), F.max(F.unix_micros(ts)).alias("hi"))
    # files changed at the same time may come in any order
    steps = files.where("hi IS NOT NULL").groupBy("changed").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("changed")
    newest, most = None, 0
    for r in steps.collect():  # one row for each time of change
        before = max(x for x in (newest, r["hi"] if r["n"] > 1 else None, r["lo"]) if x is not None)
        most, newest = max(most, before - r["lo"]), max(x for x in (newest, r["hi"]) if x is not None)
    return (most // 1000 + 1) / 1e3


def append_batches(path: str, keys: list[str], writer: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: a batch that is delivered again adds nothing. With ``writer``, a name of the stream that
    stays the same when it is restarted from its checkpoint, such a batch is not even compared."""

    def write(batch: DataFrame, number: int) -> None:
        if writer is None:
            sinks.append_new(batch, path, keys)
        else:
            sinks.append_batch(batch, path, keys, writer, number)

    return write


def trade_batches(short_path: str, long_path: str, keys: list[str], writer: str | None = None) -> Callable:
    """``foreachBatch`` sink for both trade records of each batch of legs (``keys`` by their stored names, a time among
    them), which are compared with both tables at once."""
    of = {stored_name: name for name, stored_name in schemas.TRADE_NAMES.items()}
    records = {short_path: schemas.TRADE_NAMES, long_path: {**schemas.TRADE_NAMES, **schemas.FEATURE_COLUMNS}}

    def write(batch: DataFrame, number: int) -> None:
        sinks.append_records(batch, records, [of[k] for k in keys], writer, number)

    return write


def reconcile_batches(scan: Callable[[], DataFrame], path: str) -> Callable:
    """``foreachBatch`` sink that runs the wallet reconciliation once per trigger, and only when
    the trigger brought tickers."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            scan().write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def drain(stream: DataFrame, name: str, mode: str = "append",
          checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Process everything available, then stop; result as a table on shared storage."""
    spark = stream.sparkSession
    target = target or scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", target)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)
