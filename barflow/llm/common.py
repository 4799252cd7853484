"""Words, digests and batches shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (space, tab, LF, VT, FF, CR).
SPACE = r"[\x09-\x0D\x20]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Number of words; 0 for null. A text that starts or ends with white space gives empty ends."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parts = F.split(col, SPACE)
    ends = ((F.element_at(parts, 1) == "").cast("long")
            + ((F.element_at(parts, -1) == "") & (F.size(parts) > 1)).cast("long"))
    return F.size(parts).cast("long") - ends


def unit_hash(col: Column) -> Column:
    """A number in [0, 1) from the MD5 of a string: the same in every engine and every run."""
    return F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def slices(batches: Iterator, size: int = 1024) -> Iterator:
    """Arrow batches cut to at most ``size`` rows, so that a worker holds few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def encoded(values) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null as empty."""
    import pyarrow as pa

    return [v or b"" for v in values.cast(pa.binary()).to_pylist()]
