"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target over its size is the number of copies expected of each of its documents. The
documents of a source stand in a fixed order; the expected copies are summed along it, one random
offset per source is added, and a document is taken once for each integer that its step crosses.
The order goes by size class first, so every stretch of sizes is sampled at the source's rate and
the words taken stay close to the target.

The running sum is made in two levels, so that a source with a third of all rows is no task of
its own: counts per (source, size class, hash prefix) give each such bucket its offset, and rows
are numbered inside their bucket only. The prefix gets longer with the table.

Cases: a null text or size counts 0; a null source is a source of its own, last in order; rows of
equal id are told apart by size and text hash, and rows equal in all of it are interchangeable; an
empty table gives an empty result; other columns are carried along unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.session import stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BUCKET_ROWS = 2048
SEED = "mix-1"


def size_class(size: Column) -> Column:
    """Order-preserving class of a size: its bit length and its leading four bits."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 4))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   cap: float = CAP) -> DataFrame:
    """Rows (source, source_size), one per source, with ``target`` added.

    Weights repeat over the sources in code-point order. A target is the lesser of ``cap`` times
    the source and level x weight; with sources sorted by cap over weight the capped ones come
    first, and the level is the largest that any split into capped and uncapped gives.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("_w", F.element_at(
        cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("_limit", F.col("source_size").cast("double") * cap)
    before = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double") * share
    level = (total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    out = out.withColumn("_level", level)
    return out.withColumn(
        "target", F.least("_limit", F.max("_level").over(every) * F.col("_w"))
    ).drop("_w", "_limit", "_level")


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
        text_hash: Column | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
        seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs`` with a struct column ``_mix`` (size, source_size, target, copies), in place of any of that name."""
    name = F.col(source_col)
    keys = {
        "_mix_size": F.coalesce(size.cast("long"), F.lit(0)),
        "_mix_src": F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), name)),
        "_mix_order": F.md5(F.concat_ws(
            "|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))),
        "_mix_tie": F.xxhash64(text_hash if text_hash is not None else F.lit(0)),
    }
    carried = [c for c in docs.columns if c.lower() != "_mix"]
    keyed = docs.select(F.struct(*carried).alias("_mix_doc"), F.col(id_col).alias("_mix_id"), name.alias("_mix_source"),
                        *[v.alias(k) for k, v in keys.items()])
    classed = stored(keyed.select(
        F.col("_mix_source").alias("source"), "_mix_src", "_mix_size",
        size_class(F.col("_mix_size")).alias("_mix_class"), F.substring("_mix_order", 1, 8)
        .alias("_mix_prefix")), "mix-keys")
    sizes = classed.groupBy("source", "_mix_src").agg(
        F.sum("_mix_size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    targets = stored(source_targets(sizes, weights, share, cap), "mix-targets")
    rows = targets.agg(F.sum("_n")).first()[0] or 0
    digits = min(8, max(1, math.ceil(math.log(max(rows / 16 / bucket_rows, 1), 16))))

    bucket = ["_mix_src", "_mix_class", "_mix_bucket"]
    along = Window.partitionBy("_mix_src").orderBy("_mix_class", "_mix_bucket")
    offsets = (
        classed.withColumn("_mix_bucket", F.substring("_mix_prefix", 1, digits))
        .groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_mix_before", F.sum("_n").over(along) - F.col("_n")).drop("_n")
        .join(targets.select("_mix_src", F.col("source_size").alias("_mix_total"),
                             F.col("target").alias("_mix_target")), "_mix_src")
    )
    within = Window.partitionBy(*bucket).orderBy(
        "_mix_order", "_mix_id", "_mix_size", "_mix_tie")
    rank = F.col("_mix_before") + F.row_number().over(within)
    rate = F.when(F.col("_mix_total") > 0, F.col("_mix_target") / F.col("_mix_total")).otherwise(
        F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("_mix_source", F.lit("")))),
                                1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (
        keyed.withColumn("_mix_class", size_class(F.col("_mix_size")))
        .withColumn("_mix_bucket", F.substring("_mix_order", 1, digits))
        .join(offsets, bucket)
        .withColumn("_mix_rank", rank).withColumn("_mix_rate", rate)
        .withColumn("_mix_copies", F.least(F.lit(math.ceil(cap)), (
            F.floor(F.col("_mix_rank") * F.col("_mix_rate") + offset)
            - F.floor((F.col("_mix_rank") - 1) * F.col("_mix_rate") + offset))))
        .select("_mix_doc.*", F.struct(
            F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"),
            F.col("_mix_target").alias("target"), F.col("_mix_copies").cast("long")
            .alias("copies")).alias("_mix"))
    )


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy taken, with the columns that went in."""
    keep = [c for c in mixed.columns if c != "_mix"]
    return mixed.where(F.col("_mix.copies") > 0).select(
        F.struct(*keep).alias("row"), F.explode(F.sequence(F.lit(1), F.col("_mix.copies").cast("int")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE
            AS w, CAST(source_size AS DOUBLE) * 2.0 AS lim FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(lim) OVER b, 0.0))
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS lev
  FROM w WINDOW b AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(lim, max(lev) OVER () * w) AS target,
         CAST('0x' || substr(md5('mix-1|' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM l),
r AS (
  SELECT d.*, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY lpad(CAST(length(bin(d.size)) AS VARCHAR), 2, '0')
           || substr(bin(d.size), 1, 4), md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), '')),
           d.doc_id, d.size) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) AS taken
FROM r
"""


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    from barflow.llm.common import table, word_count

    docs = stored(table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count("text").alias("n"), F.xxhash64("text").alias("h")),
        "mix-sizes")
    return mix(docs, F.col("n"), text_hash=F.col("h")).select(
        "doc_id", "_mix.size", "_mix.source_size", "_mix.target",
        (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"))
