"""Line dedup by site-relative frequency.

A line is boilerplate of its host if the share of the host's pages that contain it is above a
ratio. Such lines go from every page of the host; all others stay, in order.

Lines are compared by the hash of their text without outer ASCII white space; a line without text is
never boilerplate. Each page sends each of its different lines once, so that counting needs one
shuffle, combined before it. A host has at most (mean different lines per page) / ratio
boilerplate lines, whatever its number of pages. These lists are written, so the planner knows their size: below
its limit they are broadcast and the pages are not moved, above it the join's large hosts are split.

Cases: a null text has no lines and stays null; a null host is a host of its own; repeated rows are
pages of their own; a text left without lines becomes empty; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import table
from barflow.session import stored

#: Share of a host's pages, and least number of pages, above which a line is boilerplate.
RATIO = 0.1
MIN_PAGES = 3


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit("\t\n\x0b\x0c\r ")))


def _host(col: str) -> Column:
    return F.when(F.col(col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(col)))


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host (``_host``) the keys of its boilerplate lines, as a sorted array ``_gone``."""
    blank = line_key(F.lit(""))
    pages = docs.select(_host(host_col).alias("_host"), F.col(text_col).alias("_text"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    counts = (
        pages.select("_host", F.explode(F.array_distinct(
            F.transform(F.split("_text", "\n"), line_key))).alias("_line"))
        .where(F.col("_line") != blank)
        .groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_pages)
    )
    return (
        counts.join(totals, "_host")
        .where(F.col("_n") > F.col("_pages") * F.lit(ratio))
        .groupBy("_host").agg(F.array_sort(F.collect_list("_line")).alias("_gone"))
    )


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                     ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the boilerplate lines of their hosts taken out of ``text_col``; a struct
    ``_lines`` (total, removed) is added, in place of any column of that name."""
    gone = stored(boilerplate(docs, text_col, host_col, ratio, min_pages), "boilerplate")
    field, carried = F.col("_doc").getField, [c for c in docs.columns if c.lower() != "_lines"]
    keep = F.filter(F.col("_all"), lambda x: ~F.array_contains(F.col("_gone"), line_key(x)))
    rest = F.when(F.col("_gone").isNull(), F.col("_all")).otherwise(keep)
    return (
        docs.select(F.struct(*docs.columns).alias("_doc"), _host(host_col).alias("_host"),
                    F.split(F.col(text_col), "\n").alias("_all"))
        .join(gone, "_host", "left").withColumn("_rest", rest)
        .select(*[F.when(F.size("_rest") == F.size("_all"), field(text_col))
                  .otherwise(F.array_join("_rest", "\n")).alias(c) if c == text_col else field(c).alias(c)
                  for c in carried],
                F.struct(F.coalesce(F.size("_all"), F.lit(0)).alias("total"),
                         F.coalesce(F.size("_all") - F.size("_rest"), F.lit(0)).alias("removed"))
                .alias("_lines"))
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT r, doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS key FROM x),
c AS (SELECT source, key, count(DISTINCT r) AS n FROM k WHERE key <> '' GROUP BY 1, 2),
h AS (SELECT source, count(*) AS pages FROM d GROUP BY 1),
g AS (SELECT c.source, c.key FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source
      WHERE n >= 3 AND n > pages * CAST(0.1 AS DOUBLE)),
a AS (SELECT k.*, g.key IS NOT NULL AS gone FROM k LEFT JOIN g
      ON k.key = g.key AND k.source IS NOT DISTINCT FROM g.source),
o AS (SELECT r, CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (gone) AS INT) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM a GROUP BY r)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed, o.t AS text
FROM d LEFT JOIN o USING (r)
"""


def op10_site_lines(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs).select(
        "doc_id", F.col("_lines.total").alias("n_lines"),
        F.col("_lines.removed").alias("n_removed"), "text")
