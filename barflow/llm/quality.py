"""Quality rules: text measures, and cross-document line frequency.

Each whole text is measured once, with its normalised lines (lower case, single spaces) as 64-bit
hashes and their word counts; the measured rows are written and everything after works on them
without the texts. A line's frequency on a host is the number of different texts of the host that
hold it, so exact copies count once and are judged alike. A line is over its limit when that number
is above ``LINE_TEXTS``, however large the host is; it is then removed from all
texts of the host but the first (by least document id) that holds it. A text is depleted, and
rejected, when what is left of its words is below a share, or too short a text of which most is gone.

The counts combine before their shuffle, and keys hold the line, so neither a hot host nor a line of a
third of all documents is one task. The removal joins only lines over their limit.

Repeated 8-word windows are found exactly: words are numbered, then pairs, fours and eights of
neighbouring numbers are numbered by sorting, so equal numbers mean equal windows.

Cases: a null text has no words and fails; a null host is a host of its own; lines without a word are
never removed; repeated rows are judged alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import encoded, slices, table
from barflow.session import stored

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: A line is over its limit above this many different texts of a host.
LINE_TEXTS = 10
#: A text is depleted if less than KEPT_SHARE of its words is left, or less than HALF_SHARE and
#: fewer than MIN_WORDS words.
KEPT_SHARE = 0.2
HALF_SHARE = 0.5

MEASURES = ("row bigint, {id}, host string, text_hash bigint, n_words bigint, word_chars bigint, "
            "n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "lines array<struct<line:bigint,words:int>>")


def host_of(col: str) -> Column:
    """A host as a key without nulls."""
    return F.when(F.col(col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(col)))


def repeat_words(numbers, docs, n_docs: int, window: int = WINDOW):
    """Per document, the words in ``window``-word windows found twice or more in it.

    ``numbers``: word numbers of all documents one after another; ``docs``: their documents.
    """
    import numpy as np

    out = np.zeros(n_docs, np.int64)
    size = len(numbers)
    if size <= window:
        return out
    key = np.unique(docs * (numbers.max() + 1) + numbers, return_inverse=True)[1]
    width = 1
    while width < window:  # 8 words: three doublings
        pair = key[:-width] * (key.max() + 1) + key[width:]
        key = np.unique(pair, return_inverse=True)[1]
        width *= 2
    whole = docs[:len(key)] == docs[window - 1:]
    starts = np.flatnonzero(whole)
    counts = np.bincount(key[starts])
    again = starts[counts[key[starts]] > 1]
    if len(again):
        edge = np.zeros(size + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + window, -1)
        inside = np.cumsum(edge[:-1]) > 0
        out += np.bincount(docs[inside], minlength=n_docs)
    return out


def line_stats(raw: bytes) -> tuple[int, list[dict]]:
    """Lines with a word that equal an earlier one, and each different normalised line's hash
    with the words it holds in the text."""
    from xxhash import xxh64_intdigest

    seen: set[bytes] = set()
    again = 0
    held: dict[bytes, int] = {}
    for line in raw.split(b"\n"):
        words = line.split()
        if not words:
            continue
        if line in seen:
            again += 1
        else:
            seen.add(line)
        key = b" ".join(words).lower()
        held[key] = held.get(key, 0) + len(words)
    return again, [{"line": xxh64_intdigest(k) - (1 << 63), "words": n} for k, n in held.items()]


def measure(docs: DataFrame, text_col: str = "text", host_col: str = "source",
            id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its measures and lines (see ``MEASURES``)."""
    kind = f"id {docs.schema[id_col].dataType.simpleString()}"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 512):
            texts = encoded(batch.column(3))
            split = [t.split() for t in texts]
            sizes = np.array([len(w) for w in split], np.int64)
            numbers: dict[bytes, int] = {}
            flat = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in split for w in ws),
                               np.int64, int(sizes.sum()))
            repeats = repeat_words(flat, np.repeat(np.arange(len(texts)), sizes), len(texts))
            chars, symbols, dups, lines = [], [], [], []
            for t, ws in zip(texts, split, strict=True):
                joined = b"".join(ws)
                chars.append(len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace")))
                symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
                again, held = line_stats(t)
                dups.append(again)
                lines.append(held)
            whole = pa.int64()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(2),
                batch.column(4), pa.array(sizes, whole), pa.array(chars, whole), pa.array(symbols, whole),
                pa.array(dups, whole), pa.array(repeats, whole),
                pa.array(lines, pa.list_(pa.struct([("line", whole), ("words", pa.int32())])))],
                names=["row", "id", "host", "text_hash", "n_words", "word_chars", "n_symbols",
                       "n_dup_lines", "n_repeat_words", "lines"])

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        host_of(host_col).alias("host"), F.col(text_col).alias("text"),
        F.xxhash64(text_col).alias("text_hash"),
    ).mapInArrow(run, MEASURES.format(id=kind))


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` (a written table) without its lines, with base_failed, removed_words, kept."""
    held = measured.select("row", "id", "host", "text_hash", F.explode("lines").alias("l")).select(
        "row", "id", "host", "text_hash", "l.line", "l.words")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"),
                     F.col("text_hash").alias("text_hash"))
    counts = (
        held.groupBy("host", "line", "text_hash").agg(F.min("id").alias("id"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
        .where(F.col("n") > LINE_TEXTS)
    )
    over = counts.select("host", "line", F.col("first.text_hash").alias("first_hash"))
    removed = (
        held.join(over, ["host", "line"]).where("text_hash <> first_hash")
        .groupBy("row").agg(F.sum("words").alias("removed_words"))
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < F.col("n_words") * KEPT_SHARE) | (
        (left < F.col("n_words") * HALF_SHARE) & (left < MIN_WORDS))
    return (
        measured.drop("lines", "text_hash", "host").join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~depleted)
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source",
              id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.

    A row meets its verdict by text, host and id, of which equal rows have one verdict.
    """
    measured = stored(measure(docs, text_col, host_col, id_col), "quality")
    verdict = judge(measured).where("kept").select("row")
    good = measured.join(verdict, "row", "left_semi").select(
        F.col("id").alias("_id"), F.col("host").alias("_host"),
        F.col("text_hash").alias("_hash")).distinct()
    docs_key = (F.col(id_col).eqNullSafe(good["_id"]) & (host_of(host_col) == good["_host"])
                & (F.xxhash64(text_col) == good["_hash"]))
    return docs.join(good, docs_key, "left_semi")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
g AS (
  SELECT r, pos, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o,
                  lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o] AS win,
         lead(w, 7) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY pos)),
t AS (SELECT r, pos, count(*) OVER (PARTITION BY r, win) > 1 AS twice FROM g WHERE whole),
cov AS (
  SELECT g.r, g.pos, coalesce(max(CASE WHEN twice THEN 1 ELSE 0 END) OVER (
           PARTITION BY g.r ORDER BY g.pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 0) AS inside
  FROM g LEFT JOIN t USING (r, pos)),
rep AS (SELECT r, CAST(sum(inside) AS BIGINT) AS n FROM cov GROUP BY r),
l AS (SELECT r, source, text, doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lws FROM l),
lk AS (SELECT r, source, text, doc_id, line, len(lws) AS n,
              translate(array_to_string(lws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
       FROM lw WHERE len(lws) > 0),
dup AS (SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM lk GROUP BY r),
tx AS (SELECT source, text, min(doc_id) AS id FROM lk GROUP BY 1, 2),
cnt AS (SELECT source, key, count(DISTINCT text) AS n, min(doc_id) AS first_id FROM lk GROUP BY 1, 2),
over_ AS (SELECT source, key, first_id FROM cnt WHERE n > 10),
rem AS (
  SELECT lk.r, CAST(sum(lk.n) AS BIGINT) AS n FROM lk
  JOIN over_ o ON o.key = lk.key AND o.source IS NOT DISTINCT FROM lk.source
  JOIN tx ON tx.text = lk.text AND tx.source IS NOT DISTINCT FROM lk.source
  WHERE tx.id <> o.first_id GROUP BY lk.r),
m AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(rem.n, 0) AS removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN rem USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - removed_words AS lft FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed,
       NOT base_failed AND NOT (lft < n_words * CAST(0.2 AS DOUBLE)
         OR (lft < n_words * CAST(0.5 AS DOUBLE) AND lft < 20)) AS kept
FROM f
"""


def op3_quality(spark, sf_dir: str) -> DataFrame:
    measured = stored(measure(table(spark, sf_dir, "documents").select("doc_id", "text", "source")),
                      "quality")
    return judge(measured).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "removed_words")
