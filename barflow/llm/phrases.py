"""Phrase collocations by Rabin-Karp fingerprints of every n-gram.

Texts are written once in a plain form: lower case, one space between the words of a piece, one line for
each piece, each row with a number. A pass for each length n reads it in blocks; with prefix sums of a
polynomial over a block's bytes, the fingerprint of every n-gram is one subtraction and one product. The
shuffle adds up how often each fingerprint occurs. An n-gram can only be frequent if both its
(n-1)-grams are, so the fingerprints of frequent ones are kept as a bit table of fixed size (2^FILTER_BITS
bits), which the next pass reads; where the table fills up it lets more through, and results stay the same.

Fingerprints may collide, so these counts only say which n-grams may be frequent. A last pass picks up the
n-grams whose fingerprints are. Within a block the bytes of all that share a fingerprint are compared; each different
text goes to the shuffle as its fingerprint, a digest of the text, a count and a pointer (row and word) to an
occurrence. Texts of equal fingerprints are thus counted apart, and only the pointers of frequent ones are followed to make
strings of them.

Scores are exact: products are decimals of 38 digits. A phrase's parts are at least as frequent as it is, so
all counts that scores need are there.

No key is the language alone: counts are by phrase, and the rank limit runs in every task before its shuffle.

Cases: a null or empty text has no words; a null language is ``und``; repeated rows count each; a language
without phrases gives no rows; an empty table gives an empty result; other columns are ignored. A long text is cut between pieces, so a block
holds ``BLOCK_BYTES``, or one piece that is longer.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.llm.common import slices, table
from barflow.session import stored

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
#: Bits of the tables of frequent fingerprints: 16 MB each.
FILTER_BITS = 27
#: Bits of such a table that one task fills.
SEGMENT_BITS = 20
BLOCK_BYTES = 1 << 19
#: Odd base of the polynomial, modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE, LINE = 32, 10
UNKNOWN = "und"
#: Phrases up to this many bytes are compared column by column, longer ones one by one.
LONG_PHRASE = 64

PLAIN = "row long, lang string, words long, body binary"


# --- plain form --------------------------------------------------------------------------------------


@functools.cache
def byte_map():
    """Each byte's plain form: letters A-Z in lower case, blanks as SPACE, ends of pieces as LINE."""
    import numpy as np

    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[[9, 32]] = SPACE
    out[[10, 11, 12, 13, *b".,;:!?"]] = LINE
    return out


def plain_bodies(data, ends):
    """Plain form of texts that lie one after another in ``data`` up to their ``ends``.

    Returns bytes, their ends and the words of each text. A word is followed by one byte, LINE at the end of a piece
    or text and SPACE elsewhere."""
    import numpy as np

    n = len(ends)
    # one LINE after each text keeps texts apart
    at = ends + np.arange(n)
    b = np.full(len(data) + n, LINE, np.uint8)
    keep = np.ones(len(b), bool)
    keep[at] = False
    b[keep] = byte_map()[data]
    gap = (b == SPACE) | (b == LINE)
    first = np.flatnonzero(gap & ~np.concatenate([[True], gap[:-1]]))  # first gap after each word
    lines = np.concatenate([[0], np.cumsum(b == LINE)])
    word_from = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    until = np.append(word_from[1:], len(b))
    b[first] = np.where(lines[until] > lines[first], LINE, SPACE)
    kept = ~gap
    kept[first] = True
    words = np.diff(np.searchsorted(first, at, side="right"), prepend=0)
    return b[kept], np.cumsum(kept)[at], words


def column_bytes(column):
    """Bytes and ends of an Arrow string or binary column; null as empty."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, bounds[1:] - bounds[0]


def byte_slices(batches: Iterator, column: int, rows: int = 2048, size: int = 1 << 21) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows and about ``size`` bytes of a column, or one row that is longer."""
    import numpy as np

    for batch in slices(batches, rows):
        before = np.concatenate([[0], column_bytes(batch.column(column))[1]])
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(before, before[start] + size, side="right")) - 1, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def binary_column(data, ends):
    import numpy as np
    import pyarrow as pa

    bounds = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [
        None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def plain(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of PLAIN, one for each row of ``docs``."""
    def run(batches):
        import pyarrow as pa

        for batch in byte_slices(batches, 2, size=BLOCK_BYTES):
            body, ends, words = plain_bodies(*column_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words, pa.int64()), binary_column(body, ends)],
                names=["row", "lang", "words", "body"])

    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"),
        F.col(text_col).alias("text")).mapInArrow(run, PLAIN)


# --- fingerprints ------------------------------------------------------------------------------------


def powers(base: int, size: int, known: dict = {}):  # noqa: B006 - tables kept by a worker
    import numpy as np

    if len(known.get(base, ())) < size:
        steps = np.full(max(size, 1 << 16), base, np.uint64)
        steps[0] = 1
        known[base] = np.cumprod(steps)
    return known[base][:size]


def mixed(x):
    """A bijection of 64-bit numbers whose high bits depend on all bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Block:
    """Words of texts that lie one after another, in languages of their own."""

    def __init__(self, body, word_lang, word_row, word_no, key_bits: int = 64):
        import numpy as np

        self.body, self.lang, self.row, self.number = body, word_lang, word_row, word_no
        self.end = np.flatnonzero((body == SPACE) | (body == LINE))
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        self.lines = np.concatenate([[0], np.cumsum(body[self.end] == LINE)])
        self.shift = np.uint64(64 - key_bits)
        # a zero byte counts too
        terms = (body.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(body))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        self.back = powers(INVERSE, len(body))

    def grams(self, n: int):
        """Words at which an n-gram of one piece starts."""
        import numpy as np

        size = len(self.end) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.lines[n - 1:n - 1 + size] == self.lines[:size])

    def keys(self, at, n: int):
        """Fingerprints, by language, of the n-grams that start at words ``at``."""
        start, end = self.start[at], self.end[at + n - 1]
        hashed = (self.sums[end] - self.sums[start]) * self.back[start]
        return mixed(hashed ^ self.lang[at]) >> self.shift

    def candidates(self, n: int, tables: dict):
        """Starts and keys of n-grams that may be frequent by what is known of their parts."""
        import numpy as np

        at = self.grams(n)
        if n > 1 and n - 1 in tables:
            shorter = self.grams(n - 1)
            good = shorter[listed(tables[n - 1], self.keys(shorter, n - 1))]
            mark = np.zeros(len(self.end) + 1, bool)
            mark[good] = True
            at = at[mark[at] & mark[at + 1]]
        return at, self.keys(at, n)

    def text(self, at: int, n: int) -> bytes:
        return self.body[self.start[at]:self.end[at + n - 1]].tobytes()

    def same_text(self, at, other, n: int):
        """Whether the n-grams at words ``at`` and ``other`` are equal byte by byte, and of one language."""
        import numpy as np

        a, b = self.start[at], self.start[other]
        size = self.end[at + n - 1] - a
        same = (size == self.end[other + n - 1] - b) & (self.lang[at] == self.lang[other])
        long = np.flatnonzero(same & (size > LONG_PHRASE))
        for i in long:
            same[i] = self.text(at[i], n) == self.text(other[i], n)
        left = np.flatnonzero(same & (size <= LONG_PHRASE))
        for j in range(int(size[left].max(initial=0))):
            left = left[size[left] > j]
            differ = self.body[a[left] + j] != self.body[b[left] + j]
            if differ.any():
                same[left[differ]] = False
                left = left[~differ]
        return same


def listed(bits, keys):
    """Which keys the table has."""
    import numpy as np

    slot = (keys & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 != 0


def blocks(batches: Iterator, key_bits: int = 64, size: int = BLOCK_BYTES) -> Iterator:
    """Blocks of plain rows of at most ``size`` bytes, cut between pieces."""
    import numpy as np
    from xxhash import xxh64_intdigest

    for batch in byte_slices(batches, 3):
        body, ends = column_bytes(batch.column(3))
        if not len(body):
            continue
        langs = [xxh64_intdigest(x.encode(), 11) for x in batch.column(1).to_pylist()]
        rows = batch.column(0).to_numpy()
        gaps = np.flatnonzero((body == SPACE) | (body == LINE))
        doc = np.searchsorted(ends, gaps, side="right")
        number = np.arange(len(gaps)) - np.searchsorted(doc, doc, side="left")
        lang, row = np.array(langs, np.uint64)[doc], rows[doc]
        lines = np.flatnonzero(body == LINE) + 1
        start = 0
        while start < len(body):
            cut = np.searchsorted(lines, start + size, side="right") - 1
            stop = int(lines[cut]) if cut >= 0 and lines[cut] > start else int(
                lines[np.searchsorted(lines, start, side="right")])
            words = slice(*np.searchsorted(gaps, [start, stop]))
            yield Block(body[start:stop], lang[words], row[words], number[words], key_bits)
            start = stop


def signed(keys):
    import numpy as np

    return keys.view(np.int64)


def counted(rows: DataFrame, n: int, tables, filter_bits: int = FILTER_BITS, key_bits: int = 64) -> DataFrame:
    """Rows (key, count): for each block the different fingerprints of its n-grams that may be frequent."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = unpacked(tables.value, filter_bits)
        for block in blocks(batches, key_bits):
            keys, count = np.unique(block.candidates(n, known)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(keys)), pa.array(count.astype(np.int64))], names=["key", "count"])

    return rows.mapInArrow(run, "key long, count long")


def frequent(rows: DataFrame, n: int, tables, min_count: int, filter_bits: int = FILTER_BITS,
             key_bits: int = 64) -> DataFrame:
    """Fingerprints that n-grams share ``min_count`` times or more."""
    return counted(rows, n, tables, filter_bits, key_bits).groupBy("key").agg(F.sum("count").alias("count")).where(
        F.col("count") >= min_count)


def bit_table(found: DataFrame, bits: int = FILTER_BITS) -> dict[int, bytes]:
    """The fingerprints of ``found`` as a table of 2^bits bits, whatever their number: its segments that have any,
    compressed."""
    segment_bits = min(SEGMENT_BITS, bits)

    def packed(key, frame):
        import zlib

        import numpy as np
        import pandas as pd

        flags = np.zeros(1 << segment_bits, np.uint8)
        flags[frame["slot"].to_numpy()] = 1
        return pd.DataFrame({"segment": [key[0]], "part": [
            zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1)]})

    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    parts = found.select(F.shiftright(slot, segment_bits).alias("segment"), slot.bitwiseAND(
        F.lit((1 << segment_bits) - 1)).alias("slot")).distinct().groupBy("segment").applyInPandas(
        packed, "segment long, part binary")
    return {r["segment"]: bytes(r["part"]) for r in parts.collect()}  # at most 2^bits bits


def unpacked(tables: dict[int, dict[int, bytes]], bits: int) -> dict:
    """Bit tables by length, as bytes in memory."""
    import zlib

    import numpy as np

    width, out = 1 << (min(SEGMENT_BITS, bits) - 3), {}
    for n, parts in tables.items():
        out[n] = np.zeros(1 << (bits - 3), np.uint8)
        for segment, part in parts.items():
            out[n][segment * width:(segment + 1) * width] = np.frombuffer(zlib.decompress(part), np.uint8)
    return out


# --- texts and scores --------------------------------------------------------------------------------

#: A fingerprint, the digest of the text that has it, and a pointer (row, word) to one such n-gram.
PLACES = "key long, high long, low long, words int, count long, row long, word long"


def places(rows: DataFrame, tables, max_words: int, filter_bits: int = FILTER_BITS, key_bits: int = 64) -> DataFrame:
    """Rows of PLACES for each block: the n-grams with listed fingerprints, compared byte by byte, so that one row counts
    one text."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_intdigest

        known = unpacked(tables.value, filter_bits)
        for block in blocks(batches, key_bits):
            for n in range(1, max_words + 1):
                at, keys = block.candidates(n, known)
                good = listed(known[n], keys)
                at, keys = at[good], keys[good]
                _, first, group = np.unique(keys, return_index=True, return_inverse=True)
                same = block.same_text(at, at[first][group], n)
                count = np.bincount(group[same], minlength=len(first))
                # fingerprints that collide count one by one
                at = np.concatenate([at[first], at[~same]])
                keys = np.concatenate([keys[first], keys[~same]])
                count = np.concatenate([count, np.ones(int((~same).sum()), count.dtype)])
                digest = [xxh3_128_intdigest(block.text(a, n), int(block.lang[a])) for a in at]
                high = np.array([d >> 64 for d in digest], np.uint64)
                low = np.array([d & (1 << 64) - 1 for d in digest], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(keys)), pa.array(signed(high)), pa.array(signed(low)),
                     pa.array(np.full(len(at), n, np.int32)), pa.array(count.astype(np.int64)), pa.array(block.row[at]),
                     pa.array(block.number[at].astype(np.int64))],
                    names=["key", "high", "low", "words", "count", "row", "word"])

    return rows.mapInArrow(run, PLACES)


def spelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (lang, phrase, words, count): the texts that the pointers of ``found`` lead to."""
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 64):
            out = {"lang": [], "phrase": [], "words": [], "count": []}
            for lang, body, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = body.replace(b"\n", b" ").split(b" ")
                for w in wanted:
                    out["lang"].append(lang)
                    out["phrase"].append(b" ".join(words[w["word"]:w["word"] + w["words"]]).decode("utf-8", "replace"))
                    out["words"].append(w["words"])
                    out["count"].append(w["count"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["lang"], pa.string()), pa.array(out["phrase"], pa.string()),
                 pa.array(out["words"], pa.int32()), pa.array(out["count"], pa.int64())], names=list(out))

    wanted = found.groupBy("row").agg(F.collect_list(F.struct("word", "words", "count")).alias("wanted"))
    return rows.select("row", "lang", "body").join(wanted, "row").select("lang", "body", "wanted").mapInArrow(
        run, "lang string, phrase string, words int, count long")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS,
            min_count: int = MIN_COUNT, filter_bits: int = FILTER_BITS,
            key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, words, count) of up to ``max_words`` words, and each language's number of words
    (lang, n)."""
    spark = docs.sparkSession
    rows = stored(plain(docs, text_col, lang_col), "plain")
    tables: dict[int, dict[int, bytes]] = {}
    for n in range(1, max_words + 1):
        shared = spark.sparkContext.broadcast({m: t for m, t in tables.items() if m == n - 1})
        tables[n] = bit_table(frequent(rows, n, shared, min_count, filter_bits, key_bits), filter_bits)
        shared.destroy()
        if not tables[n]:  # nor are there longer ones
            tables |= {m: {} for m in range(n + 1, max_words + 1)}
            break
    shared = spark.sparkContext.broadcast(tables)
    found = stored(places(rows, shared, max_words, filter_bits, key_bits).groupBy(
        "key", "high", "low", "words").agg(
        F.sum("count").alias("count"), F.min("row").alias("row"), F.min_by("word", "row").alias("word")).where(
        F.col("count") >= min_count), "places")
    shared.destroy()
    found = spelled(rows, found)
    sizes = rows.groupBy("lang").agg(F.sum("words").alias("n"))
    return stored(found, "phrases"), stored(sizes, "sizes")


def joined(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def collocations(found: DataFrame, sizes: DataFrame, top: int | None = TOP) -> DataFrame:
    """Scored phrases of two words or more, without those that only occur inside a longer one."""
    big = "decimal(38,0)"
    long = found.where("words > 1").withColumnRenamed("count", "a").withColumn("_w", F.split("phrase", " "))
    cuts = long.select("lang", "phrase", "words", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", joined("_w", F.lit(1), F.col("k")).alias("_left"),
        joined("_w", F.col("k") + 1, F.col("words") - F.col("k")).alias("_right"))
    parts = found.select("lang", "phrase", "count")
    cuts = (
        cuts.join(parts.select("lang", F.col("phrase").alias("_left"), F.col("count").alias("l")), ["lang", "_left"])
        .join(parts.select("lang", F.col("phrase").alias("_right"), F.col("count").alias("r")), ["lang", "_right"])
        .join(sizes, "lang")
        .withColumn("score", F.expr(f"(CAST(1000 AS {big}) * a * n) div (CAST(l AS {big}) * r)")))
    best = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("_best")).select("lang", "phrase", "_best.*")
    # every part of two words or more of a longer phrase, with the longer one's count
    inner = long.where("words > 2").select(
        "lang", "a", "_w", F.explode(F.expr(
            "flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1),"
            " i -> struct(i AS i, s AS s))))")).alias("_cut"))
    covered = inner.select("lang", joined("_w", F.col("_cut.i"), F.col("_cut.s")).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = best.join(covered, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.col("_longer") < F.col("a"))).drop("_longer", "k")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        kept = kept.where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, len(ws) AS m, unnest(range(1, len(ws) + 1)) AS i FROM w),
f AS (SELECT lang, s AS words, array_to_string(ws[i:i + s - 1], ' ') AS phrase, count(*) AS a
      FROM g, (SELECT unnest(range(1, 6)) AS s) WHERE i + s - 1 <= m GROUP BY ALL),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND a >= 100),
k AS (SELECT c.*, k, array_to_string(ws[:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
      FROM c, (SELECT unnest(range(1, 5)) AS k) WHERE k < words),
s AS (SELECT k.lang, k.phrase, k.a, x.a AS l, y.a AS r, n, k,
        CAST((1000::HUGEINT * k.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp
      JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + z - 1], ' ') AS phrase, max(a) AS longer
       FROM c, (SELECT unnest(range(2, 5)) AS z), (SELECT unnest(range(1, 5)) AS i)
       WHERE z < words AND i + z - 1 <= words GROUP BY ALL),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank,
             b.phrase, a, l, r, n, score
      FROM b LEFT JOIN inside ON inside.lang = b.lang AND inside.phrase = b.phrase WHERE longer IS NULL OR longer < a)
SELECT * FROM o WHERE rank <= 2000
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, sizes = phrases(table(spark, sf_dir, "documents").select("lang", "text"))
    return collocations(found, sizes)
