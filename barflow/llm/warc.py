"""WARC archives as chunked record tables.

Writing: a payload's SHA-1 and length group equal payloads, the one with the largest id becomes a
response and the others revisits that refer to it. A payload longer than a chunk is a WARC segmented
record: rows of (record id, chunk number), the first a response, the rest continuations, so no
task builds a record longer than a chunk. A chunk also ends inside any text equal to a record's
first line, which therefore never stands in a block: records can be found from any place in a file,
and readers share large archives. Files are written by Spark's text writer.

Reading: Spark's text reader cuts the archives at the first lines of records; headers and blocks are
parsed by column functions. A record of one chunk is digested where it is; the chunks of longer ones
are dealt by record id, sorted by chunk number, and fed one after another to a running
SHA-1, which holds one chunk at a time. Digests are checked against the headers.

Cases: a null payload counts as empty; a null id is never referred to before an id; repeated rows of
equal id and payload are records of their own with equal types; an empty table gives no archive
records and an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import table
from barflow.session import scratch_path

MARK = "WARC/1.1"
CRLF = "\r\n"
CHUNK_CHARS = 1 << 20
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive file before compression.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32(sha1_hex: Column) -> Column:
    """Base32 of 20 bytes given in hex: four groups of 40 bits, eight digits each."""
    groups = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 payload_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Rows (id, url, payload, bytes, sha1, record_type, refers_to, record)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("bytes"),
        F.sha1(payload.cast("binary")).alias("sha1"))
    owners = rows.groupBy("sha1", "bytes").agg(F.max("id").alias("owner"))
    owned = (F.col("bytes") >= min_bytes) & (F.col("owner").isNotNull()) \
        & ~F.col("id").eqNullSafe(F.col("owner"))
    return rows.join(owners, ["sha1", "bytes"]).select(
        "id", "url", "payload", "bytes", "sha1",
        F.when(owned, "revisit").otherwise("response").alias("record_type"),
        F.when(owned, F.col("owner")).alias("refers_to"),
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"),
                 F.monotonically_increasing_id().cast("string")).alias("record"))


def chunk_table(records: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows (record, chunk, chunks, data, ...): payloads in order, revisits with none."""
    safe = F.split(F.when(F.col("record_type") == "response", F.col("payload")).otherwise(""),
                   "(?<=WARC/)(?=1\\.1)")
    pieces = F.flatten(F.transform(safe, lambda s: F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.char_length(s) - 1, F.lit(0)) / chunk_chars)
                   .cast("int")),
        lambda i: F.substring(s, i * chunk_chars + 1, F.lit(chunk_chars)))))
    return records.withColumn("_all", pieces).select(
        "*", F.size("_all").alias("chunks"), F.posexplode("_all").alias("chunk", "data")) \
        .drop("_all", "payload")


def record_text(row_chunks: DataFrame) -> DataFrame:
    """One WARC record per row, without its last line end."""
    first = F.col("chunk") == 0
    block = F.concat(F.when(first, F.lit(HTTP)).otherwise(F.lit("")), F.col("data"))
    origin = F.concat(F.lit("<"), F.col("record"), F.lit(">"))

    def header(name, value, when=None):
        line = F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        return line if when is None else F.when(when, line).otherwise(F.lit(""))

    kind = F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))
    own = F.concat(F.lit("<"), F.col("record"), F.when(first, F.lit("")).otherwise(
        F.concat(F.lit(":"), F.col("chunk").cast("string"))), F.lit(">"))
    many = F.col("chunks") > 1
    refers = F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    return row_chunks.select(F.concat(
        F.lit(MARK + CRLF),
        header("WARC-Type", kind),
        header("WARC-Record-ID", own),
        header("WARC-Date", F.lit(DATE)),
        header("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", " "), F.col("url") != ""),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        header("WARC-Refers-To", refers, F.col("refers_to").isNotNull()),
        header("WARC-Profile", F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            F.col("record_type") == "revisit"),
        header("WARC-Segment-Number", (F.col("chunk") + 1).cast("string"), many),
        header("WARC-Segment-Origin-ID", origin, many & ~first),
        header("X-Page-Id", F.col("id").cast("string"), F.col("id").isNotNull()),
        header("X-Payload-Bytes", F.col("bytes").cast("string")),
        header("Content-Type", F.lit("application/http; msgtype=response"), first),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block, F.lit(CRLF)).alias("value"))


def write_archives(pages: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, **columns) -> None:
    """Write one WARC record per row (more, if oversized) to gzip files under ``path``."""
    records = record_text(chunk_table(plan_records(pages, **columns), chunk_chars))
    records.write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def read_chunks(spark, path: str) -> DataFrame:
    """Rows of records as they stand in the archives: headers as columns, the payload part as data."""
    raw = spark.read.option("lineSep", MARK + CRLF).text(path).where("value <> ''")
    cut = F.instr("value", CRLF + CRLF)
    head = F.concat(F.lit(CRLF), F.substring(F.col("value"), F.lit(1), cut - 1), F.lit(CRLF))

    def field(name):
        found = F.substring_index(F.substring_index(F.col("head"), f"{CRLF}{name}: ", -1), CRLF, 1)
        return F.when(F.contains(F.col("head"), F.lit(f"{CRLF}{name}: ")), found)

    body = F.substring(F.col("value").cast("binary"), F.octet_length(
        F.substring(F.col("value"), F.lit(1), cut - 1)) + 5, F.col("length"))
    rows = raw.withColumn("head", head).withColumn("length", field("Content-Length").cast("int")) \
        .withColumn("kind", field("WARC-Type"))
    http = F.when(F.col("kind") == "continuation", 0).otherwise(len(HTTP))
    return rows.select(
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"),
        "kind", field("X-Page-Id").alias("id"), field("X-Payload-Bytes").cast("bigint").alias("bytes"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        F.regexp_extract(field("WARC-Refers-To"), "<urn:page:(.*)>", 1).alias("refers_to"),
        field("WARC-Segment-Number").cast("int").alias("segment"),
        F.substring(body, F.lit(1) + http, F.col("length")).alias("data"))


def running_digests(chunks: DataFrame) -> DataFrame:
    """Rows (record, chunks, bytes, digest) of rows (record, segment, data), one chunk at a time."""
    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa

        at, state, size, count = None, None, 0, 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([count], pa.int32()), pa.array([size], pa.int64()),
                 pa.array([base64.b32encode(state.digest()).decode()])],
                names=["record", "chunks", "bytes", "digest"])

        for batch in batches:
            for i in range(batch.num_rows):
                record, data = batch.column(0)[i].as_py(), batch.column(2)[i]
                if record != at:
                    if at is not None:
                        yield out()
                    at, state, size, count = record, hashlib.sha1(), 0, 0
                view = data.as_buffer()
                state.update(view)
                size += view.size
                count += 1
        if at is not None:
            yield out()

    dealt = chunks.select("record", "segment", "data").repartition("record") \
        .sortWithinPartitions("record", "segment")
    return dealt.mapInArrow(run, "record string, chunks int, bytes bigint, digest string")


def read_records(spark, path: str) -> DataFrame:
    """Rows (id, bytes, digest, record_type, refers_to, intact), one per record.

    Bytes and digest of a response are taken from its payload; a revisit has those of its headers.
    ``intact``: the payload agrees with the headers.
    """
    rows = read_chunks(spark, path)
    single = rows.where("segment IS NULL")
    own = F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(base32(F.sha1("data")))
    size = F.when(F.col("kind") == "revisit", F.col("bytes")).otherwise(
        F.octet_length("data").cast("bigint"))
    refers = F.when(F.col("kind") == "revisit", F.col("refers_to"))
    alone = single.select("id", size.alias("bytes"), own.alias("digest"), F.col("kind").alias("record_type"),
                          refers.alias("refers_to"),
                          ((own == F.col("digest")) & (size == F.col("bytes"))).alias("intact"))
    heads = rows.where("segment = 1").select("record", "id", "kind", F.col("digest").alias("said"),
                                             F.col("bytes").alias("said_bytes"))
    long = running_digests(rows.where("segment IS NOT NULL")).join(heads, "record").select(
        "id", "bytes", "digest", F.col("kind").alias("record_type"),
        F.lit(None).cast("string").alias("refers_to"),
        ((F.col("digest") == F.col("said")) & (F.col("bytes") == F.col("said_bytes"))).alias("intact"))
    return alone.unionByName(long)


SQL = r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
g AS (SELECT p, max(page_id) AS owner FROM d GROUP BY p),
h AS (SELECT d.page_id, CAST(octet_length(encode(d.p)) AS BIGINT) AS payload_bytes, sha1(d.p) AS hex, owner,
             d.page_id IS DISTINCT FROM owner AND owner IS NOT NULL AS again FROM d JOIN g USING (p)),
b AS (SELECT *, list_reduce(list_transform(generate_series(0, 31), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
          CAST('0x' || substr(hex, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT)
          // CAST(pow(32, 7 - i % 8) AS BIGINT)) % 32 AS INT), 1)), lambda a, x: a || x) AS digest FROM h)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN owner END AS refers_to, true AS intact
FROM b
"""


def op4_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_records(spark, path).select(
        F.col("id").cast("bigint").alias("page_id"), F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"), "intact")
