"""Merkle manifest of a dataset: digests of rows, of groups and of the whole, with a proof for every row.

A row's digest is its leaf. Per group the leaves ascend by id, and every two neighbours become one
digest (a last one alone is digested alone) until one is left; the groups' digests, in order of the
groups, make a tree of the same kind, whose top is the digest of the dataset. The nodes are kept as
records from a digest to its children's digests. A request for a leaf descends from the root by the
binary digits of the leaf's rank, collects the child not taken at each record, and the segments of its
path, reversed, are the proof.

Ranks come from a range partitioning by (group, id, leaf) whose partitions are numbered and added up,
so neither a large group nor many equal rows are one task. Records are held in pages, each
the 2^PAGE_BITS leaves' worth of nodes under one digest and stored under that digest once, so trees are built
and descended in one round for each PAGE_BITS levels, and a round's tables shrink by 2^PAGE_BITS. All requests
below one page share one descent to it; no task holds more than one page with its requests. Rows of the documents are read for the
leaves alone; what moves afterwards is digests.

Cases: null ids come first in their group, rows of equal ids ascend by leaf, and equal rows have equal
leaves, each with a place and a proof of its own; a null group is a group of its own, the first; a null value is digested as
``-``, an empty text as ``0:``; an empty table has no root and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import table
from barflow.session import stored

#: Levels of a page: a page holds the nodes over 2^PAGE_BITS neighbours.
PAGE_BITS = 10

PAGE = "key string, page bigint, digest binary, height int, records array<struct<digest:binary,children:array<binary>>>"
STEP = "side:int,digest:binary"


def value_bytes(col: str | Column) -> Column:
    """A value with its length in bytes in front; null is ``-``."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*cols: str | Column) -> Column:
    """Hexadecimal SHA-256 of the values one after another."""
    return F.sha2(F.concat(*[value_bytes(c) for c in cols]), 256)


def group_key(col: str) -> Column:
    """A group as a key without nulls, in the order null first, then by bytes."""
    return F.when(F.col(col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(col)))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) of each row in its ``key`` by ``order``, and the key's ``total``.

    ``order`` may end in a column that differs between equal rows, so that they can be dealt out.
    """
    placed = stored(
        df.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", 33)), name)
    parts = placed.groupBy("key", "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by_part = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "key", "_part", (F.coalesce(F.sum("_n").over(by_part), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("key")).alias("total"))
    return placed.join(parts, ["key", "_part"]).withColumn("rank", F.col("_place") + F.col("_shift")).drop(
        "_place", "_part", "_shift")


def levels(total: int) -> int:
    """Levels over ``total`` neighbours."""
    return max(total - 1, 0).bit_length()


def parent(children: list[bytes]) -> bytes:
    from hashlib import sha256

    return sha256("".join(c.hex() for c in children).encode()).digest()


def page_records(leaves: list[bytes], height: int) -> tuple[bytes, list[dict]]:
    """Digest of the page's top and its records, built up ``height`` levels."""
    records, row = [], leaves
    for _ in range(height):
        above = []
        for i in range(0, len(row), 2):
            kids = row[i:i + 2]
            above.append(parent(kids))
            records.append({"digest": above[-1], "children": kids})
        row = above
    return row[0], records


def descend(at: bytes, digits: int, height: int, children: dict) -> tuple[bytes, list[dict]]:
    """From a page's top down by ``height`` binary digits: the digest reached, and the children
    not taken, lowest first. ``side``: 0 there is none, 1 it stands to the right, 2 to the left."""
    path = []
    for level in range(height - 1, -1, -1):
        kids = children[at]
        take = digits >> level & 1
        at = kids[take]
        other = kids[1 - take] if len(kids) == 2 else None
        path.append({"side": 0 if other is None else 2 if take else 1, "digest": other})
    return at, path[::-1]


def fold(leaf: bytes, path: list[dict]) -> bytes:
    """The root that a leaf and its proof come to."""
    for step in path:
        side, other = step["side"], step["digest"]
        leaf = parent([leaf] if not side else [leaf, other] if side == 1 else [other, leaf])
    return leaf


def as_table(rows: list[dict], schema):
    import pyarrow as pa

    return pa.Table.from_pylist(rows, schema)


def page_type():
    import pyarrow as pa

    record = pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))])
    return pa.schema([("key", pa.string()), ("page", pa.int64()), ("digest", pa.binary()), ("height", pa.int32()),
                      ("records", pa.list_(record))])


@dataclass
class Tree:
    """Trees of all keys. ``pages``: one table for each round of levels, lowest first, of the pages
    (key, page, digest, height, records); ``roots``: key, digest, total."""

    pages: list[DataFrame]
    roots: DataFrame


def build(leaves: DataFrame, name: str, bits: int = PAGE_BITS) -> Tree:
    """Trees over rows (key, rank, total, leaf); ``leaf`` is a digest as binary."""
    def grown(key, rows):
        found = rows.sort_by("rank").to_pydict()
        left = found["total"][0]
        digest, records = page_records(found["leaf"], min(bits, levels(left)))
        return as_table([{"key": key[0].as_py(), "page": key[1].as_py(), "digest": digest,
                          "height": min(bits, levels(left)), "records": records}], page_type())

    sizes = leaves.groupBy("key").agg(F.first("total").alias("total"))
    pages, rest, left = [], leaves, "total"
    while True:
        done = stored(rest.withColumn("page", F.shiftright("rank", bits)).select("key", "page", "rank", "total", "leaf")
                      .groupBy("key", "page").applyInArrow(grown, PAGE), f"{name}-pages")
        pages.append(done)
        counts = done.groupBy("key").agg(F.count(F.lit(1)).alias("total"))
        if counts.where("total > 1").isEmpty():
            break
        rest = done.select("key", F.col("page").alias("rank"), F.col("digest").alias("leaf")).join(counts, "key")
    tops = pages[-1].select("key", "digest")
    return Tree(pages, tops.join(sizes, "key"))


def prove(tree: Tree, wanted: DataFrame, heads: DataFrame, finish, schema: str, bits: int = PAGE_BITS) -> DataFrame:
    """``finish(row, reached digest, path)`` for each row of ``wanted`` (key, rank and more).

    ``heads``: key, at (digest of the key's tree) and path (steps above it). ``finish`` gets the whole path, lowest step
    first, and returns a row of ``schema``.
    """
    kind = wanted.limit(0).sparkSession.createDataFrame([], schema)
    out_type = _arrow_schema(kind)
    steps = _arrow_schema(kind.sparkSession.createDataFrame(
        [], f"key string, rank bigint, at binary, path array<struct<{STEP}>>"))

    def walker(last: bool):
        def walk(key, requests, page):
            held = page.to_pylist()
            if not held:
                return as_table([], out_type if last else steps)
            head = held[0]
            children = {r["digest"]: r["children"] for r in head["records"]}
            rows = []
            for row in requests.to_pylist():
                digits = row["rank"] & ((1 << bits) - 1)
                at, path = descend(head["at"], digits, head["height"], children)
                path = path + head["path"]
                rows.append(finish(row, at, path) if last
                            else {"key": row["key"], "rank": row["rank"], "at": at, "path": path})
            return as_table(rows, out_type if last else steps)

        return walk

    heads = heads.select("key", F.lit(0).cast("bigint").alias("page"), "at", "path")
    for level in range(len(tree.pages) - 1, -1, -1):
        # the same records may serve several places, and are stored under their digest once
        records = tree.pages[level].select(F.col("digest").alias("at"), "height", "records").dropDuplicates(["at"])
        found = heads.join(records, "at")
        asked = wanted if level == 0 else wanted.select(
            "key", F.shiftright("rank", bits * level).alias("rank")).distinct()
        asked = asked.withColumn("page", F.shiftright("rank", bits))
        walked = asked.groupBy("key", "page").cogroup(found.groupBy("key", "page")).applyInArrow(
            walker(level == 0), schema if level == 0 else f"key string, rank bigint, at binary, path array<struct<{STEP}>>")
        if level == 0:
            return walked
        heads = stored(walked, "heads").select("key", F.col("rank").alias("page"), "at", "path")


def _arrow_schema(df: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


@dataclass
class Manifest:
    """``leaves``: the rows with key, rank, total and leaf; ``groups``: group key, rank and subroot;
    ``tree`` and ``top``: the records of the groups and of the dataset; ``root``: None without rows."""

    leaves: DataFrame
    groups: DataFrame
    tree: Tree
    top: Tree
    root: bytes | None


def manifest(rows: DataFrame, order: list[str], bits: int = PAGE_BITS) -> Manifest:
    """Manifest of ``rows`` (key, leaf, the columns of ``order``, and more that are carried along)."""
    leaves = stored(ranked(rows, order, "leaves"), "leaves")
    tree = build(leaves, "group", bits)
    groups = stored(ranked(tree.roots.select(
        F.lit("").alias("key"), F.col("key").alias("group"), F.col("digest").alias("leaf")), ["group"], "groups"), "groups")
    top = build(groups, "top", bits)
    found = top.roots.first()
    return Manifest(leaves, groups, tree, top, bytes(found["digest"]) if found else None)


def proofs(made: Manifest, wanted: DataFrame, finish, schema: str, bits: int = PAGE_BITS) -> DataFrame:
    """Proofs of ``wanted`` (key, rank and more) from the lowest level to the dataset's root; see ``prove``."""
    none = F.array().cast(f"array<struct<{STEP}>>")
    heads = made.top.roots.select("key", F.col("digest").alias("at"), none.alias("path"))

    def reached(row, at, path):
        return {"key": row["group"], "at": at, "path": path}

    heads = stored(prove(made.top, made.groups.select("key", "rank", "group"), heads, reached,
                         f"key string, at binary, path array<struct<{STEP}>>", bits), "heads")
    return prove(made.tree, wanted, heads, finish, schema, bits)


def proof_digest(path: list[dict]) -> str:
    """SHA-256 of a proof's digests, lowest first."""
    from hashlib import sha256

    return sha256("".join(s["digest"].hex() for s in path if s["side"]).encode()).hexdigest()


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS key,
         coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS id, n_chars,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                        lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT)) AS chars
  FROM documents),
c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), chars), lambda crc, b:
        list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z:
          xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM d),
l AS (SELECT r, doc_id, key,
        sha256(id || head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
        CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN sha256(id || head
          || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS other FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS rank,
             count(*) OVER (PARTITION BY key) AS total FROM l),
n(key, lvl, idx, digest, cnt) AS (
  SELECT key, 0, rank, leaf, total FROM k
  UNION ALL
  SELECT key, lvl + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), max((cnt + 1) // 2)
  FROM n WHERE cnt > 1 GROUP BY key, lvl, idx // 2),
s AS (SELECT key, digest AS subroot, row_number() OVER (ORDER BY key) - 1 AS rank, count(*) OVER () AS total
      FROM n WHERE cnt = 1),
t(lvl, idx, digest, cnt) AS (
  SELECT 0, rank, subroot, total FROM s
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), max((cnt + 1) // 2)
  FROM t WHERE cnt > 1 GROUP BY lvl, idx // 2),
p AS (
  SELECT k.r, h.lvl, (k.rank >> h.lvl) & 1 AS digit, b.digest AS other
  FROM k JOIN n h ON h.key = k.key AND h.idx = k.rank >> h.lvl AND h.cnt > 1
  LEFT JOIN n b ON b.key = k.key AND b.lvl = h.lvl AND b.idx = xor(k.rank >> h.lvl, 1)
  UNION ALL
  SELECT k.r, 1000 + h.lvl, (s.rank >> h.lvl) & 1, b.digest
  FROM k JOIN s USING (key) JOIN t h ON h.idx = s.rank >> h.lvl AND h.cnt > 1
  LEFT JOIN t b ON b.lvl = h.lvl AND b.idx = xor(s.rank >> h.lvl, 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS step, count(*) OVER (PARTITION BY r) AS steps FROM p),
f(r, step, digest) AS (
  SELECT r, 0, coalesce(other, leaf) FROM k
  UNION ALL
  SELECT f.r, f.step + 1, sha256(CASE WHEN o.other IS NULL THEN f.digest
    WHEN o.digit = 0 THEN f.digest || o.other ELSE o.other || f.digest END)
  FROM f JOIN o ON o.r = f.r AND o.step = f.step + 1),
e AS (SELECT r, arg_max(digest, step) AS folded FROM f GROUP BY r),
q AS (SELECT r, sha256(coalesce(string_agg(other, '' ORDER BY step), '')) AS proof FROM o GROUP BY r)
SELECT k.doc_id, k.leaf, s.subroot, t.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
       e.folded AS folded_root, e.folded = t.digest AS verified
FROM k JOIN s USING (key) JOIN e USING (r) LEFT JOIN q USING (r), (SELECT digest FROM t WHERE cnt = 1) t
"""


def op13_merkle(spark, sf_dir: str, bits: int = PAGE_BITS) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    rows = docs.select(
        group_key("lang").alias("key"), "doc_id",
        F.unhex(leaf_digest("doc_id", "source", "lang", "n_chars", "text")).alias("leaf"),
        F.when(tampers, F.unhex(leaf_digest("doc_id", "source", "lang", more, "text"))).alias("other"),
        F.monotonically_increasing_id().alias("_row"))
    made = manifest(rows, ["doc_id", "leaf", "_row"], bits)
    kind = docs.schema["doc_id"].dataType.simpleString()
    root = made.root.hex() if made.root else None

    def finish(row, at, path):
        folded = fold(row["other"] or at, path).hex()
        return {"key": row["key"], "doc_id": row["doc_id"], "leaf": at.hex(), "proof_sha256": proof_digest(path),
                "folded_root": folded, "verified": folded == root}

    done = proofs(made, made.leaves.select("key", "rank", "doc_id", "other"), finish,
                  f"key string, doc_id {kind}, leaf string, proof_sha256 string, folded_root string, verified boolean", bits)
    subroots = made.tree.roots.select("key", F.hex("digest").alias("_subroot"))
    return done.join(subroots, "key").select(
        "doc_id", "leaf", F.lower("_subroot").alias("subroot"), F.lit(root).cast("string").alias("root"), "proof_sha256",
        "folded_root", "verified")
