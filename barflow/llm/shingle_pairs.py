"""Near copies by word shingles: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: the majority bits of a set's hashes are its fingerprint, fingerprints within two
bits (``simhash.links``), or equal ones, name candidates, and each is verified on the whole sets. At 0.8
most pairs are further apart, so an exact join finds the links that fingerprints miss.

The join is exact: prefix filters name the candidates, and each is verified on the whole sets, unless
its fingerprints have settled it. Sets are of 64-bit hashes; a pair of similarity 0.8 differs in at most a fifth of either set, so in any
common order of the shingles the first fifth of both, plus k, share at least k. Rows with equal
sets are one from the start.

First the order is that of the hashes: every set gives its first quarter, and only sets that find
enough of it in other sets go on. Their shingles are counted and ordered by rarity; shingles
that one set has alone meet nobody and make no rows. Sets that share a shingle of their first fifth
are candidates. A shingle with few holders lists their pairs. Sets that meet at crowded shingles
form crowds; a crowd is dealt in blocks, and two blocks are compared in one task, which returns a
spanning forest of the links it finds, not their pairs.

Cases: a null or empty text has the empty set, equal to any other such; a text of fewer words is one
shingle; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import encoded, slices
from barflow.llm import simhash
from barflow.llm.simhash import components
from barflow.session import stored

SHINGLE = 5
#: More holders than this make a shingle crowded; sets in a block of a crowd.
CROWD = 50
BLOCK = 512


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list:
    """Sorted different hashes of the n-word shingles of each text (of all words, if it has fewer)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = [t.lower().split() for t in texts]
    known = {w: i for i, w in enumerate(set().union(*words))}
    hashes = np.fromiter((xxh64_intdigest(w) for w in known), np.uint64, len(known))
    factor, out = np.uint64(0x9E3779B97F4A7C15), []
    for own in words:
        at = hashes[np.fromiter(map(known.__getitem__, own), np.int64, len(own))]
        size = min(n, len(at))
        mixed = np.full(len(at) - size + 1 if size else 0, size, np.uint64)
        for i in range(size):
            mixed = (mixed ^ at[i:i + len(mixed)]) * factor
            mixed ^= mixed >> np.uint64(32)
        out.append(np.unique(mixed.view(np.int64)))
    return out


def first_quarters(keyed: DataFrame) -> DataFrame:
    """Rows (row, sig, size, head, fp) of rows (row, text): a digest of the set, its first hashes and its
    SimHash fingerprint."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in slices(batches, 512):
            sets = shingle_sets(encoded(batch.column(1)))
            fp = simhash.majority_bits(np.concatenate(sets).view(np.uint64), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([s[:len(s) // 5 + max(1, len(s) // 20)] for s in sets],
                         pa.list_(pa.int64())), pa.array(fp.view(np.int64))],
                names=["row", "sig", "size", "head", "fp"])

    kind = keyed.schema["row"].dataType.simpleString()
    return keyed.mapInArrow(run, f"row {kind}, sig binary, size int, head array<bigint>, fp bigint")


def whole_sets(texts: DataFrame) -> DataFrame:
    """Rows (r, size, hashes) of rows (r, text)."""
    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, 512):
            sets = shingle_sets(encoded(batch.column(1)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int32()),
                pa.array(sets, pa.list_(pa.int64()))], names=["r", "size", "hashes"])

    return texts.mapInArrow(run, "r bigint, size int, hashes array<bigint>")


def forest(rows: list[int], sets: list) -> list[tuple[int, int]]:
    """Links of similarity 0.8 or more that connect all sets so linked."""
    import numpy as np

    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[starts, len(flat)])
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)
    held = np.repeat(runs > 1, runs)
    column, owner = column[held], owner[held]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):  # columns are sorted
        a, b = np.searchsorted(column, [low, low + 8192])
        part = np.zeros((len(sets), 8192), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    near = 5 * both >= 4 * (size[:, None] + size[None, :] - both)
    out, new = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        todo = [start] if new[start] else []
        new[start] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(near[i] & new)
            new[found] = False
            out += [(rows[i], rows[j]) for j in found.tolist()]
            todo += found.tolist()
    return out


def crowd_links(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within the crowds of rows (t, r): sets that meet at a crowded shingle."""
    def compare(table):
        import pyarrow as pa

        found = forest(table["r"].to_pylist(), [x.values.to_numpy() for x in table["hashes"]])
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()),
                         "b": pa.array([x for _, x in found], pa.int64())})

    least = met.groupBy("t").agg(F.min("r").alias("a"))
    crowds = stored(components(met.join(least, "t").select("a", F.col("r").alias("b"))), "crowds")
    blocks = crowds.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    own = crowds.join(blocks, "root").select(
        F.col("node").alias("r"), "root", "n", F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("own"))
    dealt = own.select("r", "root", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")) \
        .select("r", "root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return dealt.join(sets.select("r", "hashes"), "r").groupBy("root", "lo", "hi").applyInArrow(
        compare, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a similarity of 0.8 or more."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("r").alias(side), F.col("hashes").alias(f"h{side}")), side)
    both = F.size(F.array_intersect("ha", "hb"))
    return pairs.where(5 * both >= 4 * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def fingerprint_links(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified pairs (a < b) of rows whose fingerprints are equal or linked; ``reps``: r, fp. The rows of one
    fingerprint, and of two linked ones, are compared through the least row of each."""
    least = stored(reps.groupBy("fp").agg(F.min("r").alias("least")), "shingles-prints")
    same = reps.join(least, "fp").where("r <> least").select(F.col("least").alias("a"), F.col("r").alias("b"))
    near = simhash.links(least.select("fp"))
    for side in "ab":
        near = near.join(least.select(F.col("fp").alias(side), F.col("least").alias(f"_{side}")), side)
    pairs = same.unionByName(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))
    pairs = stored(pairs, "shingles-candidates")
    rows = pairs.select(F.explode(F.array("a", "b")).alias("r")).distinct()
    return stored(verified(pairs, whole_sets(texts.join(rows, "r", "left_semi"))), "shingles-near")


def links(reps: DataFrame, texts: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all linked rows, with the pairs ``settled`` (a < b) before; ``reps``: r, size,
    head; ``texts``: r, text."""
    heads = reps.select("r", "size", F.explode("head").alias("t"))
    shared = stored(heads.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t"),
                    "shingles-shared")
    hopeful = stored(heads.join(shared, "t", "left_semi").groupBy("r", "size")
                     .agg(F.count(F.lit(1)).alias("n"))
                     .where("n >= greatest(1, size * 4L DIV 100)").select("r"), "shingles-hopeful")
    sets = stored(whole_sets(texts.join(hopeful, "r", "left_semi")), "shingles-sets")
    each = sets.select("r", "size", F.explode("hashes").alias("t"))
    counts = stored(each.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shingles-counts")
    rare = each.join(counts, "t").groupBy("r", "size").agg(
        F.sort_array(F.collect_list(F.struct("n", "t"))).alias("all"))
    first = F.expr("slice(all, 1, greatest(0, size DIV 5 + 1 - (size - size(all))))")
    met = stored(rare.select("r", "size", F.explode(first).alias("x")).select("r", "size", "x.*"),
                 "shingles-met")
    few = met.where(F.col("n") <= CROWD).select("t", "r", "size")
    pairs = few.select("t", F.col("r").alias("a"), F.col("size").alias("sa")).join(
        few.select("t", F.col("r").alias("b"), F.col("size").alias("sb")), "t") \
        .where("a < b AND 5 * least(sa, sb) >= 4 * greatest(sa, sb)") \
        .select("a", "b").distinct().join(settled, ["a", "b"], "left_anti")
    near = verified(pairs, sets).unionByName(settled)
    return near.unionByName(crowd_links(met.where(F.col("n") > CROWD).select("t", "r"), sets))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of the smallest
    text hash among rows of one id)."""
    marked = stored(docs.select(
        F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_row")), "shingles-docs")
    field = F.col("doc").getField
    row = F.struct(field(id_col).isNull().alias("n"), field(id_col).alias("d"),
                   F.xxhash64(field(text_col)).alias("h"), F.col("_row").alias("r"))
    keyed = marked.select(row.alias("row"), field(text_col).alias("text"))
    reps = stored(first_quarters(keyed).groupBy("sig").agg(
        F.min("row").alias("row"), F.first("size").alias("size"), F.first("head").alias("head"),
        F.first("fp").alias("fp")).select("row", F.col("row.r").alias("r"), "size", "head", "fp"), "shingles-reps")
    texts = marked.select(F.col("_row").alias("r"), field(text_col).alias("text"))
    settled = fingerprint_links(reps.select("r", "fp"), texts)
    found = components(links(reps.select("r", "size", "head"), texts, settled))
    kept = reps.select("row", "r").join(found.withColumnRenamed("node", "r"), "r", "left") \
        .groupBy(F.coalesce("root", "r")).agg(F.min("row").alias("least"))
    return marked.join(kept.select(F.col("least.r").alias("_row")), "_row", "left_semi") \
        .select("doc.*")
