"""SimHash near-dedup: fingerprints, links at few differing bits, and their components.

Fingerprints are compared through segment popcounts: a fingerprint's 64 bits are cut into 16
segments of 4 bits, and the count of set bits in each is a coordinate. One differing bit moves one
coordinate by at most one, so the Manhattan distance of two such vectors is a lower bound of the
differing bits. The grid is the integer lattice itself: two vectors at distance 2 or less have a
lattice point at distance 1 or less from both, so each fingerprint enters its own cell and the
cells one step away, and every linked pair shares a cell.

A cell with two fingerprints names one pair, which is verified on the bits. The fingerprints of
cells with more go to a finer grid, segments of one bit, where sharing a cell means at most two
differing bits; there each links to the cell's smallest after the same verification. So the rows made
grow with the number of different fingerprints, however large a group of near copies is, and no
group's pairs are listed.

Components: the links are shrunk by alternating stars (each node's larger neighbours, then its
smaller ones, move to its smallest), each round a written table, until nothing changes.

Cases: a null or empty text has fingerprint zero, linked like any other; null ids count as larger
than all others and keep a null component only if the whole component has none; repeated rows are
members like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import encoded, slices, table
from barflow.session import stored

MAX_BITS = 2
SHINGLE = 3
SEED = 42


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> list[int]:
    """XXH64 of every n-word shingle (of the whole sequence, if it has fewer words)."""
    from xxhash import xxh64_intdigest

    if not words:
        return []
    if len(words) <= n:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    rows = [words[i:] for i in range(n)]
    return [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*rows, strict=False))]


def majority_bits(hashes, counts):
    """64-bit majority of each consecutive run of ``counts`` hashes (none: 0).

    Eight byte lanes of a word count eight bits at a time, over blocks of at most 255 hashes.
    """
    import numpy as np

    counts = np.asarray(counts, np.int64)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    hashes, held = np.asarray(hashes, np.uint64), counts[some]
    starts = np.cumsum(held) - held
    blocks = -(-held // 255)
    first = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 255 * within
    lanes = np.uint64(0x0101010101010101)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & lanes, at)
        per = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        ones = 2 * per > held[:, None]
        bits = (np.uint64(shift) + 8 * np.arange(8, dtype=np.uint64))[None, :]
        out[some] |= np.bitwise_or.reduce(ones.astype(np.uint64) << bits, axis=1)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, fp long): the fingerprint of every whole text, one row per row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 512):
            hashes, counts = [], []
            for raw in encoded(batch.column(1)):
                own = shingle_hashes(raw.lower().split())
                counts.append(len(own))
                hashes.append(np.array(own, np.uint64))
            joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            fp = majority_bits(joined, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fp bigint")


def segment_counts(fp: Column, width: int) -> Column:
    """Set bits of each segment of ``width`` (1 or 4) bits, kept in the segment's own bits."""
    if width == 1:
        return fp
    lows = [F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(0x1111111111111111)) for k in range(4)]
    return lows[0] + lows[1] + lows[2] + lows[3]


def grid_cells(fp: Column, width: int) -> Column:
    """The cell of a fingerprint's segment counts and all cells one step away; null for a step
    that leaves the lattice."""
    base = segment_counts(fp, width)
    steps = []
    for at in range(0, 64, width):
        one = F.lit((1 << at) - (1 << 64 if at == 63 else 0))
        value = F.shiftrightunsigned(base, at).bitwiseAND(F.lit(15))
        if width == 1:
            steps.append(base.bitwiseXOR(one))
        else:
            steps += [F.when(value < width, base + one), F.when(value > 0, base - one)]
    return F.array(base, *steps)


def links(reps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a < b) of different fingerprints that connect all linked ones; ``reps``: fp, unique."""
    if max_bits != 2:
        raise ValueError("the lattice steps serve two differing bits")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    cells = reps.select("fp", F.explode(grid_cells(F.col("fp"), 4)).alias("cell")) \
        .where("cell IS NOT NULL")
    shared = stored(
        cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"),
                                  F.max("fp").alias("b")).where("n >= 2"), "simhash-cells")
    pairs = shared.where("n = 2").select("a", "b").where(close).distinct()
    crowded = cells.join(shared.where("n > 2").select("cell"), "cell", "left_semi") \
        .select("fp").distinct()
    fine = stored(crowded.select("fp", F.explode(grid_cells(F.col("fp"), 1)).alias("cell")),
                  "simhash-fine")
    least = fine.groupBy("cell").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")) \
        .where("n >= 2").drop("n")
    stars = fine.join(least, "cell").where("fp <> a").select("a", F.col("fp").alias("b")) \
        .where(close).distinct()
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): the smallest node of each connected component of ``edges`` (a, b).

    Alternating stars; a round reads and writes one table of at most the starting number of
    edges. Fewer rounds than ``max_rounds`` suffice for any graph that can be stored.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")) \
            .withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"),
                                                            F.col("m").alias("v")).distinct()
        large = stored(large, "edges")
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(floor, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, "edges")
        changed = small.join(edges, ["u", "v"], "left_anti").limit(1).count()
        shrunk = changed == 0 and edges.join(small, ["u", "v"], "left_anti").limit(1).count() == 0
        edges = small
        if shrunk:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def near_duplicates(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (id, fp, component): the smallest id reachable over links, itself included.

    ``prints`` (id, fp) is read several times: give it as a written table.
    """
    reps = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-reps")
    found = components(links(reps.select("fp"), max_bits))
    joined = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    best = joined.groupBy("root").agg(F.min("least").alias("component"))
    labels = stored(joined.join(best, "root").select("fp", "component"), "simhash-labels")
    return prints.join(labels, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (of the smallest
    text hash among rows of one id)."""
    marked = stored(docs.select(
        F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("_row")), "simhash-docs")
    field = F.col("doc").getField
    row = F.struct(field(id_col).isNull().alias("n"), field(id_col).alias("d"),
                   F.xxhash64(field(text_col)).alias("h"), F.col("_row").alias("r"))
    keyed = marked.select(row.alias("row"), field(text_col).alias("_text"))
    prints = stored(fingerprints(keyed, "_text", "row"), "simhash-prints")
    reps = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-reps")
    found = components(links(reps.select("fp")))
    kept = reps.join(found.withColumnRenamed("node", "fp"), "fp", "left") \
        .groupBy(F.coalesce("root", "fp")).agg(F.min("least").alias("least"))
    return marked.join(kept.select(F.col("least.r").alias("_row")), "_row", "left_semi") \
        .select("doc.*")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = stored(fingerprints(docs), "simhash-prints")
    return near_duplicates(prints).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))
