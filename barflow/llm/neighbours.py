"""Nearest neighbours of a stated query set by cosine, as a block matrix join.

Vectors are packed into blocks, one row each: unit vectors rounded to int8 with a scale per vector, and
the originals. Every query block meets every candidate block in one tile, by an equi-join on the
tile's number, so the work is (queries x candidates) spread evenly over tiles and no task sees
more than two blocks. In a tile the int8 product gives all cosines with a bound on the error of
rounding: |uv - u'v'| <= |u'| |v - v'| + |u - u'|. A pair survives if its upper bound reaches
the k-th largest lower bound of its query; survivors are recomputed in double precision from the
originals, and a heap per query keeps its k best over the tile's slices. The tiles' heaps merge in
a last ranking. The result is exact.

Equal vectors have equal scores, so of each different vector in a block only the k + 1 smallest
ids stand (one more, as a query is not its own neighbour): a vector held by a third of all
rows costs a tile no more than any other.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors
meet only vectors of equal length; null ids take no part; rows of equal id are the query itself and
each other's; ties go to the smaller id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.common import table
from barflow.session import stored

K = 5
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: Candidates whose product with a query block is held at one time.
SLICE = 1024


def usable(vector: Column) -> Column:
    """The vector as doubles if it takes part, else null."""
    v = vector.cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good & F.exists(v, lambda x: x != 0), v)


def blocks(vectors: DataFrame, number: int, k: int | None) -> DataFrame:
    """Rows (block, dim, ids, data) of ``vectors`` (id, v), dealt by hash to ``number`` blocks.

    A block of the same dealing keeps, if ``k`` is given, the k + 1 smallest ids of equal vectors.
    """
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int")) \
        .withColumn("dim", F.size("v"))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        held, at = [], None

        def flush():
            ids = np.concatenate([h[0] for h in held])
            data = np.concatenate([h[1] for h in held])
            order = np.argsort(ids, kind="stable")
            ids, data = ids[order], np.ascontiguousarray(data[order]) + 0.0
            if k is not None:
                same = np.unique(data.view(f"V{8 * data.shape[1]}").ravel(), return_inverse=True)[1]
                rank = np.argsort(same, kind="stable")
                run = np.r_[0, np.flatnonzero(np.diff(same[rank])) + 1]
                nth = np.arange(len(rank)) - np.repeat(run, np.diff(np.r_[run, len(rank)]))
                keep = np.sort(rank[nth <= k])
                ids, data = ids[keep], data[keep]
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()),
                 pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
                names=["block", "dim", "ids", "data"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            dim = batch.column(1).to_numpy()
            flat = batch.column(3).flatten().to_numpy()
            ids = batch.column(2).to_numpy()
            cuts = np.r_[0, np.flatnonzero((np.diff(block) != 0) | (np.diff(dim) != 0)) + 1, len(ids)]
            starts = np.r_[0, np.cumsum(dim)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = (int(block[a]), int(dim[a]))
                if held and key != at:
                    yield flush()
                    held = []
                at = key
                held.append((ids[a:b].copy(), flat[starts[a]:starts[b]].reshape(b - a, -1).copy()))
        if held:
            yield flush()

    return (
        dealt.select("block", "dim", "id", "v").repartition(max(1, number), "block")
        .sortWithinPartitions("block", "dim")
        .mapInArrow(pack, "block int, dim int, ids binary, data binary")
    )


def quantised(data):
    """Unit vectors as int8 times a scale: codes, scales, norms of the rounded, of the rests."""
    import numpy as np

    top = np.abs(data).max(axis=1, keepdims=True)
    unit = data / top
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale).astype(np.int8)
    near = codes * scale
    rest = unit - near
    return (codes, scale[:, 0], np.sqrt((near * near).sum(axis=1)),
            np.sqrt((rest * rest).sum(axis=1)) + 1e-12)


def exact(a, b):
    """Cosines of paired rows in double precision; rows are first scaled by powers of two, which
    rounds nothing and keeps squares in range."""
    import numpy as np

    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def tile(q_ids, q_data, c_ids, c_data, k: int) -> tuple[list[list[tuple[float, int]]], int]:
    """Per query its k best (score, -id) of the candidates, and how many pairs were recomputed."""
    import numpy as np

    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    codes, scale, size, rest = quantised(q_data)
    codes = codes.astype(np.float32)  # sums of int8 products stay below 2^24: exact in float
    c_codes, c_scale, c_size, c_rest = quantised(c_data)
    floor = np.full(len(q_ids), -np.inf)
    again = 0
    for start in range(0, len(c_ids), SLICE):
        part = slice(start, start + SLICE)
        near = (codes @ c_codes[part].astype(np.float32).T) * scale[:, None] * c_scale[part]
        slack = size[:, None] * c_rest[part] + rest[:, None]
        own = q_ids[:, None] == c_ids[part]
        low = np.where(own, -np.inf, near - slack)
        n = low.shape[1]
        if n > k:
            floor = np.maximum(floor, np.partition(low, n - k, axis=1)[:, n - k])
        row, col = np.nonzero((near + slack >= floor[:, None]) & ~own)
        col += start
        again += len(row)
        for lo in range(0, len(row), 65_536):
            r, c = row[lo:lo + 65_536], col[lo:lo + 65_536]
            score = exact(q_data[r], c_data[c])
            for i, s, j in zip(r.tolist(), score.tolist(), c_ids[c].tolist(), strict=True):
                heap = heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, (s, -j))
                elif (s, -j) > heap[0]:
                    heapq.heapreplace(heap, (s, -j))
        full = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        floor = np.maximum(floor, full)
    return [sorted(h, reverse=True) for h in heaps], again


def nearest(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id",
            vector_col: str = "embedding", query_block: int = QUERY_BLOCK,
            candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest rows of each row where ``queries``."""
    rows = stored(
        vectors.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("bigint").alias("id"), usable(F.col(vector_col)).alias("v"),
            queries.alias("query")).where("v IS NOT NULL"), "vectors")
    size = rows.agg(F.count(F.lit(1)), F.count_if("query")).first()
    n_cand = max(1, -(-size[0] // candidate_block))
    n_query = max(1, -(-size[1] // query_block))
    cand = blocks(rows.select("id", "v"), n_cand, k).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    asked = blocks(rows.where("query").select("id", "v"), n_query, None).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))))
    tiles = asked.select(
        F.col("block").alias("qb"), "cb", "dim", F.col("ids").alias("q_ids"),
        F.col("data").alias("q_data")).hint("merge").join(
        cand.select("qb", F.col("block").alias("cb"), "dim", F.col("ids").alias("c_ids"),
                    F.col("data").alias("c_data")), ["qb", "cb", "dim"]) \
        .select("dim", "q_ids", "q_data", "c_ids", "c_data")

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                dim, qi, qd, ci, cd = [batch.column(i)[at].as_py() for i in range(5)]
                q_ids = np.frombuffer(qi, np.int64)
                best, _ = tile(q_ids, np.frombuffer(qd).reshape(-1, dim), np.frombuffer(ci, np.int64),
                               np.frombuffer(cd).reshape(-1, dim), k)
                flat = [(int(q), -j, s) for q, heap in zip(q_ids, best, strict=True)
                        for s, j in heap]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in flat], t)
                     for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                    names=["query_id", "vec_id", "score"])

    found = tiles.mapInArrow(multiply, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
