"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its different words, pairs of neighbours and pairs with one word between,
hashed to 2^20 buckets. FTRL-proximal keeps a rate per coordinate and sets weights to exact zero
until their evidence outweighs the L1 term, so the model is a short list of (bucket, weight), at most
2^20 of them whatever the corpus, and is broadcast. Scoring reads every whole text once.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the least MD5 of their id; their
features are made by the executors, and one task runs the sequential updates over them.

Cases: a null or empty text has no features and scores the intercept; labels that are null are left
out, and a document with several labels counts as toxic if one says so; without any label the score
is 0.25; repeated rows are scored alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import encoded, slices, table

BITS = 20
TRAIN_ROWS = 8_000
EPOCHS = 4
#: The L1 term is L1 x sqrt(training rows), as the noise in a coordinate's gradient sum grows.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.065, 0.1
#: Different words whose hashes a Python worker keeps at most.
KEPT_WORDS = 400_000
INTERCEPT = -1


def held_out(id_col: str, folds: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


@functools.cache
def word_hashes() -> dict[bytes, int]:
    return {}


def features(texts: list[bytes]):
    """Buckets of all texts one after another, and the text of each; repeats included."""
    import numpy as np
    from xxhash import xxh64_intdigest

    known = word_hashes()
    if len(known) > KEPT_WORDS:
        known.clear()
    split = [t.lower().split() for t in texts]
    words = [w for ws in split for w in ws]
    for w in set(words).difference(known):
        known[w] = xxh64_intdigest(w, 7)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
    shift = np.uint64(64 - BITS)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    parts, docs = [(h * a) >> shift], [doc]
    for gap, salt in ((1, np.uint64(0xD6E8FEB86659FD93)), (2, np.uint64(0xA5CB3B1F1E7D4C69))):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            pair = ((h[:-gap] * a) ^ (h[gap:] * b)) * salt
            parts.append((pair >> shift)[same])
            docs.append(doc[gap:][same])
    return np.concatenate(parts).astype(np.int64), np.concatenate(docs)


def fit(examples, labels, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
        l1: float = L1, l2: float = L2) -> dict[int, float]:
    """Weights by bucket, the intercept at ``INTERCEPT``. ``examples``: arrays of different buckets."""
    import numpy as np

    size = 1 << BITS
    l1 = l1 * len(labels) ** 0.5
    positive = float(sum(labels))
    base = float(np.log((positive + 0.5) / (len(labels) - positive + 1.5)))
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for buckets, y in zip(examples, labels, strict=True):
            at = np.append(buckets, size)
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(base + w.sum(), -35, 35)))
            g = p - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    every = weights(np.arange(size + 1))
    out = {int(i): float(every[i]) for i in np.flatnonzero(every[:size])}
    out[INTERCEPT] = base + float(every[size])
    return out


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          label_col: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows (bucket, weight) of the model fitted on labelled rows that are in ``labels``."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    order = F.md5(F.col("_id").cast("string"))
    chosen = marked.orderBy(order, "_id").limit(rows)
    found = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(
        order.alias("o"), F.col("_y").alias("y"), F.col(text_col).alias("text"))

    def hashed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 256):
            texts = encoded(batch.column(2))
            bucket, doc = features(texts)
            pair = np.unique(doc * (1 << BITS) + bucket)
            sizes = np.bincount(pair >> BITS, minlength=len(texts))
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = pa.array((pair & ((1 << BITS) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), flat)],
                names=["o", "y", "f"])

    def fitted(key, frame):
        import numpy as np
        import pandas as pd

        frame = frame.sort_values(["o", "y"], kind="stable")
        model = fit([np.asarray(f, np.int64) for f in frame["f"]], frame["y"].tolist())
        return pd.DataFrame({"bucket": list(model), "weight": list(model.values())})

    return (found.mapInArrow(hashed, "o string, y int, f array<int>").withColumn("one", F.lit(1))
            .groupBy("one").applyInPandas(fitted, "bucket int, weight double"))


def score(docs: DataFrame, model: DataFrame, text_col: str = "text",
          id_col: str = "doc_id") -> DataFrame:
    """Rows (id, score) for every row of ``docs``. ``model`` has at most 2^20 + 1 rows."""
    import numpy as np

    rows = model.toPandas()
    plain = rows[rows["bucket"] != INTERCEPT]
    at, w = plain["bucket"].to_numpy(np.int64), plain["weight"].to_numpy(np.float64)
    base = rows.loc[rows["bucket"] == INTERCEPT, "weight"]
    base = float(base.iloc[0]) if len(base) else float(np.log(1 / 3))
    shared = docs.sparkSession.sparkContext.broadcast((at, w, base))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        at, w, base = shared.value
        weight = np.zeros(1 << BITS)
        weight[at] = w
        for batch in slices(batches, 512):
            texts = encoded(batch.column(1))
            bucket, doc = features(texts)
            hit = weight[bucket] != 0
            pair = np.unique(doc[hit] * (1 << BITS) + bucket[hit])
            total = np.bincount(pair >> BITS, weight[pair & ((1 << BITS) - 1)], len(texts)) + base
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -700, 700))))],
                names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(~held_out("doc_id", 5)))
    return score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 5).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
