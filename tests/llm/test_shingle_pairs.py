"""Near copies by 5-word shingles against all pairs."""

import random

import corpus_pipeline
from barflow.llm import shingle_pairs


def sets_of(texts):
    out = []
    for t in texts:
        ws = (t or "").encode().lower().split()
        out.append({tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    return out


def kept_by_all_pairs(rows):
    sets = sets_of([t for _, t in rows])
    holders = {}
    for i, s in enumerate(sets):
        for x in s or {()}:
            holders.setdefault(x, []).append(i)
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, s in enumerate(sets):
        for j in {j for x in s or {()} for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def planted(rng):
    """Copies with edits on both sides of the limit, a crowd, a chain and a common passage."""
    def text(n):
        return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]

    texts = [text(rng.choice([1, 4, 5, 6, 30, 200])) for _ in range(60)]
    for base in list(texts):
        for edits in (1, 2, 3, 5):
            new = list(base)
            for _ in range(edits):
                new[rng.randrange(len(new))] = f"e{rng.randrange(10 ** 6)}"
            texts.append(new)
    crowd = text(150)
    for _ in range(700):
        new = list(crowd)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            new[rng.randrange(150)] = f"e{rng.randrange(10 ** 6)}"
        texts.append(new)
    chain = text(200)
    for i in range(20):
        chain = chain[5:] + text(5)
        texts.append(chain)
    passage = text(100)
    texts += [passage + text(rng.choice([20, 40, 100])) for _ in range(80)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(9000, None), (9001, ""), (9002, " \n"), (9003, rows[0][1]), (9004, rows[0][1].upper())]


def test_planted_rows_against_all_pairs(spark, docs_of, monkeypatch):
    monkeypatch.setattr(shingle_pairs, "BLOCK", 100)
    rows = planted(random.Random(4))
    docs = docs_of([(i, t, "a") for i, t in rows])
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == kept_by_all_pairs(rows)


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == kept_by_all_pairs(rows)


def test_empty_table(spark, docs_of):
    assert corpus_pipeline.near_dedup(spark, docs_of([]), "").collect() == []


def test_fingerprints_name_verified_links(spark, docs_of):
    """SimHash finds texts that differ in a word; equal or near fingerprints alone make no link."""
    from barflow.session import stored
    from pyspark.sql import functions as F

    long = [f"w{i}" for i in range(4000)]
    texts = {1: " ".join(long), 2: " ".join(long[:-1] + ["x"]), 3: "a b c d e", 4: " ".join(f"v{i}" for i in range(300))}
    docs = stored(docs_of([(i, t, "a") for i, t in texts.items()]).select(F.col("doc_id").alias("r"), "text"), "docs")
    prints = stored(shingle_pairs.first_quarters(docs.withColumnRenamed("r", "row"))
                    .select(F.col("row").alias("r"), "fp"), "prints")
    assert [tuple(r) for r in shingle_pairs.fingerprint_links(prints, docs).collect()] == [(1, 2)]
    clash = prints.withColumn("fp", F.lit(7).cast("bigint"))
    assert [tuple(r) for r in shingle_pairs.fingerprint_links(clash, docs).collect()] == [(1, 2)]
