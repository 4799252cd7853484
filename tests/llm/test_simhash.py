import random

import pytest
import xxhash

from barflow.llm import simhash
from barflow.session import stored


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return [best.get(find(i)) for i in range(len(rows))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_near_copies_in_chains_and_crowds(spark):
    rng = random.Random(3)
    prints = [(i, rng.getrandbits(64)) for i in range(150)]
    for base in range(5):  # crowds: one and two flips of one print
        for k in range(40):
            p = prints[base][1]
            for b in rng.sample(range(64), rng.choice([0, 1, 1, 2])):
                p ^= 1 << b
            prints.append((1000 + base * 100 + k, p))
    p = prints[9][1]
    for k in range(30):  # a chain: each two flips from the last
        for b in rng.sample(range(64), 2):
            p ^= 1 << b
        prints.append((5000 - k, p))
    prints += [(7000, 0), (7001, 3), (7002, (1 << 64) - 1), (7003, (1 << 64) - 1 - (1 << 63)),
               (None, 1), (None, rng.getrandbits(64)), (7000, 0)]
    rng.shuffle(prints)
    df = spark.createDataFrame([(d, signed(p)) for d, p in prints], "id long, fp long")
    got = simhash.near_duplicates(stored(df, "prints")).collect()
    expected = {(d, signed(p), c) for (d, p), c in zip(prints, brute_components(prints), strict=True)}
    assert {tuple(r) for r in got} == expected
    assert len(got) == len(prints)


def test_query_on_odd_texts(spark, docs_of, as_dir):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (4, "one", "a"), (5, "ONE", "b"),
            (6, "a b", "a"), (7, "a b c", "a"), (8, base, "a"), (9, base + " tail", "a"),
            (10, base.upper(), "a"), (None, base, "a"), (11, "x y z   q", "a"),
            (12, "long " * 60000, "a"), (8, base, "a")]
    got = simhash.op7_simhash(spark, as_dir(documents=docs_of(rows))).collect()
    prints = [(i, brute_print(t)) for i, t, _ in rows]
    want = sorted((repr(d), f"{p:016x}", c)
                  for (d, p), c in zip(prints, brute_components(prints), strict=True))
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_empty_table(spark, docs_of, as_dir):
    assert simhash.op7_simhash(spark, as_dir(documents=docs_of([]))).collect() == []


def test_keep_one_keeps_the_smallest_id_and_all_columns(spark, docs_of):
    text = " ".join(f"t{i}" for i in range(50))
    docs = docs_of([(3, text, "a"), (2, text, "b"), (2, text, "b"), (5, "other words here", None),
                    (None, text, "c"), (7, None, "a"), (6, "", "a")]).selectExpr("*", "1 AS fp", "2 AS id")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 5, 6]


@pytest.mark.parametrize("scale", ["0.01"])
def test_whole_table_against_brute_force(spark, scale):
    path = f"/root/testdata/sf{scale}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet")
            .select("doc_id", "text").collect()]
    prints = [(d, brute_print(t)) for d, t in rows]
    want = sorted((d, f"{p:016x}", c)
                  for (d, p), c in zip(prints, brute_components(prints), strict=True))
    assert sorted(tuple(r) for r in simhash.op7_simhash(spark, path).collect()) == want
