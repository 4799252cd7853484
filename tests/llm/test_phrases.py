"""Phrases against plain counting, with fingerprints that collide and tables that fill up."""

import random
import re
from collections import Counter

import pytest

from barflow.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, count int"
SPLIT = r"[.,;:!?\x0A-\x0D]"


def plain_counts(rows, max_words=5):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(SPLIT, text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, " ".join(words[i:i + n]), n] += 1
    return counts, sizes


def plain_collocations(rows, min_count, top):
    counts, sizes = plain_counts(rows)
    f = {(lang, phrase): c for (lang, phrase, _), c in counts.items()}
    found = {k: c for k, c in counts.items() if c >= min_count and k[2] > 1}
    scored = []
    for (lang, phrase, n), a in found.items():
        words = phrase.split(" ")
        cuts = []
        for k in range(1, n):
            left, right = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((1000 * a * sizes[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        inside = any(c >= a for (other, longer, m), c in found.items()
                     if other == lang and m > n and f" {phrase} " in f" {longer} ")
        if not inside:
            scored.append((lang, -score, -a, phrase.encode(), left, right))
    out, ranks = [], Counter()
    for lang, score, a, phrase, left, right in sorted(scored):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.append((lang, ranks[lang], phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def texts(seed=1, n=400):
    rng = random.Random(seed)
    words = ["a", "b", "c", "dd", "É", "\x00", "x" * 90, "A", "été", "#"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b", "?!"]
    rows = []
    for _ in range(n):
        size = rng.randrange(0, 60)
        rows.append(("".join(rng.choice(words[:rng.randrange(1, 10)]) + rng.choice(ends[:rng.randrange(1, 9)])
                             for _ in range(size)), rng.choice(["en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), (" \n\t.,", "de"), ("the same line here\n" * 300, "en"),
            *[("copies of one text", "de")] * 50]


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 7) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.mark.parametrize("filter_bits, key_bits", [(27, 64), (12, 64), (10, 8), (20, 3)])
def test_equal_to_plain_counting(spark, filter_bits, key_bits):
    """Few filter bits fill the tables, few key bits make nearly all fingerprints collide."""
    rows = texts()
    found, sizes = phrases.phrases(table_of(spark, rows), min_count=40, filter_bits=filter_bits, key_bits=key_bits)
    counts, want = plain_counts(rows)
    assert {r.lang: r.n for r in sizes.collect()} == want
    got = [((r.lang, r.phrase, r.words), r["count"]) for r in found.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: c for k, c in counts.items() if c >= 40}
    ranked = phrases.collocations(found, sizes, top=30).collect()
    assert sorted(tuple(r) for r in ranked) == plain_collocations(rows, 40, 30)


def test_blocks_are_cut_between_pieces():
    import numpy as np
    import pyarrow as pa

    texts = ["one two, three four. " * 50, "", "no end of piece here " * 40, "x"]
    body, ends, words = phrases.plain_bodies(*phrases.column_bytes(pa.array(texts)))
    assert words.tolist() == [200, 0, 200, 1]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3, 4]), pa.array(["a"] * 4), pa.array(words), phrases.binary_column(body, ends)],
        names=["row", "lang", "words", "body"])
    small = list(phrases.blocks([batch], size=64))
    assert len(small) > 15 and sum(len(b.end) for b in small) == 401
    assert all(b.body[-1] == phrases.LINE for b in small)
    assert sorted(np.concatenate([b.keys(b.grams(3), 3) for b in small]).tolist()) == sorted(
        next(phrases.blocks([batch])).keys(next(phrases.blocks([batch])).grams(3), 3).tolist())


def test_scores_beyond_64_bits(spark):
    big = 40_000_000_000_000
    found = spark.createDataFrame([("en", "a b", 2, big - 7), ("en", "a", 1, big), ("en", "b", 1, 2 * big)],
                                  "lang string, phrase string, words int, count long")
    sizes = spark.createDataFrame([("en", 50 * big)], "lang string, n long")
    row = phrases.collocations(found, sizes).first()
    assert row.score == 1000 * (big - 7) * 50 * big // (big * 2 * big)


def test_query_equals_sql_on_odd_rows(spark, as_dir):
    path = as_dir(documents=table_of(spark, texts(seed=5)))
    got = [tuple(r) for r in phrases.op12_phrases(spark, path).collect()]
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert sorted(got) == sorted(con.execute(phrases.SQL).fetchall()) and got


def test_empty_table(spark, as_dir):
    assert phrases.op12_phrases(spark, as_dir(documents=table_of(spark, []))).collect() == []
