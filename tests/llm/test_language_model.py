"""Words of chunks in packets: what crosses the shuffles, and that every word gets its own figures back."""

import collections

from pyspark.sql import functions as F

from barflow.llm import language_model
from barflow.session import stored

SF = "/root/testdata/sf0.01"


def written(spark):
    """Bytes written to shuffles by this session so far."""
    each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def texts_of(row, vocab):
    words = iter(language_model.of_planes(row.words, "i4"))
    return [[vocab[next(words)] for _ in range(n)] for n in row.sizes]


def test_words_cross_shuffles_packed(spark, monkeypatch):
    docs = stored(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(8), "documents")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    # without training: its parameters are as many for any input
    monkeypatch.setattr(language_model, "trained", lambda chunks, stats: spark.createDataFrame(
        [], "block int, part int, tokens bigint, total binary"))
    monkeypatch.setattr(language_model, "LEAST_PARTS", 8, raising=False)
    before = written(spark)
    assert language_model.score(docs).count() == docs.count()
    assert written(spark) - before < 1.7 * size


def test_each_word_gets_its_own_figures(spark):
    texts = ["a b a", "b\x00c é A", None, "", " \n", "b 😀 \x85 \x00 x" + "y" * 5000, "A a é"] * 3
    docs = spark.createDataFrame([(i, i % 4 == 0, t) for i, t in enumerate(texts)],
                                 "id bigint, held_out boolean, text string").repartition(5)
    chunks = stored(language_model.chunked(docs), "chunks")
    words = stored(language_model.words_by_part(language_model.dealt(chunks, 3), None), "words")
    vocab = [w for r in chunks.collect() for w in language_model.unpacked(r.vocab)]
    counts = collections.Counter()
    for i, t in enumerate(texts):
        if i % 4:
            counts.update([*(t or "").encode().lower().split(), b""])
    stats = words.agg(F.sum("n"), F.sum("v"), F.sum("once"), F.sum("twice")).first()
    each = list(counts.values())
    assert stats == (sum(each), len(each), each.count(1), each.count(2))
    pieces = {w: language_model.pieces_of([w], None)[0] for w in set(vocab)}
    full = language_model.joined(
        chunks, language_model.answers(words, language_model.spelling_counts(words)), 3).collect()
    assert len(full) == chunks.count() == 5
    spells = {}
    by_ids = {tuple(r.ids): language_model.unpacked(r.vocab) for r in chunks.collect()}
    for r in full:
        own = by_ids[tuple(r.ids)]
        assert language_model.of_planes(r.c, "i8").tolist() == [counts[w] for w in own]
        assert language_model.of_planes(r["at"], "i4").tolist() == [pieces[w] for w in own]
        for w, s in zip(own, language_model.of_planes(r.spell, "f4"), strict=True):
            assert s < 0 and spells.setdefault(w, s) == s
        for i, own_words in zip(r.ids, texts_of(r, own), strict=True):
            assert own_words == (texts[i] or "").encode().lower().split()


def test_spelling_chances_by_plain_counts():
    import numpy as np
    import pandas as pd

    known, asked = [b"abc", b"abd", b"ba", "é".encode()], [b"", b"abc", b"abx", b"zz", "éa".encode()]

    def cells(words):
        symbol, short, long, sizes = language_model.spelling(words)
        return [tuple(map(int, x)) for x in zip(symbol, short, long, strict=True)], sizes

    seen = [collections.Counter((x[k], x[0]) for x in cells(known)[0]) for k in (1, 2)]
    rows = pd.DataFrame([(bool(k), c, s, n) for k in (0, 1) for (c, s), n in seen[k].items()],
                        columns=["long", "context", "symbol", "n"])
    want = []
    for x in cells(asked)[0]:
        p = 1 / 257
        for k in (0, 1):
            own = {s: n for (c, s), n in seen[k].items() if c == x[k + 1]}
            if own:
                p = (own.get(x[0], 0) + len(own) * p) / (sum(own.values()) + len(own))
        want.append(p)
    symbol, short, long, _ = language_model.spelling(asked)
    assert np.allclose(language_model.spelling_model(rows)(symbol, short, long), want, rtol=1e-12)
    assert np.allclose(language_model.spelling_model(rows[:0])(symbol, short, long), 1 / 257)
