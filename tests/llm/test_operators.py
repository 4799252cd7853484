"""The corpus operators against plain versions, on whole tables and on odd rows."""

import base64
import hashlib
import math
import random
import zlib

import pytest
from parity import compare

import corpus_pipeline
from barflow.llm import (
    language_model, mixing, neighbours, quality, queries, sentence_pieces, shingle_pairs, simhash, site_lines,
    token_counts, toxicity, warc,
)
from barflow.llm.common import word_count

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet " * 12000
ODD = [(1, None, "a"), (2, "", None), (3, " \n\t\x0b", "a"), (4, "one", "a"), (None, "no id here", "b"),
       (5, "same text twice", "b"), (5, "same text twice", "b"), (6, LONG, "a"),
       (7, "é 😀 Σίσυφος \x85 x <|endoftext|>  two  spaces ", "c"), (8, "\n\nline\nline\n", "a")]
ON_DOCS = ["op1_sentence_pieces", "op2_language_model", "op3_quality", "op6_mix_sources",
           "op7_simhash", "op9_token_counts", "op10_site_lines", "pipeline"]


def all_queries():
    return queries.QUERIES | {"pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok, note


@pytest.mark.parametrize("name", ON_DOCS)
def test_odd_rows_and_extra_columns(spark, docs_of, as_dir, name):
    docs = docs_of(ODD).selectExpr("*", "1 AS id", "'x' AS size", "2 AS row", "3 AS copies", "4 AS fp")
    rows = all_queries()[name](spark, as_dir(documents=docs)).collect()
    if name != "pipeline":
        assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(i) for i, _, _ in ODD)


@pytest.mark.parametrize("name", ON_DOCS)
def test_empty_table(spark, docs_of, as_dir, name):
    assert all_queries()[name](spark, as_dir(documents=docs_of([]))).collect() == []


def test_sentence_pieces_n_best_against_all_segmentations():
    model = sentence_pieces.lattice_of(None)

    def every(text):
        if not text:
            return [0.0]
        out = []
        for k in range(1, len(text) + 1):
            s = model.score.get(text[:k], model.unknown if k == 1 else None)
            if s is not None:
                out += [s + rest for rest in every(text[k:])]
        return out

    for text in ["the thin", "a  b", "x", "über\nz", "😀 ok", "  "]:
        best = sorted(every("▁" + text.replace(" ", "▁")), reverse=True)[:4]
        ids, counts, scores = model.encode([text], 4)
        assert scores[0] == best
        assert [s for s, _ in model.search("▁" + text.replace(" ", "▁"), 4)] == best
        assert model.decode_all(ids, counts) == [text]


def test_sentence_pieces_round_trip(spark):
    rows = sentence_pieces.op1_sentence_pieces(spark, SF).collect()
    assert all(r.round_trip for r in rows)
    assert all(r.n_best_scores == sorted(r.n_best_scores, reverse=True) for r in rows)


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.id: r.n_tokens for r in token_counts.token_counts(
        spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    rng = random.Random(5)
    letters = "aabcΣσééİ 0١'s!<|endoftext|>\x1c\x85 字😀ßǅ"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)]
    odd += ["a" * 3001, "<|startoftext|>x<|endoftext|>", "can't WE'RE", ""]
    counts = token_counts.tokens_of(None).of([t.encode() for t in odd])
    assert counts.tolist() == [len(model.encode(t, add_special_tokens=False).ids) for t in odd]


def test_language_model_base_and_held_out(spark):
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in
            spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = {}
    for i, words in docs.items():
        if not held[i]:
            for w in [*words, b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    rows = language_model.op2_language_model(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = [*docs[r.doc_id], b""]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(words), n)
        assert r.n_known == sum(w in counts for w in words)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0


def test_attention_gradient_and_causality():
    import numpy as np

    model, step = language_model.Attention(), language_model.STEP
    rng = np.random.default_rng(0)
    tok = np.concatenate([np.full(2 + step, -1), rng.integers(0, 12, 3 * step)]).astype(np.int32)
    new = rng.uniform(0.01, 0.1, (3, step))
    chance = model.forward(tok, tok, tok + language_model.BUCKETS, new)[-1]
    later = tok.copy()
    later[-5] = 99
    again = model.forward(later, later, later + language_model.BUCKETS, new)[-1]
    # a token says nothing of those before it
    assert np.allclose(chance.ravel()[:-5], again.ravel()[:-5])
    # a run gives what its parts give
    part = model.forward(tok[2 * step:], tok[2 * step:], tok[2 * step:] + language_model.BUCKETS, new[2:])[-1]
    assert np.allclose(chance[2:], part)
    before = np.log(chance).sum()
    for _ in range(30):
        model.train(tok, tok, tok + language_model.BUCKETS, new)
    assert np.log(model.forward(tok, tok, tok + language_model.BUCKETS, new)[-1]).sum() > before


def test_attention_gradient_by_differences():
    import numpy as np

    step = language_model.STEP
    rng = np.random.default_rng(3)
    tok = np.concatenate([np.full(2 + step, -1), rng.integers(0, 9, 2 * step)]).astype(np.int32)
    tok[-7:] = -1
    args = tok, tok, tok + language_model.BUCKETS, rng.uniform(0.01, 0.1, (2, step))

    def total(model):
        return np.log(model.forward(*args)[-1][tok[2 + step:].reshape(-1, step) >= 0]).sum()

    model = language_model.Attention()
    for v in model.p.values():  # with more digits than in use
        v += rng.normal(0, 0.05, v.shape).astype(np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    # with squares of a very large start, a step is RATE x gradient / (n x 1e3)
    moved = language_model.Attention()
    moved.p = {k: v.copy() for k, v in model.p.items()}
    moved.square = {k: np.full(v.shape, 1e6) for k, v in model.p.items()}
    _, n = moved.train(*args)
    for name in model.p:
        slope = (moved.p[name] - model.p[name]) * n * 1e3 / language_model.RATE
        way = rng.normal(size=slope.shape) * (slope != 0)
        ends = []
        for sign in (1, -1):
            near = language_model.Attention()
            near.p = {k: v + sign * 1e-5 * way if k == name else v for k, v in model.p.items()}
            ends.append(total(near))
        assert np.isclose((ends[0] - ends[1]) / 2e-5, (slope * way).sum(), rtol=2e-2, atol=1e-2), name


def test_quality_keeps_one_of_copies_and_rejects_depleted(spark, docs_of):
    body = " ".join(f"shared{i}" for i in range(60))
    rows = [(i, f"{body}\nown{i}", "a") for i in range(30)]  # near copies on one host
    rows += [(100 + i, " ".join(f"w{i}x{j}" for j in range(40)), "a") for i in range(5)]
    rows += [(200 + i, body, "b") for i in range(50)]  # exact copies count once
    kept = {r.doc_id for r in quality.keep_good(docs_of(rows)).collect()}
    assert kept == {0, *range(100, 105), *range(200, 250)}


def test_warc_segments_marks_and_revisits(spark):
    big = "äb\r\n" * 3000 + "WARC/1.1\r\nWARC-Type: response\r\n" + "z" * 5000
    rows = [(1, "u\r\nX: y", big), (2, "u", "x"), (3, "u", "x"), (4, None, None), (5, "u", ""),
            (None, "u", "lonely"), (6, "u", "WARC/1.1"), (7, "u", "\r\n\r\n"), (8, "u", big + "!")]
    import tempfile
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path,
                        chunk_chars=1000)
    got = {r.id: r for r in warc.read_records(spark, path).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[None if i is None else str(i)]
        assert (r.bytes, r.digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.intact
        owner = {2: "3", 4: "5"}.get(i)
        assert (r.record_type, r.refers_to) == (("revisit", owner) if owner else ("response", None))


def test_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[50][1]) for i in range(300)]  # a very common vector
    rows += [(2001, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, []),
             (2200, [1e300] * 16), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df["vec_id"] % 50 == 0, query_block=7, candidate_block=64).collect()
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and np.isfinite(v).all()
            and np.any(v)]
    want = {}
    for q, a in good:
        if q % 50 == 0:
            a = a / np.abs(a).max()
            sims = [(-round(float(a @ (b / np.abs(b).max())) / float(np.linalg.norm(a) * np.linalg.norm(
                b / np.abs(b).max())), 9), i) for i, b in good if i != q]
            want[q] = [i for _, i in sorted(sims)[:5]]
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == want


def test_mixing_meets_targets(spark):
    rows = mixing.op6_mix_sources(spark, "/root/testdata/sf0.01").collect()
    taken, largest = {}, {}
    for r in rows:
        assert r.taken in (0, r["size"], 2 * r["size"])
        source = (r.source_size, r.target)
        taken[source] = taken.get(source, 0) + r.taken
        largest[source] = max(largest.get(source, 0), r["size"])
    assert all(abs(taken[s] - s[1]) <= largest[s] for s in taken)


def test_toxicity_on_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, path).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)
    hit = sum(r.predicted for r in rows if labels[r.doc_id]) / sum(labels[r.doc_id] for r in rows)
    assert right > 0.95 and hit > 0.6


def test_toxicity_without_labels(spark, docs_of, as_dir):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.op8_toxicity(spark, as_dir(documents=docs_of(ODD), labels=labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)


def test_site_lines_keep_order_and_blank_lines(spark, docs_of):
    rows = [(i, f"menu\n\ntext {i}\n menu", "a") for i in range(10)] + [(99, "menu\nx", None)]
    got = {r.doc_id: r.text for r in site_lines.drop_boilerplate(docs_of(rows)).collect()}
    assert got[3] == "\ntext 3" and got[99] == "menu\nx"


def test_pipeline_against_plain_stages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.round_trip for r in rows)
    assert all(r.doc_id in docs for r in rows)
    kept = {r.doc_id for r in quality.op3_quality(spark, SF).collect() if r.kept}
    assert {r.doc_id for r in rows} <= kept
    copies = {}
    for r in rows:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 2
    firsts = {r.component_id for r in simhash.op7_simhash(spark, SF).collect()}
    assert len({r.doc_id for r in rows}) <= len(firsts)


CLASHING = ["_row", "_mix", "_mix_size", "_mix_src", "_copy", "_host", "_all", "_gone", "_rest", "_text", "doc", "row", "size",
            "text_", "_lines"]


@pytest.mark.parametrize("name, reserved", [("mix", "_mix"), ("simhash", None), ("shingles", None), ("lines", "_lines")])
def test_columns_of_any_name_are_carried(spark, docs_of, name, reserved):
    rows = [(i, f"text {i} of some words\nand a line\nof its own {i * i}", "ab"[i % 2]) for i in range(40)]
    docs = docs_of(rows).selectExpr("*", *[f"doc_id * 100 + {k} AS `{c}`" for k, c in enumerate(CLASHING)])
    got = {
        "mix": lambda: mixing.emit(mixing.mix(docs, word_count("text"))),
        "simhash": lambda: simhash.keep_one(docs), "shingles": lambda: shingle_pairs.keep_one(docs),
        "lines": lambda: site_lines.drop_boilerplate(docs).drop("_lines"),
    }[name]()
    kept = [c for c in CLASHING if c != reserved]
    assert got.columns == [c for c in docs.columns if c != reserved]
    found = got.collect()
    assert found
    for r in found:
        assert [r[c] for c in kept] == [r.doc_id * 100 + CLASHING.index(c) for c in kept]


def test_an_unbroken_string_takes_memory_in_proportion():
    import tracemalloc

    model = sentence_pieces.lattice_of(None)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    tracemalloc.start()
    try:
        found = model.search("▁" + text, 4)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20
    assert len({tuple(p) for _, p in found}) == 4
    assert all("".join(p) == "▁" + text for _, p in found)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


@pytest.mark.parametrize("others", [300, 9000])
def test_a_template_is_judged_alike_on_hosts_of_any_size(spark, docs_of, others):
    def lines(name, n):
        return [" ".join(f"{name}{j}w{k}" for k in range(9)) for j in range(n)]

    rows = [(i, "\n".join(lines(f"page{i}x", 4)), "a") for i in range(others)]
    rows += [(100_000 + i, "\n".join([*lines("template", 9), f"no {i}"]), "a") for i in range(25)]
    kept = {r.doc_id for r in quality.keep_good(docs_of(rows)).select("doc_id").collect()}
    assert kept == {*range(others), 100_000}


@pytest.mark.parametrize("n", [0, 3])
def test_pages_vectors_and_labels_empty_or_with_more_columns(spark, as_dir, n):
    def some(rows, schema):
        df = spark.createDataFrame(rows[:n], schema)
        return df.selectExpr("*", "1 AS id", "2 AS row", "'x' AS record", "3 AS score", "4 AS rank", "5 AS kind")

    path = as_dir(
        pages=some([(1, "u", "<p>"), (2, None, None), (None, "u", "<p>")], "page_id long, url string, html string"),
        embeddings=some([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None)], "vec_id long, embedding array<float>"),
        documents=some([(1, "some text"), (2, None), (None, "")], "doc_id long, text string"),
        labels=some([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int"))
    found = {q: queries.QUERIES[q](spark, path).collect() for q in ("op4_warc", "op5_neighbours", "op8_toxicity")}
    assert {q: len(rows) for q, rows in found.items()} == {
        "op4_warc": n, "op5_neighbours": 1 if n else 0, "op8_toxicity": n}
