"""The additive model: measures against a plain version, its tables, and labels that it has not seen."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from barflow.llm import additive
from barflow.llm.phrases import column_bytes

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "one", "Two words.", "a a a b\n\na a a b\n| x |\n", "É 😀 Σ" * 20, "### !!! ???", "x" * 5000,
       "THE END!!\nthe end. 12\x0b34\r\n(a) {b} 'c' d=e\n", "\x00 \x00 .\n\x00 \x00 .", "line\n" * 40 + "other line."]


def plain(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\t\n\x0b\x0c\r ]+", raw)
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\t\n\x0b\x0c\r ]", x)]
    per_line = [len(re.findall(rb"[^\t\n\x0b\x0c\r ]+", x)) for x in lines]
    count = {k: sum(c in chars for c in raw) for k, chars in additive.KINDS.items()}
    pairs = list(zip(words, words[1:]))
    letter = re.compile(rb"[A-Za-z\x80-\xff]")

    def share(part, whole):
        return part / max(whole, 1)

    sizes = Counter(raw)
    return {
        "words": math.log2(1 + len(words)), "word_bytes": share(sum(map(len, words)), len(words)),
        "long_words": share(sum(len(w) > 12 for w in words), len(words)),
        "short_words": share(sum(len(w) < 3 for w in words), len(words)),
        **{k: share(count[k], len(raw)) for k in ("symbols", "shouts", "stops", "digits", "beyond_ascii", "brackets")},
        "upper": share(count["upper"], count["upper"] + count["lower"]),
        "entropy": -sum(c / len(raw) * math.log2(c / len(raw)) for c in sizes.values()),
        "line_words": math.log2(1 + share(len(words), len(lines))),
        "short_lines": share(sum(n < 4 for n in per_line), len(lines)),
        "line_copies": share(len(lines) - len(set(lines)), len(lines)),
        "distinct_words": share(len(set(words)), len(words)),
        "pair_copies": share(len(pairs) - len(set(pairs)), len(pairs)),
        "top_word": share(max(Counter(words).values(), default=0), len(words)),
        "no_letters": share(sum(not letter.search(w) for w in words), len(words)),
        "symbol_ends": share(sum(w[-1] in additive.KINDS["symbols"] for w in words), len(words)),
        "line_stops": share(sum(x.endswith(b".") for x in lines), len(lines)),
        "stutter": share(sum(a == b for a, b in pairs), len(words)),
    }


def test_measures_equal_the_plain_version():
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aB é#!.\n \t|1(") for _ in range(rng.randrange(300))) for _ in range(60)]
    got = additive.measures(*column_bytes(pa.array(texts)))
    want = np.array([[plain(t)[k] for k in additive.NAMES] for t in texts])
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
    alone = np.vstack([additive.measures(*column_bytes(pa.array([t], pa.string()))) for t in texts])
    np.testing.assert_array_equal(alone, got)


def test_line_tree_takes_the_best_cuts():
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=12) * 9, rng.random(12) * 9 + 5

    def gain(parts):
        return sum(g[a:b].sum() ** 2 / (h[a:b].sum() + additive.SMOOTH) for a, b in parts)

    best = max(range(1, 12), key=lambda c: gain([(0, c), (c, 12)]))
    two = additive.line_tree(g, h, leaves=2)
    want = np.repeat([additive.leaf_value(g[:best], h[:best]), additive.leaf_value(g[best:], h[best:])], [best, 12 - best])
    np.testing.assert_allclose(two, want)
    assert len(set(additive.line_tree(g, h))) <= 4


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)

    def right(model):
        return ((additive.sum_of_tables(model, x) > 0) == (y > 0)).mean()

    assert right(additive.fit(x, y, pairs=0)) < 0.65
    model = additive.fit(x, y, pairs=1)
    assert right(model) > 0.97 and (model[-1]["a"], model[-1]["b"]) == (0, 2)


def test_sum_of_tables_is_a_plain_lookup():
    model = additive.fit(np.random.default_rng(1).random((500, 4)), np.arange(500) % 3 > 0, rounds=5, pairs=2, pair_rounds=3)
    for row in np.random.default_rng(9).random((20, 4)):
        total = 0.0
        for t in model:
            cell = sum(row[t["a"]] >= c for c in t["cuts_a"]) if t["a"] >= 0 else 0
            if t["b"] >= 0:
                cell = cell * (len(t["cuts_b"]) + 1) + sum(row[t["b"]] >= c for c in t["cuts_b"])
            total += t["values"][cell]
        assert additive.sum_of_tables(model, row[None])[0] == pytest.approx(total)


def test_labels_it_has_not_seen(spark):
    rows = additive.op11_quality_model(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in seen if y], [s for s, y, _ in seen if not y]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert len(rows) == 1000 and auc > 0.97
    assert sum(p for _, y, p in seen if y) / len(good) > 0.95
    assert sum(p for _, y, p in seen if not y) / len(bad) < 0.2


def test_odd_rows_and_unused_labels(spark, as_dir):
    docs = spark.createDataFrame([(None if i == 3 else i, t, 1, "x") for i, t in enumerate([*ODD, "one"])],
                                 "doc_id long, text string, id int, score string").repartition(2)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    for labels, want in ((none, 0.75), (spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int"), None)):
        rows = additive.op11_quality_model(spark, as_dir(documents=docs, labels=labels)).collect()
        assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
        assert want is None or all(r.score == pytest.approx(want) for r in rows)


def test_empty_tables(spark, as_dir):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert additive.op11_quality_model(spark, as_dir(documents=docs, labels=labels)).collect() == []
