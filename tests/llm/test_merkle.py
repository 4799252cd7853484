"""The manifest against a plain version, over one and several rounds of levels."""

import hashlib
import random
import zlib

import pytest

from barflow.llm import merkle

ROWS = [(i, f"text {i}", "a", lang, 10 + i) for i in range(1, 38) for lang in ("en", "de")]
ROWS += [(100, "x", None, "fr", 1), (101, "y", "s", None, None), (7, None, "s", None, 3), (None, "", "s", None, 3),
         (None, "other", "s", None, 3), (7, "é", "a", "en", 3), (14, "", "", "", 0)]
ROWS += [(5, "again", "a", "es", 2)] * 9


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_of(row):
    levels = [row]
    while len(row) > 1:
        row = [h(*row[i:i + 2]) for i in range(0, len(row), 2)]
        levels.append(row)
    return levels


def siblings(levels, at):
    out = []
    for row in levels[:-1]:
        other = at ^ 1
        out.append((at & 1, row[other] if other < len(row) else None))
        at //= 2
    return out


def plain(rows):
    groups = {}
    for doc_id, text, source, lang, n in rows:
        leaf = h(value(doc_id), value(source), value(lang), value(n), value(text))
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n is not None
        other = h(value(doc_id), value(source), value(lang), value(n + 1), value(text)) if changed else leaf
        groups.setdefault((lang is not None, (lang or "").encode()), []).append(
            ((doc_id is not None, doc_id or 0), leaf, other))
    trees = {}
    for key, held in groups.items():
        held.sort()
        trees[key] = tree_of([leaf for _, leaf, _ in held])
    top = tree_of([trees[k][-1][0] for k in sorted(trees)])
    root = top[-1][0]
    out = []
    for place, key in enumerate(sorted(groups)):
        for at, ((known, doc_id), leaf, other) in enumerate(groups[key]):
            path = siblings(trees[key], at) + siblings(top, place)
            for right, sibling in path:
                other = h(other) if sibling is None else h(sibling, other) if right else h(other, sibling)
            out.append((doc_id if known else None, leaf, trees[key][-1][0], root,
                        h(*[s for _, s in path if s]), other, other == root))
    return sorted(out, key=repr)


def documents(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, "x") for r in rows],
        "doc_id long, text string, source string, lang string, n_chars long, rank int, key string").repartition(3)


@pytest.mark.parametrize("bits", [2, 10])
def test_odd_rows_equal_the_plain_version(spark, as_dir, bits):
    path = as_dir(documents=documents(spark, ROWS))
    got = [tuple(r) for r in merkle.op13_merkle(spark, path, bits).collect()]
    assert sorted(got, key=repr) == plain(ROWS)


def test_one_row_is_its_own_root(spark, as_dir):
    rows = [(3, "only", "s", "en", 4)]
    got = merkle.op13_merkle(spark, as_dir(documents=documents(spark, rows))).collect()
    assert [tuple(r) for r in got] == plain(rows) and got[0].leaf == got[0].root


def test_empty_table(spark, as_dir):
    assert merkle.op13_merkle(spark, as_dir(documents=documents(spark, []))).collect() == []


def test_a_changed_leaf_or_step_breaks_a_proof():
    rng = random.Random(3)
    leaves = [rng.randbytes(32) for _ in range(13)]
    height = merkle.levels(13)
    top, records = merkle.page_records(leaves, height)
    children = {r["digest"]: r["children"] for r in records}
    for rank, leaf in enumerate(leaves):
        at, path = merkle.descend(top, rank, height, children)
        assert at == leaf and merkle.fold(leaf, path) == top
        assert merkle.fold(rng.randbytes(32), path) != top
        step = next(s for s in path if s["side"])
        assert merkle.fold(leaf, [s | {"side": 3 - s["side"]} if s is step else s for s in path]) != top
