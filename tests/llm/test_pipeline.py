"""The whole pipeline against a plain version: dictionaries and loops over all rows, stage by stage."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from test_shingle_pairs import kept_by_all_pairs

import corpus_pipeline
from barflow.llm import sentence_pieces

SPACE = re.compile(r"[\x09-\x0D\x20]+")
TRIM = "\t\n\x0b\x0c\r "
COMMON = "this line stands on most pages of its host and says nothing"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def good_rows(rows):
    """Quality rules: repeated windows, and lines of too many texts of a host."""
    texts = defaultdict(dict)  # host: text: least id
    for r in rows:
        held = texts[r["source"]]
        held[r["text"]] = min(held.get(r["text"], r["doc_id"]), r["doc_id"])

    def lines(text):
        return [(lower(" ".join(ws)), len(ws)) for ws in map(words, (text or "").split("\n")) if ws]

    over = {}
    for host, held in texts.items():
        holders = defaultdict(list)
        for text, least in held.items():
            for key in {k for k, _ in lines(text)}:
                holders[key].append((least, text))
        over[host] = {k: min(v)[1] for k, v in holders.items() if len(v) > 10}
    out = []
    for r in rows:
        ws = words(r["text"])
        at = defaultdict(list)
        for i in range(len(ws) - 7):
            at[tuple(ws[i:i + 8])].append(i)
        twice = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        gone = sum(n for k, n in lines(r["text"])
                   if over[r["source"]].get(k, r["text"]) != r["text"])
        left = len(ws) - gone
        failed = len(ws) < 20 or 100 * len(twice) > 30 * len(ws)
        if not (failed or left < 0.2 * len(ws) or (left < 0.5 * len(ws) and left < 20)):
            out.append(r)
    return out


def without_boilerplate(rows):
    pages, holders = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        for key in {line.strip(TRIM) for line in r["text"].split("\n")} - {""}:
            holders[r["source"], key] += 1
    out = []
    for r in rows:
        kept = [line for line in r["text"].split("\n")
                if not (holders[r["source"], line.strip(TRIM)] >= 3
                        and holders[r["source"], line.strip(TRIM)] > pages[r["source"]] * 0.1)]
        text = "\n".join(kept)
        out.append({**r, "text": text, "n_chars": len(text)})
    return out


def one_of_each(rows):
    """Near copies: the least id stays of rows linked by 0.8 or more of their 5-word shingles, found among all pairs."""
    least = set(kept_by_all_pairs([(r["doc_id"], r["text"]) for r in rows]))
    return [r for r in rows if r["doc_id"] in least]


def share(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2 ** 32


def mixed(rows):
    """Systematic sampling along one sorted list per source."""
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] > 2.0 * sizes[s]}
        if not capped:
            break
        target.update((s, 2.0 * sizes[s]) for s in capped)
        rest -= sum(2.0 * sizes[s] for s in capped)
        free -= capped
    target.update((s, level * weight[s]) for s in free)
    out = []
    for s in names:
        def place(r):
            bits = f"{len(words(r['text'])):b}"
            order = hashlib.md5(f"mix-1|{r['doc_id']}".encode()).hexdigest()
            return f"{len(bits):02d}{bits[:4]}", order, r["doc_id"]

        rate = target[s] / sizes[s] if sizes[s] else 0.0
        start = share(f"mix-1|{s or ''}")
        for k, r in enumerate(sorted((r for r in rows if r["source"] == s), key=place), 1):
            out += [r] * (math.floor(k * rate + start) - math.floor((k - 1) * rate + start))
    return out


def pieces(rows):
    """Each unit's best segmentation by the search, not by the arrays."""
    lattice = sentence_pieces.lattice_of(None)
    out = []
    for r in rows:
        best = 0.0
        for unit in lattice.split_units("▁" + r["text"].replace(" ", "▁")):
            best += lattice.search(unit, 1)[0][0]
        out.append((r["doc_id"], r["lang"], r["source"], r["n_chars"], round(best, 5), r["text"]))
    return out


def plain(rows):
    return pieces(mixed(one_of_each(without_boilerplate(good_rows(rows)))))


def run_rows(spark, sf_dir):
    """The pipeline's rows, the texts read back from the piece ids."""
    done = corpus_pipeline.run(spark, sf_dir)
    rows = done.collect()
    assert all(r.round_trip and len(r.pieces) == r.n_pieces for r in rows)
    model = sentence_pieces.lattice_of(None)
    flat = [i for r in rows for i in r.pieces]
    texts = model.decode_all(flat, [r.n_pieces for r in rows]) if rows else []
    return [(r.doc_id, r.lang, r.source, r.n_chars, round(r.n_best_scores[0], 5), t)
            for r, t in zip(rows, texts, strict=True)]


def test_pipeline_equals_the_plain_version(spark):
    path = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = sorted(plain(rows), key=repr)
    assert want and sorted(run_rows(spark, path), key=repr) == want


def near_copy(text, share):
    """``text`` with so many words changed at its end that about ``share`` of all 5-word shingles is in both."""
    ws = text.split(" ")
    n = len(words(text)) - 4
    changed = next(c for c in range(n) if (n - c) / (n + c) < share) - (share > 0.8)
    return " ".join(ws[:len(ws) - changed] + [f"other{i}" for i in range(changed)])


def test_pipeline_on_planted_rows(spark, docs_of, as_dir):
    def body(i):
        return "\n".join(" ".join(f"w{i}n{j}x{k}" for k in range(12)) for j in range(4))

    rows = [(i, f"{COMMON}\n{body(i)}" if i % 2 else body(i), "abc"[i % 3] if i % 7 else None)
            for i in range(120)]
    rows += [(200 + i, body(1), "a") for i in range(3)]  # exact copies
    rows += [(210 + i, near_copy(body(2 + i), share), "b") for i, share in enumerate((0.79, 0.81))]
    rows += [(300, "too short", "a"), (301, None, "b"), (302, "", None), (303, "again and again " * 60, "c")]
    docs = docs_of(rows)
    want = sorted(plain([r.asDict() for r in docs.collect()]), key=repr)
    got = sorted(run_rows(spark, as_dir(documents=docs)), key=repr)
    assert got == want
    assert not {r[0] for r in got} & {300, 301, 302, 303}
    assert {r[0] for r in got} <= {*range(120), 210} and 210 in {r[0] for r in got}
    assert not any(COMMON in r[5] for r in got)
