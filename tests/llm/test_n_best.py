"""The N best segmentations themselves: scores, order and decoding, against all segmentations."""

from barflow.llm import sentence_pieces


def spliced(pieces, changes):
    out, at = [], 0
    for start, stop, new in changes:
        out += [*pieces[at:start], *new]
        at = stop
    return [*out, *pieces[at:]]


def every(model, text):
    if not text:
        return [(0.0, [])]
    out = []
    for k in range(1, len(text) + 1):
        s = model.score.get(text[:k], model.unknown if k == 1 else None)
        if s is not None:
            out += [(s + rest, [text[:k], *more]) for rest, more in every(model, text[k:])]
    return out


def test_all_n_segmentations_against_brute_force():
    model = sentence_pieces.lattice_of(None)
    for text in ["the thin", "a  b", "x", "über\nz", "😀 ok", "  ", "in the of on", ""]:
        ids, counts, (found,) = model.encode_n_best([text], 4)
        want = every(model, "▁" + text.replace(" ", "▁")) if text else [(0.0, [])]
        by_ids = {tuple(model.ids_of(p)): s for s, p in want}
        best = sorted((s for s, _ in want), reverse=True)[:4]
        got = [spliced(ids.tolist(), c) for _, c in found]
        assert len({tuple(g) for g in got}) == len(got) == len(best)
        for (score, _), g, s in zip(found, got, best, strict=True):
            assert abs(score - s) < 1e-9 and abs(by_ids[tuple(g)] - s) < 1e-9
            assert model.decode_all(g, [len(g)]) == [text]


def test_query_returns_n_segmentations_of_each_text(spark):
    model = sentence_pieces.lattice_of(None)
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in sentence_pieces.op1_sentence_pieces(spark, path).collect():
        got = [spliced(r.pieces, c) for c in r.n_best_changes]
        assert len({tuple(g) for g in got}) == len(got) == len(r.n_best_scores)
        assert not r.n_best_changes or r.n_best_changes[0] == []
        assert all(model.decode_all(g, [len(g)]) == [texts[r.doc_id] or ""] for g in got)
