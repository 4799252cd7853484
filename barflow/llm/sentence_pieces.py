"""SentencePiece encoding and decoding with exact N-best segmentation.

A text is normalised as the model's own normaliser does it (a leading space is added and spaces
become U+2581), and every way to cut it into pieces is a path of the piece lattice. Forward
Viterbi scores give, for each position, the best score of any path up to it. The search then runs
backward from the end: the score so far plus the Viterbi score of the position is exactly the
best completion, so A* takes whole segmentations off its heap in order of score. A path that is
taken runs on along its best edges and leaves only its side branches on the heap.

The lattice falls into units wherever no piece spans a place: before a run of U+2581 and around
characters that only stand alone. All new units of a batch are cut at once: a trie walk over all
starts finds the edges, and arrays hold the Viterbi scores of all positions. The loss of a unit's
second best cut is the least loss over edges that the best path leaves out. The N best of a text then
come from the N-1 units of least loss: any other unit's change costs as much as each of those, with
the unchanged text makes N. Only those units are searched. Workers keep the units they have met, up
to a bound.

Scores are those in the model file. A character without a piece costs 10 more than the least
single character and is written as its UTF-8 byte pieces.

Cases: a null text encodes as empty: no pieces, N-best scores [0]; among equal scores the longer
last piece goes first; a text holding U+2581 decodes it as a space, as the library does; repeated
rows are encoded each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import slices, table

N_BEST = 4
KEPT_UNITS = 400_000
SPACE = "▁"


class Lattice:
    """Pieces and scores of a SentencePiece model file, and the searches over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        plain = [i for i in range(len(self.pieces))
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.control = set(range(len(self.pieces))) - set(plain) - set(self.byte_of)
        self.unknown = min(s for p, s in self.score.items() if len(p) == 1) - 10.0
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece crosses into a space: units would not be independent")
        #: For each proper or whole prefix of a piece, the piece's score, else None.
        self.prefix: dict[str, float | None] = {}
        for p, sc in self.score.items():
            for k in range(1, len(p)):
                self.prefix.setdefault(p[:k], None)
            self.prefix[p] = sc
        joined = "".join(sorted({c for p in self.id if len(p) > 1 for c in p} - {SPACE}))
        inside = "".join(map(re.escape, joined))
        self.split_units = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}]").findall
        self._index()
        self.units: dict[str, int] = {}
        self.reset()

    def _index(self) -> None:
        """The trie and the pieces' bytes as arrays."""
        import numpy as np
        import pandas as pd

        chars = sorted({c for p in self.prefix for c in p})
        self.char = pd.Index(np.array([ord(c) for c in chars], np.int64))
        number = {p: i + 1 for i, p in enumerate(self.prefix)}
        at = {c: i for i, c in enumerate(chars)}
        self.n_chars = len(chars)
        self.node = pd.Index(np.array(
            [number.get(p[:-1], 0) * self.n_chars + at[p[-1]] for p in self.prefix], np.int64))
        self.node_score = np.array([np.nan if v is None else v for v in self.prefix.values()])
        self.node_id = np.array([self.id.get(p, -1) for p in self.prefix], np.int64)
        says = [b"" if i in self.control else bytes([self.byte_of[i]]) if i in self.byte_of
                else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.piece_size = np.array([len(b) for b in says], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(says), np.uint8)

    def reset(self) -> None:
        import numpy as np

        self.units.clear()
        self.found: dict[str, list[tuple[float, list[str]]]] = {}
        self.best = np.zeros(0)
        self.loss = np.zeros(0)
        self.size = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def search(self, text: str, n: int) -> list[tuple[float, list[str]]]:
        """The n best segmentations of normalised ``text``, best first: (score, pieces)."""
        size, prefix, unknown = len(text), self.prefix, self.unknown
        best = [0.0] + [float("-inf")] * size
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for i in range(size):
            base = best[i]
            one = prefix.get(text[i], None)
            if one is None:
                one = unknown
            ends[i + 1].append((i, one))
            if base + one > best[i + 1]:
                best[i + 1] = base + one
            if text[i] not in prefix:
                continue
            for j in range(i + 2, size + 1):
                piece = text[i:j]
                if piece not in prefix:
                    break
                s = prefix[piece]
                if s is not None:
                    ends[j].append((i, s))
                    if base + s > best[j]:
                        best[j] = base + s
        out, order = [], 0
        # cuts of a branch: its first one and those after it, which branches share
        heap: list = [(-best[size], 0, size, 0.0, None)]
        while heap and len(out) < n:
            _, _, at, so_far, cuts = heapq.heappop(heap)
            while at:
                nearest, choice = float("-inf"), None
                for i, s in ends[at]:
                    if best[i] + s > nearest:
                        nearest, choice = best[i] + s, (i, s)
                for i, s in ends[at]:
                    if i != choice[0]:
                        order += 1
                        # complete with the best of i: exactly best[i] + s + so_far
                        heapq.heappush(heap, (-(best[i] + s + so_far), order, i, so_far + s,
                                              (i, cuts)))
                at, so_far = choice[0], so_far + choice[1]
                cuts = (at, cuts)
            marks = []
            while cuts is not None:
                at, cuts = cuts
                marks.append(at)
            marks.append(size)
            out.append((so_far, [text[a:b] for a, b in zip(marks, marks[1:], strict=False)]))
        return out

    def edges(self, codes, ends):
        """All pieces that lie in the units: start, stop, score and id (-1: no piece, one character).

        ``codes``: the units' characters one after another; ``ends``: the end of each start's unit.
        """
        import numpy as np

        at = self.char.get_indexer(codes)
        start = np.arange(len(codes))
        node = np.zeros(len(codes), np.int64)
        alone = np.ones(len(codes), bool)
        parts = []
        for k in range(1, 1 + max(map(len, self.prefix))):
            live = (start + k <= ends[start])
            start, node = start[live], node[live]
            char = at[start + k - 1]
            hit = self.node.get_indexer(np.where(char < 0, -1, node * self.n_chars + char))
            live = hit >= 0
            start, hit = start[live], hit[live]
            node = hit + 1
            score = self.node_score[hit]
            whole = ~np.isnan(score)
            if k == 1:
                alone[start[whole]] = False
            parts.append((start[whole], start[whole] + k, score[whole], self.node_id[hit[whole]]))
            if not len(start):
                break
        alone = np.flatnonzero(alone)
        parts.append((alone, alone + 1, np.full(len(alone), self.unknown),
                      np.full(len(alone), -1, np.int64)))
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def viterbi(self, units: list[str]):
        """Per unit: best score, loss of the second best (inf: none), pieces of the best."""
        import numpy as np

        text = "".join(units)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units], np.int64)
        last = np.cumsum(sizes)
        first = last - sizes
        start, stop, score, piece = self.edges(codes, np.repeat(last, sizes))
        # positions: unit u has sizes[u] + 1 of them
        unit = np.repeat(np.arange(len(units)), sizes)[start]
        a, b = start + unit, stop + unit
        offset = b - (first + np.arange(len(units)))[unit]
        order = np.lexsort((a, offset))
        a, b, score, piece, codes_at = a[order], b[order], score[order], piece[order], start[order]
        unit, offset = unit[order], offset[order]
        steps = np.searchsorted(offset, np.arange(1, sizes.max() + 2))
        places = len(codes) + len(units)
        front = np.full(places, -np.inf)
        front[first + np.arange(len(units))] = 0.0
        via = np.full(places, len(a), np.int64)
        for lo, hi in zip(steps[:-1], steps[1:], strict=True):
            to, value = b[lo:hi], front[a[lo:hi]] + score[lo:hi]
            np.maximum.at(front, to, value)
            top = value == front[to]
            np.minimum.at(via, to[top], np.arange(lo, hi)[top])
        back = np.full(places, -np.inf)
        back[last + np.arange(len(units))] = 0.0
        away = (last + np.arange(len(units)))[unit] - a
        order = np.argsort(away, kind="stable")
        steps = np.searchsorted(away[order], np.arange(1, sizes.max() + 2))
        for lo, hi in zip(steps[:-1], steps[1:], strict=True):
            own = order[lo:hi]
            np.maximum.at(back, a[own], score[own] + back[b[own]])
        best = front[last + np.arange(len(units))]
        # the best path, from the ends backward, all units together
        taken = np.zeros(len(a), bool)
        at, base = last + np.arange(len(units)), first + np.arange(len(units))
        live = at > base
        while live.any():
            edge = via[at[live]]
            taken[edge] = True
            at[live] = a[edge]
            live = at > base
        second = np.full(len(units), -np.inf)
        np.maximum.at(second, unit[~taken], (front[a] + score + back[b])[~taken])
        on = np.flatnonzero(taken)
        on = on[np.argsort(a[on], kind="stable")]
        return best, best - second, unit[on], piece[on], codes[codes_at[on]]

    def learn(self, units: list[str]) -> None:
        import numpy as np

        for group in chunks(units, 120_000):
            best, loss, unit, piece, code = self.viterbi(group)
            odd = np.flatnonzero(piece < 0)
            if len(odd):  # characters without a piece become their bytes
                raw = [chr(c).encode("utf-8", "replace") for c in code[odd].tolist()]
                times = np.ones(len(piece), np.int64)
                times[odd] = [len(r) for r in raw]
                place = np.cumsum(times) - times
                piece, unit = np.repeat(piece, times), np.repeat(unit, times)
                for k, r in zip(place[odd].tolist(), raw, strict=True):
                    piece[k:k + len(r)] = [self.bytes[x] for x in r]
            sizes = np.bincount(unit, minlength=len(group))
            for i, u in enumerate(group, len(self.units)):
                self.units[u] = i
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, piece.astype(np.int32)])
            self.best = np.concatenate([self.best, best])
            self.loss = np.concatenate([self.loss, loss])

    def encode(self, texts: list[str], n: int):
        """Piece ids of all texts one after another, their number per text, and each text's n
        best scores."""
        ids, counts, found = self.encode_n_best(texts, n)
        return ids, counts, [[score for score, _ in x] for x in found]

    def encode_n_best(self, texts: list[str], n: int):
        """As ``encode``, with (score, changes) for each text's n best segmentations: a change (start,
        stop, pieces) replaces that part of the text's best pieces; the changes are in order."""
        import numpy as np

        if len(self.units) > KEPT_UNITS or len(self.found) > KEPT_UNITS:
            self.reset()
        split = [self.split_units(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(list(set().union(*split).difference(self.units)) if split else [])
        known = self.units.__getitem__
        every = [np.fromiter(map(known, units), np.int64, len(units)) for units in split]
        at = np.concatenate(every) if every else np.zeros(0, np.int64)
        ids = self.flat[spread(self.start[at], self.size[at])]
        counts = [int(self.size[x].sum()) for x in every]
        return ids, counts, [self.n_best(u, x, n) for u, x in zip(split, every, strict=True)]

    def n_best(self, units: list[str], at, n: int) -> list[tuple[float, list]]:
        """The n largest sums of one segmentation score of each unit, and what they change."""
        import numpy as np

        total, loss = float(self.best[at].sum()), self.loss[at]
        low = np.argpartition(loss, n - 1)[:n - 1] if len(loss) > n else np.arange(len(loss))
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for j in low.tolist():
            if not np.isfinite(loss[j]):
                continue
            found = self.found.get(units[j])
            if found is None or len(found) < n:
                found = self.found[units[j]] = self.search(units[j], n)
            sums = heapq.nsmallest(n, [(x + found[0][0] - y, (*took, (j, k)) if k else took)
                                       for x, took in sums for k, (y, _) in enumerate(found)],
                                   key=lambda s: s[0])
        ends = np.cumsum(self.size[at]) if any(took for _, took in sums) else None
        return [(total - x, [(int(ends[j] - self.size[at[j]]), int(ends[j]),
                              self.ids_of(self.found[units[j]][k][1])) for j, k in sorted(took)])
                for x, took in sums]

    def ids_of(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; characters without a piece become their bytes."""
        out: list[int] = []
        for p in pieces:
            out += [self.id[p]] if p in self.id else [self.bytes[b] for b in p.encode("utf-8", "replace")]
        return out

    def decode_all(self, ids, counts: list[int]) -> list[str]:
        """Texts of consecutive runs of piece ids; control pieces say nothing, broken bytes become
        U+FFFD."""
        import numpy as np

        size = self.piece_size[ids]
        raw = self.piece_bytes[spread(self.piece_start[ids], size)].tobytes()
        total = np.concatenate([[0], np.cumsum(size)])
        ends = total[np.cumsum([0, *counts])].tolist()
        texts = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


def spread(start, size):
    """The numbers start, start + 1, ... of each run of the given size."""
    import numpy as np

    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def chunks(units: list[str], most: int):
    """Lists of units of at most ``most`` characters together (or one longer unit)."""
    held, used = [], 0
    for u in units:
        if held and used + len(u) > most:
            yield held
            held, used = [], 0
        held.append(u)
        used += len(u)
    if held:
        yield held


@functools.cache
def lattice_of(path: str | None) -> Lattice:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Lattice(path)


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = N_BEST,
           path: str | None = None) -> DataFrame:
    """Rows (id, pieces array<int>, scores array<double>, round_trip boolean, changes).

    ``changes``: for each score the parts of ``pieces`` that its segmentation replaces (none for the first).
    ``round_trip``: decoding the pieces gives the text back. ``path``: the model file, as
    executors see it.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = lattice_of(path)
        for batch in slices(batches, 256):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, counts, found = model.encode_n_best(texts, n)
            scores = [[score for score, _ in x] for x in found]
            changes = [[[dict(zip(("start", "stop", "pieces"), c, strict=True)) for c in own]
                        for _, own in x] for x in found]
            back = [a == b for a, b in zip(model.decode_all(ids, counts), texts, strict=True)]
            ends = np.cumsum([0, *counts]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                pa.array(scores, pa.list_(pa.float64())), pa.array(back, pa.bool_()),
                pa.array(changes, pa.list_(pa.list_(pa.struct([
                    ("start", pa.int32()), ("stop", pa.int32()), ("pieces", pa.list_(pa.int32()))]))))],
                names=["id", "pieces", "scores", "round_trip", "changes"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, pieces array<int>, scores array<double>, round_trip boolean, "
             "changes array<array<struct<start: int, stop: int, pieces: array<int>>>>")


def decode(encoded_docs: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (id, text) from rows (id, pieces); null pieces give an empty text."""
    kind = encoded_docs.schema["id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = lattice_of(path)
        for batch in slices(batches, 256):
            lists = [i or [] for i in batch.column(1).to_pylist()]
            flat = np.array([i for x in lists for i in x], np.int64)
            texts = model.decode_all(flat, [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=["id", "text"])

    return encoded_docs.select("id", "pieces").mapInArrow(run, f"id {kind}, text string")


def op1_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("id").alias("doc_id"), F.size("pieces").alias("n_pieces"), "pieces",
                       F.col("scores").alias("n_best_scores"), "round_trip",
                       F.col("changes").alias("n_best_changes"))
