"""Language-model scoring: a causal self-attention model trained in numpy on subword ids.

Tokens are lower-case words and one end per text. A token's vector is the sum of the embeddings
of its first and last subword ids. For the token at t, queries made from the vectors of the two
tokens before t meet keys made from the two tokens before each earlier j; the attention over
the earlier tokens j, and one sentinel, is the chance to repeat token j, or to draw anew:

    p(t) = a_sentinel x p_new(t) + sum over j < t of a_j x [token j = token t]

p_new is an absolute-discount word model whose held-back mass is spelled byte by byte, by the bytes
before (up to four, hashed, backing off to two), so every text has a probability; its counts come
from all training texts. Windows of 2 x STEP tokens
overlap by STEP: each token is scored once, in the later half of its window, with at least STEP
tokens of context where the text has them. Windows are stacked and masked in batches, in which neighbours
share the vectors and keys of the block they overlap in.

Training goes over all training texts once: every task starts from the same seeded parameters
and ascends the likelihood of its own windows (Adagrad); the parameters are then averaged, weighted by
tokens, in two levels of grouping by parameter block.

Texts are held in chunks: a row has the texts of one stretch of a partition as numbers into the chunk's own
vocabulary, each word once. Words are dealt into parts by hash: a chunk sends each part one packet of its different
words, and gets one back with their counts, chances and pieces in the same order, so that a word's text crosses one
shuffle and numbers that say which word is meant cross none. The number of parts grows with that of the chunks,
so that a part has the words of a few chunks. No vocabulary is broadcast; only the spelling counts
(bounded by the number of contexts) and the parameters are.

Cases: a null text counts as empty: one token, the end; a null id is a training row; without training
texts the model spells every word; repeated rows are scored alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import encoded, table
from barflow.session import stored

FOLDS = 10
STEP = 32
WIDTH = 32
BUCKETS = 4096
BATCH = 128
TRAIN_BATCH = 48
RATE = 0.1
CHUNK_BYTES = 8 << 20
SEED = 11
END = b""
WORD_END = 256
LONG_BITS = 14
BLOCKS = 64
LEAST_PARTS = 256
PART_CHUNKS = 4
SOME_WORDS = 16384


# --- texts as chunks ------------------------------------------------------------------------------

def squeezed(raw: bytes) -> bytes:
    """``raw`` compressed, with its size in front."""
    import pyarrow as pa

    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def opened(raw) -> bytes:
    import pyarrow as pa

    raw = memoryview(raw)
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def planes(numbers) -> bytes:
    """Numbers as byte planes, of which the high ones compress to little."""
    import numpy as np

    return squeezed(np.ascontiguousarray(
        np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes())


def of_planes(raw, kind: str):
    import numpy as np

    kind = np.dtype(kind)
    return np.ascontiguousarray(
        np.frombuffer(opened(raw), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def packed(words: list[bytes]) -> bytes:
    """At least one word, none with a space in it."""
    return squeezed(b" ".join(words))


def unpacked(raw) -> list[bytes]:
    return opened(raw).split(b" ")


def chunked(docs: DataFrame, held: str = "held_out") -> DataFrame:
    """Rows (chunk, ids, held, sizes, words, vocab, counts) of ``docs`` (id, held_out, text).

    ``words``: int32 numbers into ``vocab`` (0: the end), ends left out; ``counts``: of the training texts.
    These three are packed.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def pack(ids, marks, texts, name):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # splits at ASCII white space alone; white space at the ends of a text gives empty words there
        split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
        every, ends = split.values, split.offsets.to_numpy()
        there = pc.binary_length(every).to_numpy() > 0
        sizes = np.diff(np.r_[0, np.cumsum(there)][ends]).astype(np.int32)
        if not there.all():
            every = every.filter(pa.array(there))
        every = every.dictionary_encode()
        flat = every.indices.to_numpy() + np.int32(1)
        known = [END, *every.dictionary.cast(pa.binary()).to_pylist()]
        train = ~np.array(marks, bool)
        counts = np.bincount(flat[np.repeat(train, sizes)], minlength=len(known))
        counts[0] = train.sum()
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([marks], pa.list_(pa.bool_())), pa.array([sizes.tolist()], pa.list_(pa.int32())),
             pa.array([planes(flat)], pa.binary()), pa.array([packed(known)], pa.binary()),
             pa.array([planes(counts.astype(np.int64))], pa.binary())],
            names=["chunk", "ids", "held", "sizes", "words", "vocab", "counts"])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        ids, marks, texts, size = [], [], [], 0
        for batch in batches:
            every = encoded(batch.column(2))
            flags = batch.column(1).to_pylist()
            for i, text in enumerate(every):
                ids.append(batch.column(0).slice(i, 1))
                marks.append(bool(flags[i]))
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES or len(texts) >= 16384:
                    yield pack(pa.concat_arrays(ids), marks, texts, (part << 24) + made)
                    made += 1
                    ids, marks, texts, size = [], [], [], 0
        if texts:
            yield pack(pa.concat_arrays(ids), marks, texts, (part << 24) + made)

    return docs.select("id", held, "text").mapInArrow(
        run, f"chunk bigint, ids array<{kind}>, held array<boolean>, sizes array<int>, words binary, "
             "vocab binary, counts binary")


# --- words of all chunks ---------------------------------------------------------------------------

def dealing(words: list[bytes], parts: int):
    """The order of ``words`` by part (a hash), the parts met and where each starts, and the end."""
    import numpy as np

    part = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts
    order = np.argsort(part, kind="stable")
    part = part[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return order, part[starts], np.r_[starts, len(words)]


def dealt(chunks: DataFrame, parts: int) -> DataFrame:
    """Rows (part, chunk, words, counts): the words of a chunk, by part."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in rows_of(batch):
                words, counts = unpacked(row["vocab"].as_buffer()), of_planes(row["counts"].as_buffer(), "i8")
                order, part, ends = dealing(words, parts)
                own = [order[lo:hi] for lo, hi in itertools.pairwise(ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int64()), pa.array([row["chunk"].as_py()] * len(own), pa.int64()),
                     pa.array([packed([words[i] for i in at]) for at in own], pa.binary()),
                     pa.array([planes(counts[at]) for at in own], pa.binary())],
                    names=["part", "chunk", "words", "counts"])

    return chunks.select("chunk", "vocab", "counts").mapInArrow(
        run, "part bigint, chunk bigint, words binary, counts binary")


def pieces_of(words: list[bytes], path: str | None):
    """Of each word the embedding rows of its first and last subword id, as one number."""
    import numpy as np

    from barflow.llm.sentence_pieces import SPACE, chunks, lattice_of

    model = lattice_of(path)
    first = np.zeros(len(words), np.int64)
    last = np.ones(len(words), np.int64)
    some = np.array([i for i, w in enumerate(words) if w], np.int64)
    at = 0
    for group in chunks([SPACE + words[i].decode() for i in some], 120_000):
        _, _, unit, piece, code = model.viterbi(group)
        # a character without a piece: a bucket by its code
        piece = np.where(piece < 0, code, piece) % BUCKETS
        own = some[at:at + len(group)]
        ends = np.flatnonzero(np.r_[np.diff(unit) != 0, True])
        last[own] = piece[ends]
        first[own] = piece[np.r_[0, ends[:-1] + 1]]
        at += len(group)
    return (first * (2 * BUCKETS) + last + BUCKETS).astype(np.int32)


def words_by_part(packets: DataFrame, path: str | None) -> DataFrame:
    """A row for each part: its different ``words``, their counts ``c`` and pieces ``at``; for each chunk
    how many of them it has (``sizes``) and which (``picks``); and counts of the counts."""
    def run(group):
        import numpy as np
        import pyarrow as pa

        held = [unpacked(x.as_buffer()) for x in group.column("words")]
        sizes = [len(x) for x in held]
        every = pa.array(list(itertools.chain.from_iterable(held)), pa.binary()).dictionary_encode()
        del held
        words, picks = every.dictionary.to_pylist(), every.indices.to_numpy()
        counts = np.concatenate([of_planes(x.as_buffer(), "i8") for x in group.column("counts")])
        c = np.zeros(len(words), np.int64)
        np.add.at(c, picks, counts)
        return pa.table(
            [group.column("part").slice(0, 1), pa.array([packed(words)], pa.binary()),
             pa.array([planes(c)], pa.binary()), pa.array([planes(pieces_of(words, path))], pa.binary()),
             pa.array([group.column("chunk").to_pylist()], pa.list_(pa.int64())),
             pa.array([sizes], pa.list_(pa.int32())), pa.array([planes(picks.astype(np.int32))], pa.binary()),
             *(pa.array([int(x)], pa.int64()) for x in (c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum()))],
            names=["part", "words", "c", "at", "chunks", "sizes", "picks", "n", "v", "once", "twice"])

    return packets.groupBy("part").applyInArrow(
        run, "part bigint, words binary, c binary, at binary, chunks array<bigint>, sizes array<int>, "
             "picks binary, n bigint, v bigint, once bigint, twice bigint")


def spelling(words: list[bytes]):
    """Per byte and word end: its symbol, and its contexts of two and four bytes hashed; word sizes."""
    import numpy as np

    sizes = np.array([len(w) for w in words], np.int64) + 1
    flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
    ends = np.cumsum(sizes) - 1
    flat[ends] = WORD_END
    place = np.arange(len(flat)) - np.repeat(ends + 1 - sizes, sizes)
    back = []
    for k in range(1, 5):
        prev = np.full(len(flat), WORD_END, np.int64)
        prev[k:] = flat[:-k]
        back.append(np.where(place >= k, prev, WORD_END))
    short = back[0] * 257 + back[1]
    long = ((short * 257 + back[2]) * 257 + back[3]).astype(np.uint64)
    mixed = (long * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - LONG_BITS)
    return flat, short, mixed.astype(np.int64), sizes


def spelling_counts(words: DataFrame) -> DataFrame:
    """Rows (long, context, symbol, n) over the different training words: at most
    257^3 + 2^LONG_BITS x 257 rows for any corpus, of which a script uses few."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        met = {False: (np.empty(0, np.int64),) * 2, True: (np.empty(0, np.int64),) * 2}
        for batch in batches:
            for row in rows_of(batch):
                c = of_planes(row["c"].as_buffer(), "i8")
                plain = [w for w, k in zip(unpacked(row["words"].as_buffer()), c, strict=True) if k and w]
                found = {which: [own] for which, own in met.items()}
                for some in itertools.batched(plain, SOME_WORDS):
                    symbol, short, long, _ = spelling(some)
                    for which, context in ((False, short), (True, long)):
                        found[which].append(np.unique(context * 257 + symbol, return_counts=True))
                for which, own in found.items():
                    key, at = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                    n = np.zeros(len(key), np.int64)
                    np.add.at(n, at, np.concatenate([n for _, n in own]))
                    met[which] = key, n
        for which, (key, n) in met.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), which)), pa.array(key // 257),
                 pa.array((key % 257).astype(np.int32)), pa.array(n)],
                names=["long", "context", "symbol", "n"])

    return words.select("words", "c").mapInArrow(
        run, "long boolean, context bigint, symbol int, n bigint").groupBy(
        "long", "context", "symbol").agg(F.sum("n").alias("n"))


def spelling_model(rows):
    """Witten-Bell chances from count rows: a long context backs off to a short one, that to equal
    chances. Gives a function of (symbol, short, long)."""
    import numpy as np

    tables = []
    for which, most in ((False, 257 * 257), (True, 1 << LONG_BITS)):
        own = rows[rows["long"] == which]
        n = own["n"].to_numpy(np.float64)
        context, at = np.unique(own["context"].to_numpy(np.int64), return_inverse=True)
        total, kinds = np.bincount(at, n), np.bincount(at).astype(np.float64)
        # by number of the context and symbol; contexts not met have the number past the last, no count and one kind,
        # which leaves a chance as it is
        numbers = np.full(most, len(context), np.int32)
        numbers[context] = np.arange(len(context))
        cells = np.zeros((len(context) + 1) * 257, np.int64)
        cells[at * 257 + own["symbol"].to_numpy(np.int64)] = n
        tables.append((numbers, cells, np.r_[total, 0], np.r_[kinds, 1]))

    def chance(symbol, short, long):
        p = np.full(len(symbol), 1 / 257)
        for (numbers, cells, total, kinds), own in zip(tables, (short, long), strict=True):
            place = numbers[own]
            p = (cells[place.astype(np.int64) * 257 + symbol] + kinds[place] * p) / (total[place] + kinds[place])
        return p

    return chance


def answers(words: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (chunk, part, c, spell, at) for each packet: its words' counts, the log10 chances of their
    spellings, and their pieces."""
    shared = words.sparkSession.sparkContext.broadcast(counts.toPandas())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        chance = spelling_model(shared.value)
        for batch in batches:
            for row in rows_of(batch):
                logs = []
                for some in itertools.batched(unpacked(row["words"].as_buffer()), SOME_WORDS):
                    symbol, short, long, sizes = spelling(some)
                    logs.append(np.add.reduceat(np.log10(chance(symbol, short, long)),
                                                np.cumsum(sizes) - sizes))
                spell = np.concatenate(logs).astype(np.float32)
                c, at = of_planes(row["c"].as_buffer(), "i8"), of_planes(row["at"].as_buffer(), "i4")
                ends = np.cumsum(row["sizes"].values.to_numpy())
                own = np.split(of_planes(row["picks"].as_buffer(), "i4"), ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [row["chunks"].values, pa.array([row["part"].as_py()] * len(own), pa.int64()),
                     *(pa.array([planes(x[pick]) for pick in own], pa.binary()) for x in (c, spell, at))],
                    names=["chunk", "part", "c", "spell", "at"])

    return words.select("part", "words", "c", "at", "chunks", "sizes", "picks").mapInArrow(
        run, "chunk bigint, part bigint, c binary, spell binary, at binary")


def joined(chunks: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """``chunks`` with the answers to its words in the order of its vocabulary instead of that."""
    def run(own, packets):
        import numpy as np

        packets = packets.sort_by("part")
        order, _, _ = dealing(unpacked(own.column("vocab")[0].as_buffer()), parts)
        out = own.select(["ids", "held", "sizes", "words"])
        for name, kind in (("c", "i8"), ("spell", "f4"), ("at", "i4")):
            cells = np.empty(len(order), kind)
            cells[order] = np.concatenate([of_planes(x.as_buffer(), kind) for x in packets.column(name)])
            out = out.append_column(name, [[planes(cells)]])
        return out

    kind = chunks.schema["ids"].dataType.simpleString()
    return chunks.select("chunk", "ids", "held", "sizes", "words", "vocab").groupBy("chunk").cogroup(
        found.groupBy("chunk")).applyInArrow(
        run, f"ids {kind}, held array<boolean>, sizes array<int>, words binary, c binary, spell binary, at binary")


# --- the model ------------------------------------------------------------------------------------

class Attention:
    """Parameters, likelihood and gradient of runs of blocks of STEP tokens.

    A window is a block and the one before it; neighbouring windows share the vectors and keys of a
    block. A run starts with the two tokens before its first block, which is context only.
    """

    def __init__(self):
        import numpy as np

        rng = np.random.default_rng(SEED)
        eye = np.eye(WIDTH, dtype=np.float32)
        self.p = {
            "emb": rng.normal(0, 0.5, (2 * BUCKETS, WIDTH)).astype(np.float32),
            # from the vectors of the last two tokens to a query and a key
            "mix": np.block([[eye, eye], [0.5 * eye, 0.5 * eye]]).astype(np.float32),
            "dist": np.zeros(2 * STEP, np.float32), "sentinel": np.full(1, 8.0, np.float32)}
        self.square = {k: np.full_like(v, 1e-5) for k, v in self.p.items()}
        # by key and query; attention is by key, window and query, so that sums over keys add whole rows
        self.gap = STEP + np.arange(STEP)[None, :] - np.arange(2 * STEP)[:, None]
        self.before = self.gap > 0
        self.gap = np.where(self.before, self.gap, 0)

    def flat(self):
        import numpy as np

        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat):
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at:at + v.size].reshape(v.shape).astype("float32")
            at += v.size
        return self

    def forward(self, tok, first, last, new):
        """tok, first, last: a run (-1 where there is no token); new: (windows, STEP) chance to draw.

        Equal tokens are few, so their attention is gathered rather than multiplied through.
        """
        import numpy as np

        p, gone = self.p, np.flatnonzero(tok < 0)
        x = p["emb"].take(first, axis=0)
        x += p["emb"].take(last, axis=0)
        x[gone] = 0
        lags = np.concatenate([x[1:-1], x[:-2]], axis=1)
        both = lags @ p["mix"]
        q = both[STEP:, :WIDTH].reshape(-1, STEP, WIDTH)
        k = overlapping(both[:, WIDTH:])
        seen = overlapping(tok[2:])
        a = np.empty((2 * STEP, len(q), STEP), both.dtype)
        np.matmul(k, q.transpose(0, 2, 1), out=a.transpose(1, 0, 2))
        a += np.where(self.before, p["dist"][self.gap], np.float32(-1e9))[:, None, :]
        keys = np.ascontiguousarray(seen.T)
        a[keys < 0] = np.float32(-1e9)
        top = np.maximum(a.max(axis=0), p["sentinel"][0])
        a -= top
        np.exp(a, out=a)
        sent = np.exp(p["sentinel"][0] - top)
        z = a.sum(axis=0) + sent
        sent = sent / z
        own = seen[:, STEP:]
        at = np.flatnonzero(keys[:, :, None] == np.where(own < 0, -2, own))
        row = at % own.size
        copied = np.bincount(row, a.ravel()[at], z.size).reshape(z.shape) / z
        return (x, lags, both, q, k, a, z, sent, (at, row),
                np.maximum(sent * new + copied, 1e-300))

    def train(self, tok, first, last, new):
        import numpy as np

        x, lags, both, q, k, g, z, sent, (at, row), chance = self.forward(tok, first, last, new)
        there = tok >= 0
        live = there[2 + STEP:].reshape(-1, STEP)
        n = max(1, int(live.sum()))
        inv = np.where(live, 1.0 / chance, 0.0)
        own = live.astype(np.float32)
        # d log p / d score: attention x (is it the token) / p, less the attention
        plus = (g.ravel()[at] / z.ravel()[row] * inv.ravel()[row]).astype(np.float32)
        g *= -own / z
        g.ravel()[at] += plus
        grad = {"sentinel": np.array([(sent * (new * inv - own)).sum()], np.float32)}
        grad["dist"] = np.bincount(self.gap.ravel(), np.where(self.before, g.sum(axis=1), 0).ravel(),
                                   2 * STEP).astype(np.float32)
        g = g.transpose(1, 0, 2)
        dk = g @ q
        d = np.zeros_like(both)
        d[STEP:, :WIDTH] = (g.transpose(0, 2, 1) @ k).reshape(-1, WIDTH)
        d[:-STEP, WIDTH:] = dk[:, :STEP].reshape(-1, WIDTH)
        d[STEP:, WIDTH:] += dk[:, STEP:].reshape(-1, WIDTH)
        grad["mix"] = lags.T @ d
        p = self.p
        dlags = d @ p["mix"].T
        dx = np.zeros_like(x)
        dx[1:-1] = dlags[:, :WIDTH]
        dx[:-2] += dlags[:, WIDTH:]
        dx[~there] = 0
        met = np.zeros(2 * BUCKETS, bool)
        met[first] = met[last] = True
        rows = np.flatnonzero(met)
        place = (np.cumsum(met) - 1) * WIDTH
        each, dx = np.arange(WIDTH), dx.ravel()
        demb = np.bincount((place[first][:, None] + each).ravel(), dx, len(rows) * WIDTH)
        demb += np.bincount((place[last][:, None] + each).ravel(), dx, len(rows) * WIDTH)
        demb = demb.reshape(-1, WIDTH)
        for name, value in grad.items():
            value = value / n
            self.square[name] += value * value
            p[name] += RATE * value / np.sqrt(self.square[name])
        demb = (demb / n).astype(np.float32, copy=False)
        square = self.square["emb"].take(rows, axis=0)
        square += demb * demb
        self.square["emb"][rows] = square
        demb *= RATE
        demb /= np.sqrt(square, out=square)
        p["emb"][rows] += demb
        return float(np.log(chance[live]).sum()), n


def overlapping(rows):
    """Rows of consecutive blocks as windows of two blocks, each STEP rows on from the last (a view)."""
    import numpy as np

    step = rows.strides[0]
    return np.lib.stride_tricks.as_strided(
        rows, (len(rows) // STEP - 1, 2 * STEP, *rows.shape[1:]), (STEP * step, *rows.strides),
        writeable=False)


def blocks_of(sizes, words):
    """Blocks of token numbers (-1: none) and each block's text. Every text has an empty block in
    front; one more comes before all."""
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    tokens = sizes + 1  # and the end, number 0
    blocks = -(-tokens // STEP) + 1
    first = 1 + np.cumsum(blocks) - blocks
    padded = np.full((1 + int(blocks.sum())) * STEP, -1, np.int32)
    start = (first + 1) * STEP
    padded[np.arange(len(words)) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)] = words
    padded[start + sizes] = 0
    return padded.reshape(-1, STEP), np.r_[0, np.repeat(np.arange(len(sizes)), blocks)]


class Chunk:
    """The arrays of one chunk row: windows and, per vocabulary number, counts and chances."""

    def __init__(self, row, n, v, discount):
        import numpy as np

        self.sizes = np.asarray(row["sizes"].values, np.int64)
        self.held = np.asarray(row["held"].values.to_numpy(zero_copy_only=False), bool)
        words = of_planes(row["words"].as_buffer(), "i4")
        self.c = of_planes(row["c"].as_buffer(), "i8").astype(np.float64)
        self.first, self.last = np.divmod(of_planes(row["at"].as_buffer(), "i4"), np.int32(2 * BUCKETS))
        spell = 10.0 ** of_planes(row["spell"].as_buffer(), "f4").astype(np.float64)
        if n:
            self.new = np.maximum(self.c - discount, 0) / n + discount * v / n * spell
        else:
            self.new = spell
        self.words = words
        self.blocks, self.doc = blocks_of(self.sizes, words)

    def runs(self, keep=None, size: int = BATCH):
        """Runs of at most ``size`` windows over all texts, or those of ``keep``: the text of each
        window, and what the model takes."""
        import numpy as np

        blocks, doc = self.blocks, self.doc
        if keep is not None:
            own = np.flatnonzero(np.r_[True, keep[doc[1:]]])
            blocks, doc = blocks[own], doc[own]
        flat = blocks.ravel()
        for at in range(2, len(blocks), size):
            upto = min(at + size, len(blocks))
            tok = flat[(at - 1) * STEP - 2:upto * STEP]
            yield (doc[at:upto], tok, self.first[tok], self.last[tok], self.new[blocks[at:upto]])


def rows_of(batch):
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {k: batch.column(j)[i] for j, k in enumerate(names)}


def trained(chunks: DataFrame, stats) -> DataFrame:
    """Rows (block, tokens, total): parameter blocks summed over tasks, weighted by tokens."""
    def local(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        model, tokens = Attention(), 0
        for batch in batches:
            for row in rows_of(batch):
                chunk = Chunk(row, *stats)
                for _, tok, first, last, new in chunk.runs(~chunk.held, TRAIN_BATCH):
                    tokens += model.train(tok, first, last, new)[1]
        if tokens:
            parts = np.array_split(model.flat().astype(np.float64) * tokens, BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()),
                 pa.array([TaskContext.get().partitionId() % 32] * BLOCKS, pa.int32()),
                 pa.array([tokens] * BLOCKS, pa.int64()),
                 pa.array([x.tobytes() for x in parts], pa.binary())],
                names=["block", "part", "tokens", "total"])

    def summed(frame):
        import numpy as np

        out = frame.iloc[:1].copy()
        out["tokens"] = frame["tokens"].sum()
        out["total"] = [sum(np.frombuffer(b) for b in frame["total"]).tobytes()]
        return out

    kind = "block int, part int, tokens bigint, total binary"
    return (chunks.mapInArrow(local, kind)
            .groupBy("block", "part").applyInPandas(summed, kind)
            .groupBy("block").applyInPandas(summed, kind))


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", held=None,
          path: str | None = None) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score, draw_score)."""
    import numpy as np

    from barflow.llm.toxicity import held_out

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    held = held_out(id_col, FOLDS) if held is None else held
    chunks = stored(chunked(docs.select(F.col(id_col).alias("id"), held.alias("held_out"),
                                        F.col(text_col).alias("text"))), "lm-chunks")
    parts = max(LEAST_PARTS, chunks.count() // PART_CHUNKS)
    words = stored(words_by_part(dealt(chunks, parts), path), "lm-words")
    n, v, once, twice = (int(x or 0) for x in words.agg(
        F.sum("n"), F.sum("v"), F.sum("once"), F.sum("twice")).first())
    discount = max(0.1, once / max(1.0, once + 2.0 * twice))
    full = stored(joined(chunks, answers(words, spelling_counts(words)), parts), "lm-full")
    stats = (n, v, discount)
    total = stored(trained(full.select("held", "sizes", "words", "c", "spell", "at"), stats), "lm-parameters")
    rows = sorted(total.collect(), key=lambda r: r["block"])  # one vector of parameters
    flat = np.concatenate([np.frombuffer(r["total"]) / r["tokens"] for r in rows]) if rows else None
    shared = spark.sparkContext.broadcast(None if flat is None else flat.astype(np.float32))

    def run(batches):
        import pyarrow as pa

        model = Attention()
        if shared.value is not None:
            model.load(shared.value)
        for batch in batches:
            for at, row in enumerate(rows_of(batch.drop_columns("ids"))):
                chunk = Chunk(row, *stats)
                total = np.zeros(len(chunk.sizes))
                for own, tok, first, last, new in chunk.runs():
                    chance = model.forward(tok, first, last, new)[-1]
                    live = tok[2 + STEP:].reshape(-1, STEP) >= 0
                    logs = np.where(live, np.log10(chance), 0.0).sum(axis=1)
                    total += np.bincount(own, logs, len(total))
                draw = np.log10(np.maximum(chunk.new, 1e-300))
                base = np.log10((chunk.c + 0.1) / (n + 0.1 * (v + 1)))
                doc = np.repeat(np.arange(len(total)), chunk.sizes)
                each = np.bincount(doc, base[chunk.words], len(total)) + base[0]
                seen = np.bincount(doc, (chunk.c > 0)[chunk.words], len(total)) + (chunk.c[0] > 0)
                ids = batch.column(batch.schema.get_field_index("ids"))[at].values
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(chunk.held), pa.array(chunk.sizes + 1), pa.array(seen.astype(np.int64)),
                     pa.array(np.full(len(total), n)), pa.array(each), pa.array(total),
                     pa.array(np.bincount(doc, draw[chunk.words], len(total)) + draw[0])],
                    names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
                           "score", "draw_score"])

    return full.mapInArrow(
        run, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
             "base_score double, score double, draw_score double")


def op2_language_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).withColumnRenamed("id", "doc_id")
