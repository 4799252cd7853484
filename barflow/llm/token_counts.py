"""Token counts by rank-synchronous array merging.

A word's pre-tokens become ragged rows of one numpy array of symbols. In each round the rank of
every adjacent pair is looked up at once, the lowest rank of each row is found, and that pair is
merged wherever it stands in its row (left to right where occurrences overlap); rows without a
mergeable pair are counted and leave. Merging all occurrences of the lowest pair together equals
merging them one by one, because a merge only makes pairs of higher rank than its own.

Words between ASCII white space are independent: no pre-token and no composition of characters
spans white space. So each task keeps the counts of the words it has met, up to a bound.

Cases: a null text counts as empty, with no tokens; special strings inside a text count as one
token each, as the tokenizer library does by default; repeated rows are counted each on its own; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import encoded, slices, table

LIMIT = 2048
#: Words whose counts a Python worker keeps at most.
KEPT_WORDS = 400_000
#: Splits lower-case text as the vocabulary's own pattern does; white space by its Unicode property.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
NEVER = 1 << 30


class WordTokens:
    """Token counts of words for a byte-level BPE vocabulary file with word ends."""

    def __init__(self, path: str):
        import numpy as np
        import pandas as pd
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.pieces = regex.compile(PIECES).findall
        chars = self.byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.width = max(vocab.values()) + 1
        self.pairs = pd.Index(np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.counts: dict[bytes, int] = {}

    @staticmethod
    def byte_chars() -> list[str]:
        """The printable stand-in of each byte: itself if printable in Latin-1, else from 256 on."""
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        chars = {b: chr(b) for b in plain}
        for b in range(256):
            chars.setdefault(b, chr(256 + len(chars) - len(plain)))
        return [chars[b] for b in range(256)]

    def pretokens(self, word: str) -> tuple[list[str], int]:
        """Pre-tokens of a word, and how many special strings it holds."""
        parts, found = [word], 0
        if self.special and "<" in word:
            parts = self.special.split(word)
            found = len(parts) - 1
        out: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += self.pieces(part.lower())
        return out, found

    def merge(self, tokens: list[bytes]):
        """Number of symbols left of each byte string."""
        import numpy as np

        lengths = np.array([len(t) for t in tokens], np.int64)
        left = np.zeros(len(tokens), np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        rows = np.arange(len(tokens))
        while len(rows):
            starts = np.cumsum(lengths) - lengths
            ranks = np.full(len(symbols), NEVER, np.int64)
            if len(symbols) > 1:
                ranks[:-1] = self.pairs.get_indexer(symbols[:-1] * self.width + symbols[1:])
                ranks[ranks < 0] = NEVER
                ranks[starts + lengths - 1] = NEVER
            least = np.minimum.reduceat(ranks, starts)
            over = least == NEVER
            if over.any():
                left[rows[over]] = lengths[over]
                stay = ~np.repeat(over, lengths)
                symbols, ranks = symbols[stay], ranks[stay]
                rows, lengths, least = rows[~over], lengths[~over], least[~over]
                if not len(rows):
                    break
                starts = np.cumsum(lengths) - lengths
            at = np.flatnonzero(ranks == np.repeat(least, lengths))
            run = np.concatenate([[True], np.diff(at) != 1])
            first = at[run][np.cumsum(run) - 1]
            at = at[(at - first) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            lengths = np.add.reduceat(stay.astype(np.int64), starts)
            symbols = symbols[stay]
        return left

    def learn(self, words: list[bytes]) -> None:
        split = [self.pretokens(w.decode("utf-8", "replace")) for w in words]
        known = {t: i for i, t in enumerate(dict.fromkeys(t for ts, _ in split for t in ts))}
        sizes = self.merge([t.encode() for t in known]) if known else []
        size = dict(zip(known, map(int, sizes), strict=True))
        for word, (tokens, found) in zip(words, split, strict=True):
            self.counts[word] = found + sum(map(size.__getitem__, tokens))

    def of(self, texts: list[bytes]):
        """Token count of each text."""
        import numpy as np

        if len(self.counts) > KEPT_WORDS:
            self.counts.clear()
        split = [t.split() for t in texts]
        words = [w for ws in split for w in ws]
        new = list(set(words).difference(self.counts))
        for start in range(0, len(new), 20_000):
            self.learn(new[start:start + 20_000])
        each = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(words))
        total = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum([len(ws) for ws in split])
        return np.diff(total[np.concatenate([[0], ends])]) if len(split) else each


@functools.cache
def tokens_of(path: str | None) -> WordTokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordTokens(path)


def token_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 path: str | None = None) -> DataFrame:
    """Rows (id, n_bytes, n_tokens). ``path``: the vocabulary file, as executors see it."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        model = tokens_of(path)
        for batch in slices(batches, 512):
            texts = encoded(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(model.of(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_bytes bigint, n_tokens bigint")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > LIMIT).alias("over_limit"))
