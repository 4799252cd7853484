"""Quality by a generalised additive model with pairwise interactions.

A text is measured by the shares of its kinds of bytes, words and lines (``NAMES``). Each measure has a
table with a value for each of its bins, and some pairs of measures have a table over both; a score is the
logistic function of the sum of the entries that a text falls into. Scoring is therefore a search for
the bins and one addition for each table, for many texts at once.

The tables are learned by boosting in cycles: each round fits, one measure after another, a tree of at most
four leaves to what all the others leave over, and adds a part of it to that measure's table. When the single
tables are done, pairs are ordered by how much of the rest four quadrants explain, and the best
``PAIRS`` of them are boosted the same way with trees that split one measure, then the other.

The model is fitted by one task on at most ``TRAIN_ROWS`` labelled rows, those with the least MD5 of their
id, whose measures the executors have taken. It has ``len(NAMES) + PAIRS`` rows at most, whatever the corpus.

Cases: a null or empty text has the measures of no words and is scored by them; labels that are null are left
out, and a document with several labels counts as good only if all say so; without any label every score is 0.75;
repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import table
from barflow.llm.phrases import BASE, INVERSE, byte_slices, column_bytes, mixed, powers

TRAIN_ROWS = 20_000
ROUNDS = 150
RATE = 0.1
BINS = 32
PAIRS = 12
PAIR_BINS = 8
PAIR_ROUNDS = 60
#: Least sum of p (1 - p) in a leaf, and what is added to it.
LEAF, SMOOTH = 4.0, 1.0

NAMES = (
    "words", "word_bytes", "long_words", "short_words", "symbols", "shouts", "stops", "upper", "digits", "beyond_ascii",
    "brackets", "entropy", "line_words", "short_lines", "line_copies", "distinct_words", "pair_copies", "top_word",
    "no_letters", "symbol_ends", "line_stops", "stutter",
)

#: Kinds of bytes that are counted.
KINDS = {
    "symbols": b"#*$%&|<>", "shouts": b"!?", "stops": b".,;:", "digits": b"0123456789",
    "brackets": b"()[]{}\"'/\\=_", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)),
    "beyond_ascii": bytes(range(128, 256)),
}


def held_out(id_col: str, folds: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == rest, F.lit(False))


@functools.cache
def byte_table(kind: str):
    import numpy as np

    out = np.zeros(256, bool)
    out[list({"space": b"\t\n\x0b\x0c\r "}.get(kind) or KINDS[kind])] = True
    return out


def share(part, whole):
    import numpy as np

    return part / np.maximum(whole, 1)


def repeats(doc, keys, n: int):
    """Per document: rows, rows that equal an earlier one, and rows of the most frequent key."""
    import numpy as np

    own = mixed(keys + mixed(doc.astype(np.uint64)) * np.uint64(INVERSE))
    both, count = np.unique(own, return_index=True, return_counts=True)[1:]
    owner = doc[both]
    rows = np.bincount(doc, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, count)
    return rows, rows - np.bincount(owner, minlength=n), top


def measures(data, ends):
    """One row of ``NAMES`` for each text; texts lie one after another in ``data`` up to their ``ends``."""
    import numpy as np

    n = len(ends)
    sizes = np.diff(ends, prepend=0)
    of_byte = np.repeat(np.arange(n), sizes)
    bytes_of = np.bincount(of_byte * 256 + data, minlength=n * 256).reshape(n, 256)
    kinds = {k: bytes_of[:, byte_table(k)].sum(1) for k in KINDS}
    p = share(bytes_of, sizes[:, None])
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)

    def runs(gap):
        """First bytes, ends and texts of runs of bytes that are no gaps, cut where a text starts."""
        cut = np.zeros(len(data) + 1, bool)
        cut[np.concatenate([[0], ends])] = True
        inside = np.concatenate([[False], ~gap, [False]])
        first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        last = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        return first, last, of_byte[first]

    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)))])

    def hashed(first, last):
        return mixed((sums[last] - sums[first]) * powers(INVERSE, len(data) + 1)[first])

    letters = byte_table("upper") | byte_table("lower") | byte_table("beyond_ascii")
    first, last, doc = runs(byte_table("space")[data])
    length, key = last - first, hashed(first, last)
    words, copies, top = repeats(doc, key, n)
    together = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, pair_copies, _ = repeats(doc[together], mixed(key[together]) + key[together + 1], n)
    seen = np.concatenate([[0], np.cumsum(letters[data])])
    bare = seen[last] == seen[first]
    ending = data[last - 1] if len(last) else np.zeros(0, np.uint8)

    line_first, line_last, line_doc = runs(data == 10)
    starts = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=len(data) + 1))])
    line_words = starts[line_last] - starts[line_first]
    full = line_words > 0
    line_first, line_last, line_doc, line_words = (x[full] for x in (line_first, line_last, line_doc, line_words))
    lines, line_copies, _ = repeats(line_doc, hashed(line_first, line_last), n)

    def per_doc(mask, owner=doc):
        return np.bincount(owner[mask], minlength=n)

    line_end = data[line_last - 1] if len(line_last) else np.zeros(0, np.uint8)
    found = {
        "words": np.log2(1.0 + words), "word_bytes": share(np.bincount(doc, length, n), words),
        "long_words": share(per_doc(length > 12), words), "short_words": share(per_doc(length < 3), words),
        **{k: share(kinds[k], sizes) for k in ("symbols", "shouts", "stops", "digits", "beyond_ascii", "brackets")},
        "upper": share(kinds["upper"], kinds["upper"] + kinds["lower"]), "entropy": entropy,
        "line_words": np.log2(1.0 + share(words, lines)), "short_lines": share(per_doc(line_words < 4, line_doc), lines),
        "line_copies": share(line_copies, lines), "distinct_words": share(words - copies, words),
        "pair_copies": share(pair_copies, pairs), "top_word": share(top, words), "no_letters": share(per_doc(bare), words),
        "symbol_ends": share(per_doc(byte_table("symbols")[ending]), words),
        "line_stops": share(per_doc(line_end == 46, line_doc), lines),
        "stutter": share(np.bincount(doc[together][key[together] == key[together + 1]], minlength=n), words),
    }
    return np.column_stack([found[k].astype(np.float64) for k in NAMES])


# --- fitting -----------------------------------------------------------------------------------------


def bin_cuts(values, bins: int):
    """Values between bins of about equal numbers of rows."""
    import numpy as np

    if not len(values):
        return np.zeros(0)
    inner = np.quantile(values, np.arange(1, bins) / bins)
    return np.unique(inner[inner > values.min()])


def best_split(g, h):
    """Where to cut rows of (gradient, weight) sums in two along the last axis, and the gain."""
    import numpy as np

    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g ** 2 / (left_h + SMOOTH) + right_g ** 2 / (right_h + SMOOTH) - g.sum() ** 2 / (h.sum() + SMOOTH)
    gain = np.where((left_h >= LEAF) & (right_h >= LEAF), gain, 0.0)
    return (int(gain.argmax()) + 1, float(gain.max())) if len(gain) and gain.max() > 0 else (0, 0.0)


def leaf_value(g, h) -> float:
    return float(g.sum() / (h.sum() + SMOOTH))


def line_tree(g, h, leaves: int = 4):
    """Values of the bins by a tree of at most ``leaves`` leaves, the best cut first."""
    import numpy as np

    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(best_split(g[a:b], h[a:b]), a, b) for a, b in parts]
        (cut, gain), a, b = max(cuts, key=lambda x: x[0][1])
        if gain <= 0:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = leaf_value(g[a:b], h[a:b])
    return out


def grid_tree(g, h):
    """Values of a grid's cells by a tree that splits one axis, then each half along the other; and its gain."""
    import numpy as np

    best, out = 0.0, np.full(g.shape, leaf_value(g, h))
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(a)):
            if min(b[:cut].sum(), b[cut:].sum()) < LEAF:
                continue
            halves = [(a[:cut].sum(0), b[:cut].sum(0), slice(0, cut)), (a[cut:].sum(0), b[cut:].sum(0), slice(cut, None))]
            values, total = np.empty(a.shape), -a.sum() ** 2 / (b.sum() + SMOOTH)
            for hg, hh, rows in halves:
                at, gain = best_split(hg, hh)
                total += gain + hg.sum() ** 2 / (hh.sum() + SMOOTH)
                values[rows, :] = leaf_value(hg, hh)
                if at:
                    values[rows, :at], values[rows, at:] = leaf_value(hg[:at], hh[:at]), leaf_value(hg[at:], hh[at:])
            if total > best:
                best, out = total, values if axis == 0 else values.T
    return out, best


def logistic(x):
    import numpy as np

    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def fit(x, y, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS, rate: float = RATE) -> list[dict]:
    """Rows (a, b, cuts_a, cuts_b, values) of the model; the intercept has a = b = -1."""
    import numpy as np

    y = np.asarray(y, float)
    base = float(np.log((y.sum() + 1.5) / (len(y) - y.sum() + 0.5)))
    model = [{"a": -1, "b": -1, "cuts_a": [], "cuts_b": [], "values": [base]}]
    total = np.full(len(y), base)

    def sums(cell, cells):
        p = logistic(total)
        return np.bincount(cell, y - p, cells), np.bincount(cell, p * (1 - p), cells)

    cuts = [bin_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    for _ in range(rounds):
        for j, c in enumerate(cuts):
            if len(c):
                step = rate * line_tree(*sums(bins[j], len(c) + 1))
                tables[j] += step
                total += step[bins[j]]
    model += [{"a": j, "b": -1, "cuts_a": c.tolist(), "cuts_b": [], "values": t.tolist()}
              for j, (c, t) in enumerate(zip(cuts, tables, strict=True)) if len(c)]

    wide = [bin_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(wide)]

    def grid(a, b):
        cell, shape = coarse[a] * (len(wide[b]) + 1) + coarse[b], (len(wide[a]) + 1, len(wide[b]) + 1)
        return cell, shape

    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            if pairs and len(wide[a]) and len(wide[b]):
                cell, shape = grid(a, b)
                g, h = sums(cell, shape[0] * shape[1])
                gains.append((-grid_tree(g.reshape(shape), h.reshape(shape))[1], a, b))
    chosen = [(a, b, *grid(a, b)) for _, a, b in sorted(gains)[:pairs]]
    added = [np.zeros(shape) for *_, shape in chosen]
    for _ in range(pair_rounds):
        for k, (_, _, cell, shape) in enumerate(chosen):
            g, h = sums(cell, shape[0] * shape[1])
            step = rate * grid_tree(g.reshape(shape), h.reshape(shape))[0]
            added[k] += step
            total += step.ravel()[cell]
    return model + [{"a": a, "b": b, "cuts_a": wide[a].tolist(), "cuts_b": wide[b].tolist(), "values": t.ravel().tolist()}
                    for (a, b, *_), t in zip(chosen, added, strict=True)]


def sum_of_tables(model: list[dict], x):
    """The model's sum for each row of measures."""
    import numpy as np

    total = np.zeros(len(x))
    for t in model:
        cell = np.zeros(len(x), np.int64)
        if t["a"] >= 0:
            cell = np.searchsorted(t["cuts_a"], x[:, t["a"]], side="right")
        if t["b"] >= 0:
            cell = cell * (len(t["cuts_b"]) + 1) + np.searchsorted(t["cuts_b"], x[:, t["b"]], side="right")
        total += np.asarray(t["values"])[cell]
    return total


# --- on Spark ----------------------------------------------------------------------------------------

MODEL = "a int, b int, cuts_a array<double>, cuts_b array<double>, values array<double>"


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
          label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows of MODEL fitted on the labelled rows that are in ``labels``."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    order = F.md5(F.col("_id").cast("string"))
    chosen = marked.orderBy(order, "_id").limit(rows)
    found = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(
        order.alias("o"), F.col("_y").alias("y"), F.col(text_col).alias("text"))

    def measured(batches):
        import pyarrow as pa

        for batch in byte_slices(batches, 2):
            x = measures(*column_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["o", "y", "x"])

    def fitted(key, frame):
        import numpy as np
        import pandas as pd

        frame = frame.assign(t=[tuple(v) for v in frame["x"]]).sort_values(["o", "y", "t"], kind="stable")
        return pd.DataFrame(fit(np.stack(frame["x"]), frame["y"]))

    return (found.mapInArrow(measured, "o string, y int, x array<double>").withColumn("one", F.lit(1))
            .groupBy("one").applyInPandas(fitted, MODEL))


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, score) for every row of ``docs``. ``model`` is a table of a few dozen rows."""
    import numpy as np

    tables = [r.asDict() for r in model.collect()] or fit(np.zeros((0, len(NAMES))), [], pairs=0)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in byte_slices(batches, 1):
            x = measures(*column_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(logistic(sum_of_tables(tables, x)))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, score double")


def op11_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.where(~held_out("doc_id", 4, 2)))
    return score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
