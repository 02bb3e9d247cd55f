"""Quality scores: histogram gradient-boosted trees over document statistics.

The statistics are counted over the bytes of a whole Arrow batch at once. Training (on the driver, over at most
TRAIN_ROWS labelled rows, statistics only) grows trees level by level from histograms of binned statistics. A trained
model is a handful of flat arrays, broadcast and walked by numpy for all rows of a batch together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import gram_hashes, slices, span_hashes, text_bytes

#: Bound on the labelled rows that a model is fitted on.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
BINS, TREES, DEPTH, RATE, LEAF_ROWS, L2 = 64, 120, 4, 0.12, 12, 1.0

STATS = (
    "log_bytes", "log_words", "log_lines", "letters", "upper", "digits", "sentence_marks", "symbols", "space", "non_ascii",
    "word_bytes", "word_bytes_sd", "words_per_line", "capitalised", "marked_words", "distinct_words", "repeated_pairs",
    "repeated_fives", "repeated_lines", "commonest_word", "longest_word",
)

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[[9, 11, 12, 13, 32]] = 7
_CLASS[10] = 8
_CLASS[[k for k in range(33, 127) if _CLASS[k] == 0]] = 6


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at row edges, and how many runs start before each row."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets] = True
    prev = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~prev | edge[:-1]))
    following = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~following | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _repeated(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row (fewer than 2^20): the share of its hashes that occur before in it, and the share of its commonest one. 44 bits of a hash tell."""
    count = np.bincount(rows, minlength=n_rows).astype(float)
    if not len(hashes):
        return np.zeros(n_rows), np.zeros(n_rows)
    keys = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    r = (keys >> np.uint64(44)).astype(np.int64)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.flatnonzero(first)
    runs = np.diff(np.concatenate([at, [len(keys)]]))
    distinct = np.bincount(r[at], minlength=n_rows)
    top = np.zeros(n_rows)
    np.maximum.at(top, r[at], runs)
    safe = np.maximum(count, 1)
    return np.where(count > 0, 1 - distinct / safe, 0.0), top / safe


def _stats(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    safe = np.maximum(size, 1)
    kinds = _CLASS[raw]
    sums = {}
    for c in range(1, 9):
        total = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(kinds == c, out=total[1:])
        sums[c] = np.diff(total[offsets]).astype(float)
    starts, ends, at = _runs(kinds < 7, offsets)
    words = np.diff(at).astype(float)
    some = np.maximum(words, 1)
    row = np.repeat(np.arange(n), np.diff(at))
    length = (ends - starts).astype(float)
    mean = np.bincount(row, length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, minlength=n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    hashes = span_hashes(raw, starts, ends)
    repeated, commonest = _repeated(hashes, row, n)
    grams = {}
    for k in (2, 5):
        g = gram_hashes(hashes, k)
        inside = row[: len(g)] == row[k - 1 : k - 1 + len(g)]
        grams[k] = _repeated(g[inside], row[: len(g)][inside], n)[0]
    ls, le, la = _runs(raw != 10, offsets)
    lines = np.diff(la).astype(float)
    again = _repeated(span_hashes(raw, ls, le), np.repeat(np.arange(n), np.diff(la)), n)[0]
    capital = np.bincount(row, kinds[starts] == 2, minlength=n) / some
    marked = np.bincount(row, kinds[ends - 1] == 6, minlength=n) / some
    letters = sums[1] + sums[2] + sums[4]
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), letters / safe, sums[2] / np.maximum(letters, 1), sums[3] / safe, sums[5] / safe,
        sums[6] / safe, (sums[7] + sums[8]) / safe, sums[4] / safe, mean, spread, words / np.maximum(lines, 1), capital, marked,
        1 - repeated, grams[2], grams[5], again, commonest, np.log1p(longest),
    ])


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text; null and empty texts have zeros (and all distinct words)."""
    raw, offsets = text_bytes(column)
    parts = [_stats(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATS)))


@dataclass
class Trees:
    """A forest in flat arrays: of node k, its statistic, cut and children stand at k; leaves point to themselves."""

    stat: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.stat[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for P(y = 1) by Newton steps on the logistic loss. Rows with one class only (or none) give its smoothed share."""
    n, m = x.shape
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    bins = np.column_stack([np.searchsorted(cuts[j], x[:, j]) for j in range(m)]) if n else np.zeros((0, m), int)
    flat = bins + np.arange(m) * BINS
    stat, cut, left, right, value, roots = [], [], [], [], [], []

    def add(v: float) -> int:
        k = len(stat)
        for to, what in ((stat, 0), (cut, np.inf), (left, k), (right, k), (value, v)):
            to.append(what)
        return k

    f = np.full(n, base)
    for _ in range(TREES if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(add(0.0))
        front = [(roots[-1], np.arange(n), 0)]
        while front:
            node, rows, depth = front.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best, at = 1e-6, None
            if depth < DEPTH and len(rows) >= 2 * LEAF_ROWS:
                cells = flat[rows].ravel()
                hist = [np.bincount(cells, np.repeat(w, m), minlength=m * BINS).reshape(m, BINS).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = hist
                gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                gain[(nl < LEAF_ROWS) | (len(rows) - nl < LEAF_ROWS)] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > best and b < len(cuts[j]):
                    at = (int(j), int(b))
            if at is None:
                value[node] = -RATE * gs / (hs + L2)
                f[rows] += value[node]
                continue
            stat[node], cut[node] = at[0], cuts[at[0]][at[1]]
            low = bins[rows, at[0]] <= at[1]
            left[node], right[node] = add(0.0), add(0.0)
            front += [(left[node], rows[low], depth + 1), (right[node], rows[~low], depth + 1)]
    a = lambda v, t: np.array(v, dtype=t)
    return Trees(a(stat, int), a(cut, float), a(left, int), a(right, int), a(value, float), a(roots, int), DEPTH, base)


def held_out(key, modulus: int, rest: int):
    """Whether the crc32 of the id, as text, leaves that rest; a null id is held out of training too."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == rest, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, modulus: int, rest: int, most: int) -> DataFrame:
    """(id, hash, text, label) of the rows of at most `most` labelled ids that may be learnt from, an even sample by a hash of the ids."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("label")).where("label is not null")
    known = known.where(~held_out(F.col("id"), modulus, rest)).groupBy("id").agg(F.max("label").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(most)
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).join(F.broadcast(picked), "id").select("id", "hash", "text", "label")


def one_each(described: DataFrame) -> DataFrame:
    """One row of (id, hash, x, label) for each id, that of the least hash, however the rows were dealt: as many as there are
    ids in the sample. Rows of one id meet as what was made of their texts, combined before they move."""
    return described.groupBy("id", "label").agg(F.min(F.struct("hash", "x")).alias("least")).select("id", "label", "least.x")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, rest: int = 2) -> Trees:
    """The model of the labelled rows, at most TRAIN_ROWS of them and one of each id, the same however the rows are dealt."""
    rows = labelled(docs, labels, label, id_col, text_col, modulus, rest, TRAIN_ROWS)

    def describe(batches):
        for b in batches:
            x = statistics(b.column(2))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat, b.column(3)], names=["id", "hash", "x", "label"])

    each = one_each(rows.mapInArrow(describe, f"id {rows.schema['id'].dataType.simpleString()}, hash long, x array<double>, label double"))
    got = each.select(F.concat("x", F.array("label")).alias("x")).toArrow()["x"].combine_chunks()
    x = np.asarray(got.flatten()).reshape(-1, len(STATS) + 1)
    x = x[np.lexsort(x.T)]  # the same rows in the same order, however they were dealt
    return fit(x[:, :-1], x[:, -1])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted (score >= THRESHOLD) per row of docs.

    Null and empty texts are scored by their (zero) statistics, very long ones by those of the whole text. Without usable
    labels every score is the smoothed share of a class, one half; an empty table gives no rows. Repeated rows stay (one of
    an id is learnt from), only the id and text columns are read. Scores do not depend on how the rows are dealt.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))

    def rate(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.value.predict(statistics(b.column(2))))], names=["id", "held_out", "score"])

    slim = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), 4, 2).alias("held_out"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(rate, f"id {slim.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    at = docs.columns.index(text_col)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(model.value.predict(statistics(b.column(at))) >= THRESHOLD))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
