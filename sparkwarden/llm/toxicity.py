"""Toxicity scores by a factorization machine over hashed terms.

Terms are words and their first five bytes (which joins inflected forms), hashed into 2^BITS cells. A text is a vector
over the cells that it has, each weighted by how surely the training texts with it differ in label, alone or together
with another cell; what tells in neither way weighs nothing. The machine adds a linear part and, through RANK factors a cell, a weight for every pair of terms: an insult next to the
mention of a group can count for more, or less, than both alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import delete, slices, span_hashes, text_bytes, word_spans, written
from sparkwarden.llm.quality import held_out, labelled, one_each

#: Bounds on the labelled rows that a model is fitted on, and on the cells of their texts.
TRAIN_ROWS, TRAIN_CELLS = 12_000, 16_000_000
THRESHOLD = 0.7
BITS, RANK, LEAST, EPOCHS, BATCH, RATE, L2, G0 = 18, 8, 3, 12, 128, 0.2, 1e-3, 1.0
#: |z| from which a cell counts on its own or as one of a pair (half a million pairs are looked at), and that of full weight.
Z_LEAST, Z_PAIR, Z_FULL = 3.5, 6.0, 10.0
#: Cells whose pairs are screened: those that most texts, or fewest, are without or with.
PAIR_CELLS = 1024
STEM = 5


def terms(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of each row and the row boundaries in them; weights: cells of weight zero are left out."""
    starts, ends, rows = word_spans(raw, offsets)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(rows))
    long = ends - starts > STEM
    shift = np.uint64(64 - BITS)
    cell = np.concatenate([span_hashes(raw, starts, ends) >> shift, (span_hashes(raw, starts[long], starts[long] + STEM) ^ np.uint64(0x5851F42D4C957F2D)) >> shift]).astype(np.int64)
    row = np.concatenate([row, row[long]])
    if weights is not None:
        used = weights[cell] > 0
        cell, row = cell[used], row[used]
    both = np.unique(row << BITS | cell)
    return (both & (1 << BITS) - 1).astype(np.int32), np.searchsorted(both, np.arange(n + 1) << BITS)


def _cells(column: pa.Array, weights: np.ndarray | None = None):
    raw, offsets = text_bytes(pc.utf8_lower(column))
    for a, b in slices(offsets):
        yield terms(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], weights)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds, along the first axis; a row's sum does not depend on the rows around it."""
    padded = np.concatenate([values, np.zeros((1, *values.shape[1:]))]).astype(np.float64)
    out = np.add.reduceat(padded, bounds[:-1], axis=0)
    out[bounds[1:] == bounds[:-1]] = 0.0
    return out


@dataclass
class Machine:
    weight: np.ndarray  # of each cell, 0 (not used) to 1
    linear: np.ndarray
    factors: np.ndarray
    bias: float

    def vector(self, cell: np.ndarray) -> np.ndarray:
        return self.weight[cell].astype(np.float64)

    def margin(self, cell: np.ndarray, bounds: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The margin of each row, and its summed factors."""
        vx = self.factors[cell] * x[:, None]
        s = _sums(vx, bounds)
        pairs = 0.5 * ((s**2).sum(axis=1) - _sums((vx**2).sum(axis=1), bounds))
        return self.bias + _sums(self.linear[cell] * x, bounds) + pairs, s

    def predict(self, column: pa.Array) -> np.ndarray:
        """P(toxic) of each text; a text without known terms gets what the bias says."""
        out = [1 / (1 + np.exp(-np.clip(self.margin(c, b, self.vector(c))[0], -30, 30))) for c, b in _cells(column, self.weight)]
        return np.concatenate(out) if out else np.zeros(0)


def association(seen: np.ndarray, toxic: np.ndarray, n: int, positive: float) -> np.ndarray:
    """|z| of the share of toxic texts among those with a cell against the others; 0 for cells of fewer than LEAST texts."""
    other = np.maximum(n - seen, 1)
    share = positive / max(n, 1)
    spread = np.sqrt(max(share * (1 - share), 1e-9) * (1 / np.maximum(seen, 1) + 1 / other))
    z = np.abs(toxic / np.maximum(seen, 1) - (positive - toxic) / other) / spread
    return np.where(seen >= LEAST, z, 0.0)


def interaction(cell: np.ndarray, bounds: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The largest |z| over all partners of each of the cells `used`: by how much the toxic share of texts with both cells
    of a pair differs from what either alone adds up to (a pair counts if LEAST texts have both, each alone and neither)."""
    n, m = len(y), len(used)
    column = np.full(1 << BITS, -1)
    column[used] = np.arange(m)
    at = column[cell]
    has = np.zeros((n, m), dtype=np.float32)
    has[np.repeat(np.arange(n), np.diff(bounds))[at >= 0], at[at >= 0]] = 1
    out = np.zeros(m)
    one, one_toxic = has.sum(axis=0), y.astype(np.float32) @ has
    for k in range(0, m, 256):  # bounds the work arrays
        both, both_toxic = has[:, k : k + 256].T @ has, (has[:, k : k + 256] * y[:, None].astype(np.float32)).T @ has
        rows, toxic = [both, one[k : k + 256, None] - both, one - both], [both_toxic, one_toxic[k : k + 256, None] - both_toxic, one_toxic - both_toxic]
        rows.append(n - rows[0] - rows[1] - rows[2])
        toxic.append(y.sum() - toxic[0] - toxic[1] - toxic[2])
        share = [(t + 0.5) / (r + 1) for r, t in zip(rows, toxic, strict=True)]
        spread = np.sqrt(sum(p * (1 - p) / np.maximum(r, 1) for r, p in zip(rows, share, strict=True)))
        z = np.abs(share[0] - share[1] - share[2] + share[3]) / spread
        z[np.minimum.reduce(rows) < LEAST] = 0
        out[k : k + 256] = z.max(axis=1)
    return out


def weights(cell: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 to 1 for each cell: how surely it tells on its own (from Z_LEAST on) or as one of a pair (from Z_PAIR on, by the PAIR_CELLS
    cells that parted texts most evenly)."""
    size, n = 1 << BITS, len(y)
    seen = np.bincount(cell, minlength=size)
    own = association(seen, np.bincount(cell, np.repeat(y, np.diff(bounds)), size), n, float(y.sum()))
    out = np.where(own >= Z_LEAST, np.minimum(own / Z_FULL, 1.0), 0.0)
    even = np.minimum(seen, n - seen)
    used = np.argsort(-even, kind="stable")[:PAIR_CELLS]
    used = used[even[used] >= 2 * LEAST]
    if len(used) > 1:
        z = interaction(cell, bounds, y, used)
        out[used] = np.maximum(out[used], np.where(z >= Z_PAIR, np.minimum(z / Z_FULL, 1.0), 0.0))
    return out.astype(np.float32)


def fit(cell: np.ndarray, bounds: np.ndarray, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS) -> Machine:
    """A machine fitted by AdaGrad over small batches, in a fixed shuffled order; rank 0 leaves the linear part alone."""
    size, n = 1 << BITS, len(y)
    weight = weights(cell, bounds, y)
    rng = np.random.default_rng(7)
    share = (y.sum() + 1) / (n + 2)
    m = Machine(weight, np.zeros(size, np.float32), (0.05 * rng.standard_normal((size, rank))).astype(np.float32), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < n:
        return m
    x = m.vector(cell)
    keep = x > 0
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    cell, x = cell[keep], x[keep]
    g_lin, g_fac, g_bias = np.full(size, G0, np.float32), np.full((size, rank), G0, np.float32), G0
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            rows = order[k : k + BATCH]
            length = bounds[rows + 1] - bounds[rows]
            at = np.repeat(bounds[rows] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            c, v, b = cell[at], x[at], np.concatenate([[0], np.cumsum(length)])
            margin, s = m.margin(c, b, v)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows])
            each = np.repeat(err, length) * v
            used, place = np.unique(c, return_inverse=True)
            d = np.bincount(place, each, len(used)) + L2 * m.linear[used]
            g_lin[used] += d**2
            m.linear[used] -= RATE * d / np.sqrt(g_lin[used])
            if rank:
                full = each[:, None] * (np.repeat(s, length, axis=0) - m.factors[c] * v[:, None])
                d = np.column_stack([np.bincount(place, full[:, f], len(used)) for f in range(rank)]) + L2 * m.factors[used]
                g_fac[used] += d**2
                m.factors[used] -= RATE * d / np.sqrt(g_fac[used])
            d = err.sum()
            g_bias += d**2
            m.bias -= RATE * d / np.sqrt(g_bias)
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", modulus: int = 3, rest: int = 1) -> Machine:
    """The model of the labelled rows, one of each id, the same however the rows are dealt: at most TRAIN_ROWS, and of these,
    by the hash of their ids, as many as have TRAIN_CELLS cells together, so that the driver holds so many whatever the texts are."""
    rows = labelled(docs, labels, label, id_col, text_col, modulus, rest, TRAIN_ROWS)

    def describe(batches):
        for b in batches:
            found = [np.split(c, e[1:-1]) for c, e in _cells(b.column(2))]
            cells = pa.array([x.astype("<i4").tobytes() for part in found for x in part], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cells, b.column(3)], names=["id", "hash", "x", "label"])

    each = written(one_each(rows.mapInArrow(describe, f"id {rows.schema['id'].dataType.simpleString()}, hash long, x binary, label double")), "toxicity-rows")
    sizes = sorted(tuple(r) for r in each.select(F.xxhash64("id"), "id", F.octet_length("x") / 4).collect())
    fits = int(np.searchsorted(np.cumsum([n for *_, n in sizes]), TRAIN_CELLS, side="right"))
    if fits < len(sizes):
        h, key = sizes[fits][:2]
        used = each.where((F.xxhash64("id") < h) | ((F.xxhash64("id") == h) & (F.col("id") < F.lit(key))))
    else:
        used = each
    got = used.select("x", "label").toArrow()
    delete(each)
    rows = sorted(zip(got["x"].to_pylist(), got["label"].to_pylist(), strict=True))  # in the same order, however they were dealt
    cells = [np.frombuffer(c, dtype="<i4") for c, _ in rows]
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)
    return fit(np.concatenate([*cells, np.zeros(0, np.int32)]).astype(np.int32), bounds, np.array([v for _, v in rows]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted (score >= THRESHOLD) per row of docs.

    Null and empty texts get the score of a text without known terms, very long ones that of the whole text. Without usable
    labels every score is near the smoothed share of a class; an empty table gives no rows. Repeated rows stay (one of an id
    is learnt from), only the id and text columns are read. The model is of fixed size, and so is what it is learnt from;
    scores do not depend on how the rows are dealt.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))

    def rate(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.value.predict(b.column(2)), pa.float64())], names=["id", "held_out", "score"])

    slim = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), 3, 1).alias("held_out"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(rate, f"id {slim.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
