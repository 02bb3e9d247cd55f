"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Documents and benchmark items are sequences of folded words. Item runs of SEED words are the join keys; a document
that shares enough of them with an item is tiled against it: the longest common run of words not yet marked is found
by rolling hashes, marked on both sides, and the search goes on until no run of SEED words is left. The share of an
item's words under tiles is its coverage, whatever order its passages stand in.

The seed table of the benchmark is broadcast in blocks of at most BLOCK_WORDS words, one at a time, so what a task and the
driver hold is bounded however large the benchmark grows; every block is joined with all documents, and no text is shuffled.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import forget, gram_hashes, prefix_sums, slices, sums_hashes, text_bytes, word_hashes, written

SEED, COVERAGE = 5, 0.8
#: Words of the benchmark that are broadcast at once.
BLOCK_WORDS = 4_000_000


class _Side:
    """A sequence of words and which of them are free: hashes and free runs of any length from prefix sums, in linear time."""

    def __init__(self, words: np.ndarray):
        self.words, self.free = words, np.ones(len(words), dtype=np.int64)
        self.sums, self.taken = prefix_sums(words), np.zeros(len(words) + 1, dtype=np.int64)

    def mark(self, at: int, n: int) -> bool:
        """Takes the n words from `at` on, if all are free."""
        if not self.free[at : at + n].all():
            return False
        self.free[at : at + n] = 0
        return True

    def note(self) -> None:
        """Lets open_runs() see what was taken."""
        np.cumsum(1 - self.free, out=self.taken[1:])

    def open_runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the free runs of n words, and their hashes."""
        at = np.flatnonzero(self.taken[n:] == self.taken[:-n]) if n <= len(self.words) else np.zeros(0, np.int64)
        return at, sums_hashes(self.sums, at, at + n)


def _common(item: _Side, doc: _Side, n: int):
    """Free runs of n words that both sides have: starts and hashes in the item, and in the document."""
    (at_i, hash_i), (at_d, hash_d) = item.open_runs(n), doc.open_runs(n)
    both = np.intersect1d(hash_i, hash_d)
    in_i, in_d = np.isin(hash_i, both), np.isin(hash_d, both)
    return at_i[in_i], hash_i[in_i], at_d[in_d], hash_d[in_d]


def _longest(item: _Side, doc: _Side, most: int) -> int:
    """Length of the longest common run of free words, at most `most`, 0 if under SEED: common runs of n words imply ones of n-1."""
    low, high = SEED - 1, most
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if len(_common(item, doc, n)[0]) else (low, n - 1)
    return low if low >= SEED else 0


def _shared(item: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words of the document lie in a run of SEED words that the item has: no tile can take another."""
    out = np.zeros(len(doc) + 1, dtype=np.int64)
    at = np.flatnonzero(np.isin(gram_hashes(doc, SEED), gram_hashes(item, SEED)))
    np.add.at(out, at, 1)
    np.add.at(out, at + SEED, -1)
    return np.cumsum(out)[:-1] > 0


def _by_length(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles where runs repeat so often that their pairs cannot be listed: the longest length by bisection, all its tiles, the next.

    The document is first cut down to the words that a tile could take, with one word that matches nothing in each gap.
    """
    shared = _shared(item, doc)
    keep = shared | np.concatenate([[False], shared[:-1]])
    place = np.flatnonzero(keep)
    a, b = _Side(item), _Side(doc[keep])
    b.free[~shared[keep]] = 0
    b.note()
    tiles, most = [], min(len(item), len(place))
    while n := _longest(a, b, most):
        at_i, hash_i, at_d, hash_d = _common(a, b, n)
        places: dict[int, list[int]] = {}
        for d, h in zip(at_d.tolist(), hash_d.tolist(), strict=True):
            places.setdefault(h, []).append(d)
        for i, h in zip(at_i.tolist(), hash_i.tolist(), strict=True):
            for k, d in enumerate(places[h]):
                if not a.free[i : i + n].all():
                    break
                if (a.words[i : i + n] == b.words[d : d + n]).all() and b.mark(d, n):
                    a.mark(i, n)
                    tiles.append((i, int(place[d]), n))
                    places[h] = places[h][k + 1 :]
                    break
        a.note()
        b.note()
        most = n
    return tiles


#: Pairs of equal seeds for each word of both sides up to which tile() lists them.
LISTED = 8


def tile(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, words), longest first, none of under SEED words.

    Equal seeds that follow each other on both sides are one run. The longest run is taken if all of it is still free,
    else what is free of it goes back among the others, so every run is looked at once and for each tile that cuts it.
    """
    of_item, of_doc = gram_hashes(item, SEED), gram_hashes(doc, SEED)
    order = np.argsort(of_item, kind="stable")
    low, high = (np.searchsorted(of_item[order], of_doc, side=x) for x in ("left", "right"))
    count = high - low
    if count.sum() > LISTED * (len(item) + len(doc)):
        return _by_length(item, doc)
    d = np.repeat(np.arange(len(of_doc)), count)
    i = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    k = np.lexsort((i, d - i))
    i, d = i[k], d[k]
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(d - i) != 0) | (np.diff(i) != 1)])) if len(i) else np.zeros(0, np.int64)
    runs = [(-int(n) - SEED + 1, int(x), int(y)) for n, x, y in zip(np.diff(np.concatenate([begins, [len(i)]])), i[begins], d[begins], strict=True)]
    heapq.heapify(runs)
    free_i, free_d, tiles = np.ones(len(item), dtype=bool), np.ones(len(doc), dtype=bool), []
    while runs:
        n, x, y = heapq.heappop(runs)
        n = -n
        good = free_i[x : x + n] & free_d[y : y + n] & (item[x : x + n] == doc[y : y + n])
        if good.all():
            tiles.append((x, y, n))
            free_i[x : x + n] = free_d[y : y + n] = False
            continue
        step = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            if b - a >= SEED:
                heapq.heappush(runs, (a - b, x + a, y + a))
    return tiles


class Seeds:
    """The seeds of a block of items: sorted hashes, with the items and positions that have them; items of under SEED words,
    which have none, by the hash of all their words, for each number of words."""

    def __init__(self, ids: list, texts: list[str]):
        raw, offsets = text_bytes(pc.utf8_lower(pa.array(texts, pa.string())))
        words, rows, _, _ = word_hashes(raw, offsets)
        self.ids, self.items = ids, [words[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        grams = [gram_hashes(w, SEED) for w in self.items]
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, w in enumerate(self.items):
            if 0 < len(w) < SEED:
                self.short.setdefault(len(w), {}).setdefault(int(gram_hashes(w, len(w))[0]), []).append(k)
        owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, int)])
        every = np.concatenate([*grams, np.zeros(0, np.uint64)]).astype(np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes, first = np.unique(every[order], return_index=True)
        self.first = np.concatenate([first, [len(every)]])
        self.owner, self.place = owner[order], place[order]
        self.screen = np.zeros(1 << 22, dtype=bool)
        self.screen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def short_hits(self, words: np.ndarray, rows: np.ndarray):
        """(row, item, words) of the short items whose words stand in a row somewhere in a text; each once."""
        for n, known in sorted(self.short.items()):
            grams = gram_hashes(words, n)
            at = np.flatnonzero(np.isin(grams, np.fromiter(known, np.uint64, len(known))))
            row = np.searchsorted(rows, at, side="right") - 1
            inside = at + n <= rows[row + 1]
            for r, h in sorted(set(zip(row[inside].tolist(), grams[at[inside]].tolist(), strict=True))):
                yield from ((r, k, n) for k in known[h])

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of grams that are seeds, and which."""
        at = np.flatnonzero(self.screen[(grams >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        good = self.hashes[k] == grams[at]
        return at[good], k[good]

    def covered(self, words: np.ndarray, seeds: np.ndarray, coverage: float) -> list[tuple]:
        """(item, its words, covered words, tiles, longest tile) of the items that a document of these words covers enough of."""
        seeds = np.unique(seeds)
        pick = np.concatenate([np.arange(self.first[s], self.first[s + 1]) for s in seeds])
        owner, place, out = self.owner[pick], self.place[pick], []
        for k in np.unique(owner):
            item = self.items[k]
            under = np.zeros(len(item), dtype=bool)
            at = place[owner == k]
            for d in range(SEED):
                under[at + d] = True
            if under.sum() >= coverage * len(item):  # no tiling can cover more than its seeds
                tiles = tile(item, words)
                total = sum(n for _, _, n in tiles)
                if total >= coverage * len(item):
                    out.append((self.ids[k], len(item), total, len(tiles), tiles[0][2]))
        return out


def _found(column: pa.Array, seeds: Seeds, coverage: float):
    """(row, item, words, covered, tiles, longest) for the contaminated texts of a column."""
    raw, offsets = text_bytes(pc.utf8_lower(column))
    for a, b in slices(offsets):
        words, rows, _, _ = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        at, which = seeds.hits(gram_hashes(words, SEED))
        row = np.searchsorted(rows, at, side="right") - 1
        inside = at + SEED <= rows[row + 1]
        at, which, row = at[inside], which[inside], row[inside]
        for r in np.unique(row):
            for got in seeds.covered(words[rows[r] : rows[r + 1]], which[row == r], coverage):
                yield (a + int(r), *got)
        for r, k, n in seeds.short_hits(words, rows):
            yield (a + r, seeds.ids[k], n, n, 1, n)


#: The words of word_hashes() as a pattern: runs of ASCII letters and digits and of what is not ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _blocks(items: DataFrame):
    """The distinct items (item, text) in blocks of at most BLOCK_WORDS words (an item of more is a block), each ready to broadcast.

    The blocks are cut by a hash of the text; their number comes from the size of the benchmark. One block is read,
    broadcast and given up before the next.
    """
    total = items.agg(F.sum(F.regexp_count("text", F.lit(_WORD)))).first()[0] or 0
    n = math.ceil(total / (BLOCK_WORDS / 2))
    for k in range(n):
        got = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item").toArrow()
        yield items.sparkSession.sparkContext.broadcast(Seeds(got["item"].to_pylist(), got["text"].to_pylist())), n


def _distinct_items(benchmark: DataFrame, text_col: str) -> DataFrame:
    """(item: a hash of the text, text): equal items are one, so a repeated item does not fill a block."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return written(benchmark.select(F.xxhash64(text).alias("item"), text.alias("text")).distinct(), "benchmark")


_HITS = ["item_words", "covered_words", "tiles", "longest"]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item_id, item_words, covered_words, coverage, tiles, longest for each document and item that it covers enough of.

    Words are runs of letters and digits, case folded. Null and empty texts and items match nothing; an item of under
    SEED words, which no tile covers, is in each document that has all its words in a row. Repeated documents and items give repeated rows;
    of equally long tiles the first in the item is taken, then the first in the document. A long text costs in
    proportion to its length and to what it shares with an item. Only the named columns are read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, item long, " + ", ".join(f"{c} long" for c in _HITS)
    items = _distinct_items(benchmark, "text")

    def search(block):
        def run(batches):
            for b in batches:
                rows = list(_found(b.column(1), block.value, coverage))
                if rows:
                    take = b.column(0).take(pa.array([r[0] for r in rows]))
                    yield pa.RecordBatch.from_arrays([take, *[pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6)]], names=["id", "item", *_HITS])

        return slim.mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for block, n in _blocks(items):
        found = search(block)
        if n > 1:
            found = written(found, "benchmark-hits")
            block.destroy()
        out = found if n == 1 else out.unionByName(found)
    names = benchmark.select(F.col(item_col).alias("item_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("item"))
    out = out.join(names, "item")
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "item_words", "covered_words", (F.col("covered_words") / F.col("item_words")).alias("coverage"), "tiles", "longest")


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """The rows of docs that cover no item enough (see contaminated()), with all their columns and repeats; one pass over docs a block, no shuffle.

    With several blocks, what a block leaves is written before the next block is read, so one block is held at a time.
    """
    at, names = docs.columns.index(text_col), docs.columns
    plain, before = docs.toDF(*[f"c{k}" for k in range(len(names))]), None
    for block, n in _blocks(_distinct_items(benchmark, "text")):

        def keep(batches, block=block):
            for b in batches:
                good = np.ones(b.num_rows, dtype=bool)
                good[[r[0] for r in _found(b.column(at), block.value, coverage)]] = False
                yield b.filter(pa.array(good))

        plain = plain.mapInArrow(keep, plain.schema)
        if n > 1:
            plain = written(plain, "uncontaminated")
            block.destroy()
            forget(before)
            before = plain
    return plain.toDF(*names)
