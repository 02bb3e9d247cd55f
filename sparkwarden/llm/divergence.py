"""How the sources of a language differ in the words they use.

Each task counts the terms of its documents in byte tries, one for each language. A trie's edges are eight bytes long, and
it is built level by level with numpy: the nodes of a level are the distinct pairs of a parent and an edge, so all terms of
some megabytes of text go down together. Its leaves, laid out in byte order, have a counter for every source and the number
of documents; they travel in pieces, are dealt by ranges of prefixes and merged there in tries again. As they come in
order, all leaves before the newest piece are complete and leave, so that a merging task holds what overlaps and no more.
The kept leaves, in blocks, are walked once more with the totals of all sources: each block adds to the distance of every
pair of sources and offers its terms, in UTF-8 order, as candidates.
"""

from __future__ import annotations

from bisect import bisect_right
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import delete, slices, text_bytes, written

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of text that are counted in one trie; leaves that a task gathers before it merges them.
GATHER, HELD = 8_000_000, 600_000
#: Leaves in a piece, and in a block of kept leaves; bytes of an edge.
PIECE, BLOCK, EDGE = 8192, 2048, 8
#: Sources whose distances one row of work measures, and pieces of the sample that sets the ranges, for each range.
TILE, SAMPLE = 256, 20
#: Bytes of pieces that a range aims at.
RANGE_BYTES = 8 << 20

#: The bytes of terms: [^\x00-\x40\x5B-\x60\x7B-\x7F] in UTF-8, A-Z lower-cased.
_LETTER = np.zeros(256, dtype=np.int8)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --- tries -----------------------------------------------------------------------------------------------------------


def edges(raw: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The EDGE bytes from `at` on as a number that is ordered as they are; what is at or after an end counts as zero, a byte
    that no term has."""
    view = np.ndarray(len(raw) + 1, ">u8", np.concatenate([raw, np.zeros(EDGE, np.uint8)]).tobytes(), strides=(1,))
    gone = np.uint64(8) * np.clip(EDGE - (ends - at), 0, EDGE).astype(np.uint64)
    value = view[np.minimum(at, len(raw))].astype(np.uint64)
    return np.where(gone < 64, value >> np.minimum(gone, np.uint64(63)) << np.minimum(gone, np.uint64(63)), np.uint64(0))


def nodes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """The node at which each term ends, and how many nodes there are: equal terms, and no others, end at one node."""
    number, total = np.zeros(len(starts), np.int64), 0
    going, parent, depth = np.arange(len(starts)), np.zeros(len(starts), np.int64), 0
    while len(going):
        edge = edges(raw, starts[going] + EDGE * depth, ends[going])
        order = np.lexsort((edge, parent)) if depth else np.argsort(edge)
        e, p = edge[order], parent[order]
        node = np.empty(len(going), np.int64)
        node[order] = total + np.cumsum(np.concatenate([[False], (e[1:] != e[:-1]) | (p[1:] != p[:-1])]))
        number[going], total, depth = node, int(node.max()) + 1, depth + 1
        more = ends[going] > starts[going] + EDGE * depth
        going, parent = going[more], node[more]
    return number, total


def byte_order(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The order of the terms by their bytes."""
    levels = -(-int((ends - starts).max(initial=0)) // EDGE)
    if levels <= 8:
        return np.lexsort([edges(raw, starts + EDGE * k, ends) for k in reversed(range(levels))]) if levels else np.arange(len(starts))
    data = raw.tobytes()  # a few very long terms would make many keys for all
    return np.array(sorted(range(len(starts)), key=[data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)].__getitem__), dtype=np.int64)


def _least_type(x: np.ndarray) -> str:
    top = int(x.max(initial=0))
    return next(t for t in ("<u1", "<u2", "<u4", "<i8") if top <= np.iinfo(t).max)


class Leaves:
    """Leaves of a trie in byte order: term k is raw[starts[k]:ends[k]], docs[k] documents have it, and its counters are
    bounds[k] to bounds[k+1] of source and count."""

    def __init__(self, raw, starts, ends, docs, bounds, source, count):
        self.raw, self.starts, self.ends, self.docs, self.bounds, self.source, self.count = raw, starts, ends, docs, bounds, source, count

    def __len__(self) -> int:
        return len(self.docs)

    @property
    def terms(self) -> list[bytes]:
        data = self.raw.tobytes()
        return [data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def prefixes(self) -> np.ndarray:
        """The first edges."""
        return edges(self.raw, self.starts, self.ends)

    def take(self, which: np.ndarray) -> Leaves:
        """The leaves at the places `which`."""
        size = np.diff(self.bounds)[which]
        at = np.repeat(self.bounds[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return Leaves(self.raw, self.starts[which], self.ends[which], self.docs[which], np.concatenate([[0], np.cumsum(size)]), self.source[at], self.count[at])

    def parts(self, most: int):
        for k in range(0, len(self), most):
            yield self.take(np.arange(k, min(k + most, len(self))))

    def packed(self) -> Leaves:
        """The same with a raw of its terms alone."""
        size = self.ends - self.starts
        end = np.cumsum(size)
        at = np.repeat(self.starts - (end - size), size) + np.arange(size.sum())
        return Leaves(self.raw[at], end - size, end, self.docs, self.bounds, self.source, self.count)

    def dump(self) -> tuple[list[int], bytes]:
        """The sources, and the bytes of the leaves, whose counters have a source's place among them; each column in the least type that holds it."""
        used, place = np.unique(self.source, return_inverse=True)
        own = self.packed()
        columns = [own.ends - own.starts, own.docs, np.diff(own.bounds), place, own.count]
        kinds = [_least_type(c) for c in columns]
        head = np.array([len(own), len(own.count), len(own.raw), *[int(k[2:]) for k in kinds]], dtype="<i8")
        return used.tolist(), b"".join([head.tobytes(), *[c.astype(k).tobytes() for c, k in zip(columns, kinds, strict=True)], own.raw.tobytes()])

    @classmethod
    def load(cls, data: bytes, sources: np.ndarray) -> Leaves:
        """What dump() wrote; sources: what to put for each place."""
        head = np.frombuffer(data, "<i8", 8)
        at, columns = 64, []
        for n, width in zip((head[0], head[0], head[0], head[1], head[1]), head[3:], strict=True):
            columns.append(np.frombuffer(data, {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}[int(width)], int(n), at).astype(np.int64))
            at += int(n * width)
        ends = np.cumsum(columns[0])
        return cls(np.frombuffer(data, np.uint8, int(head[2]), at), ends - columns[0], ends, columns[1], np.concatenate([[0], np.cumsum(columns[2])]), sources[columns[3]], columns[4])


def _reduced(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of the values of each."""
    if not len(key):
        return key, *values
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], *[np.add.reduceat(v[order], first) for v in values]


def merge(tries: list[Leaves]) -> Leaves:
    """One trie of the leaves of several: those of one term are one, its documents and counts added up."""
    raw = np.concatenate([t.raw for t in tries])
    base = np.cumsum([0, *[len(t.raw) for t in tries[:-1]]])
    starts, ends = (np.concatenate([getattr(t, x) + b for t, b in zip(tries, base, strict=True)]) for x in ("starts", "ends"))
    number, total = nodes(raw, starts, ends)
    one = np.full(total, -1)
    one[number] = np.arange(len(number))
    leaf = np.flatnonzero(one >= 0)  # the other nodes lie on the way to one
    leaf = leaf[byte_order(raw, starts[one[leaf]], ends[one[leaf]])]
    rank = np.zeros(total, np.int64)
    rank[leaf] = np.arange(len(leaf))
    docs = np.zeros(len(leaf), np.int64)
    np.add.at(docs, rank[number], np.concatenate([t.docs for t in tries]))
    source, count = (np.concatenate([getattr(t, x) for t in tries]) for x in ("source", "count"))
    each = np.repeat(rank[number], np.concatenate([np.diff(t.bounds) for t in tries]))
    width = int(source.max(initial=0)) + 1
    key, count = _reduced(each * width + source, count)
    return Leaves(raw, starts[one[leaf]], ends[one[leaf]], docs, np.searchsorted(key, np.arange(len(leaf) + 1) * width), key % width, count).packed()


# --- counting and merging ---------------------------------------------------------------------------------------------


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms, and the row of each; none runs over the edge of two rows."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def counted(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray, langs: np.ndarray) -> dict[int, Leaves]:
    """A trie for each language of the texts (lower-cased bytes, offsets, each one's group); langs: the language of each group. The sources are groups."""
    starts, ends, row = spans(raw, offsets)
    if not len(starts):
        return {}
    number, total = nodes(raw, starts, ends)
    one = np.full(total, -1)
    one[number] = np.arange(len(number))
    leaf = np.flatnonzero(one >= 0)
    leaf = leaf[byte_order(raw, starts[one[leaf]], ends[one[leaf]])]
    rank = np.zeros(total, np.int64)
    rank[leaf] = np.arange(len(leaf))
    at, m, g = one[leaf], len(leaf), len(langs)
    # a row for each document and term, then one for each language, term and group
    pair = np.sort(row * m + rank[number])
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    pair, n = pair[first], np.diff(np.append(first, len(pair)))
    own = group[pair // m]
    both, docs, count = _reduced((langs[own] * m + pair % m) * g + own, np.ones(len(pair), np.int64), n)
    of, out = both // g, {}
    for lang in np.unique(of // m).tolist():
        lo, hi = np.searchsorted(of, [lang * m, (lang + 1) * m])
        terms, first = np.unique(of[lo:hi], return_index=True)
        which = at[terms - lang * m]
        out[lang] = Leaves(raw, starts[which], ends[which], np.add.reduceat(docs[lo:hi], first), np.concatenate([first, [hi - lo]]), both[lo:hi] % g, count[lo:hi])
    return out


def _portions(raw: np.ndarray, size: int):
    """Parts of a text of at least `size` bytes (the last may have fewer), cut where no term is."""
    gaps, start = np.flatnonzero(_LETTER[raw] == 0), 0
    while start < len(raw):
        k = int(np.searchsorted(gaps, start + size))
        stop = int(gaps[k]) if k < len(gaps) else len(raw)
        yield raw[start:stop]
        start = stop


_PIECES = "lang string, first binary, last binary, sources array<string>, data binary"


def _record(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def _prefix(value) -> bytes:
    return int(value).to_bytes(EDGE, "big")


_KINDS = [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()]


def _piece(lang: str, part: Leaves, sources: list[str]) -> tuple:
    used, data = part.dump()
    ends = part.prefixes()[[0, -1]]
    return lang, _prefix(ends[0]), _prefix(ends[1]), [sources[k] for k in used], data


def _counted(batches):
    """Pieces of the tries of a partition's documents (lang, source, text)."""
    sources: dict[str, int] = {}
    held: dict[str, list[Leaves]] = {}

    def pieces():
        names = list(sources)
        for lang, tries in held.items():
            for part in merge(tries).parts(PIECE):
                yield _record([_piece(lang, part, names)], ["lang", "first", "last", "sources", "data"], _KINDS)
        held.clear()

    for b in batches:
        of = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        groups = sorted(set(of))
        place = {x: k for k, x in enumerate(groups)}
        group = np.array([place[x] for x in of], dtype=np.int64)
        names = sorted({lang for lang, _ in groups})
        langs = np.array([names.index(lang) for lang, _ in groups], dtype=np.int64)
        known = np.array([sources.setdefault(source, len(sources)) for _, source in groups], dtype=np.int64)
        raw, offsets = text_bytes(b.column(2))
        for x, y in slices(offsets, GATHER):
            low = _LOWER[raw[offsets[x] : offsets[y]]]
            if y == x + 1 and len(low) > 2 * GATHER:
                tries, found = {}, [t for part in _portions(low, GATHER) for t in counted(part, np.array([0, len(part)]), group[x:y], langs).values()]
                if found:
                    tries[int(langs[group[x]])] = whole = merge(found)
                    whole.docs[:] = 1  # it is one document
            else:
                tries = counted(low, offsets[x : y + 1] - offsets[x], group[x:y], langs)
            for lang, trie in tries.items():
                trie = trie.packed()
                trie.source = known[trie.source]
                held.setdefault(names[lang], []).append(trie)
            if sum(len(t) for tries in held.values() for t in tries) >= HELD:
                yield from pieces()
    yield from pieces()


def _ranged(cuts: list[tuple]):
    """Pieces cut at the edges of ranges; range k begins at cuts[k-1]."""

    def rows(batches):
        for b in batches:
            for lang, first, last, sources, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                key = lang.encode()
                lo, hi = (bisect_right(cuts, (key, x)) for x in (first, last))
                out = [(lo, lang, first, last, sources, data)]
                if hi > lo:
                    leaves = Leaves.load(data, np.arange(len(sources)))
                    edge = np.array([int.from_bytes(x, "big") for _, x in cuts[lo:hi]], dtype=np.uint64)
                    at = [0, *np.searchsorted(leaves.prefixes(), edge).tolist(), len(leaves)]
                    out = [(lo + k, *_piece(lang, leaves.take(np.arange(at[k], at[k + 1])), sources)) for k in range(len(at) - 1) if at[k] < at[k + 1]]
                yield _record(out, ["range", "lang", "first", "last", "sources", "data"], [pa.int32(), *_KINDS])

    return rows


_BLOCKS = "lang string, terms int, sources array<string>, sums array<long>, data binary"


def _merged(least: int):
    """Blocks of kept leaves, from pieces (range, lang, first, last, sources, data) in this order."""

    def rows(batches):
        now, names, held, most = None, {}, [], HELD

        def blocks(leaves: Leaves):
            known = list(names)
            for part in leaves.take(np.flatnonzero(leaves.docs >= least)).parts(BLOCK):
                used, data = part.dump()
                sums = np.zeros(len(used), np.int64)
                np.add.at(sums, np.searchsorted(used, part.source), part.count)
                kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                yield _record([(now[1], len(part), [known[s] for s in used], sums.tolist(), data)], ["lang", "terms", "sources", "sums", "data"], kinds)

        for b in batches:
            for range_, lang, first, sources, data in zip(*[b.column(k).to_pylist() for k in (0, 1, 2, 4, 5)], strict=True):
                if now != (range_, lang):
                    if held:
                        yield from blocks(merge(held))
                    now, names, held, most = (range_, lang), {}, [], HELD
                elif sum(map(len, held)) >= most:
                    whole = merge(held)
                    done = int(np.searchsorted(whole.prefixes(), np.uint64(int.from_bytes(first, "big"))))  # what comes is not before `first`
                    yield from blocks(whole.take(np.arange(done)))
                    held = [whole.take(np.arange(done, len(whole))).packed()]
                    most = max(HELD, 2 * len(held[0]))
                held.append(Leaves.load(data, np.array([names.setdefault(s, len(names)) for s in sources], dtype=np.int64)))
        if held:
            yield from blocks(merge(held))

    return rows


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Blocks of the leaves that at least `least` documents of a language have, from docs (lang, source, text) without nulls."""
    spark = docs.sparkSession
    pieces = written(docs.select("lang", "source", "text").mapInArrow(_counted, _PIECES), "trie-pieces")
    size = pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    # a bounded sample, which sets how evenly the ranges are dealt and nothing else
    sample = sorted((r["lang"].encode(), bytes(r["first"])) for r in pieces.select("lang", "first").orderBy(F.xxhash64("first", "lang"), "lang", "first").limit(SAMPLE * ranges).collect())
    cuts = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    dealt = pieces.mapInArrow(_ranged(cuts), "range int, " + _PIECES).repartition(ranges, "range").sortWithinPartitions("range", "lang", "first")
    kept = written(dealt.mapInArrow(_merged(least), _BLOCKS), "trie-kept")
    delete(pieces)
    return kept


# --- distances and candidates -----------------------------------------------------------------------------------------


def shares(counts: np.ndarray, total, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    total = np.asarray(total, dtype=np.int64)
    if max(int(counts.max(initial=0)), int(total.max(initial=0)) // SCALE + 1) + SMOOTH < (1 << 63) // SCALE:
        return 1 + SCALE * (counts + SMOOTH) // (total + SMOOTH * terms)
    return (1 + SCALE * (counts.astype(object) + SMOOTH) // (total.astype(object) + SMOOTH * terms)).astype(np.int64)


_FOUND = "lang string, source string, part string, item string, value long"


def _measured(batches):
    """Sums of distances of pairs (each once) and the best candidates of each source, of a partition's blocks and tiles."""
    sums: dict[tuple, tuple] = {}
    best: dict[tuple, list] = {}

    def out(rows):
        return _record(rows, ["lang", "source", "part", "item", "value"], [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()])

    def pairs():
        for (lang, a, b), (left, right, total) in sums.items():
            for i, s in enumerate(left):
                yield out([(lang, s, "pair", right[j], int(total[i, j])) for j in range(i + 1 if a == b else 0, len(right))])
        sums.clear()

    def candidates():
        for (lang, source), top in best.items():
            yield out([(lang, source, "term", term.decode(), -f) for f, term in top])
        best.clear()

    for batch in batches:
        for row in batch.to_pylist():
            leaves, lang, terms = Leaves.load(row["data"], np.arange(len(row["sources"]))), row["lang"], row["kept"]
            line, spelled = np.repeat(np.arange(len(leaves)), np.diff(leaves.bounds)), leaves.terms

            def dense(names, line=line, leaves=leaves, row=row):
                place = {s: k for k, s in enumerate(names)}
                column = np.array([place.get(s, -1) for s in row["sources"]], dtype=np.int64)[leaves.source]
                has = column >= 0
                counts = np.zeros((len(leaves), len(names)), dtype=np.int64)
                counts[line[has], column[has]] = leaves.count[has]
                return counts

            left = dense(row["left"])
            p = shares(left, row["left_totals"], terms)
            same = row["a"] == row["b"]
            q = p if same else shares(dense(row["right"]), row["right_totals"], terms)
            key = lang, row["a"], row["b"]
            if key not in sums:
                if len(sums) >= 64:
                    yield from pairs()
                sums[key] = row["left"], row["right"], np.zeros((len(row["left"]), len(row["right"])), dtype=np.int64)
            for i in range(len(row["left"])):
                begin = i + 1 if same else 0
                sums[key][2][i, begin:] += np.abs(q[:, begin:] - p[:, i : i + 1]).sum(axis=0)
            if same:  # the tiles on the diagonal cover every source once
                whole = np.zeros(len(leaves), dtype=np.int64)
                np.add.at(whole, line, leaves.count)
                over = p - shares(whole, row["lang_total"], terms)[:, None]
                for i, source in enumerate(row["left"]):
                    mine = np.flatnonzero((left[:, i] > 0) & (over[:, i] > 0))
                    mine = mine[np.argsort(-over[mine, i], kind="stable")[:TOP]]  # equal ones stay in the order of the walk
                    best[lang, source] = nsmallest(TOP, best.get((lang, source), []) + [(-int(over[k, i]), spelled[k]) for k in mine.tolist()])
                if len(best) > 4096:
                    yield from candidates()
    yield from pairs()
    yield from candidates()


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and its own terms.

    Terms are runs of letters (all of what is not ASCII counts as one), A-Z lower-cased, that `least` documents of the
    language have. Part "pair": item is another source of the language, value the sum over all kept terms of the
    distance of the two smoothed shares (0 without kept terms). Part "term": item is a term that the source has and uses
    more than its language does, value by how much, the TOP first of each source. Ranks go by value descending, then by
    the item's UTF-8 bytes. A source without terms is a source. Nulls are empty strings, and so are one with those; what is
    no UTF-8 is replaced. Repeated rows are documents of their own, a long text is counted in portions, an empty table
    gives no rows, extra columns are not read.

    What moves are pieces of tries: a term that fills a third of all text is one leaf of each, a source or language
    that holds a third of the rows is dealt with its documents. All distances are whole numbers.
    """
    column = lambda c: F.coalesce(F.make_valid_utf8(F.col(c).cast("string")), F.lit(""))
    slim = docs.select(column(lang_col).alias("lang"), column(source_col).alias("source"), column(text_col).alias("text"))
    kept = kept_terms(slim, least)
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("terms").alias("kept"))
    groups = slim.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, "total")
    groups = written(groups.withColumn("tile", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / TILE).cast("int")), "trie-groups")
    langs = langs.join(groups.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang")
    tiles = groups.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("x"))  # of TILE sources at most
    side = lambda n, names, sums: tiles.select("lang", F.col("tile").alias(n), F.col("x.source").alias(names), F.col("x.total").alias(sums))
    work = side("a", "left", "left_totals").join(side("b", "right", "right_totals"), "lang").where("a <= b").join(langs, "lang")
    # a language has many blocks and, up to TILE sources, one row of work: Spark sends the work to the blocks if it is small by its statistics, and splits hot languages if it is not
    found = written(kept.select("lang", "sources", "data").join(written(work, "trie-work"), "lang").mapInArrow(_measured, _FOUND), "trie-found")
    one, other = groups.select("lang", "source"), groups.select("lang", F.col("source").alias("item"))
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pair = one.join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").fillna(0, "value")
    rows = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(found.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    ranked = rows.select("*", rank.alias("rank")).where(f"part = 'pair' or rank <= {TOP}")
    return ranked.select(F.col("lang").alias(lang_col), F.col("source").alias(source_col), "part", "item", "value", "rank")
