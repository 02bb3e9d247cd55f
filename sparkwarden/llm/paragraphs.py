"""Passages of more than 50 words that repeat across documents: MinHash banding of paragraphs, exact Jaccard, components.

A paragraph is any PASSAGE words in a row, so lines and the places where a passage begins and ends play no part. A band's
minimum hash is taken over the paragraph's five-word shingles, and the band's key is the KEY words that begin with the
least one: neighbouring paragraphs mostly share it and are one row, about one in 22 words for each band. A repeated
paragraph shares the keys of all its bands, one with a changed word each key with a probability of 0.69 or more.

Paragraphs of one key are compared with those of the first and the last text that has the key, in an order of texts that
goes by the key: the pairs are aligned at the key, cut into blocks and verified by exact Jaccard of their shingles. That is
all that there is to compare if a key stands in two places. Where it stands in more, none of the other pairs is left out,
and yet they are not compared all with all. Equal paragraphs are one, linked with the first text that has it. Unlike
ones that are similar enough differ in one word that is changed, added or left out (two would cost six shingles of 47),
so they have their first or last HALF words in common: of few paragraphs with such a half all are compared, of many those
that are equal but for one word are one class, linked with its first text and with what is a word shorter. So no
link is lost, and what is compared grows with the paragraphs, not with their pairs. (That they differ in one word holds if
no three words in a row repeat in them, and for a similarity of 0.8 or more.) Equal texts are one text.
Overlapping paragraphs that matched are one passage, links make components, and a passage's words are cut where they
match an earlier text: what is cut in one place stands in another.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.llm.common import _ROOT_INV, connected_components, delete, gram_hashes, mix, powers, prefix_sums, slices, span_hashes, sums_hashes, text_bytes, word_hashes, word_spans
from sparkwarden.llm.common import written_once as written

PASSAGE, SHINGLE, SIMILARITY = 51, 5, 0.8
#: Words of a key, and bands.
KEY, BANDS = 8, 3
#: Words at the beginning or the end of a paragraph that one with another word has as well; so many paragraphs with the
#: same are compared all with all, more go by their words but one. That decides what is faster, not what is found.
HALF, FEW = PASSAGE // 2, 16
#: Orders of the texts, of which each key has one: by t with these bits turned round.
ORDERS = (0, 0x2AAAAAAAAAAAAAAA)
#: Paragraphs of a block that is verified at once; shingles of a paragraph and of a block.
BLOCK = 256
_EACH = PASSAGE - SHINGLE + 1
_SPAN = BLOCK + _EACH - 1
_CHUNK_BITS = 20  # positions that one sliding minimum runs over
_FACTORS = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# --- keys of paragraphs -------------------------------------------------------------------------------------------


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def hashes(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the shingles and of the runs of `length` words, for all bands."""
    at = np.arange(len(words) - length + 1)
    return gram_hashes(words, SHINGLE), span_hashes(words, at, at + length)


def keys(shingles: np.ndarray, spelled: np.ndarray, length: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For each PASSAGE words in a row: where the band's least shingle begins (leftmost if equal), and the words' hash from there."""
    n, width = len(spelled), PASSAGE - length + 1
    if width == 1:
        return np.arange(n), spelled
    low = np.uint64((1 << _CHUNK_BITS) - 1)
    order = shingles[:n] * _FACTORS[band] & ~low  # the shingles' hashes are spread evenly, so a product's upper bits order them anew
    at = np.concatenate(
        [
            (_sliding_least(order[a : a + (1 << _CHUNK_BITS)] | np.arange(min(1 << _CHUNK_BITS, n - a), dtype=np.uint64), width) & low).astype(np.int64) + a
            for a in range(0, n - width + 1, (1 << _CHUNK_BITS) - width + 1)
        ]
    )
    return at, spelled[at]


def _inside(n: int, places: np.ndarray) -> np.ndarray:
    """Which of n paragraphs lie in one of the packed places, or next to one."""
    steps = np.zeros(n + 1, dtype=np.int64)
    first, more, _ = unpacked(places)
    np.add.at(steps, np.maximum(first - 1, 0), 1)
    np.add.at(steps, np.minimum(first + more + 2, n), -1)
    return np.cumsum(steps)[:n] > 0


def packed(first, more, anchor):
    """A row's first paragraph, how many follow it and where the key begins (words after the first paragraph's), in one long."""
    return (first << 32) | (more << 6) | anchor


def unpacked(place):
    return place >> 32, (place >> 6) & 0x3FFFFFF, place & 63


def _again(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which of the values (of texts in order) stand further ahead in the same text."""
    order = np.lexsort((value, doc))  # stable, so equal ones stay in order
    same = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    out = np.zeros(len(doc), dtype=bool)
    out[order[1:][same]] = True
    return out


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, size = column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(size)[:-1])


def _key_rows(length: int, bands: int):
    """(t, text) to (key, t, place, again): a row for each run of paragraphs with one key; again: the text has had the key before."""

    def run(batches):
        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = text_bytes(pc.utf8_lower(b.column(1)))
            for x, y in slices(offsets):
                words, rows, _, _ = word_hashes(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                count = np.maximum(np.diff(rows) - PASSAGE + 1, 0)
                if not count.any():
                    continue
                doc = np.repeat(np.arange(y - x), count)
                para = np.arange(len(doc)) + np.repeat(rows[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
                made = hashes(words, length)
                for band in range(bands):
                    at, key = (x[para] for x in keys(*made, length, band))
                    new = np.concatenate([[True], (key[1:] != key[:-1]) | (para[1:] != para[:-1] + 1) | (doc[1:] != doc[:-1])])
                    k = np.flatnonzero(new)
                    since = np.arange(len(new)) - k[np.cumsum(new) - 1]  # a longer run repeats its own words: cut, so that each part is aligned
                    k = np.flatnonzero(since % (PASSAGE - length + 1) == 0)
                    size = np.diff(np.concatenate([k, [len(para)]]))
                    place = packed(para[k] - rows[doc[k]], size - 1, at[k] - para[k])
                    named = mix(key[k] + np.uint64(band)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(names[x + doc[k]]), pa.array(place), pa.array(_again(doc[k], named))], names=["key", "t", "place", "again"])

    return run


# --- exact verification -------------------------------------------------------------------------------------------


def _pieces(batches):
    """(t, text, starts) to (t, start, shingles): the hashes of the _SPAN shingles from `start` on, 0 where there is none."""
    for b in batches:
        names = b.column(0).to_numpy(zero_copy_only=False)
        raw, offsets = text_bytes(pc.utf8_lower(b.column(1)))
        starts = _lists(b.column(2)) if b.num_rows else []
        for x, y in slices(offsets):
            words, rows, _, _ = word_hashes(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            every = (gram_hashes(words, SHINGLE) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            for k in range(x, y):
                own = every[rows[k - x] : max(rows[k - x], rows[k - x + 1] - SHINGLE + 1)]
                for part in range(0, len(starts[k]), 1024):
                    start = starts[k][part : part + 1024].astype(np.int64)
                    at = start[:, None] + np.arange(_SPAN)
                    found = np.where((at >= 0) & (at < len(own)), own[np.clip(at, 0, max(len(own) - 1, 0))] if len(own) else np.uint32(0), np.uint32(0))
                    lists = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * _SPAN), len(start), [None, pa.py_buffer(np.ascontiguousarray(found))])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), names[k])), pa.array(start.astype(np.int32)), lists.cast(pa.binary())], names=["t", "start", "shingles"])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of two blocks of shingles: which of its BLOCK paragraphs have a Jaccard of `similarity` with the other's
    and begin and end with a shingle that the other has there; and where the other block has each shingle (-1: nowhere).

    The shingles are counted with repeats; a shingle that repeats within a block counts where it is aligned, or once.
    At the ends "there" allows for the shift that words added or left out in a paragraph of that similarity can make.
    """
    n = len(a)
    same = (a == b) & (a != 0)
    steps, partner = np.zeros((n, BLOCK + 1), dtype=np.int32), np.where(same, np.arange(_SPAN, dtype=np.int32), np.int32(-1))
    row_a, at_a = np.nonzero(~same & (a != 0))
    row_b, at_b = np.nonzero(~same & (b != 0))
    name = lambda rows, v: (rows.astype(np.uint64) << np.uint64(32)) | v
    _, i, j = np.intersect1d(name(row_a, a[row_a, at_a]), name(row_b, b[row_b, at_b]), return_indices=True)
    row, i, j = row_a[i], at_a[i], at_b[j]
    partner[row, i] = j
    first, last = np.maximum(np.maximum(i, j) - _EACH + 1, 0), np.minimum(np.minimum(i, j), BLOCK - 1)
    good = first <= last
    np.add.at(steps, (row[good], first[good]), 1)
    np.add.at(steps, (row[good], last[good] + 1), -1)

    def sums(x):
        total = np.concatenate([np.zeros((n, 1), np.int32), np.cumsum(x, axis=1, dtype=np.int32)], axis=1)
        return total[:, _EACH:] - total[:, :-_EACH]

    both = sums(same) + np.cumsum(steps, axis=1)[:, :BLOCK]
    whole = (sums(a != 0) == _EACH) & (sums(b != 0) == _EACH)
    there = (partner >= 0) & (np.abs(partner - np.arange(_SPAN)) <= shift(similarity))
    return whole & (both >= similarity * (2 * _EACH - both)) & there[:, :BLOCK] & there[:, _EACH - 1 :], partner


def shift(similarity: float) -> int:
    """By how many words two paragraphs of that similarity can be out of step: the shingles that either may lack."""
    return _EACH - math.ceil(2 * _EACH * similarity / (1 + similarity))


_LINKS = "t long, lo int, hi int, rep long, rep_lo int, rep_hi int"


def _alike_spans(a: np.ndarray, b: np.ndarray, similarity: float) -> list[np.ndarray]:
    """The rows of two blocks and the first and last shingles, there and in the other block, of the paragraphs in a row of `a` that are alike."""
    good = np.zeros((len(a), BLOCK + 2), dtype=np.int8)
    good[:, 1:-1], partner = alike(a, b, similarity)
    step = np.diff(good, axis=1)
    row, lo = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1] - 1 + _EACH - 1  # the last shingle of the last paragraph
    return [x.astype(np.int64) for x in (row, lo, last, partner[row, lo], partner[row, last])]


def _verify(similarity: float, both_ways: bool):
    """(t, start, rep, rep_start, sa, sb) to the spans of words that are alike in both, ends exclusive.

    both_ways: paragraphs of t that begin and end with shingles of rep, and those of rep that do so with t's; the same spans once.
    """

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                t, start, rep, rep_start = (part.column(c).to_numpy(zero_copy_only=False) for c in range(4))
                sa, sb = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint32).reshape(-1, _SPAN) for c in (4, 5))
                row, *spans = _alike_spans(sa, sb, similarity)
                if both_ways:
                    row_b, *spans_b = _alike_spans(sb, sa, similarity)
                    packed_spans = np.concatenate([row, row_b]) << 40
                    for n, m in enumerate((2, 3, 0, 1)):  # of rep first
                        packed_spans |= np.concatenate([spans[n], spans_b[m]]) << 10 * n
                    packed_spans = np.unique(packed_spans)
                    row, *spans = packed_spans >> 40, *((packed_spans >> 10 * n) & 1023 for n in range(4))
                lo, last, rep_lo, rep_last = spans
                columns = [t[row], start[row] + lo, start[row] + last + SHINGLE, rep[row], rep_start[row] + rep_lo, rep_start[row] + rep_last + SHINGLE]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64 if n in (0, 3) else np.int32)) for n, c in enumerate(columns)], names=[c.split()[0] for c in _LINKS.split(", ")])

    return run


# --- candidates ---------------------------------------------------------------------------------------------------


def _repeated_keys(rows: DataFrame) -> DataFrame:
    """The rows whose key more than one text has, with the first and the last such text in the key's order, and whether the
    row is neither of these two (`other`): what such a key has beyond the two goes to _rest().

    There are several orders of texts, so the paragraphs of one passage meet other texts under other keys.
    The ends are combined in the map tasks and written, so both sides of the join are plain shuffles and the rows of a
    key that very many texts have can be split among tasks.
    """
    turned = lambda t: F.col(t).bitwiseXOR(F.element_at(F.array(*[F.lit(x).cast("long") for x in ORDERS]), (F.pmod("key", F.lit(len(ORDERS))) + 1).cast("int")))
    ends = rows.where(~F.col("again")).withColumn("h", turned("t")).groupBy("key")  # numbers only, so they are hashed and not sorted
    ends = ends.agg(F.min("h").alias("h1"), F.min_by("place", "h").alias("p1"), F.max("h").alias("h2"), F.max_by("place", "h").alias("p2")).where("h1 <> h2")
    ends = written(ends.select("key", turned("h1").alias("t1"), "p1", turned("h2").alias("t2"), "p2"), "paragraph-ends")
    is_end = [(F.col("t") == F.col(f"t{k}")) & (F.col("place") == F.col(f"p{k}")) for k in (1, 2)]
    return rows.join(ends, "key").select("key", "t", "place", "t1", "t2", (~(is_end[0] | is_end[1])).alias("other"))


def _pairs(cand: DataFrame) -> DataFrame:
    """(t, start, rep, rep_start), distinct: the blocks of t to compare with the first and last text of a key, aligned at it."""
    first, more, anchor = unpacked_columns("place")
    cand = cand.select("key", "t", "t1", "t2", first.alias("p"), more.alias("n"), (first + anchor).alias("a"))
    reps = cand.groupBy("key").agg(F.min(F.when(F.col("t") == F.col("t1"), F.col("a"))).alias("a1"), F.min(F.when(F.col("t") == F.col("t2"), F.col("a"))).alias("a2"))
    reps = written(reps, "paragraph-places")  # for the join below as in _repeated_keys
    both = F.array(F.struct(F.col("t1").alias("rep"), F.col("a1").alias("ra")), F.struct(F.col("t2").alias("rep"), F.col("a2").alias("ra")))
    out = cand.join(reps, "key").select("t", "p", "n", "a", F.explode(F.filter(both, lambda r: r["rep"] != F.col("t"))).alias("r"))
    blocks = F.explode(F.sequence(F.floor(F.col("p") / BLOCK), F.floor((F.col("p") + F.col("n")) / BLOCK)))
    out = out.select("t", F.col("r.rep").alias("rep"), (F.col("r.ra") - F.col("a")).alias("shift"), blocks.alias("block"))
    start = (F.col("block") * BLOCK).cast("int")
    return out.select("t", start.alias("start"), "rep", (start + F.col("shift")).cast("int").alias("rep_start")).distinct()


def unpacked_columns(place: str):
    return F.shiftright(place, 32), F.shiftright(place, 6).bitwiseAND(F.lit(0x3FFFFFF)), F.col(place).bitwiseAND(F.lit(63))


# --- keys that stand in more than two places ----------------------------------------------------------------------


def _listed(batches):
    """For each text of (t, text, a list): its t, its list, its words and their prefix sums."""
    for b in batches:
        names = b.column(0).to_numpy(zero_copy_only=False)
        raw, offsets = text_bytes(pc.utf8_lower(b.column(1)))
        lists = _lists(b.column(2)) if b.num_rows else []
        for x, y in slices(offsets):
            words, rows, _, _ = word_hashes(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
            for k in range(x, y):
                yield names[k], lists[k], words[rows[k - x] : rows[k - x + 1]]


_EVERY = "whole long, left long, right long, t long, at int, again boolean"


def _every_paragraph(batches):
    """(t, text, places) to a row for each paragraph there, with the hashes of all, the first HALF and the last HALF of its words, and whether the text has had it before."""
    for t, places, words in _listed(batches):
        at = np.flatnonzero(_inside(len(words) - PASSAGE + 1, places))
        sums = prefix_sums(words)
        made = [sums_hashes(sums, at + a, at + b).view(np.int64) for a, b in ((0, PASSAGE), (0, HALF), (PASSAGE - HALF, PASSAGE))]
        again = _again(np.zeros(len(at), np.int8), made[0])
        yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(np.full(len(at), t)), pa.array(at.astype(np.int32)), pa.array(again)], names=[c.split()[0] for c in _EVERY.split(", ")])


#: The words that may be another one beside an equal first or last half, so that the paragraph begins and ends with a shingle of
#: the other. The word at the far end is left out for the paragraphs that have a word more inside.
_GAPS = (np.array([*range(HALF, PASSAGE - SHINGLE), PASSAGE - 1]), np.array([0, *range(SHINGLE, PASSAGE - HALF)]))
_BUT_ONE = "words long, gap int, t long, at int, copied boolean"


def _but_one(batches):
    """(t, text, paragraphs: four times their place, and 2 if other texts have the same, and 1 if the last half is what others have) to the hashes of all words but one."""
    for t, asked, words in _listed(batches):
        sums, back = prefix_sums(words), powers(_ROOT_INV, len(words) + 1)
        for part in range(0, len(asked), 1 << 14):
            mine = asked[part : part + (1 << 14)]
            for side, gaps in enumerate(_GAPS):
                its = mine[mine % 2 == side]
                at = (its // 4)[:, None]
                if not len(at):
                    continue
                value = (sums[at + gaps] - sums[at]) * back[at] + (sums[at + PASSAGE] - sums[at + gaps + 1]) * back[at + 1]
                columns = [mix(value).ravel().view(np.int64), np.tile(gaps, len(at)).astype(np.int32), np.full(value.size, t), np.repeat(at.ravel(), len(gaps)).astype(np.int32), np.repeat(its // 2 % 2 == 1, len(gaps))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=[c.split()[0] for c in _BUT_ONE.split(", ")])


def _aligned(rows: DataFrame, edge: int = 0) -> DataFrame:
    """(t, at, rep, ra), paragraphs to compare, as distinct pairs of blocks (see _pairs); none lies within `edge` words of its block's ends."""
    within = F.pmod("at", F.lit(BLOCK))
    moved = F.when(within < edge, -BLOCK // 2).when(within >= BLOCK - edge, BLOCK // 2).otherwise(0)
    start = (F.col("at") - within + moved).cast("int")
    return rows.select("t", start.alias("start"), "rep", (start + F.col("ra") - F.col("at")).cast("int").alias("rep_start")).distinct()


def _later_first(rows: DataFrame) -> DataFrame:
    """Each pair once, as (t, at) and (rep, ra) of an earlier text: _verify() looks at both ways."""
    later = F.col("t") > F.col("rep")
    return rows.select(*[F.when(later, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("t", "t", "rep"), ("at", "at", "ra"), ("rep", "rep", "t"), ("ra", "ra", "at"))])


def _against(rows: DataFrame, *ends: str) -> DataFrame:
    """Pairs of each row's paragraph with those of `ends`, structs (t, at), that stand in another text."""
    met = rows.select("t", "at", F.explode(F.filter(F.array(*ends), lambda e: e["t"] != F.col("t"))).alias("e"))
    return met.select("t", "at", F.col("e.t").alias("rep"), F.col("e.at").alias("ra"))


def _rest(texts: DataFrame, cand: DataFrame) -> DataFrame:
    """Pairs of blocks, as of _pairs, for the keys of cand that stand in more than two places: whatever is alike there is
    linked, with each other or by way of others that are alike, and each text with an earlier one if there is one.

    A paragraph that several texts have stands for all of them, by the first and the last of them: equal ones are linked with the
    first. Of those that are unlike, two of one text do not count, so then the other's last text is met.
    """
    keys = cand.where("other").select("key").distinct()
    places = cand.join(keys, "key", "left_semi").select("t", "place").distinct().groupBy("t").agg(F.collect_list("place").alias("places"))
    every = written(texts.join(places, "t").select("t", "text", "places").mapInArrow(_every_paragraph, _EVERY), "paragraph-every")
    one = every.where(~F.col("again")).groupBy("whole").agg(*[F.min(c).alias(c) for c in ("left", "right", "t")], F.min_by("at", "t").alias("at"), F.max("t").alias("tz"), F.max_by("at", "t").alias("az"))
    z = F.when(F.col("tz") != F.col("t"), F.struct(F.col("tz").alias("t"), F.col("az").alias("at")))
    one = written(one.select("whole", "t", "at", "left", "right", z.alias("z")), "paragraph-one")
    equal = every.join(one.where("z is not null").select("whole", F.struct("t", "at").alias("e")), "whole")
    same = written(_aligned(_against(equal, "e")), "paragraph-same")
    delete(every)
    pairs, edge = [same], SHINGLE

    sides = _union([one.select(F.lit(side).alias("side"), F.col(half).alias("half"), "t", "at", "z") for side, half in enumerate(("left", "right"))])
    counts = written(sides.groupBy("side", "half").agg(F.count("*").alias("n")).where("n > 1"), "paragraph-halves")
    beside = written(sides.join(counts, ["side", "half"]), "paragraph-beside")  # the few that have a half in common with another
    delete(counts)
    few = beside.where(F.col("n") <= FEW).select("side", "half", F.struct("t", "at").alias("a"), "z")
    link = lambda p, q: F.struct(F.col(f"{p}.t").alias("t"), F.col(f"{p}.at").alias("at"), F.col(f"{q}.t").alias("rep"), F.col(f"{q}.at").alias("ra"))
    met = few.join(few.withColumnsRenamed({"a": "b", "z": "y"}), ["side", "half"]).where("a < b")
    links = F.when(F.col("a.t") != F.col("b.t"), F.array(link("a", "b"))).otherwise(F.array(link("a", "y"), link("b", "z")))
    pairs.append(_aligned(_later_first(met.select(F.explode(links).alias("l")).select("l.*").where("rep is not null")), edge))
    many = beside.where(F.col("n") > FEW).select("t", (F.col("at") * 4 + F.col("z").isNotNull().cast("int") * 2 + F.col("side")).alias("asked"))
    asked = many.groupBy("t").agg(F.collect_list("asked").alias("asked"))
    short = written(texts.join(asked, "t").select("t", "text", "asked").mapInArrow(_but_one, _BUT_ONE), "paragraph-words")
    # each paragraph is there once, by its first place; those that have all words but one in common with another one, in another text, are then added by their last text too
    place = F.xxhash64("t", "at")
    alike = short.groupBy("words").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.min("t").alias("ta"), F.max("t").alias("tz"), F.max("copied").alias("copied")).where("a <> z and (ta <> tz or copied)")
    met = written(short.drop("copied").join(alike.select("words"), "words", "left_semi"), "paragraph-met")
    delete(short)
    last = one.where("z is not null").select("t", "at", "z")
    shared = written(met.unionByName(met.join(last, ["t", "at"]).select("words", "gap", "z.t", "z.at")), "paragraph-shared")
    delete(met)
    plain, place = F.col("gap").isin(0, PASSAGE - 1), F.struct("t", "at")
    changed = shared.where(~plain).groupBy("words", "gap").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a.t <> z.t")
    added = shared.groupBy("words").agg(*[f(F.when(c, place)).alias(f"{n}{m}") for n, f in (("a", F.min), ("z", F.max)) for m, c in ((0, plain), (1, ~plain))]).where("a0 is not null and a1 is not null")
    added = shared.join(added, "words").withColumns({e: F.when(plain, F.col(f"{e}1")).otherwise(F.col(f"{e}0")) for e in "az"})
    for rows in (shared.join(changed, ["words", "gap"]), added):
        pairs.append(_aligned(_later_first(_against(rows, "a", "z")), edge))
    found = written(_union(pairs).distinct(), "paragraph-rest")
    delete(one, beside, same, shared)
    return found


def _links(texts: DataFrame, pairs: DataFrame, similarity: float, both_ways: bool = False) -> DataFrame:
    """The verified spans of pairs of blocks."""
    asked = pairs.select("t", "start").unionByName(pairs.select(F.col("rep").alias("t"), F.col("rep_start").alias("start")))
    asked = asked.distinct().groupBy("t").agg(F.collect_list("start").alias("starts"))
    pieces = written(texts.join(asked, "t").select("t", "text", "starts").mapInArrow(_pieces, "t long, start int, shingles binary"), "paragraph-pieces")
    left = pieces.withColumnRenamed("shingles", "sa")
    right = pieces.select(F.col("t").alias("rep"), F.col("start").alias("rep_start"), F.col("shingles").alias("sb"))
    # the side that many texts share joins first, while the pairs are narrow; then each block meets its few partners
    both = pairs.join(right, ["rep", "rep_start"]).join(left, ["t", "start"]).select("t", "start", "rep", "rep_start", "sa", "sb")
    links = written(both.mapInArrow(_verify(similarity, both_ways), _LINKS), "paragraph-links")
    delete(pairs, pieces)
    return links


def _spans(links: DataFrame) -> DataFrame:
    """(t, lo, hi), distinct: the spans on both sides."""
    return links.select("t", "lo", "hi").unionByName(links.select(F.col("rep").alias("t"), F.col("rep_lo").alias("lo"), F.col("rep_hi").alias("hi"))).distinct()


def matches(slim: DataFrame, copied: DataFrame, similarity: float) -> tuple[list[DataFrame], DataFrame]:
    """(t, lo, hi, rep, rep_lo, rep_hi) of what is compared by key and of the rest, and (t, text) of the texts that are copied or had a candidate."""
    rows = written(slim.mapInArrow(_key_rows(KEY, BANDS), "key long, t long, place long, again boolean"), "paragraph-keys")
    cand = written(_repeated_keys(rows), "paragraph-candidates")
    delete(rows)
    wanted = cand.select("t").unionByName(copied.select("t")).distinct()
    texts = written(slim.groupBy("t").agg(F.first("text").alias("text")).join(wanted, "t"), "paragraph-texts")
    links = [_links(texts, written(_pairs(cand), "paragraph-pairs"), similarity)]
    rest = _rest(texts, cand)
    delete(cand)
    return [*links, _links(texts, rest, similarity, both_ways=True)], texts


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


# --- passages -----------------------------------------------------------------------------------------------------

_OUT = "t long, place int, n_words int, start_byte int, end_byte int, node_place int, cuts array<struct<start_byte:int,end_byte:int>>"


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unions of spans that overlap, in order."""
    if not len(lo):
        return lo, hi
    order = np.lexsort((hi, lo))
    lo, far = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] >= far[:-1]]))
    return lo[first], far[np.concatenate([first[1:] - 1, [len(lo) - 1]])]


def _passages(batches):
    """(t, text, copied, lo, hi, cut_lo, cut_hi) to the passages of each text, with the bytes of their words and of their cuts."""
    for b in batches:
        names, copied = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
        raw, offsets = text_bytes(b.column(1))
        spans = [_lists(b.column(k)) for k in (3, 4, 5, 6)] if b.num_rows else None
        for k in range(b.num_rows):
            starts, ends, _ = word_spans(raw[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))
            lo, hi = _runs(spans[0][k], spans[1][k])
            if copied[k]:
                lo, hi = (np.array([0]), np.array([len(starts)])) if len(starts) >= PASSAGE else (lo[:0], hi[:0])
            if not len(lo):
                continue
            cut_lo, cut_hi = _runs(spans[2][k], spans[3][k])
            own = np.searchsorted(lo, cut_lo, side="right") - 1
            cuts = [[{"start_byte": int(starts[x]), "end_byte": int(ends[y - 1])} for x, y in zip(cut_lo[own == n], cut_hi[own == n], strict=True)] for n in range(len(lo))]
            number = lambda x: pa.array(np.asarray(x).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lo), names[k])), number(lo), number(hi - lo), number(starts[lo]), number(ends[hi - 1]), number(lo), pa.array(cuts, pa.list_(pa.struct([("start_byte", pa.int32()), ("end_byte", pa.int32())])))],
                names=["t", "place", "n_words", "start_byte", "end_byte", "node_place", "cuts"],
            )


def repeated_paragraphs(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", named: bool = False) -> DataFrame:
    """One row per passage that repeats in another text: id, place, n_words, start_byte, end_byte, group_id, cuts, remove.

    A passage is a longest run of words of which each lies in PASSAGE words in a row (runs of letters and digits, case
    folded) that are alike in another text, or a whole text of so many words that several documents have. place is its
    first word's number, the byte span is that of its words in the text; it may have up to shift() words less than PASSAGE
    if its partner has as many more. group_id names its component. cuts are the byte
    spans that an earlier text has (texts are ordered by their hash, documents of one text by id, null first), remove
    tells that all of the passage is cut. What repeats within one text only is not reported. Null, empty and shorter
    texts have no passages; extra columns are not read; an empty table gives no rows. Repeated rows of one id and text
    each get the same rows, and are copies of each other only if another id has the text too, or else kept.
    named: with t, the hash of the text.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where(F.length(text_col) >= 2 * PASSAGE - 1)
    copied = keyed.groupBy("t").agg(F.count("*").alias("copies"), F.min(F.struct("id")).alias("first")).where("copies > 1")
    copied = written(copied.select("t", F.col("first.id").alias("first_id")), "paragraph-copies")

    rounds, texts = matches(keyed.select("t", "text"), copied, similarity)
    links = _union(rounds)
    spans = _spans(links).join(copied.select("t", F.lit(True).alias("copied")), "t", "left")
    before = F.max("hi").over(Window.partitionBy("t").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("begins", F.when(before.isNull() | (F.col("lo") >= before), F.col("lo")))
    begins = F.max("begins").over(Window.partitionBy("t").orderBy("lo", "hi"))
    node = lambda t, place: F.xxhash64(t, place)
    spans = written(spans.select("t", "lo", "hi", node("t", F.when(F.col("copied"), F.lit(0)).otherwise(begins)).alias("node")), "paragraph-spans")

    mine = spans.select("t", "lo", "hi", F.col("node").alias("a"))
    theirs = spans.select(F.col("t").alias("rep"), F.col("lo").alias("rep_lo"), F.col("hi").alias("rep_hi"), F.col("node").alias("b"))
    edges = links.join(mine, ["t", "lo", "hi"]).join(theirs, ["rep", "rep_lo", "rep_hi"]).select("a", "b").distinct()
    roots = connected_components(edges)

    later = F.col("rep") < F.col("t")
    cut = links.select(*[F.when(later, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("t", "rep"), ("lo", "rep_lo"), ("hi", "rep_hi"))]).distinct()
    found = spans.groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    cut = cut.groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))
    marked = found.join(copied.select("t", F.lit(True).alias("copied")), "t", "full").join(cut, "t", "left")
    none = F.array().cast("array<int>")
    lists = [F.coalesce(F.col(c), none).alias(n) for c, n in (("found.lo", "lo"), ("found.hi", "hi"), ("cut.lo", "cut_lo"), ("cut.hi", "cut_hi"))]
    marked = written(marked.select("t", F.coalesce("copied", F.lit(False)).alias("copied"), *lists), "paragraph-marked")
    places = texts.join(marked, "t").select("t", "text", "copied", "lo", "hi", "cut_lo", "cut_hi").mapInArrow(_passages, _OUT).withColumn("node", node("t", F.col("node_place")))
    places = places.join(roots.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node")).drop("node", "node_place")
    places = written(places, "paragraph-places")
    delete(texts, spans, marked, *rounds)

    whole = F.array(F.struct("start_byte", "end_byte"))
    out = keyed.select("id", "t").join(places, "t").join(copied, "t", "left")
    copy = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    out = out.withColumn("cuts", F.when(F.coalesce(copy, F.lit(False)), whole).otherwise(F.col("cuts")))
    covers = F.exists("cuts", lambda c: (c["start_byte"] <= F.col("start_byte")) & (c["end_byte"] >= F.col("end_byte")))
    return out.select(F.col("id").alias(id_col), *["t"] * named, "place", "n_words", "start_byte", "end_byte", F.lower(F.lpad(F.hex("group"), 16, "0")).alias("group_id"), "cuts", covers.alias("remove"))


def _cut_out(batches):
    """(..., text, gone: byte spans) to the rows with the spans taken out of their texts."""
    for b in batches:
        at = b.schema.get_field_index("__text")
        raw, offsets = text_bytes(b.column(at))
        gone, kept = b.column(b.num_columns - 1).to_pylist(), []
        for k, text in enumerate(b.column(at)):
            if not gone[k]:
                kept.append(text.as_py())
                continue
            inside = np.ones(offsets[k + 1] - offsets[k], dtype=bool)
            for span in gone[k]:
                inside[span["start_byte"] : span["end_byte"]] = False
            kept.append(raw[offsets[k] : offsets[k + 1]][inside].tobytes().decode("utf-8", "replace"))
        columns = [pa.array(kept, pa.string()) if n == at else b.column(n) for n in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])


def without_repeats(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the cuts of repeated_paragraphs taken out of their texts; all rows and columns stay (n_chars follows the text).

    Rows of one id are told apart by their text's hash, so unlike texts under one id each lose their own cuts.
    """
    cuts = repeated_paragraphs(docs, similarity, id_col, text_col, named=True).select(F.col(id_col).alias("gone_id"), "t", F.explode("cuts").alias("cut")).distinct()
    gone = written(cuts.groupBy("gone_id", "t").agg(F.collect_list("cut").alias("gone")), "paragraph-cuts")
    names = docs.columns
    plain = docs.toDF(*["__text" if n == text_col else f"c{k}" for k, n in enumerate(names)])
    same = plain[f"c{names.index(id_col)}"].eqNullSafe(gone["gone_id"]) & (F.xxhash64("__text") == gone["t"])
    out = plain.join(gone, same, "left").select(*plain.columns, "gone").mapInArrow(_cut_out, plain.schema).toDF(*names)
    return out.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
