"""Token ids in files of 64-bit words (Simple-8b).

Of each word the top four bits are a selector, which says how many ids the other sixty hold and how wide each is. An id
that is too wide for any of them stands in a list of escapes, and its word holds its place there. Every BLOCK ids a new
block begins with a new word; the words before each block are stored, so that a reader can begin at any block, and all
words of one selector are unpacked together by numpy.

A token set is a folder of Parquet files whose rows are documents in ascending order of ids, file after file: a range of
documents is one file, written by one task, and Parquet's commit leaves no half of a file behind when a task is lost.
"""

from __future__ import annotations

import codecs
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import tokens
from sparkwarden.llm.common import scratch_path, slices, span_hashes, text_bytes
from sparkwarden.llm.tokens import _UNSAFE, Counter, _normal, tokenizer_version

#: Ids in a word and bits of each, by selector - 1: the layouts that fill sixty bits. Selector 0 is an escape.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 4096
#: Ids that are packed, and bytes of text that are encoded, at a time.
WORK_IDS, WORK_BYTES = 1 << 21, 8_000_000

_COUNT = np.array([1, *[c for c, _ in LAYOUTS], 1], dtype=np.int64)
_HELD = (1 << 60) - 1


# --- the code --------------------------------------------------------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value takes, at least one; one too many for a few of more than 53 (which a float rounds up): those may become escapes."""
    return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)


def _selectors(bits: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each place the selector of most ids that a word which begins there can have; room: ids to the end of its block, up to 60."""
    n, widest, half = len(bits), {1: bits}, 1
    out = np.where(bits > 60, 0, len(LAYOUTS)).astype(np.uint8)
    for count, _ in LAYOUTS[-2::-1]:  # the widest value of each window, from those of shorter windows
        shift = count - half
        widest[count] = np.full(n, 255, dtype=np.uint8)
        if n >= count:
            widest[count][: n - shift] = np.maximum(widest[half][: n - shift], widest[half][shift:])
        half = count
    for s in range(len(LAYOUTS) - 1, 0, -1):
        count, width = LAYOUTS[s - 1]
        np.copyto(out, s, where=(widest[count] <= width) & (room >= count))
    return out


def pack(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words for values, with a new one after each of `ends` (ascending, the last is len(values)); words up to each end; places of escapes."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64), np.zeros(0, np.int64)
    last = np.repeat(ends, np.diff(ends, prepend=0))
    sel = _selectors(_bits(values), np.minimum(last - np.arange(n), 60).astype(np.uint8))
    step, begun = _COUNT[sel], []
    at, stop = np.concatenate([[0], ends[:-1]]), ends
    while len(at):  # a word further in all blocks that have one
        begun.append(at)
        at = at + step[at]
        more = at < stop
        at, stop = at[more], stop[more]
    at = np.sort(np.concatenate(begun))
    sel = sel[at]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel[sel > 0]).tolist():
        count, width = LAYOUTS[s - 1]
        mine = np.flatnonzero(sel == s)
        shifts = (np.arange(count) * width).astype(np.uint64)
        words[mine] |= np.bitwise_or.reduce(values[at[mine][:, None] + np.arange(count)] << shifts, axis=1)
    return words, np.searchsorted(at, ends), at[sel == 0]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of words; escapes: the list that the escape words refer to."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[sel]
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], dtype=np.uint64)
    for s in np.unique(sel).tolist():
        mine = np.flatnonzero(sel == s)
        held = words[mine] & np.uint64(_HELD)
        if s == 0:
            out[at[mine]] = escapes[held.astype(np.int64)]
            continue
        n, width = LAYOUTS[s - 1]
        shifts = (np.arange(n) * width).astype(np.uint64)
        out[at[mine][:, None] + np.arange(n)] = (held[:, None] >> shifts) & np.uint64((1 << width) - 1)
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[bytes, bytes, bytes]:
    """One list of unsigned 64-bit values as bytes: its words, the words before each block, its escapes (all little-endian)."""
    (got,) = encode_many(values, np.array([0, len(values)]), block)
    return got


def encode_many(values: np.ndarray, bounds: np.ndarray, block: int = BLOCK):
    """encode() of each of the lists values[bounds[k]:bounds[k+1]]; about WORK_IDS values are packed at a time."""
    length = np.diff(bounds)
    blocks = -(-length // block)
    first = np.repeat(bounds[:-1], blocks) + block * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    ends = np.minimum(first + block, np.repeat(bounds[1:], blocks))
    words, upto, escapes, k = [], [], [], 0
    while k < len(ends):
        stop = max(k + 1, int(np.searchsorted(ends, first[k] + WORK_IDS, side="right")))
        w, e, x = pack(values[first[k] : ends[stop - 1]], ends[k:stop] - first[k])
        upto.append(e + (upto[-1][-1] if upto else 0))
        words.append(w)
        escapes.append(x + first[k])
        k = stop
    words, upto, escapes = (np.concatenate([*x, np.zeros(0, t)]).astype(t) for x, t in ((words, np.uint64), (upto, np.int64), (escapes, np.int64)))
    b = np.concatenate([[0], np.cumsum(blocks)])
    upto = np.concatenate([[0], upto])
    for r in range(len(length)):
        w = words[upto[b[r]] : upto[b[r + 1]]]
        own = values[escapes[np.searchsorted(escapes, bounds[r]) : np.searchsorted(escapes, bounds[r + 1])]]
        if len(own):
            w = w.copy()
            w[(w >> np.uint64(60)) == 0] = np.arange(len(own), dtype=np.uint64)
        yield w.astype("<u8", copy=False).tobytes(), (upto[b[r] : b[r + 1]] - upto[b[r]]).astype("<u4").tobytes(), own.astype("<u8", copy=False).tobytes()


def decode(words: bytes, escapes: bytes) -> np.ndarray:
    return unpack(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8"))


def decode_many(words: list[bytes], escapes: list[bytes]) -> np.ndarray:
    """The values of several lists, one list after the other."""
    w, x = np.frombuffer(b"".join(words), "<u8"), np.frombuffer(b"".join(escapes), "<u8")
    if len(x):  # the words of each list refer to its own escapes
        w = w.copy()
        mine = w >> np.uint64(60) == 0
        w[mine] = np.arange(len(x), dtype=np.uint64)
    return unpack(w, x)


def decode_span(words: bytes, blocks: bytes, escapes: bytes, begin: int, end: int, block: int = BLOCK) -> np.ndarray:
    """Values begin to end: only the words of the blocks that hold them are looked at."""
    starts, w = np.frombuffer(blocks, "<u4"), np.frombuffer(words, "<u8")
    if begin >= end:
        return np.zeros(0, np.uint64)
    a, b = begin // block, -(-end // block)
    out = unpack(w[starts[a] : starts[b] if b < len(starts) else len(w)], np.frombuffer(escapes, "<u8"))
    return out[begin - a * block : end - a * block]


# --- ids of texts ----------------------------------------------------------------------------------------------------


_OTHER, _LETTERS, _DIGITS, _SPACES = range(4)


def _kinds() -> np.ndarray:
    """The class of each character below U+0250 that the byte-level pre-tokenizer goes by."""
    every = "".join(map(chr, range(0x250)))
    kinds = np.zeros(0x250, dtype=np.int8)
    for kind, chars in ((_LETTERS, tokens._L), (_DIGITS, tokens._N), (_SPACES, tokens._S)):
        kinds[[m.start() for m in re.finditer(f"[{chars}]", every)]] = kind
    return kinds


_KINDS = _kinds()


def piece_starts(raw: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of the byte-level pre-tokenizer begin in texts of safe characters; first: where each text begins, and the end of the last.

    A piece is a run of one class, with one space before it if there is one; of white space before another class the last
    character is a piece of its own or that space, and 's, 't, 're, 've, 'm, 'll, 'd are pieces where one can begin.
    """
    n = len(raw)
    kind = _KINDS[raw]  # of an ASCII character; the other safe ones of three bytes are all of one class
    two = np.flatnonzero((raw >= 0xC0) & (raw < 0xE0))
    kind[two] = kind[two + 1] = _KINDS[(raw[two].astype(np.int64) & 0x1F) << 6 | raw[two + 1] & 0x3F]
    three = np.flatnonzero(raw >= 0xE0)
    kind[three] = kind[three + 1] = kind[three + 2] = _OTHER
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[first] = True
    starts = text_start.copy()
    starts[1:n] |= kind[1:] != kind[:-1]
    # white space before something else of the same text: its last character begins a piece, and a space goes on with what follows
    ends = np.flatnonzero((kind[:-1] == _SPACES) & starts[1:n] & ~text_start[1:n]) + 1
    starts[ends - 1 - (raw[ends - 1] >= 0x80)] = True
    starts[ends[raw[ends - 1] == 32]] = False
    # contractions: a lone apostrophe where a piece begins, and the letters after it
    quote = np.flatnonzero((raw == 39) & starts[:n])
    quote = quote[~text_start[quote + 1]]
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    one, two = padded[quote + 1], padded[quote + 2]
    whole = ~text_start[np.minimum(quote + 2, n)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = whole & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    starts[quote[short | long] + 1] = False
    starts[quote[short] + 2] = True
    starts[quote[long] + 3] = True
    return np.flatnonzero(starts[:n])


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, and for each place which of them it holds."""
    which = pa.array(values).dictionary_encode().indices.to_numpy()
    place = np.empty(int(which.max(initial=-1)) + 1, dtype=np.int64)
    place[which] = np.arange(len(values))
    return place, which


def _spelled() -> str:
    """The character that stands for each byte in a byte-level token; a line end stands for itself here."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    named = {b: b if b in plain else next(other) for b in range(256)}
    return "".join(map(chr, (named | {10: 10}).values()))


_SPELLED = _spelled()


#: Pieces that are one text for the library.
JOINED = 200
#: Pieces whose ids a worker keeps.
_MOST_KEPT = 1_500_000


class Encoder(Counter):
    """Ids of texts as the library gives them. Byte-level texts of safe characters are cut into pieces, all texts of a batch at
    once; each distinct piece is looked up once, and those that are new go to the library, many in one call."""

    def __init__(self, kind: str, data: bytes):
        super().__init__(kind, data)
        self.pieces: dict[bytes, bytes] = {}
        if self.by_piece:  # each character of a byte-level token stands for a byte
            vocab = self.library.get_vocab(with_added_tokens=False)
            self.size = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
            self.size[list(vocab.values())] = [len(t) for t in vocab]
            from tokenizers import Tokenizer, pre_tokenizers

            self.by_line = Tokenizer.from_str(data.decode())
            self.by_line.no_truncation()
            self.by_line.no_padding()
            self.by_line.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")

    def _ids(self, texts: list[str], library=None) -> list[bytes]:
        library = library or self.library
        got = library.encode(texts, num_threads=1) if self.kind == "model" else [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(got), "<u4").tobytes()
        ends = list(itertools.accumulate([4 * len(x) for x in got]))
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if got else []

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces. The library gets many as the lines of one text, already spelled as its tokens are, which it cuts at the
        line ends and no further; the tokens' sizes tell where each ends. Pieces that hold a line end go on their own."""
        alone = [b"\n" in p for p in pieces]
        rest = iter(self._ids([p.decode() for p, own in zip(pieces, alone, strict=True) if own]))
        many = [p for p, own in zip(pieces, alone, strict=True) if not own]
        flat = b"".join(self._ids([codecs.charmap_decode(b"\n".join(many[k : k + JOINED]), "strict", _SPELLED)[0] for k in range(0, len(many), JOINED)], self.by_line))
        ends = np.cumsum(self.size[np.frombuffer(flat, "<u4")])
        cuts = 4 * (np.searchsorted(ends, np.cumsum(list(map(len, many)))) + 1)
        found = iter([flat[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False)])
        return [next(rest) if own else next(found) for own in alone]

    def _looked_up(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of safe characters, none of them empty."""
        coded = [t.encode() for t in texts]
        data = b"".join(coded)
        raw, first = np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in coded])])
        starts = piece_starts(raw, first)
        ends = np.concatenate([starts[1:], first[-1:]])
        one, which = _distinct(span_hashes(raw, starts, ends))
        pieces = [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        got = list(map(self.pieces.get, pieces))
        if None in got:
            new = [k for k, known in enumerate(got) if known is None]
            if len(self.pieces) > _MOST_KEPT:
                self.pieces.clear()
            for k, ids in zip(new, self._new([pieces[k] for k in new]), strict=True):
                got[k] = self.pieces[pieces[k]] = ids
        size = np.array(list(map(len, got))) // 4
        n = size[which]
        end = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[which] - (end - n), n) + np.arange(end[-1])
        return np.split(np.frombuffer(b"".join(got), "<u4")[at], end[np.searchsorted(starts, first[1:-1]) - 1])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = [np.zeros(0, "<u4")] * len(texts)
        plain, whole = [], []
        for k, text in enumerate(texts):
            if text:
                (whole if not self.by_piece or _UNSAFE.search(text) or any(s in text for s in self.special) else plain).append(k)
        for k, found in zip(plain, self._looked_up([texts[k] for k in plain]) if plain else [], strict=True):
            out[k] = found
        for k, found in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = np.frombuffer(found, "<u4")
        return out


_ENCODERS: dict[str, Encoder] = {}
_NAMES = ["id", "n_tokens", "words", "blocks", "escapes", "shard", "at"]


def _encoded(version: str, kind: str, data, end_id: int | None):
    """(id, text) in order to the rows of a file: with the file's number and how many ids stand before each row in it."""
    tail = np.array([] if end_id is None else [end_id], dtype="<u4")

    def rows(batches):
        if version not in _ENCODERS:
            _ENCODERS[version] = Encoder(kind, data.value)
        encoder, shard, before = _ENCODERS[version], TaskContext.get().partitionId(), 0
        for b in batches:
            _, offsets = text_bytes(b.column(1))
            for x, y in slices(offsets, WORK_BYTES):
                parts = encoder.ids(b.column(1)[x:y].to_pylist())
                n = np.array([len(p) + len(tail) for p in parts], dtype=np.int64)
                bounds = np.concatenate([[0], np.cumsum(n)])
                values = np.concatenate([p for part in parts for p in (part, tail)]).astype(np.uint64)
                coded = [pa.array(c, pa.binary()) for c in zip(*encode_many(values, bounds), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[x:y], pa.array(n), *coded, pa.array(np.full(len(n), shard, dtype=np.int32)), pa.array(before + bounds[:-1])], names=_NAMES)
                before += int(bounds[-1])

    return rows


# --- files -----------------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token set of docs to `path`: ids of each whole text, then end_id (None: nothing), by ascending document id.

    Null ids come last; documents of one id follow each other by a hash of their texts, then by the texts. Null texts are
    empty and have the end id alone, what is no UTF-8 is replaced, very long texts are encoded whole, extra columns are not
    read, an empty table makes a set without rows. Texts move once, into ranges of ids and hashes; rows equal in both are
    dealt by a number, so that no id or text that a third of the rows share fills a file. Each range is encoded once, where
    its file is written.
    """
    spark = docs.sparkSession
    version, kind, data = tokenizer_version(tokenizer)
    slim = docs.select(F.col(id_col).alias("id"), _normal(text_col).alias("text"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, n_tokens long, words binary, blocks binary, escapes binary, shard int, at long"
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    dealt = slim.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "text")
    dealt.mapInArrow(_encoded(version, kind, spark.sparkContext.broadcast(data), end_id), schema).write.option("compression", "zstd").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a token set with `start`, the ids of all documents before. One number a file reaches the driver."""
    rows = spark.read.parquet(path)
    total, before = 0, []
    for shard, n in sorted(tuple(r) for r in rows.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        before.append((shard, total))
        total += n
    files = spark.createDataFrame(before, "shard int, before long")
    return rows.join(F.broadcast(files), "shard").select("id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "words", "blocks", "escapes")


def _per_document(make, kind):
    def rows(batches):
        for b in batches:
            n, bounds = b.column(2).to_numpy(), np.concatenate([[0], np.cumsum(b.column(2).to_numpy())])
            words, escapes, out, k = b.column(3), b.column(5), [], 0
            while k < len(n):
                stop = max(k + 1, int(np.searchsorted(bounds, bounds[k] + WORK_IDS, side="right")) - 1)
                values = decode_many(words[k:stop].to_pylist(), escapes[k:stop].to_pylist())
                out += [make(values[bounds[j] - bounds[k] : bounds[j + 1] - bounds[k]]) for j in range(k, stop)]
                k = stop
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, kind)], names=["id", "start", "n_tokens", "made"])

    return rows


def _read(spark: SparkSession, path: str, make, kind, ddl: str, name: str, id_col: str) -> DataFrame:
    rows = read_packed(spark, path)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, start long, n_tokens long, made {ddl}"
    return rows.mapInArrow(_per_document(make, kind), schema).withColumnsRenamed({"id": id_col, "made": name})


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids per document of a token set."""
    return _read(spark, path, lambda ids: ids.astype(np.int64), pa.list_(pa.int64()), "array<long>", "ids", id_col)


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) per document of a token set."""
    return _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "long", "ids_crc32", id_col)


def read_span(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """start, ids of what documents have of the ids begin to end of the whole set, as a reader of training sequences asks for
    them: only rows that overlap are decoded, and of those only the blocks that do."""
    rows = read_packed(spark, path).where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin))

    def cut(batches):
        for b in batches:
            out = [(max(s, begin), decode_span(w, k, e, max(begin - s, 0), min(end - s, n)).astype(np.int64)) for _, s, n, w, k, e in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["start", "ids"])

    return rows.mapInArrow(cut, "start long, ids array<long>")


def token_set(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """write_tokens() to a folder of its own in the shared one; where that is."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end_id, id_col, text_col)
    return path
