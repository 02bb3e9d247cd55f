"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of an incremental dictionary (each the longest known phrase plus one character), the
phrases are hashed, and LANES minimum hashes make the fingerprint; the share of equal lanes estimates the Jaccard
likeness of two phrase sets, which follows how well one text would compress given the other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import mix, span_hashes, written

LANES = 64
_FACTORS = mix(np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def parse(text: str, start: int = 0, known: set[str] | None = None) -> tuple[list[str], list[int]]:
    """New phrases from `start` on, in order, and where each ends; known: the dictionary so far, which grows.

    The dictionary holds every prefix of its phrases, so the longest match is sought from the last length up or down.
    A last phrase that is already known adds nothing.
    """
    known = set() if known is None else known
    phrases, ends, n, i, length = [], [], len(text), start, 3
    while i < n:
        j = i + length
        if text[i:j] in known:
            j += 1
            while j <= n and text[i:j] in known:
                j += 1
        else:
            j -= 1
            while j > i and text[i:j] not in known:
                j -= 1
            j += 1
        if j > n:
            break
        phrase = text[i:j]
        known.add(phrase)
        phrases.append(phrase)
        ends.append(j)
        length = max(1, j - i - 1)
        i = j
    return phrases, ends


def lanes(text: str, start: int, ends: list[int]) -> np.ndarray:
    """The minimum hashes of the phrases text[start:ends[0]], text[ends[0]:ends[1]], ...; no phrase: all ones."""
    least = np.full(LANES, np.uint32(0xFFFFFFFF))
    if ends:
        points = np.frombuffer(text[start : ends[-1]].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        stop = np.array(ends, dtype=np.int64) - start
        h = span_hashes(points, np.concatenate([[0], stop[:-1]]), stop)
        for k in range(0, len(h), 4096):  # bounds the work array
            many = np.multiply.outer(_FACTORS, h[k : k + 4096])
            least = np.minimum(least, (many.min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return least


def spell(least: np.ndarray) -> str:
    """Four hex digits for each lane: the low half of its minimum."""
    return (least & np.uint32(0xFFFF)).astype(">u2").tobytes().hex()


def fingerprint(text: str) -> str:
    return spell(lanes(text, 0, parse(text)[1]))


def likeness(a: str, b: str) -> float:
    """The share of lanes in which two fingerprints agree."""
    return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 4 * LANES, 4)) / LANES


def _near(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean((a & np.uint32(0xFFFF)) == (b & np.uint32(0xFFFF))))


def edited_text(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by the first as many characters of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


class _Document:
    def __init__(self, key, text: str):
        self.key, self.text = key, text
        self.phrases, self.ends = parse(text)
        self.lanes = lanes(text, 0, self.ends)

    def row(self, following: str, next_lanes: np.ndarray) -> tuple:
        """The result row. The parse of the unchanged start is shared with the edited text: a phrase that ends there depends on nothing after it."""
        text, third = self.text, len(self.text) // 3
        edited = edited_text(text, following)
        shared = int(np.searchsorted(self.ends, len(text) - third, side="right")) if self.ends else 0
        at = self.ends[shared - 1] if shared else 0
        _, ends = parse(edited, at, set(self.phrases[:shared]))
        both = np.minimum(lanes(text, 0, self.ends[:shared]), lanes(edited, at, ends))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (self.key, len(text), digest, spell(self.lanes), spell(both), _near(self.lanes, both), _near(self.lanes, next_lanes))


_DDL = "id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(batches):
    """Texts sorted by descending id within the partition. The first row of a partition leaves its text for the one
    before it, and the last row waits for the next partition's first: those two carry their texts, the others none."""
    part, before, names = TaskContext.get().partitionId(), None, None

    def out(rows, kind):
        cols = [pa.array([r[k] for r in rows], names.field(k).type if k == 0 else t) for k, t in enumerate(_TYPES)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([kind[0]] * len(rows), pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array([kind[1]] * len(rows), pa.string())], names=_NAMES)

    for b in batches:
        names, rows = b.schema, []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            now = _Document(key, text)
            if before is None:
                yield out([(key, *[None] * 6)], ("head", text))
            else:
                rows.append(before.row(text, now.lanes))
            before = now
        yield out(rows, ("done", None))
    if before is not None:
        yield out([(before.key, *[None] * 6)], ("tail", before.text))


_TYPES = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kind", "part", "text"]


def _tails(batches):
    for b in batches:
        rows = [_Document(k, t).row(f, _Document(None, f).lanes) for k, t, f in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)]
        cols = [pa.array([r[k] for r in rows], b.column(0).type if k == 0 else t) for k, t in enumerate(_TYPES)]
        yield pa.RecordBatch.from_arrays(cols, names=_NAMES[:7])


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are ordered by descending id (null ids last, equal ids by their text's hash, then the text); each one's
    edited text borrows from the next, the last one's from the first, an only document's from itself. Null texts are
    empty; empty texts have the fingerprint of no phrases; very long texts are parsed whole; extra columns are not read.
    Texts move once, into ranges of ids and hashes, and rows equal in both are dealt by a number, so neither one id nor
    one row that a third of all rows repeat fills a range; what crosses the edge of two ranges is one document a partition.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    slim = slim.withColumn("hash", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    order = [F.col("id").desc_nulls_last(), "hash", "salt"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(ranges, *order).sortWithinPartitions(order[0], "hash", "text", "salt")
    found = written(dealt.select("id", "text").mapInArrow(_rows, _DDL.format(id=kind) + ", kind string, part int, text string"), "lz")
    parts = sorted(r[0] for r in found.where("kind = 'tail'").select("part").collect())  # one number a partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = found.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = found.where("kind = 'tail'").select("id", "part", "text").join(after, "part").join(heads, "next_part")
    last = tails.select("id", "text", "following").mapInArrow(_tails, _DDL.format(id=kind))
    return found.where("kind = 'done'").select(*last.columns).unionByName(last).withColumnRenamed("id", id_col)
