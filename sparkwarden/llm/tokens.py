"""Token counts behind a digest cache.

Each text is known by the SHA-256 of its bytes, each tokenizer by the digest of its file and library version. Counts
are joined from the cache table; only distinct texts that it lacks are encoded, and their counts are appended.
Normalising a text means that null becomes empty and what is no UTF-8 is replaced: anything more would change its tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import scratch_path

#: Characters for which the two regular expressions below split exactly as the byte-level pre-tokenizer does: all
#: its classes are spelled out, so no Unicode table of either library matters. Other texts go to the library whole.
_UNSAFE = re.compile("[^\t\n\r -~\xa0-ɏ‐-‧]")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t\n\r \xa0"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_MOST_PIECES = 400_000


class Counter:
    """Counts tokens as the library does; made once in each Python worker."""

    def __init__(self, kind: str, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kind, self.known = kind, {}
        if kind == "json":
            from tokenizers import Tokenizer

            spec = json.loads(data)
            self.library = Tokenizer.from_str(data.decode())
            self.library.no_truncation()
            self.library.no_padding()
            before = spec.get("pre_tokenizer") or {}
            self.by_piece = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and spec["model"]["type"] == "BPE"
            self.special = [t["content"] for t in spec.get("added_tokens", [])]
        elif kind == "model":
            import sentencepiece

            self.library, self.by_piece = sentencepiece.SentencePieceProcessor(model_proto=data), False
        else:
            raise ValueError(f"no library for a .{kind} tokenizer")

    def _whole(self, texts: list[str]) -> list[int]:
        if self.kind == "model":
            return [len(x) for x in self.library.encode(texts, num_threads=1)]
        return [len(x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, text: str) -> int:
        """Pieces of a byte-level text are encoded each on its own, so their counts are kept and added up."""
        if not text:
            return 0
        if not self.by_piece or _UNSAFE.search(text) or any(s in text for s in self.special):
            return self._whole([text])[0]
        known, pieces = self.known, _PIECES.findall(text)
        try:
            return sum([known[p] for p in pieces])
        except KeyError:
            new = list({p for p in pieces if p not in known})
        if len(known) > _MOST_PIECES:
            known.clear()
            new = list(set(pieces))
        known.update(zip(new, self._whole(new), strict=True))
        return sum([known[p] for p in pieces])


_COUNTERS: dict[str, Counter] = {}


def _encoder(version: str, kind: str, data):
    def encode(batches):
        if version not in _COUNTERS:
            _COUNTERS[version] = Counter(kind, data.value)
        counter = _COUNTERS[version]
        for b in batches:
            counts = [counter.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return encode


def tokenizer_version(path: str) -> tuple[str, str, bytes]:
    """Digest of file and library version, kind, content (a few MB at most: a tokenizer is read on the driver)."""
    kind = path.rsplit(".", 1)[-1]
    library = __import__({"json": "tokenizers", "model": "sentencepiece"}[kind])
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.sha256(data + library.__version__.encode()).hexdigest(), kind, data


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _normal(text_col: str):
    """The text that is encoded: null is empty, what is no UTF-8 is replaced."""
    return F.coalesce(F.make_valid_utf8(F.col(text_col)), F.lit(""))


def _digest(text):
    return F.unhex(F.sha2(text, 256))


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The counts of one tokenizer: the cache is a folder for each, so no other's are read."""
    rows = spark.read.schema("tokenizer string, digest binary, n_tokens long").parquet(cache)
    return rows.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def warm(docs: DataFrame, tokenizer: str, cache: str, text_col: str = "text") -> None:
    """Appends the counts of the distinct texts of docs that the cache (made if absent) lacks; what it has is not encoded again."""
    spark = docs.sparkSession
    version, kind, data = tokenizer_version(tokenizer)
    text = _normal(text_col)
    misses = docs.select(_digest(text).alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    if _exists(spark, cache):
        misses = misses.join(_stored(spark, cache, version), "digest", "left_anti")
    counted = misses.mapInArrow(_encoder(version, kind, spark.sparkContext.broadcast(data)), "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) per row of docs; repeated rows and null ids stay, null texts are empty.

    cache: a Parquet folder of (digest, n_tokens) under a folder for each tokenizer, made if absent; None: one of this
    call alone. A digest that two callers append at once is counted once when read. Texts move once, after copies are
    merged in each map task, so a text that a third of all rows share costs one row a task. Bytes that are no UTF-8 count
    as n_bytes, and as the replacement character for the tokenizer. Very long texts are encoded whole, one at a time;
    extra columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    warm(docs, tokenizer, cache, text_col)
    counts = _stored(spark, cache, tokenizer_version(tokenizer)[0])
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_col), _digest(_normal(text_col)).alias("digest"), n_bytes.alias("n_bytes"))
    return slim.join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def token_counts_in_parts(docs: DataFrame, tokenizer: str, cache: str | None = None, parts: int = 8, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """token_counts over a table that comes in two deliveries: one in `parts` of the ids first, then all rows against its counts."""
    cache = cache or scratch_path(docs.sparkSession, "token-cache")
    warm(docs.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == 0), tokenizer, cache, text_col)
    return token_counts(docs, tokenizer, cache, limit, id_col, text_col)
