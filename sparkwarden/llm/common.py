"""What the corpus operators share: shared scratch tables, byte-level text hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_RE = r"[^\x20\x09-\x0D]+"


# --- scratch space ------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; with a local master (one machine, as in tests) one of our own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = f"file://{tempfile.mkdtemp(prefix='sparkwarden-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sparkwarden/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def written_once(df: DataFrame, what: str) -> DataFrame:
    """written(), and Spark drops the shuffle files of df when it is there and not some time later; nothing may be left of df that is read again but its sources."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return written(df, what)
    finally:
        conf.set(name, before)


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables made by written() that nothing will read again, and tidies up."""
    known = [t for t in tables if t is not None]
    delete(*known)
    if known:
        tidy(known[0])


def delete(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written()."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of past jobs: its cleaner does so for what the driver's collector finds unused."""
    df.sparkSession._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Arrow batches --------------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n+1 offsets into them, without making Python strings; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - (at[0] if len(at) else 0)


def slices(offsets: np.ndarray, most: int = 4_000_000):
    """Ranges of whole rows of about `most` bytes, so that work arrays stay small whatever the batch holds."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


# --- rolling hashes (Karp-Rabin: polynomials modulo 2^64, from prefix sums) ------------------------------------------

_ROOT = 0x9E3779B97F4A7C15 | 1
_ROOT_INV = pow(_ROOT, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(root: int, n: int) -> np.ndarray:
    """root^0 .. root^(n-1) modulo 2^64."""
    have = _POWERS.get(root)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        row = np.full(size, root, dtype=np.uint64)
        row[0] = 1
        have = _POWERS[root] = np.multiply.accumulate(row)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span; equal content gives equal hashes wherever it stands."""
    return sums_hashes(prefix_sums(values), starts, ends)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """What sums_hashes() needs of values, for all their spans."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_ROOT, len(values)), out=sums[1:])
    return sums


def sums_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """span_hashes() from the prefix sums."""
    h = (sums[ends] - sums[starts]) * powers(_ROOT_INV, len(sums))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of ASCII letters, digits and any non-ASCII bytes), and how many lie before each row."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = _LETTERS[raw]
    step = np.diff(inside)
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    if len(cuts):  # words do not run over the edge between two rows
        glued = np.unique(cuts)
        glued = glued[(inside[glued] == 1) & (inside[glued + 1] == 1)]
    else:
        glued = cuts
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(glued):
        starts, ends = np.sort(np.concatenate([starts, glued])), np.sort(np.concatenate([ends, glued]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of each row, ASCII case folded: hashes, row boundaries, starts, ends."""
    starts, ends, rows = word_spans(raw, offsets)
    return span_hashes(_LOWER[raw], starts, ends), rows, starts, ends


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words: entry i covers words i .. i+n-1; runs over row edges are the caller's to drop."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(words) - n + 1, dtype=np.uint64)
    weights = powers(0xA0761D6478BD642F, n + 1)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * weights[k + 1]
    return mix(total)


# --- connected components -----------------------------------------------------------------------------------------


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b), root being the smallest node that it reaches.

    Alternating large-star and small-star rounds; each contracts the graph, so the number of rounds grows with the
    logarithm of its size. Every step is a grouped minimum (combined before the shuffle) and a join of two stored
    tables, whose hot keys adaptive execution can split. Self-loops, repeats and nulls are dropped; no edge: no row.
    """
    def minima(e: DataFrame, what: str) -> DataFrame:
        return written(e.groupBy("u").agg(F.min("v").alias("m")), what)

    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = minima(both, "large")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = written(large.distinct(), "large-star")
        lower = minima(large, "small")
        small = large.join(lower, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        contracted = written(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        delete(e, least, large, lower)
        e = contracted
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
