"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most R=3 bits apart meet if each emits its variants within half the radius. Half of an odd radius
leaves one bit over, which is settled by cutting the 64 bits into two halves: of three differing bits, one half holds
at most one. So each fingerprint emits, for either half, that half and its 32 one-bit variants (66 rows). All that
share a variant lie at most two bits apart in that half, and there the other half decides: equal or one bit apart
links at once. Three differing bits in one half leave the other equal, so among those equal in a half the other
half's variants within one and within two bits meet. Every link found is a true one, no pair is listed for a whole
group (equal keys form chains), and the rows grow with the number of fingerprints alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import connected_components, written

SHINGLE, SEED, RADIUS = 3, 42, 3
_LANES = np.uint64(0x0101010101010101)


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set, lowest bit first: eight byte lanes are added at a time."""
    out = np.zeros((8, 8), dtype=np.int64)
    edges = np.arange(0, len(hashes), 255)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, edges)
        out[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-SHINGLE] + 1]).tolist()
        hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n - SHINGLE + 1)
    bits = votes(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: the fingerprint's bits as a long) for each row of docs; null texts count as empty."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_fingerprints, f"id {slim.schema['id'].dataType.simpleString()}, fp long")


def _chains(order: np.ndarray, same: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(fp[order[:-1]][same], fp[order[1:]][same])] if len(order) > 1 else []


def _lookups(bucket: np.ndarray, key: np.ndarray, fp: np.ndarray, masks) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links from each row to one row of the same bucket whose key differs by the mask. Rows are sorted by (bucket, key)."""
    cell = np.zeros(len(bucket), dtype=np.uint64)
    cell[1:] = np.cumsum(bucket[1:] != bucket[:-1])
    have = (cell << np.uint64(32)) | key
    out = []
    for mask in masks:
        want = have ^ mask
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        hit = have[at] == want
        if hit.any():
            out.append((fp[hit], fp[at[hit]]))
    return out


_ONE = [np.uint64(1 << a) for a in range(32)]
_TWO = [np.uint64(1 << a | 1 << b) for a in range(32) for b in range(a)]
_BALL = [np.uint64(0), *_ONE]


def _bucket_links(bucket: np.ndarray, cell: np.ndarray, fp: np.ndarray, exact: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal bucket and cell; exact marks rows whose half was emitted unchanged. Runs of one row link nothing."""
    new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1]), [True]])
    edge = np.flatnonzero(new)
    many = np.repeat(np.diff(edge) > 1, np.diff(edge))
    half = (bucket >> np.int64(32)).astype(np.uint64)[many]
    bucket, fp, exact = np.cumsum(new[:-1])[many], fp[many], exact[many]
    if not len(fp):
        return []
    bits = fp.view(np.uint64)
    other = np.where(half == 0, bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF))
    order = np.lexsort((other, bucket))
    bucket, fp, exact, other = bucket[order], fp[order], exact[order], other[order]
    links = _chains(np.arange(len(fp)), (bucket[1:] == bucket[:-1]) & (other[1:] == other[:-1]), fp)
    links += _lookups(bucket, other, fp, _ONE)
    bucket, fp, other = bucket[exact], fp[exact], other[exact]  # equal in this half: two or three bits in the other
    if len(fp) > 1:
        links += _three(bucket, fp, other)
    return links


_SMALL, _PART = 64, 65_536


def _three(bucket: np.ndarray, fp: np.ndarray, other: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of a bucket whose other half differs in up to three bits.

    Buckets of up to _SMALL rows are compared row by row in place; in larger ones, balls of one bit meet balls of two.
    """
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    size = np.repeat(np.diff(edge), np.diff(edge))
    links, small = [], size <= _SMALL
    b, f, o = bucket[small], fp[small], other[small]
    for d in range(1, int(size[small].max(initial=1))):
        near = (b[d:] == b[:-d]) & (np.bitwise_count(o[d:] ^ o[:-d]) <= RADIUS)
        links.append((f[d:][near], f[:-d][near]))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        for part in range(lo, hi if hi - lo > _SMALL else lo, _PART):  # bounds the work arrays
            k, f = other[part : min(part + _PART, hi)], fp[part : min(part + _PART, hi)]
            keys, owners = np.concatenate([k ^ m for m in _BALL]), np.tile(f, len(_BALL))
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            for mask in [*_BALL, *_TWO]:
                want = other[lo:hi] ^ mask
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = (keys[at] == want) & (owners[at] != fp[lo:hi])
                links.append((fp[lo:hi][hit], owners[at[hit]]))
            same = keys[1:] == keys[:-1]  # two that share a variant of one bit
            links.append((owners[:-1][same], owners[1:][same]))
    return links


def _links(batches):
    """Batches of (bucket, cell, fp, exact) sorted by bucket and cell within the partition; the last run of a batch waits for the next."""
    rest = None
    for b in batches:
        now = [np.asarray(b.column(k).to_numpy(zero_copy_only=False)) for k in range(4)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        new = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))
        cut = int(new[-1]) + 1 if len(new) else 0
        rest = [x[cut:] for x in now]
        yield from _as_batches(_bucket_links(*[x[:cut] for x in now]) if cut else [])
    if rest is not None and len(rest[0]):
        yield from _as_batches(_bucket_links(*rest))


def _as_batches(links):
    if links:
        a, b = (np.concatenate(x) for x in zip(*links, strict=True))
        low, high = np.minimum(a, b), np.maximum(a, b)
        pair = np.unique(np.stack([low, high], axis=1)[low != high], axis=0)
        for k in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[k : k + 100_000, 0]), pa.array(pair[k : k + 100_000, 1])], names=["a", "b"])


#: Fingerprints that share a half from which its buckets are cut into cells.
HOT = 3_000


def _cells(hot: DataFrame) -> DataFrame:
    """The rows of hot buckets, cut by their other half: at most one bit apart there, two share a quarter of the
    fingerprint; equal in the bucket's half and at most three bits apart in the other, they share a byte of it."""
    other = F.when(F.col("bucket") < F.lit(1 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    part = lambda k, bits: F.shiftright(other, k * bits).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit((k + bits) << 32))
    quarters = hot.select("bucket", F.explode(F.array(*[part(k, 16) for k in range(2)])).alias("cell"), "fp", F.lit(False).alias("exact"))
    return quarters.unionByName(hot.where("exact").select("bucket", F.explode(F.array(*[part(k, 8) for k in range(4)])).alias("cell"), "fp", "exact"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints of column fp that connect all those at most three bits apart.

    A half that very many fingerprints share would make its buckets the work of one task each: those buckets are cut
    into cells by the other half. No link is lost by that, and the other buckets are as they were.
    """
    distinct = fps.select("fp").where(F.col("fp").isNotNull()).distinct()
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    flips = F.expr("transform(sequence(-1, 31), i -> if(i < 0, 0L, shiftleft(1L, i)))")
    halves = distinct.select("fp", F.explode(F.array(low, high.bitwiseOR(F.lit(1 << 32)))).alias("half"))
    flipped = F.col("half").bitwiseXOR(F.col("flip")).alias("bucket")
    emitted = halves.select("fp", "half", F.explode(flips).alias("flip")).select(flipped, F.lit(0).cast("long").alias("cell"), "fp", (F.col("flip") == 0).alias("exact"))
    hot = halves.groupBy("half").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("half", F.explode(flips).alias("flip")).select(flipped).distinct()
    hot = written(hot, "hot-buckets")
    dealt = emitted
    if hot.limit(1).count():
        dealt = emitted.join(hot, "bucket", "left_anti").unionByName(_cells(emitted.join(hot, "bucket", "left_semi")))
    dealt = dealt.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    return dealt.mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id per row of docs: component_id is the smallest id whose fingerprint is reached over links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay. A null id is in its
    component, but names it only if all its ids are null (then component_id is null). Equal fingerprints are merged
    before anything else, so copies cost nothing.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    roots = connected_components(links(prints))
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    rooted = written(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    classes = written(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def spelled(fp):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each component: the one with the smallest id (of equal ids, one text; of equal rows, one).

    All columns stay. Rows whose id is null take part in the components; one stays if a component has no other id.
    A row is known by its id and its text's hash, so rows of one id in several components each count in their own.
    Texts move once, at any size: the list of rows to keep grows with the documents, so it is merged and never broadcast.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key")).alias("row"), F.col(text_col).alias("text"))
    prints = written(fingerprints(keyed, "row", "text"), "fingerprints")
    roots = connected_components(links(prints))
    rows = prints.groupBy("fp", F.col("id.id").alias("id"), F.col("id.key").alias("key")).agg(F.count("*").alias("n"))
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "key", "n")).alias("row"))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("row", F.coalesce("root", "fp").alias("root"))
    kept = written(rooted.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.id").alias("kept_id"), F.col("row.key").alias("kept_key"), F.col("row.n").alias("n")), "kept")
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    same = plain[key].eqNullSafe(F.col("kept_id")) & (F.xxhash64(plain[text]) == F.col("kept_key"))
    once = plain.join(kept.where("n = 1").hint("merge"), same, "left_semi")
    repeated = plain.join(kept.where("n > 1").hint("merge"), same, "left_semi").dropDuplicates([key, text])
    return once.unionByName(repeated).toDF(*names)
