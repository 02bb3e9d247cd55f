"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and size S takes each document T/S times. The whole part is taken outright; the fractional
parts are rounded by pairs: word mass moves at random from one document to the other until one of the two is taken
wholly or not at all, which keeps every document's expectation and the source's sum. Leaves of about LEAF documents
(dealt by a hash, so a hot source has many) hand on the one document that is left undecided and their HANDED smallest,
which nothing has been decided of; those meet again in a tree of FAN-way groups, and only the last of a source is rounded
alone. That is the whole rounding; mix(exact=True) adds a step of its own, which flips documents of the last group, one or
two at a time, until the source is as near its target as they can bring it (those documents then no longer have their
expectation). What is flipped there is mostly small, and where a document is larger than its source's target, the step
looks at both ways of rounding it and at what the others can make of either.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import WORD_RE, written

WEIGHTS, MOST, LEAF, FAN, SEED = (5.0, 2.0, 1.0), 3.0, 1024, 64, 20240
#: Smallest documents that a group hands on; largest documents of the last group that are tried both ways; documents up to which all choices are looked at.
HANDED, TRIED, FEW = 8, 16, 20

_ROW = "id {id}, src long, bucket long, size long, source_size long, target double, whole int, frac double, copies int, round_key long, n long"


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words to take from each source: shares by weight (sources by code point, null last), none above `most` times its
    size, what is over going to the others by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    open_, left, out = list(names), float(sum(sizes.values())), {}
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def settle(size: np.ndarray, frac: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """1 or 0 per document, and -1 for the one that stays fractional (`last`: it is rounded by itself); frac is changed in place."""
    out = np.where(frac >= 1.0, 1, np.where((frac <= 0.0) | (size <= 0), 0, -1))
    open_, draws = np.flatnonzero(out < 0), rng.random(len(size) + 1)
    held = -1
    for k, j in enumerate(open_):
        if held < 0:
            held = j
            continue
        a, b, p, q = float(size[held]), float(size[j]), frac[held], frac[j]
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        if draws[k] * (up + down) < down:  # mass goes from j to the held one
            p, q = (1.0, q - up / b) if (1 - p) * a <= q * b else (p + up / a, 0.0)
        else:
            p, q = (0.0, q + down / b) if p * a <= (1 - q) * b else (p - down / a, 1.0)
        frac[held], frac[j] = p, q
        for i in (held, j):
            if frac[i] <= 1e-12 or frac[i] >= 1 - 1e-12:
                out[i] = int(frac[i] > 0.5)
        held = next((i for i in (held, j) if out[i] < 0), -1)
    if held >= 0 and last:
        out[held] = int(draws[-1] < frac[held])
    return out


def _best_choice(size: np.ndarray, goal: float) -> np.ndarray:
    """1 or 0 for each of a few documents, so that those with 1 come nearest to the goal; sums of either half meet in order."""
    half, sums = len(size) // 2, []
    for part in (size[:half], size[half:]):
        total = np.zeros(1)
        for x in part:
            total = np.concatenate([total, total + x])
        sums.append(total)
    order = np.argsort(sums[1], kind="stable")
    at = np.searchsorted(sums[1][order], goal - sums[0])
    pairs = [(np.abs(sums[0] + sums[1][order[j]] - goal), order[j]) for j in (np.clip(at - 1, 0, len(order) - 1), np.clip(at, 0, len(order) - 1))]
    near, other = min(pairs, key=lambda p: p[0].min())
    first = int(near.argmin())
    code = first | int(other[first]) << half
    return code >> np.arange(len(size)) & 1


def work_off(size: np.ndarray, extra: np.ndarray, error: float) -> np.ndarray:
    """extra with one or two documents flipped at a time, the best choice first, as long as that brings the taken words
    nearer to the target; error: how far they are over. That is tried from extra as it is, and with each of the TRIED
    largest documents flipped at the start and then left alone; the nearest outcome counts, the first of equal ones. Of at
    most FEW documents the best of all choices is taken."""
    if len(size) <= FEW:
        return _best_choice(size, float((extra * size).sum()) - error)
    best, least = extra, abs(error)
    for first in [-1, *np.argsort(-size, kind="stable")[:TRIED].tolist()]:
        if least < 1:
            break
        now, left = extra.copy(), error
        change = np.where(now > 0, -size, size).astype(np.float64)
        if first >= 0:
            now[first], left, change[first] = 1 - now[first], left + change[first], np.inf
        for _ in range(len(size)):
            order = np.argsort(change, kind="stable")
            order = order[np.isfinite(change[order])]
            d = change[order]
            flips = [(abs(left + d[k]), (order[k],)) for k in [int(np.abs(left + d).argmin())]] if len(d) else []
            at = np.searchsorted(d, -left - d)
            for shift in (-2, -1, 0, 1):  # the second of two flips: the one nearest to what the first leaves, but not itself
                j = at + shift
                usable = np.flatnonzero((j >= 0) & (j < len(d)) & (j != np.arange(len(d))))
                if len(usable):
                    after = np.abs(left + d[usable] + d[j[usable]])
                    k = usable[int(after.argmin())]
                    flips.append((float(after.min()), (order[k], order[j[k]])))
            after, which = min(flips, key=lambda f: (f[0], len(f[1])), default=(np.inf, ()))
            if after >= abs(left):
                break
            for k in which:
                now[k], left, change[k] = 1 - now[k], left + change[k], -change[k]
        if abs(left) < least:
            best, least = now, abs(left)
    return best


def _round(level: int, last: bool, exact: bool):
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["n"])]  # rows that are equal came as one
        pdf = pdf.sort_values(["size", "round_key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([SEED, level, int(pdf["src"].iloc[0]), int(pdf["bucket"].iloc[0]) // FAN**level])
        frac, size = pdf["frac"].to_numpy(dtype=float, copy=True), pdf["size"].to_numpy()
        mass, free = float((frac * size).sum()), (frac > 0) & (frac < 1) & (size > 0)
        handed = np.zeros(len(pdf), dtype=bool) if last else free & (np.cumsum(free[::-1])[::-1] <= HANDED)
        extra, some = np.full(len(pdf), -1), frac[~handed]
        extra[~handed] = settle(size[~handed], some, rng, last)
        frac[~handed] = some
        if exact and last and free.any():
            extra[free] = work_off(size[free], extra[free], float((extra * size).sum()) - mass)
        pdf["frac"], pdf["copies"], pdf["n"] = frac, np.where(extra < 0, -1, pdf["whole"] + extra).astype(np.int32), 1
        return pdf

    return group


def ranked_sources(sources: DataFrame) -> DataFrame:
    """sources with src: their place by code point, from 0, null last. Only one number a partition reaches the driver."""
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    dealt = written(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "mix-sources")
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())
    before = dict(zip([p for p, _ in sizes], np.cumsum([0, *[n for _, n in sizes]]).tolist(), strict=False))
    offsets = sources.sparkSession.createDataFrame(list(before.items()), "part int, offset long")
    return dealt.join(F.broadcast(offsets), "part").select(*sources.columns, (F.col("offset") + F.col("place")).alias("src"))


def aims(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, total, n) with src, weight and target, as targets() has them, however many sources there are.

    A source is full where `most` times its size per unit of weight is below the level at which the others fill, which
    rises as full ones leave; sums of whole numbers, so that the order of adding them does not matter.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    ranked = written(ranked_sources(sources).withColumn("weight", weight), "mix-weights")
    full = F.col("total") * F.lit(most)
    level, before = 0.0, None
    while level != before:
        is_full = full < F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum("total").alias("all"), F.sum(F.when(is_full, F.col("total"))).alias("gone"), F.sum(F.when(~is_full, F.col("weight"))).alias("open")).first()
        before, level = level, (row["all"] - most * (row["gone"] or 0)) / row["open"] if row["open"] else level
    return ranked.withColumn("target", F.when(full < F.lit(level) * F.col("weight"), full).otherwise(F.lit(level) * F.col("weight")).cast("double"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = MOST, exact: bool = True) -> DataFrame:
    """id, size, source_size, target, copies, taken per row of docs; reruns agree, whatever the partitioning.

    size: words of the text (null: 0). Documents without words are taken 0 words. Repeated rows are rows of their own
    (rows equal in id, source and size travel as one with a count until they are rounded, LEAF at most in one place).
    A null source is a source, the last; null ids are ids. An empty table gives no rows, extra columns are not read,
    and a long text is only counted. What reaches the driver are sums and one number a partition, not the sources.
    exact: see work_off(); without it each document is taken as often as its expectation says.
    """
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"))
    sizes = written(sizes.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    plan = aims(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n")), weights, most)
    times = F.coalesce(F.least(F.lit(float(most)), F.try_divide("target", "total")), F.lit(0.0))
    plan = plan.select(F.col("source").alias("of"), "src", F.col("total").alias("source_size"), "target", times.alias("times"), F.ceil(F.col("n") / LEAF).alias("buckets"))
    plan = written(plan.withColumn("whole", F.floor("times").cast("int")), "mix-plan")
    deep = plan.agg(F.max("buckets")).first()[0] or 1
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / LEAF))).alias("chunk")
    rows = sizes.select("id", "source", "size", F.col("n").alias("of_all"), chunk)
    key = F.xxhash64(F.lit(SEED), "id", "size", "chunk")
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["of"])).select(
        "id", "src", F.pmod(key, "buckets").alias("bucket"), "size", "source_size", "target", "whole", (F.col("times") - F.col("whole")).alias("frac"), F.lit(-1).alias("copies"), key.alias("round_key"),
        F.least(F.lit(LEAF), F.col("of_all") - F.col("chunk") * LEAF).cast("long").alias("n"),
    )
    schema, done, level = _ROW.format(id=sizes.schema["id"].dataType.simpleString()), [], 0
    while True:
        last = deep <= FAN**level
        step = rows.groupBy("src", F.floor(F.col("bucket") / F.lit(FAN**level)).alias("leaf")).applyInPandas(_round(level, last, exact), schema)
        step = written(step, f"mix-{level}")
        done.append(step if last else step.where("copies >= 0"))
        if last:
            break
        rows, level = step.where("copies < 0"), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
