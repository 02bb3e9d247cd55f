"""Which of very many version ranges a version lies in, without pairing the ranges of a package with its versions.

Versions and the bounds of ranges become strings that sort as PEP 440 does. All distinct ones, with their packages, are put
in one order and numbered; a range is then an interval of numbers, which is cut into the few aligned blocks of 2^k numbers
that make it up, and a version has one block of each size. Equal blocks meet in a plain join, so a package with a third of
all versions and ranges is dealt by blocks like any other. An interval is as tight as order can tell; the clauses that
look at more than order (pre- and post-releases next to a bound, `!=`) are tried on what met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.advisories import ZERO, meets, parsed, version_key
from sparkwarden.sources.scratch import numbered, stored

#: Before and after all keys.
FIRST, LAST = "", "\x7f\x7f"


def _head(key: Column, release: Column) -> Column:
    return F.concat(key["epoch"], F.array_join(release, ""))


def order_key(key: Column) -> Column:
    """A version_key() as a string of the same order; none is the beginning of another."""
    post = F.when(key["post"] == "", " ").otherwise(key["post"])
    return F.concat(_head(key, key["release"]), F.lit(" "), (key["phase"] + 1).cast("string"), key["pre"], post, key["dev"])


def bounds(clause: Column) -> Column:
    """(lo, hi) of a parsed clause: the keys that meet it are from lo on and before hi. Null if it cannot be read."""
    op, wild, size, key = (clause[n] for n in ("op", "wild", "size", "bound"))
    at = order_key(key)
    padded = lambda n: F.slice(F.concat(key["release"], F.array_repeat(F.lit(ZERO), n)), F.lit(1), n)
    group = lambda n: F.concat(_head(key, padded(n)), F.lit("\x7f"))
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    first, last = F.lit(FIRST), F.lit(LAST)
    found = (
        F.when(op.isin("==", "===") & wild, pair(F.concat(_head(key, key["release"]), F.lit(" ")), group(size))).when(op.isin("==", "==="), pair(at, F.concat(at, F.lit(" "))))
        .when(op == "~=", pair(at, group(F.greatest(size - 1, F.lit(1))))).when(op.isin(">", ">="), pair(at, last)).when(op == "<", pair(first, at))
        .when(op == "<=", pair(first, F.concat(at, F.lit(" ")))).when(op == "!=", pair(first, last))
    )
    return F.when(key.isNotNull(), found)


def intervals(ranges: DataFrame, clauses: str = "clauses") -> DataFrame:
    """ranges with their clauses parsed, lo and hi, those left out that no version can meet: an unreadable clause is never met.
    Each clause is a row while it is read, so that no part of it is worked out twice."""
    row = ranges.withColumn("_row", F.monotonically_increasing_id())
    each = row.select("*", F.explode(F.split(clauses, ",")).alias("_text")).withColumn("_clause", parsed(F.col("_text"))).withColumn("_bounds", bounds(F.col("_clause")))
    every = [F.first(c).alias(c) for c in ranges.columns if c != clauses]
    rows = each.groupBy("_row").agg(*every, F.collect_list("_clause").alias(clauses), F.max("_bounds.lo").alias("lo"), F.min("_bounds.hi").alias("hi"), F.bool_and(F.col("_bounds").isNotNull()).alias("_read"))
    return rows.where("_read and lo < hi").drop("_row", "_read")


def _cover(first: Column, end: Column, levels: int) -> Column:
    """The aligned blocks (level, block) that the numbers from first on and before end consist of, two of a level at most."""
    parts = []
    for k in range(levels + 1):
        lo, hi = F.shiftright(first + ((1 << k) - 1), k), F.shiftright(end, k)
        block = lambda b, k=k: F.struct(F.lit(k).alias("level"), b.alias("block"))
        parts += [F.when((lo < hi) & (lo % 2 == 1), block(lo)), F.when((lo < hi) & (hi % 2 == 1), block(hi - 1))]
    return F.array_compact(F.array(*parts))


def range_hits(points: DataFrame, ranges: DataFrame, package: str = "package", version: str = "version", range_id: str = "range_id", clauses: str = "clauses") -> DataFrame:
    """(package, version, range_id), distinct: the versions of points that a range of their package contains.

    points: (package, version), in any number of repeats; ranges: (range_id, package, clauses: joined by commas, all to be
    met). Unreadable versions lie in no range, a range with an unreadable clause holds none; null packages match nothing, nor
    do null clauses. Spellings of one version are versions of their own with the same hits. Other columns are not read; empty
    tables give no rows. A version that a third of the rows have is one row before anything moves.
    """
    points = points.select(F.col(package).alias("package"), F.col(version).alias("version")).where("package is not null").distinct()
    points = points.withColumn("parts", version_key(F.col("version"))).where("parts is not null")
    points = stored(points.withColumn("key", order_key(F.col("parts"))), "version-points")
    rows = ranges.select(F.col(range_id).alias("range_id"), F.col(package).alias("package"), F.col(clauses).alias("clauses")).where("package is not null")
    rows = stored(intervals(rows), "version-ranges")
    keys = points.select("package", "key").unionByName(rows.select("package", F.col("lo").alias("key"))).unionByName(rows.select("package", F.col("hi").alias("key")))
    order, n = numbered(keys.distinct(), "package", "key")
    place = lambda name, at: order.select("package", F.col("key").alias(name), F.col("pos").alias(at))
    levels = max(1, n).bit_length()
    wide = rows.join(place("lo", "first"), ["package", "lo"]).join(place("hi", "end"), ["package", "hi"])
    wide = wide.select("range_id", "clauses", F.explode(_cover(F.col("first"), F.col("end"), levels)).alias("b")).select("range_id", "clauses", "b.*")
    every = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("pos", k).alias("block")) for k in range(levels + 1)])
    each = points.join(place("key", "pos"), ["package", "key"]).select("package", "version", "parts", F.explode(every).alias("b")).select("package", "version", "parts", "b.*")
    met = each.join(wide, ["level", "block"])
    return met.where(F.forall("clauses", lambda c: meets(F.col("parts"), c))).select(F.col("package").alias(package), F.col("version").alias(version), F.col("range_id").alias(range_id))
