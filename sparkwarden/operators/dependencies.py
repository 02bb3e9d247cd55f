"""What a manifest pulls in through its packages' own dependencies.

Requirements are first resolved to the best version that a package offers within the required range (see version_ranges). Then
the packages of each root are found breadth first: each round joins only what the last one found, so the number of rounds is
the depth of the graph, and cycles end where nothing new is found. Of several requirements of one package the one nearest
to the root decides its version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.advisories import version_key
from sparkwarden.operators.version_ranges import range_hits
from sparkwarden.sources.scratch import stored


def resolved(requirements: DataFrame, available: DataFrame) -> DataFrame:
    """requirements (package, needs, clauses) with version: the highest of available (package, version) of the needed package
    that the clauses allow; requirements that no version meets are left out. Of spellings of one version the first by bytes counts."""
    asked = requirements.select(F.col("needs").alias("package"), "clauses").distinct()
    asked = stored(asked.withColumn("range_id", F.struct("package", "clauses")), "requirements")
    hits = range_hits(available, asked)
    key = version_key(F.col("version"))
    best = hits.withColumn("key", key).groupBy("range_id").agg(F.max("key").alias("top"), F.collect_set(F.struct("key", "version")).alias("every"))
    best = best.select("range_id", F.array_min(F.transform(F.filter("every", lambda x: x["key"] == F.col("top")), lambda x: x["version"])).alias("version"))
    best = best.select(F.col("range_id.package").alias("needs"), F.col("range_id.clauses").alias("clauses"), "version")
    return requirements.join(best, ["needs", "clauses"]).select(*requirements.columns, "version")


def closure(roots: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(root, package, depth, parent, version): each package that a root needs, directly (depth 0, no parent) or through others.

    roots: (root, package, version); edges: (package, needs, version), resolved. depth is the least; of requirements at that
    depth the one of the least (parent, version) counts. most: a depth beyond which nothing is followed. A package that needs
    itself, or a root's package again, is found once; repeated rows are one; rows with a null package are left out, a null
    root is a root. Empty tables give no rows, other columns are not read.
    """
    first = roots.where("package is not null").groupBy("root", "package").agg(F.min("version").alias("version"))
    front = stored(first.select("root", "package", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["package"].dataType).alias("parent"), "version"), "closure-0")
    edges = stored(edges.where("package is not null and needs is not null").groupBy("package", "needs").agg(F.min("version").alias("version")), "closure-edges")
    found, depth = [front], 0
    while not front.isEmpty() and (most is None or depth < most):
        depth += 1
        step = front.select("root", F.col("package").alias("parent")).join(edges.withColumnRenamed("package", "parent"), "parent")
        step = step.groupBy("root", "needs").agg(F.min(F.struct("parent", "version")).alias("by"))
        step = step.select("root", F.col("needs").alias("package"), F.lit(depth).alias("depth"), "by.parent", "by.version")
        known = reduce(DataFrame.unionByName, found).select(F.col("root").alias("r"), F.col("package").alias("p"))
        front = stored(step.join(known, F.col("root").eqNullSafe(F.col("r")) & (F.col("package") == F.col("p")), "left_anti"), f"closure-{depth}")
        found.append(front)
    return reduce(DataFrame.unionByName, found)
