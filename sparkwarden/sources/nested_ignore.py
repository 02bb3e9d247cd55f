"""Ignore files in any folder: of all rules that match a path, the last one in the deepest folder decides.

A path is spread out into the folders above it, each is joined with the one row of that folder's rules, and the decisions
of its folders meet again as a maximum by depth: nothing is compared but a path with rules of its own folders.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.sources.patterns import to_regex

_RULE = "folder string, ord int, pattern string, regex string, exclude boolean"


def _compiled(batches):
    for b in batches:
        rows = [(folder, k, p, *rule) for folder, k, p in zip(*[b.column(c).to_pylist() for c in range(3)], strict=True) if (rule := to_regex(p or ""))]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["folder", "ord", "pattern", "regex", "exclude"])


def rules_of_files(files: DataFrame, name: str = ".gitignore", path: str = "file_path", content: str = "content") -> DataFrame:
    """(folder, ord, pattern) of the lines of all ignore files among files (path, content as text); the top folder is ''."""
    own = files.where((F.col(path) == name) | F.endswith(F.col(path), F.lit(f"/{name}")))
    folder = F.regexp_replace(F.regexp_replace(F.col(path), r"[^/]*\z", ""), "/$", "")
    return own.select(folder.alias("folder"), F.posexplode(F.split(F.col(content), r"\r?\n")).alias("ord", "pattern"))


def decided(paths: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """(path, ignored, folder, pattern), one row for each distinct path: the rule that decides (null if none matches) and what it says.

    rules: (folder, ord, pattern), folders without slashes at either end, '' the top one; within a folder the greatest ord
    that matches counts, patterns are relative to it. Blank patterns and comments are no rules, rules that repeat are one, a null
    folder is the top one. A path is taken as it is written; null paths are left out, '' is only matched by nothing. Other
    columns are not read; without rules no path is ignored, an empty table gives no rows.
    """
    known = rules.select(F.coalesce("folder", F.lit("")).alias("folder"), F.col("ord").cast("int").alias("ord"), "pattern").mapInArrow(_compiled, _RULE)
    # one row for each folder: the rules of one file, the last first
    known = known.groupBy("folder").agg(F.sort_array(F.collect_set(F.struct("ord", "pattern", "regex", "exclude")), asc=False).alias("rules"))
    every = paths.select(F.col(path).alias("path")).where("path is not null").distinct()
    parts = F.split("path", "/")
    above = every.select("path", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth"))
    folder = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/")
    rest = F.array_join(F.slice(F.split("path", "/"), F.col("depth") + 1, F.size(F.split("path", "/"))), "/")
    met = above.select("path", "depth", folder.alias("folder"), rest.alias("rest")).join(known, "folder")
    first = F.try_element_at(F.filter("rules", lambda r: F.regexp_instr("rest", r["regex"]) > 0), F.lit(1))
    met = met.select("path", F.struct("depth", "folder", first.alias("rule")).alias("by")).where("by.rule is not null")
    deepest = met.groupBy("path").agg(F.max_by("by", "by.depth").alias("by"))
    out = every.join(deepest, "path", "left")
    return out.select(F.col("path").alias(path), F.coalesce("by.rule.exclude", F.lit(False)).alias("ignored"), F.col("by.folder").alias("folder"), F.col("by.rule.pattern").alias("pattern"))
