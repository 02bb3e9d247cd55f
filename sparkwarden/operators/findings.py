"""The findings schema, deduplication, roll-ups and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwarden.functions.catalog import SEVERITIES

SCHEMA = (
    "file_path string, line_number int, issue_type string, severity string, message string, rule_id string, confidence double, snippet string, "
    "detection_method string, remediation_hint string, cwe_id string, owasp_category string, endpoint string, evidence string, sev_rank tinyint, ord bigint"
)
_DEFAULTS = {"line_number": 0, "confidence": 1.0, "detection_method": "regex"}
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def rank(severity: Column) -> Column:
    """0 (LOW) to 3 (CRITICAL); null for any other text."""
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int") - 1


def conform(rows: DataFrame) -> DataFrame:
    """rows in the findings schema: absent and null columns get their defaults, which are never null."""
    types = dict(c.split() for c in SCHEMA.split(", "))
    have = set(rows.columns)
    out = []
    for c in COLUMNS[:-2]:
        default = F.lit(_DEFAULTS.get(c, "")).cast(types[c])
        out.append((F.coalesce(F.col(c).cast(types[c]), default) if c in have else default).alias(c))
    sev = F.coalesce(F.when(F.col("severity") != "", rank(F.col("severity"))), F.lit(0)).cast("tinyint").alias("sev_rank")
    ord_ = (F.col("ord").cast("bigint") if "ord" in have else F.lit(0).cast("bigint")).alias("ord")
    return rows.select(*out, sev, ord_)


def union(*detectors: DataFrame) -> DataFrame:
    """All detectors' findings in one frame, ordered by detector first: ord holds the detector's place in its top bits, its own ord (below 2^52) the others."""
    out = None
    for k, d in enumerate(detectors):
        part = conform(d).withColumn("ord", F.col("ord") + F.lit(k << 52))
        out = part if out is None else out.unionByName(part)
    return out


def first_only(findings: DataFrame, *key: str) -> DataFrame:
    """One finding per key, the one with the smallest ord (default key: file, line, rule, endpoint).

    A grouped minimum rather than a window: what a task sends on is one row a key.
    """
    key = key or ("file_path", "line_number", "rule_id", "endpoint")
    rest = [c for c in findings.columns if c not in key and c != "ord"]
    best = findings.groupBy(*key).agg(F.min(F.struct("ord", *rest)).alias("best"))
    return best.select(*[F.col(c) if c in key else F.col(f"best.{c}").alias(c) for c in findings.columns])


def type_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("issue_type").agg(F.count("*").alias("n"))


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    """Counts of each severity, zeros included, and the total; with `by`, one row per group."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return findings.groupBy(*by).agg(*map(count, SEVERITIES), F.count("*").alias("total"), F.max("sev_rank").alias("max_rank"))


def verdict(max_rank: Column, threshold: str | Column) -> Column:
    """BLOCK at or above the threshold, WARN exactly one below it, else PASS; no finding (null) passes."""
    at = rank(F.lit(threshold) if isinstance(threshold, str) else threshold)
    gap = at - max_rank.cast("int")
    return F.when(max_rank.isNull(), "PASS").when(gap <= 0, "BLOCK").when(gap == 1, "WARN").otherwise("PASS")


def exit_code(v: Column) -> Column:
    return F.when(v == "BLOCK", 2).when(v == "WARN", 1).otherwise(0)


def parse_threshold(text: str) -> str:
    name = text.strip().upper()
    if name not in SEVERITIES:
        raise ValueError(f"no such severity: {text!r}; one of {', '.join(SEVERITIES)}")
    return name


def distinct_rules(findings: DataFrame) -> DataFrame:
    """One row per rule, with the attributes of its first finding, in the order of first appearance."""
    attrs = findings.groupBy("rule_id").agg(F.min(F.struct("ord", "severity", "issue_type", "message")).alias("f"))
    return attrs.select("rule_id", "f.severity", "f.issue_type", "f.message", F.col("f.ord").alias("first_ord"))


def by_file(findings: DataFrame) -> DataFrame:
    """Findings of each file in their order, as one array."""
    told = [c for c in ("remediation_hint", "cwe_id", "owasp_category") if c in findings.columns]
    item = F.struct("ord", "line_number", "severity", "rule_id", "message", *told)
    return findings.groupBy("file_path").agg(F.array_sort(F.collect_list(item)).alias("findings"), F.max("sev_rank").alias("max_rank"))


def shares(counts: DataFrame, name: str, n: str = "n") -> DataFrame:
    """Each row's percentage of the total and its bar length (1 to 20), largest first, ties by name."""
    total = counts.agg(F.sum(n).alias("total"))
    pct = F.lit(100.0) * F.col(n) / F.col("total")
    bar = F.least(F.lit(20), F.greatest(F.lit(1), F.floor(pct / 5))).cast("int")
    return counts.join(F.broadcast(total)).select(name, n, F.round(pct, 4).alias("pct"), bar.alias("bar")).orderBy(F.desc(n), name)


def time_shares(times: DataFrame, total_ms: float | Column) -> DataFrame:
    """(scanner, ms) with its percentage of a scan's whole time, which other work is part of too; longest first, ties by name."""
    whole = total_ms if isinstance(total_ms, Column) else F.lit(float(total_ms))
    return times.withColumn("pct", F.when(whole > 0, F.round(100 * F.col("ms") / whole, 4)).otherwise(0.0)).orderBy(F.desc("ms"), "scanner")


def ranked(findings: DataFrame, *order: Column) -> DataFrame:
    """findings with ord as their place within the file, from 1, for detectors that number by file."""
    return findings.withColumn("ord", F.row_number().over(Window.partitionBy("file_path").orderBy(*order)).cast("bigint"))
