"""The library's entry points: scan a folder of files, or a table of captured responses."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.functions.advice import code_advice
from sparkwarden.functions.text import lines
from sparkwarden.operators import advisories, code_rules, findings, manifests, responses, syntax_tree
from sparkwarden.sources import files


def _numbered(rows: DataFrame, kind: str, method: str, path: str = "file_path", line: str = "line_no") -> DataFrame:
    """Detector rows with the columns that findings have in common."""
    out = rows.withColumn("file_path", F.col(path)).withColumn("line_number", F.col(line)).withColumn("issue_type", F.lit(kind)).withColumn("detection_method", F.lit(method))
    rule = F.col("rule_ord") if "rule_ord" in rows.columns else F.lit(0)
    if "message" not in rows.columns:
        message, hint = code_advice(F.col("rule_id"))
        out = out.withColumns({"message": message, "remediation_hint": hint})
    return out.withColumn("rule_ord", rule)


def _ordered(rows: DataFrame) -> DataFrame:
    """ord from the place of a finding in the order of detectors, paths, lines and rules: dealt in ranges, numbered in each."""
    names = ["detector", "file_path", "line_number", "rule_ord", "rule_id"]
    dealt = rows.repartitionByRange(*names).sortWithinPartitions(*names)
    return dealt.withColumn("ord", F.monotonically_increasing_id())


def detectors(
    spark: SparkSession, found: DataFrame, scan_all: bool = False, advisory_rows: DataFrame | None = None, records: DataFrame | None = None, disabled: list[str] = (), dotenv: bool = False
) -> dict[str, DataFrame]:
    """Findings by detector over files(file_path, ext, content): secrets, code rules, syntax trees, manifests.

    records: an OSV dump, which is looked up in place of the advisories; disabled: rules without findings; dotenv: .env files too.
    """
    texts = files.text_of(files.scannable(found, scan_all, dotenv))
    rows = lines(texts, "file_path", "content")
    known = advisories.offline_advisories(spark) if advisory_rows is None else advisory_rows
    packages = manifests.packages(files.text_of(found))
    if records is None:
        deps = advisories.advisory_findings(packages, known)
    else:
        packages = packages.persist(StorageLevel.MEMORY_AND_DISK)  # looked up in the dump, and then joined with what was found
        deps = advisories.osv_findings(packages, advisories.osv_hits(packages, records), records)
    cve = F.replace(F.substring("rule_id", 5, 99), F.lit("_"), F.lit("-"))
    deps = deps.withColumn("message", F.concat_ws(" ", "name", "version", F.lit("is affected by"), cve))
    deps = deps.withColumn("remediation_hint", F.concat_ws(" ", F.lit("Update"), "name", *[F.when(F.col("fixed") != "", F.concat(F.lit("to "), "fixed"))] * (records is not None)))
    deps = _numbered(deps, "dependency", "dependency", "manifest", "line_num")
    out = {
        "secrets": _numbered(code_rules.secret_findings(rows), "secret", "regex"),
        "static_analysis": _numbered(code_rules.code_findings(rows), "static_analysis", "regex"),
        "syntax_trees": _numbered(syntax_tree.tree_findings(texts), "static_analysis", "ast"),
        "dependencies": deps.dropDuplicates(["file_path", "line_number", "rule_id", "message"]),
    }
    return {name: rows.where(~F.col("rule_id").isin(*disabled)) for name, rows in out.items()} if disabled else out


def _together(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for k, rows in enumerate(parts.values()):
        part = rows.withColumn("detector", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return findings.first_only(findings.conform(_ordered(out)))


def scan_files(spark: SparkSession, found: DataFrame, scan_all: bool = False, advisory_rows: DataFrame | None = None) -> DataFrame:
    """Deduplicated findings of all detectors."""
    return _together(detectors(spark, found, scan_all, advisory_rows))


def scan_repository(
    spark: SparkSession, root: str, threshold: str = "HIGH", advisory_file: str | None = None, osv: str | None = None, disabled: list[str] = (), dotenv: bool = False, **options
) -> tuple[dict, DataFrame]:
    """Summary and findings of a folder. options: scan_all, include_ignored, exclude, include (see sources.files.discover).

    advisory_file: a JSON file of advisories instead of the built-in ones; osv: an OSV dump (see advisories.read_osv) instead of
    both; disabled, dotenv: see detectors(). The summary has the time of each detector.
    """
    began, times = time.time(), {}
    found = files.discover(spark, root, **{"include_ignored": False} | options).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r.ext: r.n for r in files.extension_counts(found).collect()}
    times["discovery"] = _since(began)
    known = advisories.read_advisories(spark, advisory_file) if advisory_file else None
    parts = {}
    records = advisories.read_osv(spark, osv) if osv else None
    for name, rows in detectors(spark, found, options.get("scan_all", False), known, records, list(disabled), dotenv).items():
        start = time.time()
        parts[name] = rows.persist(StorageLevel.MEMORY_AND_DISK)
        parts[name].count()
        times[name] = _since(start)
    rows = _together(parts).persist(StorageLevel.MEMORY_AND_DISK)
    scanned = files.scannable(found, options.get("scan_all", False), dotenv).count()
    summary = _summary(rows, threshold, began, scanned_files=scanned, scanner_times_ms=times, files_by_extension=counts)
    for held in (found, *parts.values()):  # the findings are kept, what they were made of is not
        held.unpersist()
    return summary, rows


def _since(began: float) -> float:
    return round(1000 * (time.time() - began), 2)


def scan_responses(spark: SparkSession, captured: DataFrame, as_of: int, threshold: str = "HIGH", skip: frozenset[str] = frozenset()) -> tuple[dict, DataFrame]:
    """Summary and findings of a capture, as of a moment in epoch seconds."""
    began = time.time()
    rows = findings.first_only(findings.conform(responses.response_findings(captured, as_of, skip))).persist(StorageLevel.MEMORY_AND_DISK)
    return _summary(rows, threshold, began, scanned_endpoints=captured.count()), rows


def _summary(rows: DataFrame, threshold: str, began: float, **more) -> dict:
    threshold = findings.parse_threshold(threshold)
    row = findings.severity_counts(rows).select("*", findings.verdict(F.col("max_rank"), threshold).alias("verdict")).first()
    return {
        "verdict": row.verdict, "total_findings": row.total, "severity_threshold": threshold, "scan_time_ms": _since(began),
        "by_severity": {s: row[s.lower()] for s in findings.SEVERITIES}, "by_type": {r.issue_type: r.n for r in findings.type_counts(rows).collect()}, **more,
    }
