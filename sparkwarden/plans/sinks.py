"""Reports: JSON, SARIF 2.1.0 and text. Bulk findings are written by Spark; a report is made of a collected summary."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the shape of the reports ---
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
ALWAYS = ("file_path", "line_number", "issue_type", "severity", "message", "rule_id", "confidence", "snippet", "detection_method", "remediation_hint")
SPARSE = ("cwe_id", "owasp_category", "endpoint", "evidence")
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def finding_json(findings: DataFrame) -> DataFrame:
    """(ord, json): one JSON object a finding; the web fields only if they are not empty."""
    kept = [F.col(c) for c in ALWAYS] + [F.nullif(F.col(c), F.lit("")).alias(c) for c in SPARSE]
    return findings.select("ord", F.to_json(F.struct(*kept)).alias("json"))


def write_findings(findings: DataFrame, path: str) -> None:
    findings.drop("sev_rank").write.mode("overwrite").json(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """(ord, json): one SARIF result a finding. Line 0, which stands for a whole file, is written as 1."""
    levels = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    snippet = F.when(F.col("snippet") != "", F.struct(F.substring("snippet", 1, 80).alias("text")))
    region = F.struct(F.greatest(F.col("line_number"), F.lit(1)).alias("startLine"), snippet.alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    props = F.struct("confidence", F.col("detection_method").alias("detectionMethod"), F.col("remediation_hint").alias("remediationHint"))
    out = F.struct(F.col("rule_id").alias("ruleId"), F.try_element_at(levels, F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), props.alias("properties"))
    return findings.select("ord", F.to_json(out).alias("json"))


# --- fixed values: lengths at which a rule's descriptions are cut ---
SHORT, FULL = 120, 200


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(first_ord, rule_id, json): one SARIF rule for each rule id, with what its first finding says."""
    from sparkwarden.operators.findings import distinct_rules

    levels = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    rule, text = F.col("rule_id"), lambda c: F.struct(c.alias("text"))
    title = F.when(rule.contains("-"), F.initcap(F.replace(F.lower(F.regexp_replace(rule, "^[^-]*-", "")), F.lit("-"), F.lit(" ")))).otherwise(rule)
    out = F.struct(
        rule.alias("id"), title.alias("name"), text(F.substring(F.substring_index("message", ".", 1), 1, SHORT)).alias("shortDescription"), text(F.substring("message", 1, FULL)).alias("fullDescription"),
        F.struct(F.try_element_at(levels, F.col("severity")).alias("level")).alias("defaultConfiguration"),
        F.struct("severity", F.col("issue_type").alias("issueType"), F.array(F.lit("security"), F.col("issue_type")).alias("tags")).alias("properties"),
    )
    return distinct_rules(findings).select("first_ord", "rule_id", F.to_json(out).alias("json"))


def sarif(findings: DataFrame, tool: str = "sparkwarden", version: str = "0.1.0") -> dict:
    """The SARIF log of (deduplicated) findings, in their order. Rules are as many as the catalog has at most; results are streamed."""
    rules = [json.loads(r.json) for r in sarif_rules(findings).orderBy("first_ord", "rule_id").toLocalIterator()]
    results = [json.loads(r.json) for r in sarif_results(findings).orderBy("ord", "json").toLocalIterator()]
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "results": results}
    if results:
        run["invocations"] = [{"executionSuccessful": True}]
    return {"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [run]}


#: What a SARIF log must hold: where (a list is entered item by item), which keys, of which type.
SARIF_SHAPE = [
    ((), {"version": str, "runs": list}),
    (("runs",), {"tool": dict}),
    (("runs", "tool"), {"driver": dict}),
    (("runs", "tool", "driver"), {"name": str}),
    (("runs", "tool", "driver", "rules"), {"id": str}),
    (("runs", "results"), {"message": dict}),
    (("runs", "results", "message"), {"text": str}),
    (("runs", "results", "locations", "physicalLocation", "artifactLocation"), {"uri": str}),
]


def _reached(node, path: tuple[str, ...], where: str = "log"):
    """The nodes at the end of a path, with their places; lists stand for their items, and a missing step ends it."""
    for k, item in enumerate(node) if isinstance(node, list) else [(None, node)]:
        at = where if k is None else f"{where}[{k}]"
        if not path:
            yield at, item
        elif isinstance(item, dict) and path[0] in item:
            yield from _reached(item[path[0]], path[1:], f"{at}.{path[0]}")


def sarif_errors(log) -> list[str]:
    """What a SARIF log breaks of the format's structure: required keys and their types, the version, levels, lines, rules that results name."""
    if not isinstance(log, dict):
        return ["log: not an object"]
    errors = []
    for path, keys in SARIF_SHAPE:
        for at, item in _reached(log, path):
            if not isinstance(item, dict):
                errors.append(f"{at}: not an object")
                continue
            errors += [f"{at}.{key}: {'missing' if key not in item else f'not a {kind.__name__}'}" for key, kind in keys.items() if not isinstance(item.get(key), kind)]
    if errors:
        return errors
    if log["version"] != "2.1.0":
        errors.append(f"log.version: {log['version']!r}")
    for at, run in _reached(log, ("runs",)):
        ids = [r["id"] for r in run["tool"].get("driver", {}).get("rules", [])]
        errors += [f"{at}: rule {i} twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
        for place, result in _reached(run, ("results",), at):
            if result.get("level", "warning") not in ("none", "note", "warning", "error"):
                errors.append(f"{place}.level: {result['level']!r}")
            if ids and result.get("ruleId") not in ids:
                errors.append(f"{place}.ruleId: {result.get('ruleId')!r} is no rule of the run")
    for at, region in _reached(log, ("runs", "results", "locations", "physicalLocation", "region")):
        if not isinstance(region.get("startLine", 1), int) or region.get("startLine", 1) < 1:
            errors.append(f"{at}.startLine: {region['startLine']!r}")
    return errors


def json_report(summary: dict, findings: DataFrame, compact: bool = False) -> str:
    rows = [json.loads(r.json) for r in finding_json(findings).orderBy("ord", "json").toLocalIterator()]
    return json.dumps(summary | {"findings": rows}, indent=None if compact else 2)


def sarif_report(findings: DataFrame, compact: bool = False) -> str:
    return json.dumps(sarif(findings), indent=None if compact else 2)


# --- fixed values: terminal codes ---
RESET, BOLD, DIM = "\033[0m", "\033[1m", "\033[2m"
COLOURS = {"CRITICAL": "\033[95m", "HIGH": "\033[91m", "MEDIUM": "\033[93m", "LOW": "\033[94m", "BLOCK": "\033[97;41m", "WARN": "\033[30;43m", "PASS": "\033[30;42m"}


def text_report(summary: dict, findings: DataFrame, width: int = 20, colour: bool = False, stats: bool = False) -> str:
    """Findings by file (paths in order) with advice and categories, counts, and the verdict. stats: time by scanner and files by extension."""
    from sparkwarden.operators.findings import by_file

    paint = lambda code, text: f"{code}{text}{RESET}" if colour else text
    badge = lambda name, pad=0: paint(COLOURS[name], f" {name} " if pad == 0 else f"{name:<{pad}}")
    out = [f"Verdict: {badge(summary['verdict']).strip()} (threshold {summary['severity_threshold']})", f"Findings: {summary['total_findings']}", ""]
    for row in by_file(findings).orderBy("file_path").toLocalIterator():
        out.append(paint(BOLD, row.file_path))
        for f in row.findings:
            out.append(f"  {f.line_number:>5}  {badge(f.severity, 8)}  {f.rule_id:<{width}}  {f.message}")
            more = [x for x in (f.remediation_hint, " | ".join(filter(None, (f.cwe_id, f.owasp_category)))) if x]
            out += [paint(DIM, f"         {x}") for x in more]
    times, total = summary.get("scanner_times_ms") or {}, summary.get("scan_time_ms") or 0
    for name, ms in sorted(times.items(), key=lambda x: (-x[1], x[0])) if stats else []:
        out.append(paint(DIM, f"{name:<20} {ms:.0f} ms ({100 * ms / total if total else 0:.0f}%)"))
    counts = summary.get("files_by_extension") or {}
    total = sum(counts.values())
    for ext, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        pct = 100 * n / total
        out.append(f"{ext:<12} {'█' * min(20, max(1, int(pct / 5)))} {n} ({pct:.1f}%)")
    return "\n".join(out)


def emit(text: str, path: str | None) -> None:
    """To the file, or to standard output if there is no path or it cannot be written."""
    if path:
        try:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
            return
        except OSError as e:
            print(f"cannot write {path}: {e}", file=sys.stderr)
    print(text)
