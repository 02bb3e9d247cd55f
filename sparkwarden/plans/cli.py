"""Command line: `python -m sparkwarden scan PATH` and `python -m sparkwarden responses CAPTURE`."""

from __future__ import annotations

import argparse
import os
import sys
import time

from sparkwarden.operators.findings import parse_threshold
from sparkwarden.sources.patterns import parse_list

EXITS = {"PASS": 0, "WARN": 1, "BLOCK": 2}
USAGE_ERROR = 3  # apart from the verdicts' codes


def _severity(text: str) -> str:
    try:
        return parse_threshold(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkwarden")
    sub = top.add_subparsers(dest="command", required=True)
    for name, what in (("scan", "folder of files"), ("responses", "Parquet table of captured responses")):
        p = sub.add_parser(name, help=f"findings of a {what}")
        p.add_argument("path", help=what)
        p.add_argument("--threshold", type=_severity, default="HIGH")
        p.add_argument("--format", choices=("text", "json", "sarif"), default="text")
        p.add_argument("--compact", action="store_true")
        p.add_argument("--output", help="file for the report")
        p.add_argument("--findings", help="folder, in any store that Spark writes to, for all findings as JSON lines")
    scan, web = sub.choices["scan"], sub.choices["responses"]
    scan.add_argument("--all", action="store_true", dest="scan_all")
    scan.add_argument("--no-gitignore", action="store_true", help="files that git ignores too")
    scan.add_argument("--exclude", type=parse_list, default=[])
    scan.add_argument("--include", type=parse_list, default=[])
    scan.add_argument("--advisories", help="JSON file of advisories instead of the built-in ones")
    scan.add_argument("--osv", help="OSV dump (JSON files, or .jsonl) to look packages up in")
    scan.add_argument("--disable", type=parse_list, default=[], help="rules to leave out")
    scan.add_argument("--dotenv", action="store_true", help="scan .env files")
    scan.add_argument("--stats", action="store_true", help="time by scanner in the text report")
    web.add_argument("--as-of", type=int, default=None, help="moment for token lifetimes, in epoch seconds")
    web.add_argument("--skip", type=parse_list, default=[], help="checks to leave out")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from sparkwarden.plans import api, sinks

    if "://" not in args.path and not os.path.exists(args.path):
        print(f"no such path: {args.path}", file=sys.stderr)
        return USAGE_ERROR
    spark = SparkSession.builder.appName("sparkwarden").getOrCreate()
    if args.command == "scan":
        summary, rows = api.scan_repository(spark, args.path, args.threshold, scan_all=args.scan_all, include_ignored=args.no_gitignore, exclude=args.exclude, include=args.include, advisory_file=args.advisories, osv=args.osv, disabled=args.disable, dotenv=args.dotenv)
    else:
        as_of = int(time.time()) if args.as_of is None else args.as_of
        summary, rows = api.scan_responses(spark, spark.read.parquet(args.path), as_of, args.threshold, frozenset(args.skip))
    if args.findings:
        sinks.write_findings(rows, args.findings)
    colour = sys.stdout.isatty() and not args.output
    report = {"text": lambda: sinks.text_report(summary, rows, colour=colour, stats=getattr(args, "stats", False)), "json": lambda: sinks.json_report(summary, rows, args.compact), "sarif": lambda: sinks.sarif_report(rows, args.compact)}
    sinks.emit(report[args.format](), args.output)
    return EXITS[summary["verdict"]]
