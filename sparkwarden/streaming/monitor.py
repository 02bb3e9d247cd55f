"""Streams, an extension: bursts of events by tumbling window, and first findings within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, least: int = 5, window: str = "10 seconds", late: str = "1 minute", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, window_start, n) of the windows in which a user has at least `least` events; works on batches and streams."""
    counted = events.withWatermark(ts, late).groupBy(F.col(user), F.window(ts, window)).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least).select(user, F.col("window.start").alias("window_start"), "n")


def first_findings(findings: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One finding per file, line, rule and endpoint within the watermark."""
    return findings.withWatermark(ts, late).dropDuplicatesWithinWatermark(["file_path", "line_number", "rule_id", "endpoint"])
