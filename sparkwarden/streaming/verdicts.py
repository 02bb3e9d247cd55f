"""A verdict for each key of a stream of findings, kept up to date: what changes it comes out, quiet keys are forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkwarden.operators.findings import SEVERITIES

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "verdict string, max_rank int, findings long, at timestamp, forgotten boolean"


def word(rank: int | None, threshold: int) -> str:
    """BLOCK from the threshold on, WARN one below it, else PASS."""
    return "PASS" if rank is None or rank < threshold - 1 else "WARN" if rank == threshold - 1 else "BLOCK"


class Verdicts(StatefulProcessor):
    """State of a key: its worst severity, how many findings, the time of its latest, and when it will have been quiet for long enough."""

    def __init__(self, threshold: int, quiet_ms: int):
        self.threshold, self.quiet_ms = threshold, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "max_rank int, findings long, latest_ms long, timer_ms long")

    def _row(self, key, rank, n, at_ms, forgotten) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "verdict": [word(rank, self.threshold)], "max_rank": [rank], "findings": [n], "at": [pd.Timestamp(at_ms, unit="ms")], "forgotten": [forgotten]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.seen.get()
        worst, n, latest, timer = had if had else (None, 0, None, None)
        before = word(worst, self.threshold) if had else None
        for part in rows:
            n += len(part)
            ranks = part["rank"].dropna()
            if len(ranks):
                worst = int(ranks.max()) if worst is None else max(worst, int(ranks.max()))
            at = int(part["at"].max().value // 1_000_000)
            latest = at if latest is None else max(latest, at)
        due = latest + self.quiet_ms
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.seen.update((worst, n, latest, due))
        if word(worst, self.threshold) != before:
            yield self._row(key, worst, n, latest, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        worst, n, latest, _ = self.seen.get()
        self.seen.clear()
        yield self._row(key, worst, n, latest, True)

    def close(self) -> None:
        pass


def running_verdicts(findings: DataFrame, key: str, ts: str, threshold: str = "MEDIUM", quiet: str = "30 days", late: str = "1 day") -> DataFrame:
    """(key, verdict, max_rank, findings, at, forgotten) whenever the verdict of a key changes, from findings (key, ts, severity).

    The first row of a key is a change too. A verdict only gets worse as rows come, in whatever order, so the last row of each
    key is the batch's verdict. `forgotten`: no row came for `quiet` of event time; the row repeats the verdict, with all
    findings counted, and the key starts anew after it. Rows more than `late` behind the latest time seen in earlier batches
    are not looked at. Unknown and null severities count as findings of none; rows without a time are left out, a null key
    is a key. Works on streams (state in RocksDB) and on tables, where no row is late and quiet keys are told at the end.
    """
    ranks = F.coalesce(*[F.when(F.upper("severity") == s, F.lit(k)) for k, s in enumerate(SEVERITIES)])
    rows = findings.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("at"), ranks.alias("rank")).withWatermark("at", late)
    quiet_ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, {OUTPUT}"
    out = rows.groupBy("key").transformWithStateInPandas(Verdicts(SEVERITIES.index(threshold), quiet_ms), schema, "Update", "EventTime")
    return out.withColumnRenamed("key", key)


def run_to_end(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over all that its source has now, and returns what it put out with batch_id; folder: a shared one of its own."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    spark.createDataFrame([], stream.withColumn("batch_id", F.lit(0).cast("long")).schema).write.mode("append").parquet(f"{folder}/{name}")

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(f"{folder}/{name}")

    try:
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/{name}")
