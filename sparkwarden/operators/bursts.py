"""Bursts of a user's events in windows that begin at any event.

A window of length `within` begins at each event; it counts if it holds `least` events, and windows that share an event are
one burst. Time is cut into blocks of several windows; a block also sees the events of one window after it, so every window is
counted whole in the block that it begins in, and a user with a third of all events is many tasks. Bursts that end within
their block are done; only those that reach over its end, and those near its start, meet once more per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows in a block.
WINDOWS = 8


def _merged(spans: DataFrame, *group: str) -> DataFrame:
    """(group, start, end) of the unions of spans that share a moment."""
    before = F.max("end").over(Window.partitionBy(*group).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    island = F.sum("_new").over(Window.partitionBy(*group).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_new", new).withColumn("_island", island).groupBy(*group, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _block(t: Column, size: int) -> Column:
    return F.floor(t / F.lit(size)).cast("long")


def any_window_bursts(events: DataFrame, within: int, least: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user, start, end, n) of the maximal bursts: all n events of the user from start to end lie in windows of `within`
    seconds (both ends included) that hold at least `least` events, and no further event does.

    Null users are one user, events without a time have no window; events at one moment are counted each, but travel as one
    row, and so do repeated rows. Other columns are not read; an empty table has no bursts.
    """
    span = within * 1_000_000
    size = WINDOWS * span
    each = events.where(F.col(ts).isNotNull()).groupBy(F.col(user).alias("user"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).agg(F.count("*").alias("n"))
    each = each.withColumn("block", _block(F.col("t"), size))
    seen = F.when(F.col("t") - F.col("block") * size <= span, F.array("block", F.col("block") - 1)).otherwise(F.array("block"))
    rows = each.withColumn("at", F.explode(seen))
    ahead = Window.partitionBy("user", "at").orderBy("t").rangeBetween(0, span)
    rows = rows.withColumn("held", F.sum("n").over(ahead)).withColumn("end", F.max("t").over(ahead)).where((F.col("at") == F.col("block")) & (F.col("held") >= least))
    spans = _merged(rows.select("user", "at", F.col("t").alias("start"), "end"), "user", "at")
    # windows begin in their block, so a burst can share an event with one of another block only over an edge
    edge = (F.col("end") >= (F.col("at") + 1) * size) | (F.col("start") - F.col("at") * size <= span)
    spans = spans.withColumn("edge", edge)
    found = spans.where("not edge").select("user", "start", "end").unionByName(_merged(spans.where("edge").select("user", "start", "end"), "user"))
    # how many events: bursts and moments meet in stretches of one window, of which a burst has few that others have too
    parts = found.withColumn("part", F.explode(F.sequence(_block(F.col("start"), span), _block(F.col("end"), span))))
    moments = each.select(F.col("user").alias("of"), "t", "n", _block(F.col("t"), span).alias("piece"))
    both = parts.join(moments, parts["user"].eqNullSafe(moments["of"]) & (F.col("part") == F.col("piece")) & F.col("t").between(F.col("start"), F.col("end")))
    counted = both.groupBy("user", "start", "end").agg(F.sum("n").alias("n"))
    return counted.select(F.col("user").alias(user), F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "n")
