"""Lines of texts that are too long for one task: a text comes as ranges, and each is numbered where it lies.

What a range holds is counted first: how many lines end in it, and whether it begins or ends within a pair of break
characters. These few bytes a range are summed up in order; each range then knows the number of its first line. A line that
goes over edges is in several ranges, and its pieces meet under its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.functions.text import LINE_BREAK


def ranges(texts: DataFrame, key: str, text: str, size: int, *order: str) -> DataFrame:
    """(key, order, part, chunk): the texts cut into ranges of `size` characters, for sources that hold whole texts."""
    parts = F.explode(F.sequence(F.lit(0), F.floor((F.char_length(text) - 1) / size).cast("int"))).alias("part")
    rows = texts.where(F.col(text) != "").select(key, *order, text, parts)
    return rows.select(key, *order, "part", F.substr(F.col(text), F.col("part") * size + 1, F.lit(size)).alias("chunk"))


def range_lines(chunks: DataFrame, key: str, *order: str, chunk: str = "chunk") -> DataFrame:
    """(key, line_no from 1, n_chars, pieces) of the lines of texts that come as chunks, in the order of the columns `order`.

    Breaks are those of text.lines(): a carriage return and line feed are one, wherever a chunk ends; a break at the end of
    a text starts no further line. pieces: how many chunks have a part of the line. Null and empty chunks add nothing, a text
    without others has no lines; chunks that are equal in `order` are put in an order of their own, the same for all steps, by
    their content. A null key is a key. No task holds more than the chunks it reads; what is put in order is one number a
    chunk, and a line over very many chunks is summed up where they are.
    """
    rows = chunks.select(F.col(key).alias("key"), F.struct(*order, F.xxhash64(chunk).alias("_h")).alias("at"), F.col(chunk).alias("chunk")).where("chunk <> ''")
    ends_cr, starts_lf = F.endswith("chunk", F.lit("\r")), F.startswith("chunk", F.lit("\n"))
    counted = rows.groupBy("key", "at").agg(F.max(F.regexp_count("chunk", F.lit(LINE_BREAK))).alias("breaks"), F.bool_or(ends_cr).alias("cr"), F.bool_or(starts_lf).alias("lf"), F.count("*").alias("copies"))
    in_order = Window.partitionBy("key").orderBy("at")
    joined = F.coalesce(F.col("cr") & F.lead("lf").over(in_order), F.lit(False))
    counted = counted.withColumn("joined", joined)
    each = F.col("breaks") * F.col("copies") - F.col("joined").cast("int")
    before = F.sum(each).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.select(F.col("key").alias("of"), F.col("at").alias("there"), F.coalesce(before, F.lit(0)).alias("before"), "joined", "copies", F.sum(each).over(Window.partitionBy("key")).alias("total"))
    met = rows.dropDuplicates(["key", "at"]).join(placed, F.col("key").eqNullSafe(F.col("of")) & (F.col("at") == F.col("there")))
    whole = F.array_join(F.array_repeat("chunk", F.col("copies").cast("int")), "")
    text = F.when(F.col("joined"), F.substr(whole, F.lit(1), F.char_length(whole) - 1)).otherwise(whole)
    pieces = met.select("key", "before", "total", F.posexplode(F.split(text, LINE_BREAK)).alias("pos", "piece"))
    lines = pieces.groupBy("key", (F.col("before") + F.col("pos") + 1).alias("line_no")).agg(F.sum(F.char_length("piece")).alias("n_chars"), F.count("*").alias("pieces"), F.max("total").alias("total"))
    return lines.where("n_chars > 0 or line_no <= total").select(F.col("key").alias(key), "line_no", "n_chars", "pieces")
