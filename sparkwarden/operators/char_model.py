"""How unlike prose a string is: bits per character under pairs of characters counted in a corpus.

Shannon's entropy of a string only sees how its own characters repeat; a long word and a random key of its length look alike.
The model knows which characters follow which in the given texts, so letters in no language's order cost more bits. Pairs are
counted by Spark, combined in the map tasks; the model is one array of fixed size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Printable ASCII characters, and one symbol for all others.
SYMBOLS, FIRST = 96, 32
SMOOTH = 0.5


def _symbol(byte: Column) -> Column:
    return F.when(byte.between(FIRST, FIRST + SYMBOLS - 2), byte - FIRST).otherwise(SYMBOLS - 1)


def pair_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(a, b, n): how often symbol b follows symbol a in the texts' bytes; at most SYMBOLS squared rows, texts of one byte and null ones add none."""
    data = F.col(text).cast("binary")
    pairs = texts.where(F.octet_length(text) > 1).select(data.alias("d"), F.explode(F.sequence(F.lit(1), F.octet_length(text) - 1)).alias("k"))
    pair = F.conv(F.hex(F.substring("d", F.col("k"), F.lit(2))), 16, 10).cast("int")
    raw = pairs.select(pair.alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return raw.select(_symbol(F.shiftright("p", 8)).alias("a"), _symbol(F.col("p").bitwiseAND(F.lit(255))).alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))


def model(texts: DataFrame, text: str = "text") -> np.ndarray:
    """Bits of each symbol after each other one: row a, column b. Without texts all cost the same."""
    counts = np.zeros((SYMBOLS, SYMBOLS))
    for r in pair_counts(texts, text).collect():
        counts[r.a, r.b] = r.n
    return -np.log2((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * SYMBOLS))


def bits(token: Column, costs: np.ndarray) -> Column:
    """Mean bits of a token's characters after the first, under a model(); 0 for shorter ones, null for null."""
    table = F.split(F.lit(",".join(f"{x:.9f}" for x in costs.ravel())), ",").cast("array<double>")  # a literal: made once
    symbols = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: _symbol(F.ascii(c)))
    n = F.size(symbols)
    cost = lambda k: F.get(table, F.get(symbols, k - 1) * SYMBOLS + F.get(symbols, k))
    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda acc, k: acc + cost(k))
    return F.when(token.isNull(), None).when(n > 1, total / (n - 1)).otherwise(0.0)
