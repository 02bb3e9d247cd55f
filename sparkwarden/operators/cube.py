"""Counts by every combination of some columns, kept delivery by delivery.

A delivery (a day's rows, say) is counted once, by all columns together, and stored: an exact count, a sketch of distinct
values and a sketch of a measure's quantiles. Any number of deliveries is then rolled up from these small rows, into all
grouping sets at once; nothing that was counted is read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct-count sketch: its standard error is 1.04 / sqrt(2 ** LG_K), 1.6 % here.
LG_K = 12
#: Size of a quantile sketch: its rank error is about 1.33 % with 99 % confidence.
KLL_K = 200


def deliveries(rows: DataFrame, part: str, dims: list[str], distinct: str, measure: str) -> DataFrame:
    """(part, dims, n, values, sizes) for each part and combination of dims that rows have: to be stored, and appended to.

    Null dims are values of their own; null distinct values and measures are counted in n alone. Counts and sketches are made in
    the map tasks, so a combination that a third of the rows share moves as one row a task. Empty tables give no rows.
    """
    return rows.groupBy(part, *dims).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("values"), F.kll_sketch_agg_bigint(F.col(measure).cast("long"), F.lit(KLL_K)).alias("sizes"))


def cube(stored: DataFrame, dims: list[str], quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(level, dims, n, distinct_values, quantiles) of every grouping set of dims over stored deliveries.

    level: the bits of the dims that are summed over (the first is the highest), which tells a null value from a sum. n is
    exact; distinct_values is within 5 % in all but three of a thousand cases, and each quantile's rank within 1.33 points
    in 99 of a hundred; a quantile is null where nothing was measured. Deliveries are merged in any order.
    """
    found = stored.cube(*dims).agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"), F.hll_union_agg("values", F.lit(True)).alias("v"), F.kll_merge_agg_bigint("sizes").alias("s"))
    at = F.when(F.kll_sketch_get_n_bigint("s") > 0, F.kll_sketch_get_quantile_bigint("s", F.array(*map(F.lit, quantiles))))
    return found.select("level", *dims, "n", F.hll_sketch_estimate("v").alias("distinct_values"), at.alias("quantiles"))
