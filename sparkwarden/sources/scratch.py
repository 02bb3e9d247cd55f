"""Tables that a job keeps between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; with a local master (one machine, as in tests) a folder of our own if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparkwarden-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table: computed once, with no lineage before it, whole when executors are lost."""
    path = f"{folder(df.sparkSession)}/sparkwarden/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "pos") -> tuple[DataFrame, int]:
    """df with the place of each row from 0 in the order of these columns, as a stored table, and how many rows it has.

    Rows are dealt by ranges, so a column's value that very many rows share fills one task only if all of `order` is equal
    in them: rows should be distinct there. One number for each task reaches the driver.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect())
    ends = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    before = df.sparkSession.createDataFrame([(p, e) for (p, _), e in zip(sizes, ends, strict=False)], "_part int, _before long")
    return dealt.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias(name)), ends[-1]
