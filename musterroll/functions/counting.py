"""Turning a count into that many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def numbered_rows(
    df: DataFrame, key: list[str], count: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Each row ``count`` times with ``out`` = 0..count-1; none if the count is below one.

    ``key`` is unique per row. Large counts expand in two steps, so no array holds more
    than a block. In between, the few block rows are shuffled on key and block: one row
    that stands for a large share of the output is expanded by many tasks. Their number
    is given, since adaptive execution would judge by the size before the expansion.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.floor((F.col("_count") - 1) / block)
    size = F.least(F.lit(block), F.col("_count") - F.col("_block") * block)
    starts = (
        df.withColumn("_count", count.cast("long"))
        .where(F.col("_count") > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
    )
    return (
        starts.repartition(tasks, *key, "_block")
        .withColumn("_in_block", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
        .withColumn(out, F.col("_block") * block + F.col("_in_block"))
        .drop("_count", "_block", "_in_block")
    )
