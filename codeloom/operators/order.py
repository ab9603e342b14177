"""A global order without one task that sorts all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.shared import kept


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows with their place (from 1) in a global order: dealt by ranges and sorted within them; what stands before a range
    is a sum over one row for each partition."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = kept(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__n", F.monotonically_increasing_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"), F.min("__n").alias("first"))
    before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")
    starts = counts.select("__part", (before - F.col("first") + 1).alias("shift"))
    return dealt.join(F.broadcast(starts), "__part").select(*rows.columns, (F.col("__n") + F.col("shift")).alias(name))
