"""Ranks and running sums over a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def ordered(df: DataFrame, order: list[Column], rank: str, **sums: str) -> DataFrame:
    """df with its rank (from 1) in a global order and running sums of columns: name of the sum = column.

    Rows are dealt to ranges of the order, the ranges' counts are added up (one row for each range, as
    many as shuffle partitions at most) and a window runs inside each range, so no task holds all.
    """
    ranges = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("__range").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    totals = totals.select("__range", *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in ("n", *sums)))
    inside = Window.partitionBy("__range").orderBy(*order)
    out = ranges.withColumn("__at", F.row_number().over(inside))
    for k, c in sums.items():
        out = out.withColumn(k, F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(totals), "__range")
    return out.select(*df.columns, (F.col("__at") + F.col("__n")).alias(rank), *((F.col(k) + F.col(f"__{k}")).alias(k) for k in sums))
