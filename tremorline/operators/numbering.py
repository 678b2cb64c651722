"""Running numbers without a sort in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorline.session import cut_lineage


def numbered(rows: DataFrame, order: list[Column], name: str, first: int) -> DataFrame:
    """Number rows from ``first`` on, in ``order``, or as they lie when there is none.

    Sorting is a range sort and rows are numbered where they are; the only thing put in one place is a count per
    partition.
    """
    rows = rows.orderBy(*order) if order else rows
    marked = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    parts = marked.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n"), F.min("_at").alias("_start"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_skip"))
    number = F.col("_skip") + F.col("_at") - F.col("_start") + F.lit(first)
    return (marked.withColumn("_part", F.shiftright("_at", 33)).join(parts, "_part").withColumn(name, number)
            .drop("_at", "_part", "_start", "_skip"))
