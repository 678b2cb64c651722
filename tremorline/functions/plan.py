"""Helpers that shape plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters use.

    A filter on an ordinary column is pushed below the projection that defines it, and its expression is evaluated
    again there (several times over when it is used several times).  Passing the value through a generator of one
    row keeps such filters above it.
    """
    return (df.withColumn("_value", value).withColumn(name, F.explode_outer(F.array("_value")))
            .drop("_value"))
