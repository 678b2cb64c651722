"""What a source is: a function that returns rows of the ``NEW_EVENT`` schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tremorline.schemas import NEW_EVENT, assert_schema

Source = Callable[[SparkSession], DataFrame]


def fetch(spark: SparkSession, source: Source) -> DataFrame:
    """Run a source and hold it to the contract."""
    return assert_schema(source(spark), NEW_EVENT).select(NEW_EVENT.fieldNames())
