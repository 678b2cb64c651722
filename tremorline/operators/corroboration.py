"""Provenance rows, and the confidence incidents gain from independent sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tremorline.functions import constants as C
from tremorline.functions.scores import corroboration_uplift
from tremorline.functions.timefn import instant
from tremorline.schemas import EVENT_SOURCE, conform


def provenance_rows(judged: DataFrame, now: datetime | str | Column) -> DataFrame:
    """Rows for the ``event_sources`` table: weight 0 for syndicated copies, 1 otherwise."""
    rows = judged.withColumns({
        "source_type": F.lit(C.ARTICLE_FEED),
        "source_trust_weight": F.when(F.col("is_syndicated"), F.lit(0.0)).otherwise(F.lit(1.0)),
        "created_at": instant(now),
    })
    return conform(rows, EVENT_SOURCE)


def corroboration_counts(sources: DataFrame) -> DataFrame:
    """Independent and syndicated sources per incident."""
    return sources.groupBy("event_id").agg(
        F.count_if(F.col("source_trust_weight") > 0).alias("independent"),
        F.count_if(F.col("source_trust_weight") == 0).alias("syndicated"))


def apply_corroboration(events: DataFrame, counts: DataFrame, step: float = C.CORROBORATION_UPLIFT) -> DataFrame:
    """Events with source count and confidence raised by their independent sources.

    One uplift per source, rounded each time, equals one uplift by ``n`` steps; so nothing has to be updated in
    place and the result can be derived whenever it is read.
    """
    n = F.coalesce(F.col("_n"), F.lit(0))
    joined = events.join(counts.select(F.col("event_id").alias("id"), F.col("independent").alias("_n")), "id", "left")
    return joined.withColumns({
        "source_count": (F.coalesce("source_count", F.lit(1)) + n).cast(dict(events.dtypes)["source_count"]),
        "confidence_score": corroboration_uplift(F.col("confidence_score"), n, step),
    }).select(*events.columns)
