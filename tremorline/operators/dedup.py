"""Exact de-duplication and union-by-key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremorline.session import cut_lineage


def first_of_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; rows whose key is null or empty all stay.

    The first place of each key is found by an aggregate over key and order alone, so copies of a key collapse before the
    shuffle; whole rows are only filtered, by a join that Spark may split.
    """
    keyed = F.coalesce(F.length(key) > 0, F.lit(False)) if dict(df.dtypes)[key] == "string" else F.col(key).isNotNull()
    rows = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))  # ties in order go to the row that lies first
    first = rows.filter(keyed).groupBy(key).agg(F.min(F.struct(*order, "_at")).alias("_first")).select("_first._at")
    return rows.filter(keyed).join(first, "_at", "left_semi").unionByName(rows.filter(~keyed)).select(*df.columns)


def unseen(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key is not stored.  A null or empty key is never a duplicate."""
    known = stored.select(*keys).filter(" and ".join(f"{k} is not null" for k in keys))
    for k, kind in known.dtypes:
        if kind == "string":
            known = known.filter(F.length(k) > 0)
    return batch.join(known, keys, "left_anti")


def exact_dedup(batch: DataFrame, stored: DataFrame, order: list[str], key: str = "source_id") -> DataFrame:
    """New rows of a batch: not stored yet, and the first of their key within the batch."""
    return first_of_key(unseen(batch, stored, [key]), key, order)


def merge_page(loaded: DataFrame, page: DataFrame, key: str = "id") -> DataFrame:
    """Rows already loaded, plus those of the next page whose key is new."""
    return loaded.unionByName(page.join(loaded.select(key), key, "left_anti"))
