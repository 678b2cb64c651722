"""Which token sets of a block have a similar one earlier in order?  Decided by elimination, without a list of pairs.

Sets of Jaccard similarity above ``t`` share a word among the first few of each, rarest words first.  Per block and such
a word, undecided sets are compared with a few of the earlier ones, first of all with the earliest: where many sets are
variants of one, nearly all are decided at once and leave.  What is left meets ever larger random parts of its bucket, each
eight times the one before, until it is decided or has met all.  Signatures travel in place of the sets, which are
fetched for the pairs that pass ``fits``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremorline.functions.text import jaccard
from tremorline.operators.similarity import enough_left, enough_shared, prefix, signature
from tremorline.session import cut_lineage

#: Members of a bucket met in the first round, besides the earliest, and growth from round to round.
FIRST, GROWTH = 2, 8


def _compared(undecided: DataFrame, part: DataFrame, by: list[str], fits: Column) -> DataFrame:
    return undecided.join(part, by).where(fits)


def decided_by_earlier(asked: DataFrame, members: DataFrame, by: list[str], sets: DataFrame, fits: Column, similar: Column
                       ) -> DataFrame:
    """The rows of ``asked`` that have an earlier member in one of their buckets that fits and is similar: distinct ``k``.

    Both inputs: ``k``, the bucket columns ``by``, ``position`` (earlier is less) and further columns; a row may be in
    several buckets.  ``sets``: ``k, ordered`` of both.  ``fits`` and ``similar`` see the member's columns as ``e_...``;
    ``fits`` is the cheaper test and sees ``sign`` (``similarity.signature``), ``similar`` sees ``ordered`` and no column
    of the bucket nor ``at``, ``size``.
    """
    sizes = members.groupBy(*by).agg(F.count("*").alias("n"), F.min("position").alias("head"))
    # a bucket whose earliest member is no earlier decides nothing
    undecided = cut_lineage(asked.join(sizes, by).where(F.col("head") < F.col("position")))
    if undecided.isEmpty():
        return undecided.select("k")
    drawn = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n")
    signs = cut_lineage(sets.select("k", signature(F.col("ordered")).alias("sign")))
    met = members.join(undecided.select(*by, "n", "head").distinct(), by).withColumn("drawn", drawn).join(signs, "k")
    own = [c for c in met.columns if c not in (*by, "n", "head", "drawn")]
    met = cut_lineage(met.withColumnsRenamed({c: f"e_{c}" for c in own}))
    undecided = cut_lineage(undecided.drop("head").join(signs, "k"))
    local = ["at", "size", "sign"]
    others = sets.select(F.col("k").alias("e_k"), F.col("ordered").alias("e_ordered"))
    found, low, high = undecided.select("k").limit(0), 0, FIRST
    while not undecided.isEmpty():
        part = (F.col("drawn") >= low) & (F.col("drawn") < high)
        part = met.where(part if low else part | (F.col("head") == F.col("e_position")))
        pairs = _compared(undecided.drop("n"), part.drop("n", "head", "drawn"), by, (F.col("e_position") < F.col("position")) & fits)
        pairs = cut_lineage(pairs.drop(*by, *local, *[f"e_{c}" for c in local]).distinct())
        hits = cut_lineage(pairs.join(sets, "k").join(others, "e_k").where(similar).select("k").distinct())
        found = found.unionByName(hits)
        undecided = cut_lineage(undecided.where(F.col("n") > high).join(hits, "k", "left_anti"))
        low, high = high, high * GROWTH
    return found


def with_earlier(rows: DataFrame, bucket: list[str], threshold: float, reach: tuple[str, int] | None = None) -> DataFrame:
    """The rows that have an earlier one of similarity above ``threshold`` in their bucket: distinct values of ``k``.

    ``rows``: ``k`` (unique), the ``bucket`` columns, ``position`` (earlier is less), ``ordered`` (tokens, not empty, in an
    order common to the bucket).  With ``reach = (column, distance)`` the two may differ by at most ``distance`` in that
    column, and buckets are further split by it.
    """
    worded = rows.select("k", *bucket, "position", *([reach[0]] if reach else []), F.size("ordered").alias("size"),
                         F.posexplode(prefix(F.col("ordered"), threshold)).alias("at", "word"))
    by, asked = [*bucket, "word"], worded
    fits = (enough_left(threshold, F.col("at"), F.col("size"), F.col("e_at"), F.col("e_size"))
            & enough_shared(threshold, "sign", F.col("size"), "e_sign", F.col("e_size")))
    if reach:
        by.append("slot")
        slot = F.floor(F.col(reach[0]) / F.lit(reach[1]))
        worded = worded.withColumn("slot", slot)
        asked = asked.withColumn("slot", F.explode(F.array(slot, slot - 1, slot + 1)))
        fits = fits & (F.abs(F.col(reach[0]) - F.col(f"e_{reach[0]}")) <= reach[1])
    similar = jaccard(F.col("ordered"), F.col("e_ordered")) > F.lit(threshold)
    return decided_by_earlier(asked, worded, by, rows.select("k", "ordered"), fits, similar)
