"""Syndicated copies: sources of an incident that repeat an earlier source of the same incident.

Every rule asks whether an earlier source with some property exists, so no rule pairs up rows; URLs and titles are joined
to the verdicts once:

* equal outlet / wire family / wire domain / upstream event: compare with the smallest position of that key, one
  aggregate over narrow rows that collapses before the shuffle;
* similar title, and similar title within 30 minutes: titles collapse to distinct word sets per incident (and time), of
  which later rows are copies anyway; whether a set has a similar one before it is decided by elimination
  (``operators.earlier``), within half hours and their neighbours for the second rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tremorline.functions import constants as C
from tremorline.functions.text import empty_to_null, outlet_family, token_set, url_domain
from tremorline.operators.earlier import with_earlier
from tremorline.operators.similarity import coded_sets, set_key
from tremorline.session import cut_lineage

RULES = ["same_outlet", "same_family", "near_identical_title", "same_wire_domain", "rapid_rewrite",
         "same_upstream_event"]


def _equal_keys(rows: DataFrame) -> DataFrame:
    """``event_id, position, rule`` of sources after the first of their outlet, family, wire domain or upstream event.

    One aggregate over narrow rows serves all four rules.
    """
    keys = {"same_outlet": F.col("outlet"), "same_family": F.col("family"), "same_wire_domain": F.col("domain"),
            "same_upstream_event": F.concat("family", F.lit("\n"), "upstream")}
    entry = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), key.alias("key")) for rule, key in keys.items()]))
    keyed = rows.select("event_id", "position", entry.alias("e")).select("event_id", "position", "e.*").dropna(subset=["key"])
    firsts = keyed.groupBy("event_id", "rule", "key").agg(F.min("position").alias("first"))
    return (keyed.join(firsts, ["event_id", "rule", "key"]).filter(F.col("first") < F.col("position"))
            .select("event_id", "position", "rule"))


def _title_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``event_id, position`` of sources that repeat an earlier title, and of those that do so within half an hour."""
    titled = rows.filter(F.col("set_key").isNotNull())
    sets = titled.groupBy("event_id", "set_key").agg(F.first("tokens").alias("tokens"), F.min("position").alias("first"))
    sets = cut_lineage(sets.withColumn("k", F.monotonically_increasing_id()))
    # a word has a number per incident, so sets of different incidents share none and numbers alone part them
    ordered = coded_sets(sets, "k", ["event_id"]).withColumnRenamed("tokens", "ordered")
    sets = cut_lineage(sets.drop("tokens").join(ordered, "k"))
    found = with_earlier(sets.select("k", F.col("first").alias("position"), "ordered"), [], C.COPY_SIMILARITY)
    judged = sets.join(found.withColumn("early", F.lit(True)), "k", "left")
    same = titled.select("event_id", "set_key", "position").join(judged.select("event_id", "set_key", "first", "early"),
                                                                 ["event_id", "set_key"])
    titles = same.filter(F.col("early") | (F.col("first") < F.col("position"))).select("event_id", "position")

    timed = titled.filter(F.col("micros").isNotNull())
    points = timed.groupBy("event_id", "set_key", "micros").agg(F.min("position").alias("first"))
    points = cut_lineage(points.join(sets.select("event_id", "set_key", "ordered"), ["event_id", "set_key"])
                         .withColumn("k", F.monotonically_increasing_id()))
    found = with_earlier(points.select("k", F.col("first").alias("position"), "micros", "ordered"), [], C.REWRITE_SIMILARITY,
                         ("micros", C.REWRITE_MINUTES * 60_000_000))
    judged = points.join(found.withColumn("early", F.lit(True)), "k", "left")
    same = timed.select("event_id", "set_key", "micros", "position").join(
        judged.select("event_id", "set_key", "micros", "first", "early"), ["event_id", "set_key", "micros"])
    return titles, same.filter(F.col("early") | (F.col("first") < F.col("position"))).select("event_id", "position")


def syndication_rules(sources: DataFrame) -> DataFrame:
    """Add one boolean per rule and ``is_syndicated``.

    ``sources``: ``event_id, position`` (arrival order, unique per incident), ``source_name, source_url,
    source_title, source_published_at, event_uri``.
    """
    keep = sources.columns
    rows = sources.withColumns({
        "outlet": F.lower(empty_to_null(F.col("source_name"))),
        "family": outlet_family(F.col("source_name")),
        "domain": F.when(url_domain(F.col("source_url")).isin(C.WIRE_DOMAINS), url_domain(F.col("source_url"))),
        "upstream": empty_to_null(F.col("event_uri")),
        "tokens": token_set(F.col("source_title")),
        "micros": F.unix_micros("source_published_at"),
    }).withColumn("set_key", set_key(F.col("tokens")))

    # Rows feed every rule; words, families and domains are computed once.
    rows = cut_lineage(rows)
    titles, rewrites = _title_copies(rows)
    hits = (_equal_keys(rows)
            .unionByName(titles.select("event_id", "position", F.lit("near_identical_title").alias("rule")))
            .unionByName(rewrites.select("event_id", "position", F.lit("rapid_rewrite").alias("rule"))))
    found = hits.groupBy("event_id", "position").agg(*[F.bool_or(F.col("rule") == r).alias(r) for r in RULES])
    out = rows.join(found, ["event_id", "position"], "left").select(
        *keep, *[F.coalesce(r, F.lit(False)).alias(r) for r in RULES])
    verdict = F.lit(False)
    for rule in RULES:
        verdict = verdict | F.col(rule)
    return out.withColumn("is_syndicated", verdict)
