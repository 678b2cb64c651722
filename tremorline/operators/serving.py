"""Read queries over incidents, hotspots, sources and runs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import coded_cell, explode_cells, haversine_miles
from tremorline.functions.text import plural
from tremorline.functions.timefn import instant, is_stale


def active(events: DataFrame) -> DataFrame:
    return events.filter("is_active")


def quality_gate(events: DataFrame) -> DataFrame:
    """Drop coded events that only one source reports."""
    return events.filter(~F.coalesce((F.col("source_name") == C.CODED_FEED) & (F.col("source_count") < 2),
                                     F.lit(False)))


def feed_filter(events: DataFrame, types: Sequence[str] = (), min_severity: float = 0.0,
                min_confidence: float = 0.0, trends: Sequence[str] = ()) -> DataFrame:
    """Feed view; an empty list of types or trends means all."""
    out = quality_gate(events).filter((F.col("severity_score") >= F.lit(float(min_severity)))
                                      & (F.col("confidence_score") >= F.lit(float(min_confidence))))
    if types:
        out = out.filter(F.col("event_type").isin(list(types)))
    if trends:
        out = out.filter(F.col("trend_state").isin(list(trends)))
    return out


def type_facets(events: DataFrame, min_severity: float = 0.0, min_confidence: float = 0.0,
                trends: Sequence[str] = ()) -> DataFrame:
    """Events per type under every filter but the type filter."""
    return (feed_filter(events, (), min_severity, min_confidence, trends)
            .groupBy("event_type").agg(F.count("*").alias("event_count")))


def trend_filter(hotspots: DataFrame, trends: Sequence[str]) -> DataFrame:
    return hotspots.filter(F.col("trend_state").isin(list(trends))) if trends else hotspots


def by_id(df: DataFrame, key: int) -> DataFrame:
    """The row with this id; raises ``LookupError`` when there is none."""
    found = df.filter(F.col("id") == key)
    if found.isEmpty():
        raise LookupError(f"no row with id {key}")
    return found


def still_selected(selected: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """Snapshot rows for the selected keys that still exist."""
    return snapshot.join(selected.select(key), key, "left_semi")


def list_events(events: DataFrame, limit: int = 500, offset: int = 0, most_offset: int = 100_000) -> DataFrame:
    """A page of active incidents, newest first.

    Every task keeps ``offset + limit`` rows, so the offset is bounded; ``list_events_after`` serves deeper pages.
    """
    if not 0 <= limit <= 1000:
        raise ValueError("limit must be between 0 and 1000")
    if not 0 <= offset <= most_offset:
        raise ValueError(f"offset must be between 0 and {most_offset}; deeper pages: list_events_after")
    return active(events).orderBy(F.desc("occurred_at"), "id").offset(offset).limit(limit)


def list_events_after(events: DataFrame, occurred_at: datetime | str | Column, last_id: int,
                      limit: int = 500) -> DataFrame:
    """The page that follows a given row.  The filter reaches the scan, so deep pages cost what the first one does."""
    ts = instant(occurred_at)
    behind = (F.col("occurred_at") < ts) | ((F.col("occurred_at") == ts) & (F.col("id") > last_id))
    return list_events(events.filter(behind), limit)


def page_total(events: DataFrame, limit: int = 500, offset: int = 0) -> DataFrame:
    """Size of the result a page is cut from, and whether more follows."""
    total = F.count("*")
    shown = F.greatest(F.lit(0), F.least(F.lit(limit), total - offset))
    return active(events).agg(total.alias("total"), F.lit(limit).cast("long").alias("limit"),
                              F.lit(offset).cast("long").alias("offset"), (offset + shown < total).alias("has_more"))


def list_hotspots(hotspots: DataFrame) -> DataFrame:
    return hotspots.orderBy(F.desc("priority_score"), "id")


def priorities(hotspots: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` hotspots of highest priority, ranked."""
    order = [F.desc("priority_score"), "id"]
    return hotspots.orderBy(*order).limit(n).withColumn(
        "rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def hotspot_members(hotspots: DataFrame, events: DataFrame) -> DataFrame:
    """One row per hotspot and active member; hotspots without members keep one row of nulls."""
    members = active(events).withColumnRenamed("id", "event_id").drop("trend_state").withColumnsRenamed(
        {c: f"event_{c}" for c in ("severity_score", "confidence_score", "name") if c in events.columns})
    return hotspots.join(members, hotspots["id"] == members["cluster_id"], "left").drop("cluster_id")


def top_members(events: DataFrame, n: int = 8, by: str = "cluster_id") -> DataFrame:
    """The ``n`` most severe active members per cluster.

    Ranking filters early within each task (window group limit), so a huge cluster ships ``n`` rows per task.
    """
    order = Window.partitionBy(by).orderBy(F.desc("severity_score"), "id")
    return (active(events).filter(F.col(by).isNotNull()).withColumn("position", F.row_number().over(order))
            .filter(F.col("position") <= n).withColumn("position", F.col("position").cast("long")))


def sources_ordered(sources: DataFrame) -> DataFrame:
    """Sources by incident, most recently published first, marked independent or syndicated."""
    label = F.when(F.col("source_trust_weight") == 0, F.lit("syndicated")).otherwise(F.lit("independent"))
    return sources.withColumn("label", label).orderBy(
        "event_id", F.desc_nulls_last("source_published_at"), "source_record_id")


def independent_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("source_trust_weight") > 0)


def independent_count(sources: DataFrame) -> DataFrame:
    return sources.groupBy("event_id").agg(F.count_if(F.col("source_trust_weight") > 0).alias("independent"))


def event_with_sources(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Incidents with their sources, one row per source, most recently published first.

    Rows stay flat: an incident with very many sources is spread by the range sort instead of becoming one value.
    Incidents without sources keep one row.
    """
    mine = sources.select(F.col("event_id").alias("id"), "source_record_id",
                          F.col("source_name").alias("outlet"), "source_published_at", "source_trust_weight")
    return events.join(mine, "id", "left").orderBy("id", F.desc_nulls_last("source_published_at"), "source_record_id")


def dominant_type(members: DataFrame, by: str) -> DataFrame:
    """Most frequent type per group; on a tie the type of the most severe member."""
    per_type = members.groupBy(by, "event_type").agg(
        F.count("*").alias("n"), F.min(F.struct((-F.col("severity_score")).alias("s"), "id")).alias("first"))
    return per_type.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "event_type"))["event_type"]
                                    .alias("dominant_type"))


def imprecise_count(members: DataFrame, by: str) -> DataFrame:
    return members.groupBy(by).agg(
        F.count_if(F.col("location_precision").isin("state", "country")).alias("imprecise"),
        F.count("*").alias("members"))


def hotspot_summary(hotspots: DataFrame, members: DataFrame, by: str = "hotspot_id") -> DataFrame:
    """``id, summary``: one sentence per hotspot, with its dominant type and a note on imprecise members."""
    facts = dominant_type(members, by).join(imprecise_count(members, by), by).withColumnRenamed(by, "id")
    trend, severity = F.lit(C.TREND_WORD_OTHERWISE), F.lit(C.SEVERITY_WORD_OTHERWISE)
    for state, word in C.TREND_WORDS.items():
        trend = F.when(F.col("trend_state") == state, F.lit(word)).otherwise(trend)
    for least, word in reversed(C.SEVERITY_WORDS):  # the highest threshold is asked first
        severity = F.when(F.col("severity_score") >= F.lit(least), F.lit(word)).otherwise(severity)
    head = F.concat(trend, F.lit(" "), severity, F.lit(C.SUMMARY_CLUSTER), plural(F.col("event_count"), "event"),
                    F.lit(C.SUMMARY_PRIORITY),
                    F.floor(F.col("priority_score") * F.lit(100.0) + F.lit(0.5)).cast("string"), F.lit("."))
    kind = F.coalesce(F.concat(F.lit(C.SUMMARY_TYPE), F.col("dominant_type"), F.lit(".")), F.lit(""))
    n, all_members = F.coalesce("imprecise", F.lit(0)), F.coalesce("members", F.lit(0))
    note = (F.when((n > 0) & (n == all_members), F.lit(C.SUMMARY_ALL_IMPRECISE))
            .when(n > 0, F.concat(F.lit(" "), plural(n, "event"), F.lit(C.SUMMARY_SOME_IMPRECISE)))
            .otherwise(F.lit("")))
    return hotspots.join(facts, "id", "left").select("id", F.concat(head, kind, note).alias("summary"))


def latest_run(runs: DataFrame, source: str) -> DataFrame:
    return runs.filter(F.col("ingest_source") == source).orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def latest_success(runs: DataFrame, source: str) -> DataFrame:
    """``last_success_at``: finish time of the last successful run of a source, null when there is none."""
    return runs.filter((F.col("ingest_source") == source) & (F.col("status") == "success")).agg(
        F.max("finished_at").alias("last_success_at"))


def system_status(events: DataFrame, hotspots: DataFrame, runs: DataFrame, source: str,
                  now: datetime | str | Column, interval_seconds: int = C.POLL_SECONDS) -> DataFrame:
    """One row on freshness: each table is reduced to one row, and the rows are put side by side."""
    of_events = events.agg(F.max("ingested_at").alias("last_ingested_at"),
                           F.count_if("is_active").alias("event_count"))
    of_hotspots = hotspots.agg(F.max("last_computed_at").alias("last_computed_at"),
                               F.count("*").alias("hotspot_count"))
    mine = runs.filter(F.col("ingest_source") == source)
    last = F.max_by(F.struct("started_at", "status", "error_message"), F.struct("started_at", "id"))
    of_runs = mine.agg(last.alias("r"), F.max(F.when(F.col("status") == "success", F.col("finished_at")))
                       .alias("last_success_at"))
    one = F.lit(1).alias("one")
    wide = (of_events.select("*", one).join(of_hotspots.select("*", one), "one")
            .join(of_runs.select("*", one), "one").drop("one"))
    return wide.select(
        "last_ingested_at", "last_computed_at", "event_count", "hotspot_count",
        is_stale(F.col("last_success_at"), now, interval_seconds).alias("is_stale"),
        F.col("r.started_at").alias("last_run_at"), "last_success_at", F.col("r.status").alias("last_run_status"),
        F.when(F.col("r.status") == "failed", F.col("r.error_message")).alias("last_error"),
        instant(now).alias("generated_at"))


def nearest_centre(events: DataFrame, centres: DataFrame, radius: float = C.CLUSTER_MILES) -> DataFrame:
    """The nearest of ``centres`` (``centre_id, centre_lat, centre_lon``) within ``radius`` for each event.

    Centres are copied to the cells of the globe they reach, so only events in their surroundings meet them.
    """
    size = 2.0 * radius
    near = explode_cells(centres.select("centre_id", "centre_lat", "centre_lon"), "centre_lat", "centre_lon", size,
                         radius)
    met = events.select("id", "latitude", "longitude",
                        coded_cell(F.col("latitude"), F.col("longitude"), size).alias("cell")).join(near, "cell")
    distance = haversine_miles(F.col("latitude"), F.col("longitude"), F.col("centre_lat"), F.col("centre_lon"))
    best = (met.select("id", distance.alias("miles"), "centre_id").filter(F.col("miles") <= F.lit(float(radius)))
            .groupBy("id").agg(F.min(F.struct("miles", "centre_id")).alias("c")))
    return best.select("id", "c.centre_id", "c.miles")
