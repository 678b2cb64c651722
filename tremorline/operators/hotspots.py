"""Hotspots: candidate clusters, scores, names, and the write-back to incidents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import grid_index, haversine_miles, is_country_level, is_county, lookup
from tremorline.functions.scores import cluster_priority, heat_weight, round3, status_label, trend_state
from tremorline.functions.text import empty_to_null
from tremorline.functions.timefn import age_seconds, hours, instant
from tremorline.operators.anchors import anchor_clusters
from tremorline.operators.clustering import ROWS_PER_TASK, greedy_clusters, state_level_events
from tremorline.session import cut_lineage

MEMBER_COLUMNS = ["id", "city", "state", "latitude", "longitude", "occurred_at", "severity_score",
                  "confidence_score", "event_type", "location_precision"]


def cluster_window(events: DataFrame, now: datetime | str | Column, window_hours: int = C.CLUSTER_HOURS) -> DataFrame:
    """Active incidents of the last 72 hours; incidents dated in the future stay in.

    A table partitioned by ``event_date`` (see ``append_events``) is read from the first day of the window on.
    """
    start = instant(now) - hours(window_hours)
    if "event_date" in events.columns:
        events = events.filter(F.col("event_date") >= F.to_date(start))
    return events.filter(F.col("is_active") & (F.col("occurred_at") >= start))


def state_group_key(state: Column) -> Column:
    return F.coalesce(empty_to_null(state), F.lit("unknown"))


def state_groups(events: DataFrame, min_members: int = C.MIN_MEMBERS) -> DataFrame:
    """Fallback clusters of state-level incidents by state, with at least ``min_members`` members."""
    return (state_level_events(events).groupBy(state_group_key(F.col("state")).alias("state_key"))
            .agg(F.count("*").alias("event_count"), F.avg("latitude").alias("centroid_lat"),
                 F.avg("longitude").alias("centroid_lon"))
            .filter(F.col("event_count") >= min_members))


def cluster_members(events: DataFrame, radius: float = C.CLUSTER_MILES, sequential: bool = False,
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Incidents with the cluster they belong to: ``pass`` 1 is by place, ``pass`` 2 is by state.

    Places cluster around anchors, in parallel rounds.  ``sequential`` takes the rule in order of time instead, which
    gives other clusters where several overlap, and whose run time is bounded by its largest component.
    """
    seeds = greedy_clusters(events, radius, rows_per_task) if sequential else anchor_clusters(events, radius)
    greedy = (events.select(*MEMBER_COLUMNS).join(seeds, "id")
              .withColumn("cluster", F.col("seed").cast("string")).withColumn("pass", F.lit(1)).drop("seed"))
    by_state = (state_level_events(events).select(*MEMBER_COLUMNS)
                .withColumn("cluster", state_group_key(F.col("state"))).withColumn("pass", F.lit(2)))
    return greedy.unionByName(by_state)


def _newest_first() -> Column:
    return F.struct((-F.unix_micros("occurred_at")).alias("newest"), "id")


def rank_candidates(members: DataFrame, min_members: int = C.MIN_MEMBERS, limit: int | None = C.MAX_HOTSPOTS) -> DataFrame:
    """The ``limit`` largest clusters (None: all); on equal size the one that was opened first.  Ids follow that order."""
    candidates = members.groupBy("pass", "cluster").agg(
        F.count("*").alias("event_count"), F.avg("latitude").alias("centroid_lat"),
        F.avg("longitude").alias("centroid_lon"), F.min(_newest_first()).alias("opened"),
    ).filter(F.col("event_count") >= min_members)
    order = [F.desc("event_count"), "pass", "opened"]
    top = candidates if limit is None else candidates.orderBy(*order).limit(limit)
    return top.withColumn("hotspot_id", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("opened")


def cluster_scores(members: DataFrame, by: list[str], now: datetime | str | Column) -> DataFrame:
    """Count, centre, severity, confidence, momentum, priority, trend and status per group, in one aggregate."""
    age = age_seconds(F.col("occurred_at"), now)
    recent, earlier = age < 8 * 3600, (age >= 8 * 3600) & (age < 24 * 3600)
    severity = F.col("severity_score")
    fresh = severity * F.greatest(F.lit(0.0), F.lit(1.0) - age / F.lit(86400.0))
    agg = members.groupBy(*by).agg(
        F.count("*").alias("event_count"), F.avg("latitude").alias("centroid_lat"),
        F.avg("longitude").alias("centroid_lon"),
        round3(F.lit(0.7) * F.max(severity) + F.lit(0.3) * F.avg(severity)).alias("severity_score"),
        round3(F.avg("confidence_score")).alias("confidence_score"),
        round3(F.least(F.lit(1.0), F.sum(fresh) / F.count("*"))).alias("momentum_score"),
        F.count_if(recent).alias("recent_count"), F.count_if(earlier).alias("earlier_count"),
        F.coalesce(F.avg(F.when(recent, severity)), F.lit(0.0)).alias("recent_severity"),
        F.coalesce(F.avg(F.when(earlier, severity)), F.lit(0.0)).alias("earlier_severity"))
    scored = agg.withColumns({
        "priority_score": cluster_priority(F.col("severity_score"), F.col("momentum_score"), F.col("event_count")),
        "trend_state": trend_state(F.col("recent_count"), F.col("earlier_count"), F.col("recent_severity"),
                                   F.col("earlier_severity"))})
    return scored.withColumn("status_label", status_label(F.col("priority_score"), F.col("trend_state")))


def trend_metrics(members: DataFrame, centres: DataFrame, by: str, now: datetime | str | Column) -> DataFrame:
    """Change in count and mean severity between the two trend windows, and distance of the farthest member."""
    base = cluster_scores(members, [by], now)
    spread = members.join(centres.select(by, "centroid_lat", "centroid_lon"), by).groupBy(by).agg(
        F.max(haversine_miles(F.col("latitude"), F.col("longitude"), F.col("centroid_lat"), F.col("centroid_lon")))
        .alias("spread_miles"))
    return base.join(spread, by).select(
        by, (F.col("recent_count") - F.col("earlier_count")).alias("escalation_rate"),
        (F.col("recent_severity") - F.col("earlier_severity")).alias("intensity_delta"), "spread_miles")


def hotspot_names(members: DataFrame, by: str) -> DataFrame:
    """``by, name``.  Members carry ``centroid_lat, centroid_lon`` of their group.

    First choice is the most representative precise city, then county or parish, each with the most frequent state;
    then the most frequent state; then the coordinates.  One aggregate by (group, city, state) feeds all of them.
    """
    city, state = F.col("city"), empty_to_null(F.col("state"))
    named = F.coalesce(F.length(city) > 0, F.lit(False))
    precise = (named & ~city.isin(C.STATE_NAMES) & ~is_country_level(city) & ~is_county(city)
               & ~F.coalesce(city == F.col("state"), F.lit(False)))
    kind = F.when(precise, F.lit(1)).when(named & is_county(city), F.lit(2)).otherwise(F.lit(3))
    distance = haversine_miles(F.col("centroid_lat"), F.col("centroid_lon"), F.col("latitude"), F.col("longitude"))
    grain = members.groupBy(by, kind.alias("kind"), "city", state.alias("state")).agg(
        F.count("*").alias("n"), F.sum(distance).alias("miles"), F.min(_newest_first()).alias("first"),
        F.first("centroid_lat").alias("centroid_lat"), F.first("centroid_lon").alias("centroid_lon"))

    common_state = F.min(F.when(F.col("state").isNotNull(), F.struct((-F.col("n")).alias("n"), "state")))["state"]
    cities = grain.filter("kind < 3").groupBy(by, "kind", "city").agg(
        F.sum("n").alias("total"), F.sum("miles").alias("miles"), F.min("first").alias("first"),
        common_state.alias("city_state"))
    weight = F.col("total") / (F.lit(1.0) + F.col("miles") / F.col("total") / F.lit(50.0))
    best = cities.groupBy(by).agg(F.min(F.struct(
        "kind", (-weight).alias("weight"), "first", "city", "city_state")).alias("c"))
    states = (grain.filter("state is not null").groupBy(by, "state").agg(F.sum("n").alias("n"))
              .groupBy(by).agg(common_state.alias("main_state")))
    centres = grain.groupBy(by).agg(F.first("centroid_lat").alias("lat"), F.first("centroid_lon").alias("lon"))
    full_name = F.coalesce(lookup(F.col("main_state"), C.STATE_DISPLAY_NAME), F.col("main_state"))
    return centres.join(best, by, "left").join(states, by, "left").select(by, F.coalesce(
        F.concat(F.col("c.city"), F.lit(", "), F.col("c.city_state")), F.col("c.city"),
        F.concat(full_name, F.lit(" region")),
        F.format_string("Cluster (%.1f°N, %.1f°W)", F.col("lat"), F.abs("lon"))).alias("name"))


def score_hotspots(members: DataFrame, top: DataFrame, now: datetime | str | Column) -> tuple[DataFrame, DataFrame]:
    """Hotspot rows and hotspot membership (``id, hotspot_id, trend_state``) for ranked candidates.

    Whether ``top`` is broadcast is left to Spark's size check, since its length is a parameter.
    """
    placed = members.join(top.select("pass", "cluster", "hotspot_id", "centroid_lat", "centroid_lon"), ["pass", "cluster"])
    scores = cluster_scores(placed.drop("centroid_lat", "centroid_lon"), ["hotspot_id"], now)
    hotspots = scores.join(hotspot_names(placed, "hotspot_id"), "hotspot_id").select(
        F.col("hotspot_id").alias("id"), "name", "centroid_lat", "centroid_lon", "event_count", "confidence_score",
        "severity_score", "momentum_score", "priority_score", "trend_state", "status_label",
        instant(now).alias("last_computed_at"))
    membership = placed.select("id", "hotspot_id").join(
        hotspots.select(F.col("id").alias("hotspot_id"), "trend_state"), "hotspot_id")
    return hotspots, membership


def compute_hotspots(events: DataFrame, now: datetime | str | Column, radius: float = C.CLUSTER_MILES,
                     min_members: int = C.MIN_MEMBERS, limit: int | None = C.MAX_HOTSPOTS,
                     sequential: bool = False, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """Recompute hotspots at ``now``: hotspot rows, and membership ``id, hotspot_id, trend_state``."""
    members = cut_lineage(cluster_members(cluster_window(events, now), radius, sequential, rows_per_task))
    top = cut_lineage(rank_candidates(members, min_members, limit))
    return score_hotspots(members, top, now)


def assign_clusters(events: DataFrame, membership: DataFrame) -> DataFrame:
    """Events with fresh ``cluster_id`` and ``trend_state``: active ones get the new value or null, inactive ones
    keep what they had."""
    new = membership.select("id", F.col("hotspot_id").alias("_cluster"), F.col("trend_state").alias("_trend"))
    return events.join(new, "id", "left").withColumns({
        "cluster_id": F.when(F.col("is_active"), F.col("_cluster")).otherwise(F.col("cluster_id")),
        "trend_state": F.when(F.col("is_active"), F.col("_trend")).otherwise(F.col("trend_state")),
    }).select(*events.columns)


def heat_grid(events: DataFrame, cell_degrees: float = 1.0) -> DataFrame:
    """Severity-weighted density per grid cell."""
    return events.groupBy(grid_index(F.col("latitude"), cell_degrees).alias("lat_cell"),
                          grid_index(F.col("longitude"), cell_degrees).alias("lon_cell")).agg(
        F.count("*").alias("event_count"), F.sum(heat_weight(F.col("severity_score"))).alias("weight"),
        F.avg("latitude").alias("mean_lat"), F.avg("longitude").alias("mean_lon"))
