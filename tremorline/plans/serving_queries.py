"""Registered queries: pages, filters, facets, details, freshness, GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorline.functions import constants as C
from tremorline.operators import serving as S
from tremorline.operators.dedup import merge_page
from tremorline.plans.hotspot_queries import STATE_HOTSPOTS, state_hotspots
from tremorline.plans.registry import query
from tremorline.plans.views import NOW, NOW_SQL, incidents, places, provenance, r_sql, run_log, with_ctes
from tremorline.sources import sinks

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


def _trended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents carrying the trend of the state they are in."""
    trends = state_hotspots(spark, sf_dir).select("state_key", F.col("trend_state").alias("t"))
    ev = incidents(spark, sf_dir).drop("trend_state").withColumn(
        "state_key", F.coalesce("state", F.lit("unknown")))
    return ev.join(trends, "state_key", "left").withColumnRenamed("t", "trend_state")


_TRENDED = {**STATE_HOTSPOTS, "trended": """SELECT i.*, h.trend_state FROM incidents i
  LEFT JOIN hotspots h ON h.state_key = coalesce(i.state, 'unknown')"""}
_GATE = "NOT (source_name = 'gdelt' AND source_count < 2)"


@query(with_ctes("SELECT id, title, event_type, city FROM incidents WHERE is_active ORDER BY occurred_at DESC, id LIMIT 500",
                 "incidents"))
def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_events(incidents(spark, sf_dir)).select("id", "title", "event_type", "city")


@query(with_ctes("SELECT id, title, event_type FROM incidents WHERE is_active ORDER BY occurred_at DESC, id LIMIT 200 OFFSET 300",
                 "incidents"))
def event_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_events(incidents(spark, sf_dir), 200, 300).select("id", "title", "event_type")


@query(with_ctes("""SELECT id, title, event_type FROM incidents WHERE is_active AND (occurred_at < TIMESTAMP '2024-01-20 12:00:00'
  OR (occurred_at = TIMESTAMP '2024-01-20 12:00:00' AND id > 100)) ORDER BY occurred_at DESC, id LIMIT 500""", "incidents"))
def event_page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_events_after(incidents(spark, sf_dir), "2024-01-20 12:00:00", 100).select("id", "title", "event_type")


@query(with_ctes("""SELECT count(*) AS total, 500::BIGINT AS "limit", 1000::BIGINT AS "offset",
  1000 + greatest(0, least(500, count(*) - 1000)) < count(*) AS has_more FROM incidents WHERE is_active""", "incidents"))
def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_total(incidents(spark, sf_dir), 500, 1000)


@query(with_ctes("SELECT id, title, city, severity_score FROM incidents WHERE id = 42", "incidents"))
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_id(incidents(spark, sf_dir), 42).select("id", "title", "city", "severity_score")


@query(with_ctes(f"""SELECT id, event_type, severity_score, trend_state FROM trended
WHERE {_GATE} AND severity_score >= 0.6::DOUBLE AND confidence_score >= 0.5::DOUBLE
  AND event_type IN ('protest', 'violence') AND trend_state IN ('stable', 'escalating')""", "recent", **_TRENDED))
def feed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.feed_filter(_trended(spark, sf_dir), ["protest", "violence"], 0.6, 0.5, ["stable", "escalating"]).select(
        "id", "event_type", "severity_score", "trend_state")


@query(with_ctes(f"SELECT source_name, source_count, count(*) AS event_count FROM incidents WHERE {_GATE} GROUP BY ALL",
                 "incidents"))
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quality_gate(incidents(spark, sf_dir)).groupBy("source_name", "source_count").agg(
        F.count("*").alias("event_count"))


@query(with_ctes(f"""SELECT event_type, count(*) AS event_count FROM incidents
WHERE {_GATE} AND severity_score >= 0.4::DOUBLE AND confidence_score >= 0.5::DOUBLE GROUP BY 1""", "incidents"))
def type_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.type_facets(incidents(spark, sf_dir), 0.4, 0.5)


@query(with_ctes("""SELECT state_key, priority_score, trend_state, rank FROM (
  SELECT *, row_number() OVER (ORDER BY priority_score DESC, state_key) AS rank FROM hotspots)
WHERE rank <= 3 AND trend_state IN ('stable', 'declining')""", "recent", **STATE_HOTSPOTS))
def trend_filtered_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.priorities(state_hotspots(spark, sf_dir).withColumn("id", F.col("state_key")))
    return S.trend_filter(top, ["stable", "declining"]).select("state_key", "priority_score", "trend_state", "rank")


@query(with_ctes("SELECT state_key, priority_score, status_label FROM hotspots", "recent", **STATE_HOTSPOTS))
def hotspot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = S.list_hotspots(state_hotspots(spark, sf_dir).withColumn("id", F.col("state_key")))
    return ranked.select("state_key", "priority_score", "status_label")


@query(with_ctes("""SELECT place_id AS cluster_id, id, position FROM (
  SELECT p.place_id, i.id, row_number() OVER (PARTITION BY p.place_id ORDER BY i.severity_score DESC, i.id) AS position
  FROM incidents i JOIN places p ON i.city IS NOT DISTINCT FROM p.city AND i.state IS NOT DISTINCT FROM p.state
   AND i.location_precision = p.location_precision WHERE i.is_active) WHERE position <= 8""", "incidents"))
def hotspot_members_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_members(_placed(spark, sf_dir)).select("cluster_id", "id", "position")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with the number of their place as cluster."""
    where = places(spark).select(F.col("place_id").alias("p"), F.col("city").alias("c"), F.col("state").alias("s"),
                                 F.col("location_precision").alias("l"))
    ev = incidents(spark, sf_dir).drop("cluster_id")
    same = ev["city"].eqNullSafe(where["c"]) & ev["state"].eqNullSafe(where["s"]) & (ev["location_precision"] == where["l"])
    return ev.join(where, same).withColumnRenamed("p", "cluster_id").drop("c", "s", "l")


@query(with_ctes("""SELECT p.place_id AS id, i.id AS event_id, i.severity_score AS event_severity_score
FROM places p LEFT JOIN incidents i ON i.is_active AND i.city IS NOT DISTINCT FROM p.city
  AND i.state IS NOT DISTINCT FROM p.state AND i.location_precision = p.location_precision""", "incidents"))
def hotspot_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    hotspots = places(spark).select(F.col("place_id").alias("id"))
    return S.hotspot_members(hotspots, _placed(spark, sf_dir)).select("id", "event_id", "event_severity_score")


@query(with_ctes(f"""SELECT i.id, i.event_type, p.source_record_id, p.source_name AS outlet,
  {_TS.format('p.source_published_at')} AS source_published_at, p.source_trust_weight
FROM incidents i LEFT JOIN (SELECT *, CASE WHEN position % 3 = 0 THEN 0::DOUBLE ELSE 1::DOUBLE END AS source_trust_weight
  FROM provenance) p ON p.event_id = i.id""", "incidents", "provenance"))
def event_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.event_with_sources(incidents(spark, sf_dir).select("id", "event_type"), weighted_sources(spark, sf_dir))
    return out.withColumn("source_published_at", _text("source_published_at"))


def weighted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance(spark, sf_dir).withColumn(
        "source_trust_weight", F.when(F.col("position") % 3 == 0, F.lit(0.0)).otherwise(F.lit(1.0)))


@query(with_ctes("""SELECT event_id, source_record_id,
  CASE WHEN position % 3 = 0 THEN 'syndicated' ELSE 'independent' END AS label FROM provenance""", "provenance"))
def sources_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sources_ordered(weighted_sources(spark, sf_dir)).select("event_id", "source_record_id", "label")


@query(with_ctes("SELECT event_id, count(*) FILTER (position % 3 <> 0) AS independent FROM provenance GROUP BY 1", "provenance"))
def independent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.independent_count(weighted_sources(spark, sf_dir))


@query(with_ctes("SELECT event_id, source_record_id FROM provenance WHERE position % 3 <> 0", "provenance"))
def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.independent_sources(weighted_sources(spark, sf_dir)).select("event_id", "source_record_id")


@query(with_ctes(f"""SELECT {_TS.format('(SELECT max(ingested_at) FROM incidents)')} AS last_ingested_at,
  '2024-01-31 00:00:00' AS last_computed_at, (SELECT count(*) FROM incidents WHERE is_active) AS event_count,
  (SELECT count(*) FROM hotspots) AS hotspot_count,
  coalesce((epoch_us({NOW_SQL}) - epoch_us(s.at)) / 1e6 > 3600, true) AS is_stale,
  {_TS.format('r.started_at')} AS last_run_at, {_TS.format('s.at')} AS last_success_at, r.status AS last_run_status,
  CASE WHEN r.status = 'failed' THEN r.error_message END AS last_error
FROM (SELECT * FROM runs WHERE ingest_source = 'gdelt' ORDER BY started_at DESC, id DESC LIMIT 1) r,
  (SELECT max(finished_at) AS at FROM runs WHERE ingest_source = 'gdelt' AND status = 'success') s""",
                 "recent", "runs", **STATE_HOTSPOTS))
def system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sinks.current_runs(run_log(spark, sf_dir))
    out = S.system_status(incidents(spark, sf_dir), state_hotspots(spark, sf_dir), runs, C.CODED_FEED, NOW)
    return out.select(_text("last_ingested_at"), _text("last_computed_at"), "event_count", "hotspot_count", "is_stale",
                      _text("last_run_at"), _text("last_success_at"), "last_run_status", "last_error")


@query(with_ctes(f"""SELECT {_TS.format('max(finished_at)')} AS last_success_at FROM runs
WHERE ingest_source = 'eventregistry' AND status = 'success'""", "runs"))
def latest_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sinks.current_runs(run_log(spark, sf_dir))
    return S.latest_success(runs, C.ARTICLE_FEED).select(_text("last_success_at"))


@query(with_ctes(f"""SELECT s.ingest_source, coalesce((epoch_us(TIMESTAMP '2024-01-30 23:50:00') - epoch_us(max(r.finished_at))) / 1e6 > 3600, true)
  AS is_stale FROM (SELECT DISTINCT ingest_source FROM runs) s
LEFT JOIN runs r ON r.ingest_source = s.ingest_source AND r.status = 'success' GROUP BY 1""", "runs"))
def stale_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremorline.functions.timefn import is_stale

    runs = sinks.current_runs(run_log(spark, sf_dir))
    last = F.max(F.when(F.col("status") == "success", F.col("finished_at")))
    return runs.groupBy("ingest_source").agg(last.alias("at")).select(
        "ingest_source", is_stale(F.col("at"), "2024-01-30 23:50:00").alias("is_stale"))


@query(with_ctes(f"""SELECT id, {_TS.format('started_at')} AS started_at, status, events_inserted, error_message FROM runs""", "runs"))
def run_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.current_runs(run_log(spark, sf_dir)).select(
        "id", _text("started_at"), "status", "events_inserted", "error_message")


@query(with_ctes("""SELECT id, 'Feature' AS kind, 'Point' AS geometry, longitude AS lon, latitude AS lat, severity_score,
  event_type FROM incidents""", "incidents"))
def geojson_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sinks.events_geojson(incidents(spark, sf_dir))
    shape = ("type string, id long, geometry struct<type:string,coordinates:array<double>>, "
             "properties struct<id:long,severity_score:double,event_type:string>")
    return f.select(F.from_json("feature", shape).alias("f")).select(
        "f.id", F.col("f.type").alias("kind"), F.col("f.geometry.type").alias("geometry"),
        F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"),
        "f.properties.severity_score", "f.properties.event_type")


@query(with_ctes(f"""SELECT state_key AS id, 'Point' AS geometry, {r_sql('centroid_lon', 6)} AS lon, {r_sql('centroid_lat', 6)} AS lat,
  CASE WHEN event_count % 2 = 0 THEN 'stable' ELSE trend_state END AS trend_state FROM hotspots""", "recent", **STATE_HOTSPOTS))
def geojson_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tremorline.functions.scores import round_to

    hs = state_hotspots(spark, sf_dir).withColumn("id", F.col("state_key")).withColumn(
        "trend_state", F.when(F.col("event_count") % 2 != 0, F.col("trend_state")))
    shape = "id string, geometry struct<type:string,coordinates:array<double>>, properties struct<trend_state:string>"
    return sinks.hotspots_geojson(hs).select(F.from_json("feature", shape).alias("f")).select(
        "f.id", F.col("f.geometry.type").alias("geometry"),
        round_to(F.col("f.geometry.coordinates")[0], 6).alias("lon"),
        round_to(F.col("f.geometry.coordinates")[1], 6).alias("lat"), "f.properties.trend_state")


@query(with_ctes("""SELECT id, occurred_at >= TIMESTAMP '2024-01-16 00:00:00' AS from_page, severity_score FROM incidents""",
                 "incidents"))
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge a page that overlaps the rows already loaded: overlapping rows keep their loaded version."""
    ev = incidents(spark, sf_dir).select("id", "occurred_at", "severity_score")
    loaded = ev.filter(F.col("occurred_at") < F.lit("2024-01-16").cast("timestamp")).withColumn("from_page", F.lit(False))
    page = ev.filter(F.col("occurred_at") >= F.lit("2024-01-11").cast("timestamp")).withColumn("from_page", F.lit(True))
    return merge_page(loaded, page).select("id", "from_page", "severity_score")


@query(with_ctes("""SELECT i.id, i.is_active FROM incidents i WHERE EXISTS (SELECT 1 FROM provenance p WHERE p.event_id = i.id)""",
                 "incidents", "provenance"))
def still_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = provenance(spark, sf_dir).select(F.col("event_id").alias("id"))
    return S.still_selected(selected, incidents(spark, sf_dir)).select("id", "is_active")


@query(with_ctes("""SELECT p.event_id, p.source_record_id FROM provenance p
WHERE NOT EXISTS (SELECT 1 FROM incidents i WHERE i.id = p.event_id AND i.is_active)""", "incidents", "provenance"))
def orphan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose incident is gone (here: not active)."""
    kept = S.active(incidents(spark, sf_dir)).select(F.col("id").alias("event_id"))
    return provenance(spark, sf_dir).join(kept, "event_id", "left_anti").select("event_id", "source_record_id")
