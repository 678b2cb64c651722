"""Registered queries: clusters, scores, names, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import grid_index, is_country_level, is_state_level
from tremorline.functions.scores import round_to, severity_bucket
from tremorline.operators import hotspots as H
from tremorline.operators import serving as S
from tremorline.operators import anchors
from tremorline.operators.clustering import greedy_clusters
from tremorline.plans.registry import query
from tremorline.plans.views import NOW, NOW_SQL, haversine_sql, incidents, places, r_sql, with_ctes


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cluster_window(incidents(spark, sf_dir), NOW)


def by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent(spark, sf_dir).withColumn("state_key", H.state_group_key(F.col("state")))


def state_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotspot rows with states as clusters: the part of the hotspot computation that SQL can repeat."""
    scores = H.cluster_scores(by_state(spark, sf_dir), ["state_key"], NOW).filter(
        F.col("event_count") >= C.MIN_MEMBERS)
    return scores.withColumn("id", F.xxhash64("state_key")).withColumn("last_computed_at", F.lit(NOW).cast("timestamp"))


def scores_sql(source: str, by: str) -> str:
    """SQL of ``cluster_scores``: sums first, then the rounded scores, then what builds on those."""
    sums = f"""SELECT {by}, count(*) AS event_count, avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon,
    {r_sql('0.7::DOUBLE * max(severity_score) + 0.3::DOUBLE * avg(severity_score)')} AS severity_score,
    {r_sql('avg(confidence_score)')} AS confidence_score,
    {r_sql('least(1::DOUBLE, sum(severity_score * greatest(0::DOUBLE, 1::DOUBLE - age / 86400::DOUBLE)) / count(*))')}
      AS momentum_score,
    count(*) FILTER (age < 28800) AS recent_count, count(*) FILTER (age >= 28800 AND age < 86400) AS earlier_count,
    coalesce(avg(severity_score) FILTER (age < 28800), 0::DOUBLE) AS recent_severity,
    coalesce(avg(severity_score) FILTER (age >= 28800 AND age < 86400), 0::DOUBLE) AS earlier_severity
  FROM {source} GROUP BY {by}"""
    priority = r_sql("0.5::DOUBLE * severity_score + 0.3::DOUBLE * momentum_score "
                     "+ 0.2::DOUBLE * least(1::DOUBLE, event_count / 5::DOUBLE)")
    return f"""SELECT *, CASE WHEN priority_score >= 0.8::DOUBLE AND trend_state = 'escalating' THEN 'Active Hotspot'
      WHEN priority_score >= 0.6::DOUBLE THEN 'Elevated Activity' WHEN trend_state = 'escalating' THEN 'Emerging'
      WHEN trend_state = 'declining' THEN 'De-escalating' ELSE 'Monitored' END AS status_label
  FROM (SELECT *, {priority} AS priority_score,
    CASE WHEN recent_count >= 2 AND (recent_count > earlier_count OR recent_severity > earlier_severity + 0.15::DOUBLE)
         THEN 'escalating'
         WHEN earlier_count > 2 * recent_count AND earlier_severity > recent_severity THEN 'declining'
         ELSE 'stable' END AS trend_state
  FROM ({sums}))"""


STATE_KEYED = "SELECT *, coalesce(nullif(state, ''), 'unknown') AS state_key FROM recent"
STATE_HOTSPOTS = {"keyed": STATE_KEYED,
                  "hotspots": f"SELECT * FROM ({scores_sql('keyed', 'state_key')}) WHERE event_count >= 3"}
SCORE_COLUMNS = ["event_count", "severity_score", "confidence_score", "momentum_score", "priority_score",
                 "trend_state", "status_label"]


@query(with_ctes("""SELECT state_key, event_count, severity_score, confidence_score, momentum_score, priority_score,
  trend_state, status_label, row_number() OVER (ORDER BY priority_score DESC, state_key) AS rank
FROM hotspots ORDER BY priority_score DESC, state_key LIMIT 3""", "recent", **STATE_HOTSPOTS))
def top_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = state_hotspots(spark, sf_dir).withColumn("id", F.col("state_key"))
    return S.priorities(scored).select("state_key", *SCORE_COLUMNS, "rank")


@query(with_ctes(f"SELECT state_key, {', '.join(SCORE_COLUMNS)} FROM hotspots", "recent", **STATE_HOTSPOTS))
def hotspot_scores_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_hotspots(spark, sf_dir).select("state_key", *SCORE_COLUMNS)


@query(with_ctes(f"""SELECT state_key, event_type, recent_count, earlier_count, {r_sql('recent_severity', 6)} AS recent_severity,
  {r_sql('earlier_severity', 6)} AS earlier_severity, trend_state
FROM ({scores_sql('keyed', 'state_key, event_type')})""", "recent", keyed=STATE_KEYED))
def cluster_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = H.cluster_scores(by_state(spark, sf_dir), ["state_key", "event_type"], NOW)
    return scores.select("state_key", "event_type", "recent_count", "earlier_count",
                         round_to(F.col("recent_severity"), 6).alias("recent_severity"),
                         round_to(F.col("earlier_severity"), 6).alias("earlier_severity"), "trend_state")


@query(with_ctes(f"""SELECT city, state, momentum_score, priority_score, {r_sql('centroid_lat', 6)} AS centroid_lat,
  {r_sql('centroid_lon', 6)} AS centroid_lon FROM ({scores_sql('recent', 'city, state')})""", "recent"))
def cluster_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = H.cluster_scores(recent(spark, sf_dir), ["city", "state"], NOW)
    return scores.select("city", "state", "momentum_score", "priority_score",
                         round_to(F.col("centroid_lat"), 6).alias("centroid_lat"),
                         round_to(F.col("centroid_lon"), 6).alias("centroid_lon"))


@query(with_ctes(f"""SELECT status_label, trend_state, count(*) AS clusters
FROM ({scores_sql('keyed', 'city, state_key, event_type')}) GROUP BY ALL""", "recent", keyed=STATE_KEYED))
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = H.cluster_scores(by_state(spark, sf_dir), ["city", "state_key", "event_type"], NOW)
    return scores.groupBy("status_label", "trend_state").agg(F.count("*").alias("clusters"))


# Named groups: 4-degree boxes split by event type, so that every way of naming a hotspot occurs.
_NAMES_LISTED = ", ".join(f"'{n}'" for n in C.STATE_NAMES)
_STATE_CASE = "CASE main_state " + " ".join(
    f"WHEN '{ab}' THEN '{n}'" for ab, n in C.STATE_DISPLAY_NAME.items()) + " ELSE main_state END"
_NAMING = {
    "boxed": """SELECT *, concat(CAST(floor(latitude / 4::DOUBLE) AS BIGINT), ':',
      CAST(floor(longitude / 4::DOUBLE) AS BIGINT), ':', event_type) AS box FROM incidents WHERE is_active""",
    "placed": """SELECT b.*, c.centroid_lat, c.centroid_lon FROM boxed b JOIN (SELECT box, avg(latitude) AS centroid_lat,
      avg(longitude) AS centroid_lon FROM boxed GROUP BY box) c USING (box)""",
    "kinds": f"""SELECT *, CASE
      WHEN city IS NULL OR city = '' THEN 3
      WHEN lower(city) LIKE '%county%' OR lower(city) LIKE '%parish%' THEN 2
      WHEN city IN ({_NAMES_LISTED}) OR city IN ('United States', 'United States of America')
        OR coalesce(city = state, false) THEN 3 ELSE 1 END AS kind,
      {haversine_sql('centroid_lat', 'centroid_lon', 'latitude', 'longitude')} AS miles FROM placed""",
    "cities": """SELECT box, kind, city, count(*) / (1::DOUBLE + avg(miles) / 50::DOUBLE) AS weight,
      min((-epoch_us(occurred_at), id)) AS first FROM kinds WHERE kind < 3 GROUP BY ALL""",
    "best": """SELECT * FROM cities QUALIFY row_number() OVER (PARTITION BY box ORDER BY kind, weight DESC, first) = 1""",
    "city_states": """SELECT box, kind, city, state FROM kinds WHERE kind < 3 AND state <> '' GROUP BY box, kind, city, state
      QUALIFY row_number() OVER (PARTITION BY box, kind, city ORDER BY count(*) DESC, state) = 1""",
    "states": """SELECT box, state AS main_state FROM kinds WHERE state <> '' GROUP BY box, state
      QUALIFY row_number() OVER (PARTITION BY box ORDER BY count(*) DESC, state) = 1""",
}


_NAME_SQL = f"""coalesce(
  CASE WHEN b.city IS NULL THEN NULL WHEN c.state IS NULL THEN b.city ELSE concat(b.city, ', ', c.state) END,
  {_STATE_CASE} || ' region',
  printf('Cluster (%.1f°N, %.1f°W)', p.centroid_lat, abs(p.centroid_lon)))"""


@query(with_ctes(f"""SELECT p.box, {_NAME_SQL} AS name
FROM (SELECT DISTINCT box, centroid_lat, centroid_lon FROM placed) p LEFT JOIN states s USING (box)
LEFT JOIN best b USING (box) LEFT JOIN city_states c ON c.box = b.box AND c.kind = b.kind AND c.city = b.city""",
                 "incidents", **_NAMING))
def hotspot_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = S.active(incidents(spark, sf_dir)).withColumn("box", F.concat_ws(
        ":", grid_index(F.col("latitude"), 4).cast("string"), grid_index(F.col("longitude"), 4).cast("string"),
        "event_type"))
    centres = boxed.groupBy("box").agg(F.avg("latitude").alias("centroid_lat"), F.avg("longitude").alias("centroid_lon"))
    return H.hotspot_names(boxed.join(centres, "box"), "box")


_IS_STATE_LEVEL = f"(coalesce(city IN ({_NAMES_LISTED}), false) OR coalesce(city = state, false))"


@query(with_ctes(f"""SELECT state_key, count(*) AS event_count, {r_sql('avg(latitude)', 6)} AS centroid_lat,
  {r_sql('avg(longitude)', 6)} AS centroid_lon FROM keyed WHERE {_IS_STATE_LEVEL} GROUP BY 1 HAVING count(*) >= 3""",
                 "recent", keyed=STATE_KEYED))
def state_fallback_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.state_groups(recent(spark, sf_dir)).select(
        "state_key", "event_count", round_to(F.col("centroid_lat"), 6).alias("centroid_lat"),
        round_to(F.col("centroid_lon"), 6).alias("centroid_lon"))


@query(with_ctes(f"""SELECT {_IS_STATE_LEVEL} AS state_level,
  coalesce(city IN ('United States', 'United States of America'), false) AS country_level, is_active,
  occurred_at >= {NOW_SQL} - INTERVAL 72 HOUR AS in_window, count(*) AS event_count FROM incidents GROUP BY ALL""",
                 "incidents"))
def location_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = incidents(spark, sf_dir)
    return ev.groupBy(
        is_state_level(F.col("city"), F.col("state")).alias("state_level"),
        is_country_level(F.col("city")).alias("country_level"), "is_active",
        (F.col("occurred_at") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 72 HOURS")).alias("in_window"),
    ).agg(F.count("*").alias("event_count"))


@query(with_ctes(f"""SELECT h.state_key, h.recent_count - h.earlier_count AS escalation_rate,
  {r_sql('h.recent_severity - h.earlier_severity', 6)} AS intensity_delta,
  {r_sql('max(' + haversine_sql('k.latitude', 'k.longitude', 'h.centroid_lat', 'h.centroid_lon') + ')', 4)} AS spread_miles
FROM keyed k JOIN ({scores_sql('keyed', 'state_key')}) h USING (state_key)
GROUP BY h.state_key, h.recent_count, h.earlier_count, h.recent_severity, h.earlier_severity""",
                 "recent", keyed=STATE_KEYED))
def trend_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = by_state(spark, sf_dir)
    out = H.trend_metrics(members, H.cluster_scores(members, ["state_key"], NOW), "state_key", NOW)
    return out.select("state_key", "escalation_rate", round_to(F.col("intensity_delta"), 6).alias("intensity_delta"),
                      round_to(F.col("spread_miles"), 4).alias("spread_miles"))


@query(with_ctes(f"""SELECT CAST(floor(latitude) AS BIGINT) AS lat_cell, CAST(floor(longitude) AS BIGINT) AS lon_cell,
  count(*) AS event_count, {r_sql('sum(0.5::DOUBLE + greatest(0::DOUBLE, least(1::DOUBLE, severity_score)))')} AS weight,
  {r_sql('avg(latitude)', 6)} AS mean_lat, {r_sql('avg(longitude)', 6)} AS mean_lon FROM incidents GROUP BY 1, 2""",
                 "incidents"))
def heat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.heat_grid(incidents(spark, sf_dir), 1.0).select(
        "lat_cell", "lon_cell", "event_count", round_to(F.col("weight"), 3).alias("weight"),
        round_to(F.col("mean_lat"), 6).alias("mean_lat"), round_to(F.col("mean_lon"), 6).alias("mean_lon"))


@query(with_ctes("""SELECT CASE WHEN severity_score >= 0.8::DOUBLE THEN 'critical' WHEN severity_score >= 0.6::DOUBLE THEN 'high'
  WHEN severity_score >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS bucket, event_type, count(*) AS event_count
FROM incidents GROUP BY ALL""", "incidents"))
def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents(spark, sf_dir).groupBy(severity_bucket(F.col("severity_score")).alias("bucket"), "event_type").agg(
        F.count("*").alias("event_count"))


_MILES = haversine_sql("i.latitude", "i.longitude", "c.lat", "c.lon")


@query(with_ctes(f"""SELECT id, place_id AS centre_id, {r_sql('miles', 4)} AS miles FROM (
  SELECT i.id, c.place_id, {_MILES} AS miles FROM incidents i, places c WHERE {_MILES} <= 75)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY miles, place_id) = 1""", "incidents"))
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = places(spark).select(F.col("place_id").alias("centre_id"), F.col("lat").alias("centre_lat"),
                                   F.col("lon").alias("centre_lon"))
    return S.nearest_centre(incidents(spark, sf_dir), centres).select(
        "id", "centre_id", round_to(F.col("miles"), 4).alias("miles"))


# Candidate ranking and write-back, with (state, type) groups as clusters.
_RANKED = {
    "clusters": "SELECT *, concat(state_key, '/', event_type) AS cluster FROM keyed",
    "ranked": """SELECT cluster, count(*) AS event_count, min((-epoch_us(occurred_at), id)) AS opened FROM clusters
      GROUP BY cluster HAVING count(*) >= 3 ORDER BY event_count DESC, opened LIMIT 15""",
    "top": "SELECT *, row_number() OVER (ORDER BY event_count DESC, opened) AS hotspot_id FROM ranked",
}


def _typed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_state(spark, sf_dir).withColumn("cluster", F.concat_ws("/", "state_key", "event_type")).withColumn(
        "pass", F.lit(1))


@query(with_ctes("SELECT hotspot_id, cluster, event_count FROM top", "recent", keyed=STATE_KEYED, **_RANKED))
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rank_candidates(_typed_members(spark, sf_dir)).select("hotspot_id", "cluster", "event_count")


@query(with_ctes(f"""SELECT i.id, CASE WHEN i.is_active THEN t.hotspot_id ELSE -1 END AS cluster_id,
  CASE WHEN i.is_active THEN s.trend_state ELSE 'stable' END AS trend_state
FROM incidents i LEFT JOIN clusters c ON c.id = i.id LEFT JOIN top t ON t.cluster = c.cluster
LEFT JOIN ({scores_sql('clusters', 'cluster')}) s ON s.cluster = t.cluster""",
                 "recent", keyed=STATE_KEYED, **_RANKED))
def assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _typed_members(spark, sf_dir)
    top = H.rank_candidates(members)
    _, membership = H.score_hotspots(members, top, NOW)
    before = incidents(spark, sf_dir).withColumns({"cluster_id": F.lit(-1).cast("long"), "trend_state": F.lit("stable")})
    return H.assign_clusters(before, membership).select("id", "cluster_id", "trend_state")


def _anchor_ctes(source: str, rounds: int = 8) -> dict[str, str]:
    """SQL of ``anchor_clusters`` over ``source``, with a fixed number of rounds that is enough for 24 towns."""
    r, size = f"{C.EARTH_RADIUS_MILES}::DOUBLE", f"{C.CLUSTER_MILES / anchors.CELLS_PER_RADIUS!r}::DOUBLE"
    axes = [f"{r} * cos(radians(latitude)) * cos(radians(longitude))", f"{r} * cos(radians(latitude)) * sin(radians(longitude))",
            f"{r} * sin(radians(latitude))"]
    near = f"{haversine_sql('p.latitude', 'p.longitude', 'a.latitude', 'a.longitude')} <= {C.CLUSTER_MILES}"
    order = "(-{0}.n, -{0}.last, {0}.latitude, {0}.longitude)"
    ctes = {
        "precise": f"SELECT * FROM {source} WHERE NOT {_IS_STATE_LEVEL} AND NOT coalesce(city IN ('United States', 'United States of America'), false)",
        "open0": f"""SELECT latitude, longitude, count(*) AS n, max(epoch_us(occurred_at)) AS last, min(id) AS first_id,
          ({', '.join(f'CAST(floor(({x}) / {size}) AS BIGINT)' for x in axes)}) AS cell FROM precise GROUP BY latitude, longitude"""}
    for k in range(rounds):
        ctes[f"contend{k}"] = f"SELECT * FROM open{k} p QUALIFY row_number() OVER (PARTITION BY cell ORDER BY {order.format('p')}) = 1"
        ctes[f"anchor{k}"] = f"""SELECT * FROM contend{k} p WHERE NOT EXISTS (
          SELECT 1 FROM contend{k} a WHERE {near} AND {order.format('a')} < {order.format('p')})"""
        ctes[f"open{k + 1}"] = f"SELECT * FROM open{k} p WHERE NOT EXISTS (SELECT 1 FROM anchor{k} a WHERE {near})"
    ctes["anchors"] = " UNION ALL ".join(f"SELECT * FROM anchor{k}" for k in range(rounds))
    ctes["seeds"] = f"""SELECT p.latitude, p.longitude, a.first_id AS seed FROM open0 p JOIN anchors a ON {near}
      QUALIFY row_number() OVER (PARTITION BY p.latitude, p.longitude
        ORDER BY {haversine_sql('p.latitude', 'p.longitude', 'a.latitude', 'a.longitude')}, {order.format('a')}) = 1"""
    return ctes


@query(with_ctes("SELECT i.id, s.seed FROM precise i JOIN seeds s USING (latitude, longitude)", "incidents",
                 live="SELECT * FROM incidents WHERE is_active", **_anchor_ctes("live")))
def anchor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters around anchors of all active incidents."""
    return anchors.anchor_clusters(S.active(incidents(spark, sf_dir)))


_ANCHORED = _anchor_ctes("recent") | {
    "members": f"""SELECT r.*, 1 AS pass, CAST(s.seed AS VARCHAR) AS cluster FROM recent r JOIN seeds s USING (latitude, longitude)
      WHERE r.id IN (SELECT id FROM precise)
      UNION ALL SELECT *, 2, coalesce(nullif(state, ''), 'unknown') FROM recent WHERE {_IS_STATE_LEVEL}""",
    "largest": """SELECT pass, cluster, count(*) AS k, min((-epoch_us(occurred_at), id)) AS opened FROM members
      GROUP BY pass, cluster HAVING count(*) >= 3""",
    "numbered": "SELECT *, row_number() OVER (ORDER BY k DESC, pass, opened) AS hotspot_id FROM largest",
    "placed": "SELECT m.*, n.hotspot_id FROM members m JOIN numbered n USING (pass, cluster)",
}


@query(with_ctes(f"SELECT hotspot_id AS id, {', '.join(SCORE_COLUMNS)} FROM ({scores_sql('placed', 'hotspot_id')})", "recent",
                 **_ANCHORED))
def anchor_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hotspots of the window, without a bound on their number."""
    return H.compute_hotspots(incidents(spark, sf_dir), NOW, limit=None)[0].select("id", *SCORE_COLUMNS)


@query()
def greedy_cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters of all active incidents, not only those of the window."""
    return greedy_clusters(S.active(incidents(spark, sf_dir)))


_COMPUTED = {k: v for k, v in _ANCHORED.items() if k not in ("numbered", "placed")} | {
    "numbered": """SELECT *, row_number() OVER (ORDER BY k DESC, pass, opened) AS hotspot_id FROM largest
      ORDER BY k DESC, pass, opened LIMIT 15""",
    "listed": "SELECT m.*, n.hotspot_id FROM members m JOIN numbered n USING (pass, cluster)",
    "placed": """SELECT l.*, l.hotspot_id AS box, c.centroid_lat, c.centroid_lon FROM listed l JOIN (SELECT hotspot_id,
      avg(latitude) AS centroid_lat, avg(longitude) AS centroid_lon FROM listed GROUP BY hotspot_id) c USING (hotspot_id)""",
} | {k: v for k, v in _NAMING.items() if k not in ("boxed", "placed")}


@query(with_ctes(f"""SELECT h.hotspot_id AS id, {_NAME_SQL} AS name, {r_sql('h.centroid_lat', 6)} AS centroid_lat,
  {r_sql('h.centroid_lon', 6)} AS centroid_lon, {', '.join(f'h.{c}' for c in SCORE_COLUMNS)}
FROM ({scores_sql('listed', 'hotspot_id')}) h JOIN (SELECT DISTINCT box, centroid_lat, centroid_lon FROM placed) p ON p.box = h.hotspot_id
LEFT JOIN states s ON s.box = p.box LEFT JOIN best b ON b.box = p.box
LEFT JOIN city_states c ON c.box = b.box AND c.kind = b.kind AND c.city = b.city""", "recent", **_COMPUTED))
def compute_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 largest hotspots of the window, as they are published."""
    out = H.compute_hotspots(incidents(spark, sf_dir), NOW)[0].drop("last_computed_at")
    return out.withColumns({c: round_to(F.col(c), 6) for c in ("centroid_lat", "centroid_lon")})


_SUMMARY = """concat(CASE trend_state WHEN 'escalating' THEN 'Escalating' WHEN 'declining' THEN 'Declining' ELSE 'Ongoing' END, ' ',
  CASE WHEN severity_score >= 0.8::DOUBLE THEN 'high-severity' WHEN severity_score >= 0.5::DOUBLE THEN 'moderate-severity'
       ELSE 'low-severity' END,
  ' cluster · ', event_count, CASE WHEN event_count = 1 THEN ' event' ELSE ' events' END, ' · priority ',
  CAST(floor(priority_score * 100::DOUBLE + 0.5::DOUBLE) AS BIGINT), '. Predominant type: ', dominant_type, '.',
  CASE WHEN imprecise > 0 AND imprecise = event_count
       THEN ' Regional aggregate — all signals are state-level. Location is approximate.'
       WHEN imprecise > 0 THEN concat(' ', imprecise, CASE WHEN imprecise = 1 THEN ' event' ELSE ' events' END,
         ' with imprecise location — cluster label may be approximate.') ELSE '' END)"""


@query(with_ctes(f"""SELECT h.city_key AS id, {_SUMMARY} AS summary
FROM ({scores_sql('cities', 'city_key')}) h
JOIN (SELECT city_key, count(*) FILTER (location_precision IN ('state', 'country')) AS imprecise FROM cities GROUP BY 1)
  USING (city_key)
JOIN (SELECT city_key, event_type AS dominant_type FROM cities GROUP BY city_key, event_type QUALIFY row_number() OVER (
  PARTITION BY city_key ORDER BY count(*) DESC, min((-severity_score, id))) = 1) USING (city_key)""",
                 "recent", cities="SELECT *, coalesce(state, 'none') AS city_key FROM recent"))
def imprecise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = recent(spark, sf_dir).withColumn("city_key", F.coalesce("state", F.lit("none")))
    scored = H.cluster_scores(members, ["city_key"], NOW).withColumnRenamed("city_key", "id")
    return S.hotspot_summary(scored, members, "city_key")


@query(with_ctes("""SELECT state_key, event_type AS dominant_type FROM keyed GROUP BY state_key, event_type QUALIFY row_number() OVER (
  PARTITION BY state_key ORDER BY count(*) DESC, min((-severity_score, id))) = 1""", "recent", keyed=STATE_KEYED))
def dominant_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dominant_type(by_state(spark, sf_dir), "state_key")
