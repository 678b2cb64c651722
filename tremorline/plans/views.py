"""Incident-shaped views over the test tables, in Spark and as SQL common table expressions.

The test tables hold no incidents, so registered queries read them through these projections: every event becomes an
incident with a place and with the headline of a document, every document becomes an article.  All rows and whole
texts take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorline.functions import constants as C
from tremorline.functions.text import first_line
from tremorline.operators.classify import Lexicon
from tremorline.session import use_utc

NOW = "2024-01-31 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"

# place_id | latitude | longitude | city | state | state name | precision
PLACE_TABLE = """
0 | 47.6062 | -122.3321 | Seattle | WA | Washington | city
1 | 47.6101 | -122.2015 | Bellevue | WA | Washington | city
2 | 45.5231 | -122.6765 | Portland | OR | Oregon | venue
3 | 41.8781 | -87.6298 | Chicago | IL | Illinois | city
4 | 42.0451 | -87.6877 | Evanston | IL | Illinois | city
5 | 29.7604 | -95.3698 | Houston | TX | Texas | city
6 | 29.4241 | -98.4936 | San Antonio | TX | Texas | city
7 | 30.2672 | -97.7431 | Austin | TX | Texas | venue
8 | 38.9072 | -77.0369 | Washington | DC | District of Columbia | city
9 | 40.7128 | -74.006 | New York | NY | New York | city
10 | 39.9526 | -75.1652 | Philadelphia | PA | Pennsylvania | city
11 | 40.7357 | -74.1724 | Newark | NJ | New Jersey | city
12 | 34.0522 | -118.2437 | Los Angeles | CA | California | venue
13 | 33.7701 | -118.1937 | Long Beach | CA | California | city
14 | 34.05 | -118.24 | Los Angeles County | CA | California | city
15 | 36.77 | -119.42 | California | CA | California | state
16 | 31.5 | -100.5 | TX | TX | Texas | state
17 | 39.84 | -98.55 | United States |  |  | country
18 | 43.5 | -107.5 |  |  |  | city
19 | 30.0687 | -89.9288 | Orleans Parish | LA | Louisiana | city
20 | 30.98 | -91.96 | Louisiana | LA | Louisiana | state
21 | 42.3601 | -71.0589 | Boston | MA | Massachusetts | venue
22 | 25.7617 | -80.1918 | Miami | FL | Florida | city
23 | 47.5 | -120.5 | Washington | WA | Washington | state
"""
OUTLETS = ["AP News", "Associated Press", "Reuters", "Reuters UK", "UPI", "Agence France-Presse", "CNN Wire",
           "NBC News Wire", "Seattle Times", "Portland Tribune", "Snap Judgment"]
ARTICLE_TYPES = ["protest", "police_clash", "riot", "vandalism_tied_to_unrest", "crowd_disruption",
                 "protest_related_road_shutdown", "political_violence", "unrest"]
INCIDENT_TYPES = {"click": "protest", "view": "unrest", "purchase": "violence", "signup": "disruption"}

# Words of the invented prose stand in for the default vocabulary, none of which occurs in it.
TEST_LEXICON = Lexicon(
    phrases=[("attion to", "riot", 0.85), ("is the", "police_clash", 0.80),
             ("esndha reedes", "crowd_disruption", 0.65), ("the and", "protest", 0.70)],
    tokens=[("eriner", "protest", 0.65), ("thon", "vandalism_tied_to_unrest", 0.65), ("thble", "unrest", 0.55),
            ("thes", "riot", 0.70), ("aux", "crowd_disruption", 0.70)],
    opinion_openers=["erreth", "to oned", "das", "les"],
    weather_tokens=["therhean", "und", "los"], weather_exempt=["reedes", "der"],
    accident_phrases=["in in", "de la"], accident_exempt=["oredble", "que"])


def _place_rows() -> list[list[str]]:
    return [[f.strip() for f in line.split("|")] for line in PLACE_TABLE.strip().splitlines()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession) -> DataFrame:
    rows = [(int(i), float(lat), float(lon), lat, lon, c or None, s or None, n or None, p)
            for i, lat, lon, c, s, n, p in _place_rows()]
    df = spark.createDataFrame(rows, "place_id long, lat double, lon double, lat_text string, lon_text string, "
                                     "city string, state string, state_name string, location_precision string")
    return F.broadcast(df)  # 24 rows, whose size Spark does not know


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("title", first_line(F.col("text")))


def _size(spark: SparkSession, sf_dir: str, name: str, key: str) -> Column:
    return table(spark, sf_dir, name).agg((F.max(key) + 1).alias("n")).scalar()


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn(
        "doc_id", F.col("event_id") % _size(spark, sf_dir, "documents", "doc_id"))
    place_id = F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 24).otherwise(F.col("doc_id") % 24)
    ev = ev.withColumn("place_id", place_id)
    joined = ev.join(documents(spark, sf_dir).select("doc_id", "title"), "doc_id", "left").join(
        places(spark), "place_id", "left")
    kind = F.lit("riot")
    for raw, mapped in INCIDENT_TYPES.items():
        kind = F.when(F.col("event_type") == raw, F.lit(mapped)).otherwise(kind)
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    occurred = F.col("ts").cast("timestamp")
    return joined.select(
        eid.alias("id"),
        F.when(eid % 50 != 7, F.concat(F.lit("x-"), (eid - F.when(eid % 10 == 9, 1).otherwise(0)).cast("string")))
        .alias("source_id"),
        "title", kind.alias("event_type"), "city", "state", "location_precision",
        (F.col("lat") + (eid % 7 - 3).cast("double") / F.lit(100.0)).alias("latitude"),
        (F.col("lon") + (eid % 5 - 2).cast("double") / F.lit(100.0)).alias("longitude"),
        occurred.alias("occurred_at"), (occurred + F.expr("INTERVAL 20 MINUTES")).alias("ingested_at"),
        F.when(eid % 3 == 0, F.lit(C.CODED_FEED)).when(eid % 3 == 1, F.lit(C.ARTICLE_FEED))
        .otherwise(F.lit(C.SAMPLE_FEED)).alias("source_name"),
        (F.lit(1) + eid % 4).cast("int").alias("source_count"),
        F.least(F.lit(1.0), F.lit(0.3) + k / F.lit(137.0)).alias("confidence_score"),
        (F.col("value") / (F.col("value") + F.lit(20.0))).alias("severity_score"),
        (eid % 17 != 0).alias("is_active"),
        F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("string").alias("trend_state"))


def _choose(index: Column, values: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v)).otherwise(out)
    return out


_ARTICLE_SQL = {
    "outlet": "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OUTLETS)) + " END",
    "event_type": "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(ARTICLE_TYPES)) + " END",
    # Each way an article can state its place: objects or text, with or without coordinates, unusable ones.
    "location": """CASE doc_id % 8
  WHEN 0 THEN concat('{"type":{"type":"city"},"label":{"eng":"', coalesce(city, ''), ', ', coalesce(state_name, ''),
       ', United States"},"lat":', lat_text, ',"long":', lon_text, '}')
  WHEN 1 THEN concat('{"type":"place","label":"', coalesce(city, ''), ', ', coalesce(state, ''), '","lat":"',
       lat_text, '","long":"', lon_text, '"}')
  WHEN 2 THEN concat('{"type":{"type":"city"},"label":{"eng":"', coalesce(city, ''), ', ',
       coalesce(state_name, ''), ', United States of America"}}')
  WHEN 3 THEN '{"type":{"type":"country"},"label":{"eng":"United States"},"lat":39.8,"long":-98.5}'
  WHEN 4 THEN concat('{"type":{"type":"admin1"},"label":{"eng":"', coalesce(state_name, ''), ', United States"}}')
  WHEN 5 THEN concat('{"type":"city","label":{"eng":"', coalesce(city, ''), '"},"lat":0,"long":0}')
  WHEN 6 THEN NULL
  ELSE concat('{"type":{"type":"landmark"},"label":"', coalesce(city, ''), ', ', coalesce(state_name, ''),
       '","lat":', lat_text, ',"long":', lon_text, '}') END""",
    "date_text": """CASE doc_id % 5
  WHEN 0 THEN concat('2024-01-', lpad(CAST(1 + doc_id % 30 AS STRING), 2, '0'), 'T08:15:00Z')
  WHEN 1 THEN concat('2024-01-', lpad(CAST(1 + doc_id % 30 AS STRING), 2, '0'), 'T21:45:30+05:00')
  WHEN 2 THEN concat('2024-01-', lpad(CAST(1 + doc_id % 30 AS STRING), 2, '0'))
  WHEN 3 THEN concat('2024-01-', lpad(CAST(1 + doc_id % 45 AS STRING), 2, '0'))
  ELSE NULL END""",
}
CATEGORY_SETS = [["dmoz/conflict/protest"], ["dmoz/sports/football"], ["dmoz/business", "dmoz/sports"], ["dmoz/news"],
                 ["dmoz/society/activism"], []]
CONCEPTS = ["en/protest", "en/social_movement", "en/riot", "en/weather"]


def articles(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One article per document, with its place, outlet, URL and publication time, and ``more`` columns of documents."""
    doc = F.col("doc_id")
    docs = documents(spark, sf_dir).withColumns({
        "place_id": doc % 24, "page_id": doc % _size(spark, sf_dir, "pages", "page_id")})
    joined = docs.join(places(spark), "place_id").join(
        table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url")), "page_id", "left")
    uri = F.when(doc % 9 == 0, F.concat(F.lit("https://apnews.com/a/"), doc.cast("string"))).otherwise(
        F.col("page_url"))
    uris = lambda values: F.array(*[F.struct(F.lit(v).alias("uri"), F.lit(v.split("/")[-1]).alias("label"))
                                    for v in values]).cast("array<struct<uri:string,label:string>>")
    categories = uris([])
    for i, values in enumerate(CATEGORY_SETS):
        categories = F.when(doc % 6 == i, uris(values)).otherwise(categories)
    concepts = F.slice(F.array(*[F.struct(F.lit(v).alias("uri")) for v in CONCEPTS]), F.lit(1),
                       (doc % 4).cast("int"))
    minutes = (doc * 37) % 43200
    return joined.select(
        doc.alias("ord"), "title", F.col("text").alias("body"), F.expr(_ARTICLE_SQL["event_type"]).alias("event_type"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "city", "state", "location_precision",
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + minutes * 60).alias("occurred_at"),
        F.expr(_ARTICLE_SQL["outlet"]).alias("outlet"), uri.alias("url"),
        F.concat(F.lit("eng-"), (doc % 50).cast("string")).alias("event_uri"),
        categories.alias("categories"), concepts.alias("concepts"),
        F.expr(_ARTICLE_SQL["location"]).alias("location"), F.expr(_ARTICLE_SQL["date_text"]).alias("date_text"),
        F.lit(0.5).alias("confidence_score"), F.lit(0.4).alias("severity_score"), *more)


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same articles in the shape of the feed."""
    return articles(spark, sf_dir).select(
        "ord", F.col("ord").cast("string").alias("uri"), F.col("event_uri").alias("eventUri"), "title", "body", "url",
        F.col("date_text").alias("dateTimePub"), F.lit(None).cast("string").alias("date"),
        F.struct(F.col("outlet").alias("title")).alias("source"), "location", "categories", "concepts")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article as a source of one of the incidents its publisher group reports on."""
    group = F.regexp_extract("source", r"(\d+)$", 1).cast("long")
    return articles(spark, sf_dir, "source").select(
        group.alias("event_id"), F.col("ord").alias("position"), F.concat(F.lit("er-"), F.col("ord").cast("string"))
        .alias("source_record_id"), F.col("outlet").alias("source_name"), F.col("url").alias("source_url"),
        F.col("title").alias("source_title"), F.col("occurred_at").alias("source_published_at"), "event_uri")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per hour of events: one entry when it starts, one when it ends."""
    hourly = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(
        F.count("*").alias("n"))
    run_id = (F.unix_timestamp("h") / 3600).cast("long")
    failed = F.col("n") % 5 == 0
    source = F.when(run_id % 3 == 0, F.lit(C.CODED_FEED)).when(run_id % 3 == 1, F.lit(C.ARTICLE_FEED)).otherwise(
        F.lit(C.SAMPLE_FEED))
    base = [run_id.alias("id"), F.col("h").alias("started_at")]
    started = hourly.select(*base, F.lit(None).cast("timestamp").alias("finished_at"), F.lit("running").alias("status"),
                            F.lit(0).cast("long").alias("events_inserted"),
                            F.lit(None).cast("string").alias("error_message"), source.alias("ingest_source"))
    ended = hourly.filter(F.col("n") % 11 != 0).select(
        *base, (F.col("h") + F.expr("INTERVAL 10 MINUTES")).alias("finished_at"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.when(failed, F.lit(0)).otherwise(F.col("n")).cast("long").alias("events_inserted"),
        F.when(failed, F.concat(F.lit("failed after rows: "), F.col("n").cast("string"))).alias("error_message"),
        source.alias("ingest_source"))
    return started.unionByName(ended)


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a row of a coded export: the 14 columns in use, all text, some of them dirty."""
    eid = F.col("event_id")
    ev = table(spark, sf_dir, "events").withColumn("place_id", eid % 24).join(places(spark), "place_id")
    return ev.select(*[F.expr(sql).alias(name) for name, sql in EXPORT_SQL.items()])


EXPORT_SQL = {
    "global_event_id": "concat(CAST(event_id AS STRING), CASE WHEN event_id % 8 = 0 THEN ' ' ELSE '' END)",
    "day": "CASE WHEN event_id % 41 = 0 THEN '2024-01-05' WHEN event_id % 43 = 0 THEN '20241399' "
           "ELSE concat('202401', lpad(CAST(1 + user_id % 30 AS STRING), 2, '0')) END",
    "actor1_name": "CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('ACTOR ', CAST(user_id AS STRING)) END",
    "event_code": "concat(CASE event_type WHEN 'click' THEN '14' WHEN 'view' THEN '17' WHEN 'purchase' THEN '18' "
                  "WHEN 'signup' THEN '14' ELSE '19' END, CAST(event_id % 5 AS STRING))",
    "root_code": "CASE event_type WHEN 'click' THEN '14' WHEN 'view' THEN '17' WHEN 'purchase' THEN '18' "
                 "WHEN 'signup' THEN ' 14 ' ELSE '19' END",
    "goldstein": "CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(CAST(event_id % 31 AS INT) - 15 AS STRING) END",
    "num_sources": "CASE WHEN event_id % 19 = 0 THEN '' ELSE CAST(event_id % 9 AS STRING) END",
    "geo_type": "CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' "
                "WHEN 4 THEN ' 3' ELSE '7' END",
    "geo_name": "CASE WHEN event_id % 29 = 0 THEN '' WHEN city IS NULL THEN ', Wyoming' "
                "ELSE concat(city, ', ', coalesce(state_name, '')) END",
    "geo_country": "CASE WHEN event_id % 10 = 3 THEN 'CA' WHEN event_id % 10 = 4 THEN ' US' ELSE 'US' END",
    "geo_adm1": "CASE WHEN state IS NULL THEN 'US' ELSE concat('US', state) END",
    "geo_lat": "CASE WHEN event_id % 23 = 0 THEN '' WHEN event_id % 37 = 0 THEN '0' "
               "WHEN event_id % 47 = 0 THEN 'north' ELSE lat_text END",
    "geo_long": "CASE WHEN event_id % 37 = 0 THEN '0.0' ELSE lon_text END",
    "source_url": "CASE WHEN event_id % 12 = 0 THEN ' ' ELSE concat('https://news.example/', "
                  "CAST(event_id AS STRING)) END",
}


# ---------------------------------------------------------------------------------------------------------------------
# The same views as SQL
# ---------------------------------------------------------------------------------------------------------------------
def _quoted(v: str) -> str:
    return "NULL" if v == "" else "'" + v.replace("'", "''") + "'"


def _duck(sql: str) -> str:
    return sql.replace("AS STRING)", "AS VARCHAR)")


_PLACE_VALUES = ",\n    ".join(
    f"({i}, {lat}::DOUBLE, {lon}::DOUBLE, '{lat}', '{lon}', {_quoted(c)}, {_quoted(s)}, {_quoted(n)}, '{p}')"
    for i, lat, lon, c, s, n, p in _place_rows())

CTES: dict[str, tuple[list[str], str]] = {
    "places": ([], f"""SELECT * FROM (VALUES
    {_PLACE_VALUES}) t(place_id, lat, lon, lat_text, lon_text, city, state, state_name, location_precision)"""),
    "incidents": (["places"], """SELECT e.event_id AS id,
    CASE WHEN e.event_id % 50 <> 7
         THEN concat('x-', CAST(e.event_id - CASE WHEN e.event_id % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR)) END AS source_id,
    split_part(d.text, chr(10), 1) AS title,
    CASE e.event_type WHEN 'click' THEN 'protest' WHEN 'view' THEN 'unrest' WHEN 'purchase' THEN 'violence'
         WHEN 'signup' THEN 'disruption' ELSE 'riot' END AS event_type,
    p.city, p.state, p.location_precision,
    p.lat + CAST(e.event_id % 7 - 3 AS DOUBLE) / 100::DOUBLE AS latitude,
    p.lon + CAST(e.event_id % 5 - 2 AS DOUBLE) / 100::DOUBLE AS longitude,
    e.ts AS occurred_at, e.ts + INTERVAL 20 MINUTE AS ingested_at,
    CASE e.event_id % 3 WHEN 0 THEN 'gdelt' WHEN 1 THEN 'eventregistry' ELSE 'mock' END AS source_name,
    CAST(1 + e.event_id % 4 AS INTEGER) AS source_count,
    least(1::DOUBLE, 0.3::DOUBLE + CAST(json_extract_string(e.props, '$.k') AS DOUBLE) / 137::DOUBLE) AS confidence_score,
    e.value / (e.value + 20::DOUBLE) AS severity_score,
    e.event_id % 17 <> 0 AS is_active
  FROM (SELECT *, event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id FROM events) e
  LEFT JOIN documents d ON d.doc_id = e.doc_id
  LEFT JOIN places p ON p.place_id = CASE WHEN e.event_id % 3 = 0 THEN e.user_id % 24 ELSE e.doc_id % 24 END"""),
    "recent": (["incidents"], f"""SELECT *, (epoch_us({NOW_SQL}) - epoch_us(occurred_at)) / 1e6 AS age
  FROM incidents WHERE is_active AND occurred_at >= {NOW_SQL} - INTERVAL 72 HOUR"""),
    "articles": (["places"], f"""SELECT d.doc_id AS ord, d.doc_id, split_part(d.text, chr(10), 1) AS title, d.text AS body,
    {_duck(_ARTICLE_SQL['event_type'].replace('doc_id', 'd.doc_id'))} AS event_type,
    p.lat AS latitude, p.lon AS longitude, p.city, p.state, p.location_precision,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((d.doc_id * 37) % 43200 AS BIGINT)) AS occurred_at,
    {_duck(_ARTICLE_SQL['outlet'].replace('doc_id', 'd.doc_id'))} AS outlet,
    CASE WHEN d.doc_id % 9 = 0 THEN concat('https://apnews.com/a/', CAST(d.doc_id AS VARCHAR)) ELSE g.url END AS url,
    concat('eng-', CAST(d.doc_id % 50 AS VARCHAR)) AS event_uri,
    CASE d.doc_id % 6 {' '.join(f"WHEN {i} THEN {v}::VARCHAR[]" for i, v in enumerate(CATEGORY_SETS))} END AS categories,
    {CONCEPTS}[1:CAST(d.doc_id % 4 AS INTEGER)] AS concepts,
    {_duck(_ARTICLE_SQL['location'].replace('doc_id', 'd.doc_id'))} AS location,
    {_duck(_ARTICLE_SQL['date_text'].replace('doc_id', 'd.doc_id'))} AS date_text
  FROM documents d JOIN places p ON p.place_id = d.doc_id % 24
  LEFT JOIN pages g ON g.page_id = d.doc_id % (SELECT max(page_id) + 1 FROM pages)"""),
    "provenance": (["articles"], """SELECT CAST(regexp_extract(d.source, '(\\d+)$', 1) AS BIGINT) AS event_id,
    a.ord AS position, concat('er-', CAST(a.ord AS VARCHAR)) AS source_record_id, a.outlet AS source_name,
    a.url AS source_url, a.title AS source_title, a.occurred_at AS source_published_at, a.event_uri
  FROM articles a JOIN documents d ON d.doc_id = a.ord"""),
    "hourly": ([], """SELECT date_trunc('hour', ts) AS h, count(*) AS n,
    CAST(epoch_us(date_trunc('hour', ts)) // 3600000000 AS BIGINT) AS id FROM events GROUP BY ALL"""),
    "run_log": (["hourly"], """SELECT id, h AS started_at, NULL::TIMESTAMP AS finished_at, 'running' AS status,
    0::BIGINT AS events_inserted, NULL::VARCHAR AS error_message,
    CASE id % 3 WHEN 0 THEN 'gdelt' WHEN 1 THEN 'eventregistry' ELSE 'mock' END AS ingest_source FROM hourly
  UNION ALL
  SELECT id, h, h + INTERVAL 10 MINUTE, CASE WHEN n % 5 = 0 THEN 'failed' ELSE 'success' END,
    CASE WHEN n % 5 = 0 THEN 0 ELSE n END,
    CASE WHEN n % 5 = 0 THEN concat('failed after rows: ', CAST(n AS VARCHAR)) END,
    CASE id % 3 WHEN 0 THEN 'gdelt' WHEN 1 THEN 'eventregistry' ELSE 'mock' END FROM hourly WHERE n % 11 <> 0"""),
    "runs": (["run_log"], """SELECT * FROM run_log r
  WHERE status <> 'running' OR NOT EXISTS (SELECT 1 FROM run_log o WHERE o.id = r.id AND o.status <> 'running')"""),
    "export_rows": (["places"], "SELECT " + ",\n    ".join(
        f"{_duck(sql)} AS {name}" for name, sql in EXPORT_SQL.items())
        + "\n  FROM events JOIN places ON place_id = event_id % 24"),
}


def with_ctes(body: str, *names: str, **more: str) -> str:
    """SQL text: the named views and what they build on, then ``more`` in order, then ``body``."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        needs, sql = CTES[name]
        for n in needs:
            add(n)
        done.setdefault(name, sql)

    for name in names:
        add(name)
    done.update(more)
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in done.items()) + "\n" + body


def r_sql(x: str, digits: int = 3) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5::DOUBLE) / 1e{digits})"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
         f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"({2 * C.EARTH_RADIUS_MILES}::DOUBLE * asin(sqrt(least(1::DOUBLE, {a}))))"


_STOP = "[" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + "]"


def tokens_sql(text: str) -> str:
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z]{{3,}}'), "
            f"lambda w: NOT list_contains({_STOP}, w))))")


def jaccard_sql(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0::DOUBLE "
            f"ELSE CAST({shared} AS DOUBLE) / CAST(len({a}) + len({b}) - {shared} AS DOUBLE) END)")


def compatible_sql(a: str, b: str) -> str:
    whens = " ".join(f"WHEN '{t}' THEN coalesce({b}, '') IN ({', '.join(repr(o) for o in others)})"
                     for t, others in C.COMPATIBLE_TYPES.items())
    return f"(CASE {a} {whens} ELSE coalesce({a} = {b}, false) END)"
