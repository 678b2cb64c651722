"""Registered queries: exact duplicates, matching, syndication, corroboration, discovery."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tremorline.functions import constants as C
from tremorline.functions.scores import round3, round_to
from tremorline.operators import corroboration as R
from tremorline.operators.dedup import exact_dedup
from tremorline.operators.discovery import discover_novel as discover
from tremorline.operators.matching import best_match as match
from tremorline.operators.syndication import RULES, syndication_rules
from tremorline.plans.registry import query
from tremorline.plans.text_queries import _CAP, _DOMAIN, _FAMILY, CLASSIFIED, LOCATED
from tremorline.plans.views import (NOW, NOW_SQL, TEST_LEXICON, articles, compatible_sql, haversine_sql, incidents, jaccard_sql,
                                    provenance, r_sql, raw_articles, tokens_sql, with_ctes)
from tremorline.schemas import EVENT, conform
from tremorline.session import cut_lineage, shared_dir
from tremorline.streaming import live


@query(with_ctes("""SELECT id, source_id FROM incidents n WHERE occurred_at >= TIMESTAMP '2024-01-16 00:00:00'
  AND (source_id IS NULL OR (NOT EXISTS (SELECT 1 FROM incidents s WHERE s.occurred_at < TIMESTAMP '2024-01-16 00:00:00'
      AND s.source_id = n.source_id)
    AND id = (SELECT min(b.id) FROM incidents b WHERE b.occurred_at >= TIMESTAMP '2024-01-16 00:00:00'
      AND b.source_id = n.source_id)))""", "incidents"))
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the month as a batch against the first half."""
    ev = incidents(spark, sf_dir).select("id", "source_id", "occurred_at")
    middle = F.lit("2024-01-16").cast("timestamp")
    fresh = exact_dedup(ev.filter(F.col("occurred_at") >= middle), ev.filter(F.col("occurred_at") < middle), ["id"])
    return fresh.select("id", "source_id")


def match_sql(hours: float, miles: float, threshold: float) -> dict[str, str]:
    distance = haversine_sql("a.latitude", "a.longitude", "e.latitude", "e.longitude")
    return {
        "a_set": f"SELECT *, {tokens_sql('title')} AS tok FROM articles",
        "e_set": f"SELECT *, {tokens_sql('title')} AS tok FROM incidents WHERE is_active",
        "near": f"""SELECT a.ord, e.id AS event_id, {distance} AS miles, {jaccard_sql('a.tok', 'e.tok')} AS sim,
          abs(epoch_us(a.occurred_at) - epoch_us(e.occurred_at)) / 1e6 / 3600::DOUBLE AS apart,
          {compatible_sql('a.event_type', 'e.event_type')} AS ok
          FROM a_set a JOIN e_set e ON e.occurred_at BETWEEN a.occurred_at - to_hours({int(hours)})
            AND a.occurred_at + to_hours({int(hours)}) WHERE {distance} <= {float(miles)}::DOUBLE""",
        "pairs": f"""SELECT *, 0.5::DOUBLE * sim + 0.3::DOUBLE * greatest(0::DOUBLE, 1::DOUBLE - apart / {float(hours)}::DOUBLE)
            + 0.2::DOUBLE * greatest(0::DOUBLE, 1::DOUBLE - miles / {float(miles)}::DOUBLE) AS score FROM near
          WHERE sim >= CASE WHEN ok THEN {threshold}::DOUBLE ELSE {threshold}::DOUBLE + 0.2::DOUBLE END""",
        "best": """SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY ord ORDER BY score DESC, event_id) = 1""",
    }


_BEST_COLUMNS = f"""ord, event_id, {r_sql('sim', 6)} AS similarity, {r_sql('apart', 6)} AS hours_apart,
  {r_sql('miles', 4)} AS distance_miles, {r_sql('score', 6)} AS score"""


def _rounded(best: DataFrame) -> DataFrame:
    return best.select("ord", "event_id", round_to(F.col("similarity"), 6).alias("similarity"),
                       round_to(F.col("hours_apart"), 6).alias("hours_apart"),
                       round_to(F.col("distance_miles"), 4).alias("distance_miles"),
                       round_to(F.col("score"), 6).alias("score"))


@query(with_ctes(f"SELECT {_BEST_COLUMNS} FROM best", "incidents", "articles", **match_sql(48, 50, 0.4)))
def match_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best incident per article with the default gates."""
    return _rounded(match(articles(spark, sf_dir), incidents(spark, sf_dir)))


@query(with_ctes(f"SELECT {_BEST_COLUMNS} FROM best", "incidents", "articles", **match_sql(96, 250, 0.25)))
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best incident per article with wide gates, where most articles have many candidates."""
    return _rounded(match(articles(spark, sf_dir), incidents(spark, sf_dir), 96, 250.0, 0.25))


_FIRST = {
    "src": f"""SELECT *, nullif(lower(source_name), '') AS low, {_FAMILY.replace('outlet', 'source_name')} AS family,
      {_DOMAIN.format('source_url')} AS domain, {tokens_sql('source_title')} AS tok FROM provenance""",
    "verdicts": f"""SELECT n.event_id, n.position,
      coalesce(bool_or(e.low = n.low), false) AS same_outlet,
      coalesce(bool_or(e.family = n.family), false) AS same_family,
      coalesce(bool_or({jaccard_sql('e.tok', 'n.tok')} > 0.85::DOUBLE), false) AS near_identical_title,
      coalesce(bool_or(e.domain = n.domain AND n.domain IN ('apnews.com', 'reuters.com', 'upi.com')), false) AS same_wire_domain,
      coalesce(bool_or(abs(epoch_us(e.source_published_at) - epoch_us(n.source_published_at)) <= 1800000000
        AND {jaccard_sql('e.tok', 'n.tok')} > 0.7::DOUBLE), false) AS rapid_rewrite,
      coalesce(bool_or(e.family = n.family AND e.event_uri = n.event_uri), false) AS same_upstream_event
      FROM src n LEFT JOIN src e ON e.event_id = n.event_id AND e.position < n.position GROUP BY ALL""",
}


@query(with_ctes(f"SELECT event_id, position, {', '.join(RULES)} FROM verdicts", "provenance", **_FIRST))
def syndication_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syndication_rules(provenance(spark, sf_dir)).select("event_id", "position", *RULES)


@query(with_ctes(f"SELECT event_id, count(*) AS sources, count(*) FILTER ({' OR '.join(RULES)}) AS syndicated FROM verdicts GROUP BY 1",
                 "provenance", **_FIRST))
def syndicated_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syndication_rules(provenance(spark, sf_dir)).groupBy("event_id").agg(
        F.count("*").alias("sources"), F.count_if("is_syndicated").alias("syndicated"))


_JUDGED = {"counts": f"""SELECT event_id, count(*) FILTER (NOT ({' OR '.join(RULES)})) AS independent,
  count(*) FILTER ({' OR '.join(RULES)}) AS syndicated FROM verdicts GROUP BY 1"""}


@query(with_ctes("SELECT * FROM counts", "provenance", **_FIRST, **_JUDGED))
def corroboration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = syndication_rules(provenance(spark, sf_dir))
    return R.corroboration_counts(R.provenance_rows(judged, "2024-01-31"))


@query(with_ctes(f"""SELECT id, source_count + coalesce(independent, 0) AS source_count,
  {r_sql('CASE WHEN coalesce(independent, 0) > 0 THEN ' + r_sql('least(1::DOUBLE, confidence_score + 0.08::DOUBLE * independent)') + ' ELSE confidence_score END', 6)}
  AS confidence_score FROM incidents LEFT JOIN counts ON event_id = id""", "incidents", "provenance", **_FIRST, **_JUDGED))
def corroboration_uplift(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = syndication_rules(provenance(spark, sf_dir))
    counts = R.corroboration_counts(R.provenance_rows(judged, "2024-01-31"))
    out = R.apply_corroboration(incidents(spark, sf_dir), counts)
    return out.select("id", F.col("source_count").cast("long").alias("source_count"),
                      round_to(F.col("confidence_score"), 6).alias("confidence_score"))


@query(with_ctes(f"""SELECT p.event_id, 'eventregistry' AS source_type, p.source_record_id, p.source_name,
  CASE WHEN {' OR '.join('v.' + r for r in RULES)} THEN 0::DOUBLE ELSE 1::DOUBLE END AS source_trust_weight,
  '2024-01-31' AS created_on FROM provenance p JOIN verdicts v USING (event_id, position)""", "provenance", **_FIRST))
def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.provenance_rows(syndication_rules(provenance(spark, sf_dir)), "2024-01-31")
    return rows.select("event_id", "source_type", "source_record_id", "source_name", "source_trust_weight",
                       F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


@query(with_ctes("""SELECT ord, rank FROM (SELECT ord, row_number() OVER (ORDER BY ord) AS rank FROM articles
  WHERE ord NOT IN (SELECT ord FROM best)) WHERE rank <= 10""", "incidents", "articles", **match_sql(48, 50, 0.4)))
def discovery_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten articles, in feed order, that match no stored incident."""
    from pyspark.sql import Window

    a = articles(spark, sf_dir)
    unmatched = a.join(match(a, incidents(spark, sf_dir)).select("ord"), "ord", "left_anti").select("ord")
    first = unmatched.orderBy("ord").limit(C.MAX_NEW_EVENTS)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("ord")).cast("long"))


def _discovery_sql(cap: int | None) -> str:
    """The rule taken literally: articles one by one, each with the list of those that have opened."""
    distance = haversine_sql("a.latitude", "a.longitude", "l.latitude", "l.longitude")
    gates = f"""abs(epoch_us(a.occurred_at) - epoch_us(l.occurred_at)) <= 48 * 3600000000 AND {distance} <= 50::DOUBLE
      AND {jaccard_sql('a.tok', 'l.tok')} >= CASE WHEN {compatible_sql('a.event_type', 'l.event_type')} THEN 0.4::DOUBLE
      ELSE 0.4::DOUBLE + 0.2::DOUBLE END"""
    full = "" if cap is None else f" OR len(opened) >= {cap}"
    more = {
        "waiting": "SELECT * FROM a_set WHERE ord NOT IN (SELECT ord FROM best)",
        "heard": f"SELECT a.ord, list(l.ord) AS others FROM waiting a JOIN waiting l ON l.ord < a.ord AND {gates} GROUP BY a.ord",
        "queue": """SELECT row_number() OVER (ORDER BY ord) AS i, ord, coalesce(others, []) AS others
          FROM waiting LEFT JOIN heard USING (ord)""",
        "leaders": f"""SELECT ord, (SELECT max(id) FROM incidents) + row_number() OVER (ORDER BY ord) AS id FROM (
          WITH RECURSIVE walk(i, opened) AS (
            SELECT 0::BIGINT, []::BIGINT[] UNION ALL
            SELECT q.i, CASE WHEN list_has_any(q.others, opened){full} THEN opened ELSE list_append(opened, q.ord) END
            FROM walk JOIN queue q ON q.i = walk.i + 1)
          SELECT unnest(opened) AS ord FROM (SELECT opened FROM walk ORDER BY i DESC LIMIT 1))""",
        "led": f"""SELECT a.ord, l.id AS event_id, 0.5::DOUBLE * {jaccard_sql('a.tok', 'l.tok')} + 0.3::DOUBLE * greatest(0::DOUBLE,
            1::DOUBLE - abs(epoch_us(a.occurred_at) - epoch_us(l.occurred_at)) / 1e6 / 3600::DOUBLE / 48::DOUBLE)
            + 0.2::DOUBLE * greatest(0::DOUBLE, 1::DOUBLE - {distance} / 50::DOUBLE) AS score
          FROM a_set a JOIN (SELECT w.*, d.id FROM waiting w JOIN leaders d USING (ord)) l ON a.ord > l.ord AND {gates}""",
        "final": """SELECT ord, event_id FROM (SELECT ord, event_id, score FROM best UNION ALL SELECT * FROM led)
          QUALIFY row_number() OVER (PARTITION BY ord ORDER BY score DESC, event_id) = 1""",
    }
    shown = r_sql(f"least(0.5::DOUBLE, {_CAP}, 0.58::DOUBLE)")
    return with_ctes(f"""SELECT l.id, l.ord, w.title, {shown} AS confidence_score,
      (SELECT count(*) FROM final f WHERE f.event_id = l.id) AS matched FROM leaders l JOIN waiting w USING (ord)""",
                     "incidents", "articles", **match_sql(48, 50, 0.4), **more)


def _discovered(spark: SparkSession, sf_dir: str, cap: int | None) -> DataFrame:
    leaders, matches = discover(articles(spark, sf_dir), incidents(spark, sf_dir), cap)
    counts = matches.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("matched"))
    return leaders.join(counts, "id", "left").select(
        "id", "ord", "title", round3(F.col("confidence_score")).alias("confidence_score"),
        F.coalesce("matched", F.lit(0).cast("long")).alias("matched"))


@query(_discovery_sql(C.MAX_NEW_EVENTS))
def discover_novel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents opened by a run over all articles with the default bound, and how many articles each then matched."""
    return _discovered(spark, sf_dir, C.MAX_NEW_EVENTS)


@query(_discovery_sql(None))
def discover_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a bound on the number of new incidents."""
    return _discovered(spark, sf_dir, None)


@query(with_ctes("SELECT * FROM counts", "provenance", **_FIRST, **_JUDGED))
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged sources arrive in four batches, one of them twice; base and open batches add up to the whole."""
    store = live.Store(f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    judged = cut_lineage(R.provenance_rows(syndication_rules(provenance(spark, sf_dir)), "2024-01-31"))
    for batch in (1, 2, 2, 3, 4):
        own = judged.where(F.pmod(F.xxhash64("source_url", "source_title"), F.lit(4)) == batch - 1)
        store.counts.add(R.corroboration_counts(own), batch)
        if batch == 3:
            store.counts.merge(spark)
    return live.summed_counts(store.counts.read(spark))


_FED = {
    "norm": f"""SELECT row_number() OVER (ORDER BY occurred_at DESC, source_id, title) AS ord, * FROM (
      SELECT concat('er-', CAST(a.ord AS VARCHAR)) AS source_id, trim(a.title) AS title, c.class_type AS event_type, l.latitude,
        l.longitude, coalesce(CASE WHEN contains(a.date_text, 'T')
            THEN try_cast(regexp_replace(a.date_text, '(Z|[+-]\\d{{2}}:?\\d{{2}})$', '') AS TIMESTAMP)
          ELSE try_strptime(substring(a.date_text, 1, 10), '%Y-%m-%d') + INTERVAL 12 HOUR END, {NOW_SQL}) AS occurred_at,
        nullif(trim(a.url), '') AS source_url, a.event_uri, a.outlet
      FROM articles a JOIN classified c USING (ord) JOIN located l USING (ord)
      WHERE l.latitude IS NOT NULL AND l.longitude IS NOT NULL AND NOT (l.latitude = 0 AND l.longitude = 0))""",
    **match_sql(48, 50, 0.4),
    "a_set": f"SELECT *, {tokens_sql('title')} AS tok FROM norm",
    "provenance": """SELECT b.event_id, n.ord AS position, n.source_id AS source_record_id, n.outlet AS source_name, n.source_url,
      n.title AS source_title, n.occurred_at AS source_published_at, n.event_uri FROM norm n JOIN best b USING (ord)""",
    **_FIRST,
}


@query(with_ctes(f"""SELECT event_id, source_record_id, source_name,
  CASE WHEN {' OR '.join('v.' + r for r in RULES)} THEN 0::DOUBLE ELSE 1::DOUBLE END AS source_trust_weight
  FROM provenance p JOIN verdicts v USING (event_id, position)""", "incidents", "articles", **CLASSIFIED, **LOCATED, **_FED))
def stream_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles land and run through the feed against stored incidents: classified, matched, judged, recorded."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store = live.Store(f"{root}/store")
    store.write_batch(conform(incidents(spark, sf_dir), EVENT, {"country": "US"}), "events", C.CODED_FEED, 0)
    raw_articles(spark, sf_dir).drop("ord").write.json(f"{root}/landed", compression="gzip")
    live.run_article_feed(spark, f"{root}/landed", store, NOW, TEST_LEXICON, min_precision="state")
    return store.sources(spark).select("event_id", "source_record_id", "source_name", "source_trust_weight")
