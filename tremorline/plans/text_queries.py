"""Registered queries: tokens, lexicon hits, classification, locations, scalar look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import haversine_miles
from tremorline.functions.nested import extract_location
from tremorline.functions.plan import once
from tremorline.functions.scores import (initial_confidence, precision_passes, round3, round_to, type_severity,
                                         types_compatible, uncorroborated_cap)
from tremorline.functions.text import clip, jaccard, outlet_family, token_set, url_domain
from tremorline.functions.timefn import floor_15, parse_published
from tremorline.operators import classify as K
from tremorline.operators import vocabulary as V
from tremorline.plans.registry import query
from tremorline.plans.views import (NOW, NOW_SQL, TEST_LEXICON, articles, compatible_sql, documents, haversine_sql,
                                    incidents, jaccard_sql, places, r_sql, table, tokens_sql, with_ctes)
from tremorline.session import cut_lineage

LEX = TEST_LEXICON


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(with_ctes(f"""SELECT ord, array_to_string({tokens_sql('title')}, ' ') AS title_tokens,
  CAST(len({tokens_sql('body')}) AS BIGINT) AS body_tokens FROM articles""", "articles"))
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(
        "ord", F.array_join(token_set(F.col("title")), " ").alias("title_tokens"),
        F.size(token_set(F.col("body"))).cast("long").alias("body_tokens"))


_NEIGHBOURS = {
    "sets": f"SELECT doc_id, {tokens_sql('split_part(text, chr(10), 1)')} AS t, {tokens_sql('text')} AS b FROM documents"}


@query(with_ctes(f"""SELECT x.doc_id, {r_sql(jaccard_sql('x.t', 'y.t'), 6)} AS title_similarity,
  {r_sql(jaccard_sql('x.b', 'y.b'), 6)} AS body_similarity FROM sets x JOIN sets y ON y.doc_id = x.doc_id + 1""", **_NEIGHBOURS))
def title_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each document to the next one, by headline and by whole text."""
    def hashed(text: str) -> Column:
        return F.transform(token_set(F.col(text)), lambda w: F.xxhash64(w))

    # Each text is split once; its hashed words go to its own pair and to that of the document before.
    sets = documents(spark, sf_dir).select("doc_id", hashed("title").alias("t"), hashed("text").alias("b"))
    both = F.explode(F.array(F.struct(F.col("doc_id").alias("pair"), F.lit(0).alias("side")),
                             F.struct((F.col("doc_id") - 1).alias("pair"), F.lit(1).alias("side"))))
    sent = sets.select(both.alias("p"), "t", "b").select("p.pair", "p.side", "t", "b")
    one, two = ([F.first(F.when(F.col("side") == s, F.col(c)), ignorenulls=True) for c in ("t", "b")] for s in (0, 1))
    met = sent.groupBy("pair").agg(one[0].alias("t"), one[1].alias("b"), two[0].alias("t2"), two[1].alias("b2"))
    return met.where("t is not null and t2 is not null").select(
        F.col("pair").alias("doc_id"), round_to(jaccard(F.col("t"), F.col("t2")), 6).alias("title_similarity"),
        round_to(jaccard(F.col("b"), F.col("b2")), 6).alias("body_similarity"))


_CAT = (f"(CASE WHEN len(list_filter(categories, lambda c: regexp_matches(lower(c), '{'|'.join(C.CATEGORY_FRAGMENTS)}'))) > 0 "
        "THEN 0.2::DOUBLE ELSE 0::DOUBLE END)")
_CON = ("least(0.3::DOUBLE, CAST(len(list_filter(concepts, lambda c: regexp_matches(lower(c), "
        f"'{'|'.join(C.CONCEPT_FRAGMENTS)}'))) AS DOUBLE) * 0.1::DOUBLE)")
_EXCLUDED_CATS = ("(len(categories) > 0 AND len(list_filter(categories, lambda c: NOT regexp_matches(lower(c), "
                  f"'{'|'.join(C.EXCLUDED_DOMAINS)}'))) = 0)")
_OPINION = f"regexp_matches(title, '(?i)^({'|'.join(LEX.opinion_openers)})[\\s:,–—]')"
_WEATHER = (f"(len(list_intersect(title_tokens, {_list(LEX.weather_tokens)})) > 0 "
            f"AND len(list_intersect(title_tokens, {_list(LEX.weather_exempt)})) = 0)")
_ACCIDENT = (f"(regexp_matches(lower(title), '{'|'.join(LEX.accident_phrases)}') "
             f"AND NOT regexp_matches(lower(title), '{'|'.join(LEX.accident_exempt)}'))")

_LEX = {
    "toks": f"SELECT *, {tokens_sql('title')} AS title_tokens, {tokens_sql('body')} AS body_tokens FROM articles",
    "lex_phrases": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{p}', '{t}', {s}::DOUBLE)" for i, (p, t, s) in enumerate(LEX.phrases)) + ") t(idx, phrase, kind, base)",
    "lex_tokens": "SELECT * FROM (VALUES " + ", ".join(
        f"({i + len(LEX.phrases)}, '{w}', '{t}', {s}::DOUBLE)" for i, (w, t, s) in enumerate(LEX.tokens))
        + ") t(idx, token, kind, base)",
    "phrase_hits": """SELECT ord, idx, kind, phrase, contains(lower(title), phrase) AS in_title,
      CASE WHEN contains(lower(title), phrase) THEN base ELSE base * 0.7::DOUBLE END AS score
      FROM toks, lex_phrases WHERE contains(lower(title), phrase) OR contains(lower(body), phrase)""",
    "title_hits": """SELECT ord, idx, kind, token, base AS score FROM toks, lex_tokens
      WHERE list_contains(title_tokens, token)""",
    "boosts": f"SELECT ord, {_CAT} AS cat, {_CON} AS con FROM articles",
    "body_hits": f"""SELECT ord, idx + {len(LEX.tokens)} AS idx, kind, token, base * 0.55::DOUBLE AS score
      FROM toks JOIN boosts USING (ord), lex_tokens WHERE list_contains(body_tokens, token) AND cat + con > 0
      AND ord NOT IN (SELECT ord FROM phrase_hits) AND ord NOT IN (SELECT ord FROM title_hits)""",
}


@query(with_ctes("""SELECT ord, phrase, in_title, floor(score * 1e6 + 0.5::DOUBLE) / 1e6 AS score FROM phrase_hits""",
                 "articles", **_LEX))
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).filter("at < {}".format(len(LEX.phrases))).select(
        "ord", F.col("word").alias("phrase"), "in_title", round_to(F.col("score"), 6).alias("score"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article and vocabulary entry that scored."""
    a = articles(spark, sf_dir)
    boosted = (K.category_boost(F.col("categories"), LEX) > 0) | (K.concept_boost(F.col("concepts"), LEX) > 0)
    scored = K.lexicon_hits(a, LEX, "title", "body", boosted)
    words = F.array(*[F.lit(w) for w, _, _ in [*LEX.phrases, *LEX.tokens, *LEX.tokens]])
    return (scored.select("ord", "_low_title", F.explode("_hits").alias("hit"))
            .select("ord", "_low_title", (-F.col("hit.order")).alias("at"), "hit.score")
            .select("ord", "at", F.get(words, F.col("at")).alias("word"), "score",
                    F.col("_low_title").contains(F.get(words, F.col("at"))).alias("in_title")))


@query(with_ctes("""SELECT ord, token, true AS in_title, floor(score * 1e6 + 0.5::DOUBLE) / 1e6 AS score FROM title_hits
UNION ALL SELECT ord, token, false, floor(score * 1e6 + 0.5::DOUBLE) / 1e6 FROM body_hits""", "articles", **_LEX))
def token_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = len(LEX.phrases), len(LEX.tokens)
    return _hits(spark, sf_dir).filter(F.col("at") >= n).select(
        "ord", F.col("word").alias("token"), (F.col("at") < n + k).alias("in_title"),
        round_to(F.col("score"), 6).alias("score"))


_STRICT_PHRASES = {t: [p for p, k, _ in LEX.phrases if k == t] for t in LEX.needs_support}
_IN_TITLE = " OR ".join(
    f"(kind = '{t}' AND ({' OR '.join(f'contains(lower(title), {p!r})' for p in ps) or 'false'}))"
    for t, ps in _STRICT_PHRASES.items())


CLASSIFIED = {**_LEX, "classified": f"""SELECT ord, CASE WHEN weak THEN 'unrest' ELSE kind END AS class_type,
    CASE WHEN weak THEN least(total, 0.6::DOUBLE) ELSE total END AS class_score FROM (
  SELECT b.ord, b.kind, least(1::DOUBLE, b.score + (s.cat + s.con)) AS total,
    b.kind IN ('vandalism_tied_to_unrest', 'crowd_disruption') AND NOT ({_IN_TITLE}) AND s.cat = 0 AND s.con = 0 AS weak
  FROM (SELECT ord, kind, max(score) AS score, min(idx) AS first FROM (
      SELECT ord, kind, idx, score FROM phrase_hits UNION ALL SELECT ord, kind, idx, score FROM title_hits
      UNION ALL SELECT ord, kind, idx, score FROM body_hits) GROUP BY ord, kind
    QUALIFY row_number() OVER (PARTITION BY ord ORDER BY max(score) DESC, min(idx)) = 1) b
  JOIN boosts s USING (ord) JOIN toks t USING (ord)
  WHERE title <> '' AND NOT ({_OPINION} OR {_EXCLUDED_CATS} OR {_WEATHER} OR {_ACCIDENT}))
  WHERE total >= 0.6::DOUBLE"""}


@query(with_ctes("SELECT ord, class_type, floor(class_score * 1e6 + 0.5::DOUBLE) / 1e6 AS class_score FROM classified",
                 "articles", **CLASSIFIED))
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.classify(articles(spark, sf_dir), LEX).filter("class_type is not null")
    return out.select("ord", "class_type", round_to(F.col("class_score"), 6).alias("class_score"))


@query(with_ctes("SELECT ord, class_type, floor(class_score * 1e6 + 0.5::DOUBLE) / 1e6 AS class_score FROM classified",
                 "articles", **CLASSIFIED))
def classify_by_vocabulary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same classification with phrases and words as tables."""
    out = V.classify_by_table(articles(spark, sf_dir), V.entries(spark, LEX.phrases), V.entries(spark, LEX.tokens), LEX)
    return out.filter("class_type is not null").select("ord", "class_type", round_to(F.col("class_score"), 6).alias("class_score"))


@query(with_ctes("""SELECT phrase, count(*) AS articles, count(*) FILTER (contains(lower(title), phrase)) AS titles
  FROM (SELECT DISTINCT lower(regexp_extract(text, '^\\S+ \\S+ \\S+')) AS phrase FROM documents) p JOIN articles a
    ON phrase <> '' AND (contains(lower(title), phrase) OR contains(lower(body), phrase)) GROUP BY phrase""", "articles"))
def vocabulary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary as large as the corpus: the first three words of every document, sought in all articles."""
    opening = F.lower(F.regexp_extract("text", r"^\S+ \S+ \S+", 0))
    phrases = (table(spark, sf_dir, "documents").select(opening.alias("word")).distinct()
               .select(F.monotonically_increasing_id().alias("at"), "word", F.lit("").alias("kind"), F.lit(1.0).alias("score")))
    phrases = cut_lineage(phrases)
    texts = cut_lineage(articles(spark, sf_dir).select(
        F.col("ord").alias("_row"), F.lower("title").alias("_front"), F.lower(F.coalesce("body", F.lit(""))).alias("_behind")))
    found = V.phrase_matches(texts, phrases).groupBy("at").agg(
        F.count("*").alias("articles"), F.count_if("front").alias("titles"))
    return found.join(phrases, "at").select(F.col("word").alias("phrase"), "articles", "titles")


@query(with_ctes(f"""SELECT ord, {_OPINION} AS opinion, {_EXCLUDED_CATS} AS other_domain, {_WEATHER} AS weather,
  {_ACCIDENT} AS accident FROM toks""", "articles", toks=_LEX["toks"]))
def hard_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(
        "ord", K.opinion_title(F.col("title"), LEX).alias("opinion"),
        K.only_excluded_categories(F.col("categories"), LEX).alias("other_domain"),
        K.weather_title(token_set(F.col("title")), LEX).alias("weather"),
        K.accident_title(F.col("title"), LEX).alias("accident"))


@query(with_ctes(f"SELECT ord, {r_sql('cat')} AS category_boost, {r_sql('con')} AS concept_boost FROM boosts", "articles",
                 boosts=_LEX["boosts"]))
def category_concept_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(
        "ord", round3(K.category_boost(F.col("categories"), LEX)).alias("category_boost"),
        round3(K.concept_boost(F.col("concepts"), LEX)).alias("concept_boost"))


_DOMAIN = "regexp_replace(lower(regexp_extract({0}, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)), '^www\\.', '')"


@query(f"SELECT page_id, url, {_DOMAIN.format('url')} AS domain FROM pages")
def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", url_domain(F.col("url")).alias("domain"))


_FAMILY = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(outlet), '{p}')" for p in parts) + f" THEN '{f}'"
    for f, parts in C.WIRE_FAMILIES.items()) + " END"


@query(with_ctes(f"SELECT outlet, {_FAMILY} AS family, count(*) AS articles FROM articles GROUP BY ALL", "articles"))
def outlet_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).groupBy("outlet", outlet_family(F.col("outlet")).alias("family")).agg(
        F.count("*").alias("articles"))


@query(with_ctes(f"""SELECT i.id, p.place_id, {r_sql(haversine_sql('i.latitude', 'i.longitude', 'p.lat', 'p.lon'), 4)} AS miles
FROM incidents i JOIN places p ON p.place_id = i.id % 24""", "incidents"))
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = incidents(spark, sf_dir).withColumn("place_id", F.col("id") % 24)
    return ev.join(places(spark).select("place_id", "lat", "lon"), "place_id").select("id", "place_id", round_to(
        haversine_miles(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")), 4).alias("miles"))


@query(with_ctes(f"""SELECT a.event_type AS article_type, i.event_type AS incident_type,
  {compatible_sql('a.event_type', 'i.event_type')} AS compatible, count(*) AS pairs
FROM incidents i JOIN articles a ON a.ord = i.id % (SELECT max(doc_id) + 1 FROM documents) GROUP BY 1, 2, 3""",
                 "incidents", "articles"))
def type_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of incidents and of the articles whose headline they share."""
    n = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n")).scalar()
    a = articles(spark, sf_dir).select("ord", F.col("event_type").alias("article_type"))
    i = incidents(spark, sf_dir).select((F.col("id") % n).alias("ord"), F.col("event_type").alias("incident_type"))
    return i.join(a, "ord").groupBy("article_type", "incident_type").agg(F.count("*").alias("pairs")).withColumn(
        "compatible", types_compatible(F.col("article_type"), F.col("incident_type")))


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("""SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS quarter, event_type, count(*) AS event_count
FROM events GROUP BY ALL""")
def floor15_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(floor_15(F.col("ts").cast("timestamp")).alias("q"), "event_type").agg(
        F.count("*").alias("event_count")).select(_ts("q").alias("quarter"), "event_type", "event_count")


@query(with_ctes(f"""SELECT ord, strftime(coalesce(CASE WHEN contains(date_text, 'T')
    THEN try_cast(regexp_replace(date_text, '(Z|[+-]\\d{{2}}:?\\d{{2}})$', '') AS TIMESTAMP)
    ELSE try_strptime(substring(date_text, 1, 10), '%Y-%m-%d') + INTERVAL 12 HOUR END, {NOW_SQL}), '%Y-%m-%d %H:%M:%S')
  AS published FROM articles""", "articles"))
def published_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("ord", _ts(parse_published(F.col("date_text"), NOW)).alias("published"))


_STATE_CODE = ("CASE {0} " + " ".join(f"WHEN '{n}' THEN '{a}'" for n, a in C.STATE_ABBREVIATION.items())
               + " ELSE CASE WHEN length({0}) = 2 THEN {0} END END")
_CENTROID_LAT = "CASE state " + " ".join(f"WHEN '{a}' THEN {v[0]}::DOUBLE" for a, v in C.STATE_CENTROID.items()) + " END"
_CENTROID_LON = "CASE state " + " ".join(f"WHEN '{a}' THEN {v[1]}::DOUBLE" for a, v in C.STATE_CENTROID.items()) + " END"
LOCATED = {
    "parsed": """SELECT ord, location,
      coalesce(json_extract_string(location, '$.type.type'),
        CASE WHEN json_extract_string(location, '$.type') NOT LIKE '{%' THEN json_extract_string(location, '$.type') END, '') AS kind,
      string_split(coalesce(json_extract_string(location, '$.label.eng'),
        CASE WHEN json_extract_string(location, '$.label') NOT LIKE '{%' THEN json_extract_string(location, '$.label') END, ''), ',')
        AS raw_parts,
      try_cast(json_extract_string(location, '$.lat') AS DOUBLE) AS lat,
      try_cast(json_extract_string(location, '$.long') AS DOUBLE) AS lon FROM articles WHERE location IS NOT NULL""",
    "split": """SELECT *, CASE kind WHEN 'place' THEN 'venue' WHEN 'city' THEN 'city' WHEN 'admin' THEN 'state'
        WHEN 'admin1' THEN 'state' WHEN 'admin2' THEN 'state' ELSE 'city' END AS stated,
      CASE WHEN len(raw_parts) > 1 AND contains(lower(raw_parts[-1]), 'united states')
        THEN list_transform(raw_parts[:-2], lambda p: trim(p)) ELSE list_transform(raw_parts, lambda p: trim(p)) END AS parts
      FROM parsed""",
    "named": f"""SELECT *, CASE WHEN stated = 'state' THEN {_STATE_CODE.format('parts[1]')}
        WHEN len(parts) >= 2 THEN {_STATE_CODE.format('parts[-1]')} END AS state,
      CASE WHEN stated <> 'state' THEN parts[1] END AS city FROM split""",
    "located": f"""SELECT ord, city, state, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN stated ELSE 'state' END AS precision,
      CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat ELSE {_CENTROID_LAT} END AS latitude,
      CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon ELSE {_CENTROID_LON} END AS longitude
      FROM named WHERE kind <> 'country'""",
}


@query(with_ctes("""SELECT ord, latitude, longitude, city, state, precision FROM located
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)""", "articles", **LOCATED))
def article_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = once(articles(spark, sf_dir).select("ord", "location"), "place", extract_location(F.col("location")))
    return place.filter("place is not null").select("ord", "place.*")


@query(with_ctes("""SELECT precision, minimum, count(*) AS articles,
  coalesce(r.rank, 99) <= coalesce(m.rank, 99) AS passes
FROM located CROSS JOIN (VALUES ('venue'), ('city'), ('state'), ('country'), ('region')) g(minimum)
LEFT JOIN (VALUES ('venue', 0), ('city', 1), ('state', 2), ('country', 3)) r(name, rank) ON r.name = precision
LEFT JOIN (VALUES ('venue', 0), ('city', 1), ('state', 2), ('country', 3)) m(name, rank) ON m.name = minimum
WHERE latitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0) GROUP BY ALL""", "articles", **LOCATED))
def precision_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = article_location(spark, sf_dir).withColumn(
        "minimum", F.explode(F.array(*[F.lit(m) for m in [*C.PRECISIONS, "region"]])))
    return found.groupBy("precision", "minimum").agg(F.count("*").alias("articles")).withColumn(
        "passes", precision_passes(F.col("precision"), F.col("minimum")))


_BONUS = "CASE location_precision WHEN 'venue' THEN 0.12::DOUBLE WHEN 'city' THEN 0.08::DOUBLE ELSE 0::DOUBLE END"
_CAP = "CASE location_precision WHEN 'venue' THEN 0.62::DOUBLE WHEN 'city' THEN 0.58::DOUBLE ELSE 0.45::DOUBLE END"
_SEVERITY = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN {s}::DOUBLE" for t, s in C.TYPE_SEVERITY.items()) + " ELSE 0.5::DOUBLE END"


@query(with_ctes(f"""SELECT id, {r_sql(f'greatest(0.15::DOUBLE, least(1::DOUBLE, 0.3::DOUBLE + 0.2::DOUBLE * severity_score + {_BONUS}))')}
    AS initial_confidence,
  {r_sql(f'least(confidence_score, {_CAP}, 0.58::DOUBLE)')} AS capped,
  {r_sql(f'least(confidence_score, {_CAP}, 0.4::DOUBLE)')} AS tightened, {_SEVERITY} AS type_severity FROM incidents""",
                 "incidents"))
def uncorroborated_cap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    precision, confidence = F.col("location_precision"), F.col("confidence_score")
    return incidents(spark, sf_dir).select(
        "id", initial_confidence(F.col("severity_score"), precision).alias("initial_confidence"),
        uncorroborated_cap(confidence, precision).alias("capped"),
        uncorroborated_cap(confidence, precision, 0.4).alias("tightened"),
        type_severity(F.col("event_type")).alias("type_severity"))


@query("""SELECT doc_id, nullif(trim(substring(text, 1, 500)), '') AS summary FROM documents""")
def article_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clip(F.col("text"), C.SUMMARY_CHARS).alias("summary"))
