"""News articles: nested JSON, one article per line or pages of articles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from tremorline.functions import constants as C
from tremorline.functions.nested import extract_location, first_labels, payload
from tremorline.functions.plan import once
from tremorline.functions.scores import initial_confidence, precision_passes, round3, type_severity
from tremorline.functions.text import clip, empty_to_null
from tremorline.functions.timefn import parse_published
from tremorline.operators.classify import DEFAULT_LEXICON, Lexicon, classify
from tremorline.schemas import ARTICLE

PAGE = T.StructType([T.StructField("articles", T.StructType([T.StructField("results", T.ArrayType(ARTICLE))]))])


def read_articles(spark: SparkSession, path: str | list[str], pages: bool = False) -> DataFrame:
    """Landed article files.  With ``pages`` each document wraps a list of articles."""
    if pages:
        wrapped = spark.read.schema(PAGE).option("multiLine", True).json(path)
        return wrapped.select(F.explode("articles.results").alias("a")).select("a.*")
    return spark.read.schema(ARTICLE).json(path)


def stream_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ARTICLE).json(path)


def normalize_articles(articles: DataFrame, now: datetime | str | Column, lexicon: Lexicon = DEFAULT_LEXICON,
                       min_score: float = C.MIN_SCORE, min_precision: str = "city",
                       summary_chars: int | None = C.SUMMARY_CHARS, labels: int | None = C.CATEGORY_LABELS) -> DataFrame:
    """Canonical rows of the articles that classify, have a usable place and are precise enough.

    Besides the canonical columns: ``outlet``, ``event_uri`` and every other input column not named in the article
    schema (such as the feed position ``ord``).  ``summary_chars`` and ``labels`` (of categories, in the payload) bound
    what is kept of an article; None keeps all.
    """
    extra = [c for c in articles.columns if c not in ARTICLE.fieldNames()]
    clean = articles.withColumns({
        "title": F.trim(F.coalesce("title", F.lit(""))), "body": F.trim(F.coalesce("body", F.lit(""))),
        "categories": F.coalesce("categories", F.array().cast(ARTICLE["categories"].dataType)),
        "concepts": F.coalesce("concepts", F.array().cast(ARTICLE["concepts"].dataType)),
    }).filter(F.length("title") > 0)
    located = once(clean, "_place", extract_location(F.col("location"))).filter(
        F.col("_place").isNotNull() & precision_passes(F.col("_place.precision"), min_precision))
    placed = located.withColumns({
        "latitude": F.col("_place.latitude"), "longitude": F.col("_place.longitude"), "city": F.col("_place.city"),
        "state": F.col("_place.state"), "location_precision": F.col("_place.precision")})
    classified = classify(placed, lexicon, min_score).filter(F.col("class_type").isNotNull())
    uri = F.trim(F.coalesce("uri", F.lit("")))
    outlet = empty_to_null(F.trim("source.title"))
    published = F.coalesce(empty_to_null(F.col("dateTimePub")), F.col("date"))
    return classified.select(
        *extra, F.concat(F.lit(C.ARTICLE_ID_PREFIX), empty_to_null(uri)).alias("source_id"), "title",
        clip(F.col("body"), summary_chars).alias("summary"), F.col("class_type").alias("event_type"), "city",
        "state", F.lit("US").alias("country"), "latitude", "longitude",
        parse_published(published, now).alias("occurred_at"),
        empty_to_null(F.trim("url")).alias("source_url"), F.lit(C.ARTICLE_FEED).alias("source_name"),
        F.lit(1).alias("source_count"), initial_confidence(F.col("class_score"), F.col("location_precision"))
        .alias("confidence_score"), type_severity(F.col("class_type")).alias("severity_score"),
        "location_precision",
        payload(er_uri=uri, er_event_uri=F.col("eventUri"), classification_score=round3(F.col("class_score")),
                source_outlet=F.coalesce(outlet, F.lit("")), categories=first_labels(F.col("categories"), labels),
                precision=F.col("location_precision")).alias("raw_payload_json"),
        outlet.alias("outlet"), F.col("eventUri").alias("event_uri"))
