"""Match articles to the incident they most likely describe.

An incident qualifies when it is active, at most 48 hours and 50 miles away, and its title is similar enough (more
so when the event types do not go together).  The best one by 0.5 similarity + 0.3 recency + 0.2 proximity wins, the
lowest id on a tie.

How it scales.  Comparing every article with every incident of its area and time would be quadratic wherever a third
of all rows are copies of one story, so rows are never paired directly:

1. Articles collapse to queries, incidents to points of equal (title words, type, place, time).
2. A query first meets points of its own title.  What it scores there bounds how similar another title must be to win,
   so distinct titles meet for the queries that still can win something, in two steps of falling similarity (one, if
   queries are few), in a prefix-filter join on (time bucket, cell of the globe, rare word) with a threshold per title.
3. Points of a title and type lie in adaptive blocks (``operators.blocks``).  A query opens, from coarse to fine and over
   all similar titles together, only blocks whose best possible score its best found one does not beat.  So n copies of
   a headline at n places and times cost each query a few blocks of at most 16 points, not n points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import haversine_miles
from tremorline.functions.plan import once
from tremorline.functions.scores import types_compatible
from tremorline.functions.text import token_set
from tremorline.operators.blocks import SLACK, Blocks, leaf_candidates, reached_roots, root_bucket, root_cell
from tremorline.operators.numbering import numbered
from tremorline.operators.similarity import coded_sets, prefix_words, set_key, similar_sets
from tremorline.session import cut_lineage

HOUR_MICROS = 3_600_000_000
#: Where the search among titles that differ stops first, as a part of the way from the threshold to equal titles.
HALFWAY = 1 / 3
#: Queries per point below which it does not stop there: the titles of all points would travel twice for few queries.
FEW = 1 / 8
POINT = ["set_key", "event_type", "latitude", "longitude", "micros"]


def title_key(title: Column) -> Column:
    return F.unhex(F.md5(title))


def _side(df: DataFrame, row_id: str) -> DataFrame:
    """The columns matching needs."""
    return df.select(
        F.col(row_id).alias("row_id"), "title", title_key(F.col("title")).alias("title_key"), F.coalesce("event_type", F.lit("")).alias("event_type"), "latitude",
        "longitude", F.unix_micros("occurred_at").alias("micros")).dropna(subset=POINT[2:])


def _sides(articles: DataFrame, events: DataFrame, article_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles and active incidents with ``set_key`` in place of the title, and the token sets, coded rarest first; words
    of a title are taken once however many rows have it, and short keys travel in place of titles (the inputs are read
    twice for that).  Rows whose title has no words cannot match and are left out."""
    sides = [_side(articles, article_id), _side(events.filter("is_active"), "id")]
    a, e = [cut_lineage(side.drop("title")) for side in sides]
    titles = once(sides[0].select("title").unionByName(sides[1].select("title")).distinct(), "tokens", token_set(F.col("title")))
    titles = cut_lineage(titles.filter(F.size("tokens") > 0).withColumn("words_key", set_key(F.col("tokens"))))
    # short numbers in place of keys and words, since they travel once per word and pair
    sets = numbered(titles.groupBy("words_key").agg(F.first("tokens").alias("tokens")), [], "set_key", 0)
    sets = cut_lineage(sets.withColumn("set_key", F.col("set_key").cast("int")))
    named = titles.select(title_key(F.col("title")).alias("title_key"), "words_key")
    named = cut_lineage(named.join(sets.select("words_key", "set_key"), "words_key").drop("words_key"))
    keyed = [side.join(named, "title_key").select("row_id", *POINT) for side in (a, e)]
    return *keyed, cut_lineage(coded_sets(sets, "set_key"))


def match_score(similarity: Column, hours_apart: Column, distance: Column, hours: float, miles: float) -> Column:
    recency = F.greatest(F.lit(0.0), F.lit(1.0) - hours_apart / F.lit(float(hours)))
    proximity = F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(float(miles)))
    return (F.lit(C.SIMILARITY_WEIGHT) * similarity + F.lit(C.RECENCY_WEIGHT) * recency
            + F.lit(C.PROXIMITY_WEIGHT) * proximity)


def similarity_for(score: Column) -> Column:
    """The similarity that a title needs to reach a score at no distance in time and place."""
    return (score - F.lit(C.RECENCY_WEIGHT + C.PROXIMITY_WEIGHT + SLACK)) / F.lit(C.SIMILARITY_WEIGHT)


def candidates(articles: DataFrame, events: DataFrame, sets: DataFrame, hours: float, miles: float, threshold: float
               ) -> DataFrame:
    """Pairs of a query (``POINT`` columns of articles) and an incident that may be its best match.

    The inputs as ``_sides`` gives them.  Output: the query's columns, ``event_id, similarity, hours_apart,
    distance_miles, score`` of pairs within the gates.
    """
    span = int(hours * HOUR_MICROS)
    queries = cut_lineage(articles.groupBy(*POINT).agg(F.min("row_id").alias("row_id"))
                          .select(F.monotonically_increasing_id().alias("q"), *POINT))
    points = cut_lineage(events.groupBy(*POINT).agg(F.min("row_id").alias("id")).withColumns({
        "cell": root_cell(F.col("latitude"), F.col("longitude"), miles), "bucket": root_bucket(F.col("micros"), span)}))
    reach = cut_lineage(reached_roots(queries, miles, span))
    blocks = Blocks(points, ["set_key", "event_type"], miles, span)
    roots = blocks.levels[0].withColumnsRenamed({"set_key": "b", "event_type": "p_type"}).drop("n")
    apart = F.abs(F.col("micros") - F.col("p_micros"))
    distance = haversine_miles(F.col("latitude"), F.col("longitude"), F.col("p_latitude"), F.col("p_longitude"))

    def search(met: DataFrame) -> DataFrame:
        """``met``: rows of ``reach`` with ``reached``, a title ``b`` that the query meets and its ``similarity``."""
        needed = needed_similarity(F.col("event_type"), F.col("p_type"), threshold)
        frontier = (met.join(roots, ["b", "cell", "bucket"]).where(F.col("similarity") >= needed)
                    .drop("b", "cell", "bucket", "event_type", "p_type"))
        found = leaf_candidates(frontier, blocks, lambda s, h, d: match_score(s, h, d, hours, miles), miles, span)
        near = found.where(apart <= span).withColumns({
            "hours_apart": apart / F.lit(1e6) / F.lit(3600.0), "distance_miles": distance}).where(F.col("distance_miles") <= F.lit(miles))
        scored = near.withColumn("score", match_score(
            F.col("similarity"), F.col("hours_apart"), F.col("distance_miles"), hours, miles))
        scored = scored.where(F.col("reached").isNull() | (F.col("score") >= F.col("reached") - F.lit(SLACK)))
        return cut_lineage(scored.select("q", F.col("p_id").alias("event_id"), "similarity", "hours_apart", "distance_miles", "score"))

    found = search(reach.withColumnRenamed("set_key", "b").withColumns({
        "similarity": F.lit(1.0), "reached": F.lit(None).cast("double")}))
    words, below = None, 1.0
    halfway = [threshold + HALFWAY * (1 - threshold)] if queries.count() >= FEW * points.count() else []
    for floor in (*halfway, threshold):
        if floor >= below:
            continue
        # a title not met yet is less similar than ``below``; a query asks for no less than may still win
        best = found.groupBy("q").agg(F.max("score").alias("reached"))
        least = F.greatest(F.lit(float(floor)), F.coalesce(similarity_for(F.col("reached")), F.lit(0.0)))
        asked = cut_lineage(reach.join(best, "q", "left").withColumn("least", least).where(F.col("least") < F.lit(float(below))))
        words = prefix_words(sets, threshold, coded=True) if words is None else words
        titles = similar_sets(asked, points, ["bucket", "cell"], sets, floor, below, words)
        # queries meet titles before blocks: a title has blocks all over, of which a query reaches few
        met = (asked.withColumnRenamed("set_key", "a").join(titles, "a").where(F.col("similarity") >= F.col("least"))
               .drop("a", "least"))
        found, below = found.unionByName(search(met)), floor
    return found.join(queries, "q")


def best_match(articles: DataFrame, events: DataFrame, hours: float = C.MATCH_HOURS, miles: float = C.MATCH_MILES,
               threshold: float = C.MATCH_SIMILARITY, article_id: str = "ord") -> DataFrame:
    """The best incident per article: ``article_id, event_id, similarity, hours_apart, distance_miles, score``.

    Articles without a qualifying incident have no row.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    a, e, sets = _sides(articles, events, article_id)
    best = candidates(a, e, sets, hours, miles, threshold).groupBy(*POINT).agg(F.max(F.struct(
        "score", (-F.col("event_id")).alias("rank"), "similarity", "hours_apart", "distance_miles")).alias("b"))
    return a.select(F.col("row_id").alias(article_id), *POINT).join(best, POINT).select(
        article_id, (-F.col("b.rank")).alias("event_id"), "b.similarity", "b.hours_apart", "b.distance_miles", "b.score")


def needed_similarity(article_type: Column, event_type: Column, threshold: float) -> Column:
    return F.when(types_compatible(article_type, event_type), F.lit(threshold)).otherwise(
        F.lit(threshold) + F.lit(C.INCOMPATIBLE_EXTRA))


def match_leaders(articles: DataFrame, leaders: DataFrame, hours: float = C.MATCH_HOURS, miles: float = C.MATCH_MILES,
                  threshold: float = C.MATCH_SIMILARITY, article_id: str = "ord", reached: DataFrame | None = None) -> DataFrame:
    """All qualifying (article, leader) pairs, each leader visible only to later articles.

    ``leaders`` has one row per incident opened in the current run (``id``, ``visible_from`` and the event columns).
    ``reached`` (article, ``score``): pairs that score less than their article has already may be left out.
    Titles meet first, so an article meets the leaders that resemble it and are near; leaders do not match each other,
    so these are few.
    """
    span = int(hours * HOUR_MICROS)
    a, e, sets = _sides(articles, leaders.withColumn("is_active", F.lit(True)), article_id)
    visible = leaders.select(F.col("id").alias("event_id"), "visible_from")
    placed = e.select(F.col("row_id").alias("event_id"), "set_key", *[F.col(c).alias(f"e_{c}") for c in POINT[1:]],
                      root_cell(F.col("latitude"), F.col("longitude"), miles).alias("cell"),
                      root_bucket(F.col("micros"), span).alias("bucket")).join(visible, "event_id")
    if reached is not None:
        a = a.join(reached.select(F.col(article_id).alias("row_id"), similarity_for(F.col("score")).alias("least")), "row_id", "left")
    least = F.greatest(F.lit(float(threshold)), F.col("least")) if reached is not None else F.lit(float(threshold))
    placed, reach = cut_lineage(placed), cut_lineage(reached_roots(a.withColumn("least", least), miles, span))
    titles = similar_sets(reach, placed, ["bucket", "cell"], sets, threshold, words=prefix_words(sets, threshold, coded=True))
    apart = F.abs(F.col("micros") - F.col("e_micros"))
    distance = haversine_miles(F.col("latitude"), F.col("longitude"), F.col("e_latitude"), F.col("e_longitude"))
    met = (reach.withColumnRenamed("set_key", "a").join(titles, "a")
           .join(placed.withColumnRenamed("set_key", "b"), ["b", "cell", "bucket"])
           .where((F.col("row_id") > F.col("visible_from")) & (F.col("similarity") >= F.col("least")) & (apart <= span) & (distance <= F.lit(float(miles)))
                  & (F.col("similarity") >= needed_similarity(F.col("event_type"), F.col("e_event_type"), threshold))))
    hours_apart = apart / F.lit(1e6) / F.lit(3600.0)
    return met.select(F.col("row_id").alias(article_id), "event_id", "similarity", hours_apart.alias("hours_apart"),
                      distance.alias("distance_miles"),
                      match_score(F.col("similarity"), hours_apart, distance, hours, miles).alias("score"))


def top_match(candidates: DataFrame, article_id: str = "ord") -> DataFrame:
    """One row per article: the highest score, the lowest id on a tie."""
    best = candidates.groupBy(article_id).agg(F.max(F.struct(
        "score", (-F.col("event_id")).alias("rank"), "similarity", "hours_apart", "distance_miles")).alias("b"))
    return best.select(article_id, (-F.col("b.rank")).alias("event_id"), "b.similarity", "b.hours_apart",
                       "b.distance_miles", "b.score")
