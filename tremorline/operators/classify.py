"""Lexicon classifier for article text.

Vocabularies are small constant tables given by the caller, so they are folded into column expressions: a row is
classified where it is read, with no join and no shuffle.  For vocabularies of thousands of entries there is
``operators.vocabulary``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tremorline.functions import constants as C
from tremorline.functions.plan import once
from tremorline.functions.text import any_of, strings, token_set


@dataclass(frozen=True)
class Lexicon:
    """Vocabularies of the classifier; the defaults are the fixed tables."""

    phrases: Sequence[tuple[str, str, float]] = field(default_factory=lambda: C.PHRASES)
    tokens: Sequence[tuple[str, str, float]] = field(default_factory=lambda: C.TOKENS)
    category_fragments: Sequence[str] = field(default_factory=lambda: C.CATEGORY_FRAGMENTS)
    concept_fragments: Sequence[str] = field(default_factory=lambda: C.CONCEPT_FRAGMENTS)
    opinion_openers: Sequence[str] = field(default_factory=lambda: C.OPINION_OPENERS)
    weather_tokens: Sequence[str] = field(default_factory=lambda: C.WEATHER_TOKENS)
    weather_exempt: Sequence[str] = field(default_factory=lambda: C.WEATHER_EXEMPT_TOKENS)
    accident_phrases: Sequence[str] = field(default_factory=lambda: C.ACCIDENT_PHRASES)
    accident_exempt: Sequence[str] = field(default_factory=lambda: C.ACCIDENT_EXEMPT_SUBSTRINGS)
    excluded_domains: Sequence[str] = field(default_factory=lambda: C.EXCLUDED_DOMAINS)
    needs_support: Sequence[str] = field(default_factory=lambda: C.NEEDS_SUPPORT_TYPES)
    whole_words: bool = False  # phrases normally match inside words as well: "mob" in "automobile"

    def finds(self, text: Column, phrase: str) -> Column:
        return text.rlike(rf"\b{re.escape(phrase)}\b") if self.whole_words else text.contains(phrase)


DEFAULT_LEXICON = Lexicon()


def category_boost(categories: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """0.2 when any category path holds a listed fragment."""
    hit = F.exists(categories, lambda c: F.lower(F.coalesce(c["uri"], F.lit(""))).rlike(
        any_of(lexicon.category_fragments)))
    return F.when(F.coalesce(hit, F.lit(False)), F.lit(C.CATEGORY_BOOST)).otherwise(F.lit(0.0))


def concept_boost(concepts: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """0.1 per concept with a listed fragment, at most 0.3."""
    hits = F.size(F.filter(F.coalesce(concepts, F.array()), lambda c: F.lower(F.coalesce(c["uri"], F.lit(""))).rlike(
        any_of(lexicon.concept_fragments))))
    return F.least(F.lit(C.CONCEPT_BOOST_CAP), hits.cast("double") * F.lit(C.CONCEPT_BOOST))


def only_excluded_categories(categories: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """There are categories, and every one is in an excluded domain."""
    every = F.forall(categories, lambda c: F.lower(F.coalesce(c["uri"], F.lit(""))).rlike(
        any_of(lexicon.excluded_domains)))
    return F.coalesce((F.size(categories) > 0) & every, F.lit(False))


def opinion_title(title: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    return title.rlike(rf"(?iU)^({'|'.join(lexicon.opinion_openers)}){C.OPINION_DELIMITERS}")


def weather_title(title_tokens: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """A weather word and none of the exempting words, all compared as whole tokens."""
    return (F.arrays_overlap(title_tokens, strings(lexicon.weather_tokens))
            & ~F.arrays_overlap(title_tokens, strings(lexicon.weather_exempt)))


def accident_title(title: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    lowered = F.lower(title)
    return lowered.rlike(any_of(lexicon.accident_phrases)) & ~lowered.rlike(any_of(lexicon.accident_exempt))


def hard_excluded(title: Column, title_tokens: Column, categories: Column,
                  lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Rejected whatever the vocabulary says: opinion pieces, foreign domains, weather, traffic accidents."""
    return (opinion_title(title, lexicon) | only_excluded_categories(categories, lexicon)
            | weather_title(title_tokens, lexicon) | accident_title(title, lexicon))


def _hit(score: float, at: int, event_type: str) -> Column:
    return F.struct(F.lit(score).alias("score"), F.lit(-at).alias("order"), F.lit(event_type).alias("event_type"))


def lexicon_hits(df: DataFrame, lexicon: Lexicon, title: str, body: str, supported: Column) -> DataFrame:
    """Add ``_hits``: an array of ``score, order, event_type`` for every vocabulary entry that hit.

    Entries are numbered phrases, title tokens, body tokens; ``order`` is minus that number.  Body tokens only count
    when nothing else hit and ``supported`` holds, so words of a body are extracted only then, and only once.
    """
    n, k = len(lexicon.phrases), len(lexicon.tokens)
    df = df.withColumns({"_low_title": F.lower(F.col(title)), "_title_tokens": token_set(F.col(title)), "_supported": supported})
    df = once(df, "_low_body", F.lower(F.coalesce(F.col(body), F.lit(""))))
    phrases = [F.when(lexicon.finds(F.col("_low_title"), p), _hit(s, i, t))
               .when(lexicon.finds(F.col("_low_body"), p), _hit(s * C.BODY_PHRASE_WEIGHT, i, t))
               for i, (p, t, s) in enumerate(lexicon.phrases)]
    titled = [F.when(F.array_contains("_title_tokens", w), _hit(s, n + i, t))
              for i, (w, t, s) in enumerate(lexicon.tokens)]
    df = once(df, "_front", F.array_compact(F.array(*phrases, *titled)))
    df = once(df, "_body_tokens", F.when(F.col("_supported") & (F.size("_front") == 0), token_set(F.col(body))))
    bodied = [F.when(F.array_contains("_body_tokens", w), _hit(s * C.BODY_TOKEN_WEIGHT, n + k + i, t))
              for i, (w, t, s) in enumerate(lexicon.tokens)]
    behind = F.when(F.col("_body_tokens").isNotNull(), F.array_compact(F.array(*bodied)))
    return df.withColumn("_hits", F.coalesce(behind, F.col("_front")))


def best_candidate(hits: str) -> Column:
    """Best score per type, then the best type; on equal scores the type that was hit first."""
    def of_type(hit: Column) -> Column:
        return F.filter(hits, lambda other: other["event_type"] == hit["event_type"])

    return F.array_max(F.transform(hits, lambda hit: F.struct(
        F.array_max(F.transform(of_type(hit), lambda h: h["score"])).alias("score"),
        F.array_max(F.transform(of_type(hit), lambda h: h["order"])).alias("order"),
        hit["event_type"].alias("event_type"))))


def classify(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, min_score: float = C.MIN_SCORE, title: str = "title",
             body: str = "body", categories: str = "categories", concepts: str = "concepts") -> DataFrame:
    """Add ``class_type`` and ``class_score``; both are null for rejected articles."""
    keep = df.columns
    cat, con = category_boost(F.col(categories), lexicon), concept_boost(F.col(concepts), lexicon)
    df = df.withColumns({"_cat": cat, "_con": con})
    df = lexicon_hits(df, lexicon, title, body, (F.col("_cat") > 0) | (F.col("_con") > 0))
    df = once(df, "_best", best_candidate("_hits"))
    in_title = F.lit(False)
    for phrase, kind, _ in lexicon.phrases:
        if kind in lexicon.needs_support:
            in_title = in_title | ((F.col("_best.event_type") == kind) & lexicon.finds(F.col("_low_title"), phrase))
    return decided(df, keep, lexicon, min_score, title, categories, in_title)


def decided(df: DataFrame, keep: list[str], lexicon: Lexicon, min_score: float, title: str, categories: str,
            in_title: Column) -> DataFrame:
    """From boosts, title words and the best candidate the columns of ``classify``; ``in_title``: a phrase of that
    candidate's type stands in the title."""
    score = F.least(F.lit(1.0), F.col("_best.score") + (F.col("_cat") + F.col("_con")))
    accepted = (F.coalesce(F.length(title) > 0, F.lit(False))
                & ~hard_excluded(F.col(title), F.col("_title_tokens"), F.col(categories), lexicon)
                & F.coalesce(score >= F.lit(min_score), F.lit(False)))
    weak = (F.col("_best.event_type").isin(list(lexicon.needs_support)) & ~in_title
            & (F.col("_cat") == 0.0) & (F.col("_con") == 0.0))
    return df.select(
        *keep,
        F.when(accepted, F.when(weak, F.lit(C.UNSUPPORTED_TYPE)).otherwise(F.col("_best.event_type")))
        .alias("class_type"),
        F.when(accepted, F.when(weak, F.least(score, F.lit(C.UNSUPPORTED_SCORE_CAP))).otherwise(score))
        .alias("class_score"),
    )
