"""Vocabularies as tables: agreement with the expression form, and vocabularies of many thousand entries."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tremorline.operators import vocabulary as V
from tremorline.operators.classify import Lexicon, classify

ARTICLE = "i int, title string, body string, categories array<struct<uri:string>>, concepts array<struct<uri:string>>, at int"


def articles(n, seed):
    rnd = random.Random(seed)
    lexicon = Lexicon()
    words = [w for p, _, _ in [*lexicon.phrases, *lexicon.tokens] for w in p.split()] + ["city", "the", "automobile", "x", "rain"]

    def text(most):
        out = rnd.choices(words, k=rnd.randrange(most))
        return " ".join(out + ([rnd.choice(lexicon.phrases)[0].title()] if rnd.random() < 0.3 else []))

    def uris(found):
        return [(rnd.choice(found),)] if rnd.random() < 0.4 else rnd.choice([[], None])

    return [(i, rnd.choice([text(6), text(3), "", None]), rnd.choice([text(30), text(8), None]),
             uris(["dmoz/news/conflict_and_protest", "dmoz/sports", None]), uris(["en/protest", "en/riot", "en/tea"]), 1)
            for i in range(n)]


@pytest.mark.parametrize("lexicon", [Lexicon(), Lexicon(whole_words=True)])
def test_table_form_agrees_with_the_expression_form(spark, lexicon):
    rows = articles(400, 7)
    df = spark.createDataFrame(rows + rows[:30], ARTICLE).repartition(5)
    tables = V.entries(spark, lexicon.phrases), V.entries(spark, lexicon.tokens)
    want = sorted(map(str, classify(df, lexicon).collect()))
    got = V.classify_by_table(df, *tables, lexicon)
    assert got.columns == [*df.columns, "class_type", "class_score"]
    assert sorted(map(str, got.collect())) == want
    assert len(set(re.findall(r"class_type='(\w+)'", " ".join(want)))) > 3


def test_empty_tables(spark):
    none = V.entries(spark, [])
    df = spark.createDataFrame(articles(20, 1), ARTICLE)
    assert V.classify_by_table(df, none, none).where("class_type is not null").count() == 0
    assert V.classify_by_table(df.limit(0), V.entries(spark, Lexicon().phrases), none).count() == 0


def test_fifty_thousand_entries(spark):
    rnd = random.Random(3)
    letters = "abcdefghij .()-é"
    listed = [("".join(rnd.choices(letters, k=rnd.choice([1, 2, 3, 5, 7, 8, 9, 14, 20]))), "kind", 1.0) for _ in range(50_000)]
    texts = []
    for i in range(60):
        parts = ["".join(rnd.choices(letters, k=rnd.randrange(40))) for _ in range(2)]
        texts.append((i, *(p + rnd.choice(listed)[0] + p[:3] for p in parts)))
    texts.append((60, "", ""))
    df = spark.createDataFrame(texts, "_row long, _front string, _behind string")
    phrases = V.entries(spark, listed)
    want = {(i, at, w in f) for i, f, b in texts for at, (w, _, _) in enumerate(listed) if w in f or w in b}
    got = V.phrase_matches(df, phrases).select("_row", "at", "front").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("phrase", ["a+b", "(x", "q\\E.c", "né", "a$"])
def test_whole_words_are_literal(spark, phrase):
    texts = [f"z {phrase} z", f"z{phrase}z", phrase, "aab", "qxc"]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "_row long, _front string, _behind string")
    got = V.phrase_matches(df, V.entries(spark, [(phrase, "k", 1.0)]), whole_words=True)
    pattern = F.lit(rf"\b{re.escape(phrase)}\b")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in df.where(F.rlike("_front", pattern)).collect())


def test_words_of_a_body_are_extracted_once(spark):
    from tremorline.operators.classify import lexicon_hits

    hits = lexicon_hits(spark.createDataFrame(articles(5, 1), ARTICLE), Lexicon(), "title", "body", F.lit(True)).select("_hits")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2  # title and body


def test_phrases_that_share_short_runs_meet_by_their_longest(spark):
    """Of 300 phrases made of the same words only those that occur are looked for in a text."""
    words = ["shared", "running", "entries", "another", "letters", "written", "several"]
    listed = sorted({f"{a} {b} {c}" for a in words for b in words for c in words})
    phrases = V.entries(spark, [(p, "k", 1.0) for p in listed])
    text = " ".join(words * 3)
    keys = V.anchored(phrases).collect()
    assert len(keys) == len(listed)
    assert sum(len(k["word"]) - 4 <= max(s for s in V.GRAMS if s <= len(k["word"])) for k in keys) > 0.9 * len(keys)
    assert len({k["gram"] for k in keys}) > 0.9 * len(keys)
    df = spark.createDataFrame([(0, text, None), (1, None, text)], "_row long, _front string, _behind string")
    got = {(r["_row"], listed[r["at"]]) for r in V.phrase_matches(df, phrases).collect()}
    assert got == {(i, p) for i in (0, 1) for p in listed if p in text}
