"""Item windows in documents against a loop over all windows."""

import random
import re

import pytest

from tremorline.llm.decontaminate import contaminated_words, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            v = words(x)
            m = min(window, len(v))
            wanted = {tuple(v[s:s + m]) for s in range(len(v) - m + 1)} if v else set()
            for s in range(len(w) - m + 1):
                if tuple(w[s:s + m]) in wanted:
                    hit |= set(range(s, s + m))
                    found.add("" if i is None else str(i))
        out.append((str(d), len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in df.collect())


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    vocabulary = ["the", "of", "É", "é", "x1", "Zed", "a", "b-c", "naïve", "w"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 9, 10, 11, 25])))) for i in range(20)]
    items += [(100, ""), (101, None), (None, "lonely null item"), (3, "second text of three"), (102, "... !")]
    docs = []
    for d in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 3))
            parts += w[a:a + rng.randint(1, 30)] + [rng.choice(["stop", "the", "Q"])]
        docs.append((d, ", ".join(parts)))
    docs += [(81, None), (82, ""), (83, "\x00 ~~"), (None, items[5][1]), (5, docs[5][1]), (84, (items[4][1] + " ") * 300)]
    return docs, items


@pytest.mark.parametrize("per_pass", [3, 50_000])
def test_against_all_windows(spark, tables, per_pass):
    docs, items = tables
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item string").repartition(3)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    assert result(contaminated_words(d, i, per_pass=per_pass)) == plain(docs, items)


@pytest.mark.parametrize("window", [1, 3])
def test_other_windows(spark, tables, window):
    docs, items = tables
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(contaminated_words(d, i, window=window)) == plain(docs, items, window)


def test_hits_are_runs_of_the_item(spark):
    item = "one two three four five six seven eight nine ten eleven"
    d = spark.createDataFrame([(1, f"zero {item} twelve")], "doc_id long, text string")
    row = contaminated_words(d, spark.createDataFrame([(9, item)], "item_id long, text string")).first()
    assert (row["n_words"], row["n_hit"]) == (13, 11)
    assert all(1 <= h["start"] and h["stop"] <= 12 and h["item"] == "9" for h in row["hits"])


def test_empty_tables_and_filter(spark, tables):
    docs, items = tables
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contaminated_words(d.limit(0), i).count() == 0
    assert all(r["n_hit"] == 0 for r in contaminated_words(d, i.limit(0)).collect())
    kept = without_contaminated(d, i)
    assert kept.columns == d.columns and kept.count() == sum(1 for x in plain(docs, items) if not x[2])
