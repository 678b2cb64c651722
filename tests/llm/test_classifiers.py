"""Quality, toxicity and mixing: held-out accuracy, plain versions of the maths, edge rows."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremorline.llm import mixing, quality, toxicity
from tremorline.llm.registry import QUERIES

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@tables
@pytest.mark.parametrize("name, label, least", [("op4_quality", "quality", 0.95), ("op7_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert QUERIES[name](spark, SF).count() == docs.count()
    assert got.score.between(0, 1).all() and len(got) > 30
    assert (got.predicted == got[label]).mean() >= least
    one, zero = got[got[label] == 1].score, got[got[label] == 0].score
    assert np.mean([[a > b for b in zero] for a in one]) >= 0.95  # the area under the curve


def edge_docs(spark):
    rows = [(i, t, 0.5, None) for i, t in enumerate(["plain words go here. " * 9, "LOUD!! " * 40, "", None, " \n", "é" * 2000])]
    rows += [(None, "no id", None, "x"), (0, rows[0][1], 0.5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, _y string")


def edge_labels(spark):
    return spark.createDataFrame([(0, 1), (1, 0), (1, 0), (None, 1), (2, None), (3, 0), (4, 1), (5, 1), (99, 1)], "doc_id long, y int")


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_rows(spark, module):
    docs, labels = edge_docs(spark), edge_labels(spark)
    model = module.train(docs, labels, "y")
    got = module.scores(docs, model)
    rows = got.collect()
    assert len(rows) == 8 and set(got.columns) == {"doc_id", "_y", "score"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 0]
    assert same[0] == same[1]
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[2] == by_id[3]
    assert module.scores(docs.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("y = 1"), labels.where("y = 0")):
        constant = {r["score"] for r in module.scores(docs, module.train(docs, none, "y")).collect()}
        assert len(constant) == 1


def test_discriminant_is_the_textbook_one():
    rng = np.random.default_rng(1)
    means, factors = [rng.normal(size=3) for _ in range(2)], []
    for _ in range(2):
        a = rng.normal(size=(3, 3))
        factors.append(np.linalg.cholesky(a @ a.T + np.eye(3)))
    classes = tuple((math.log(p), m, f, 2 * np.log(np.diag(f)).sum()) for p, m, f in zip((0.3, 0.7), means, factors))
    model = quality.Discriminant(np.zeros(3), np.ones(3), classes, 0.7)
    for x in rng.normal(size=(20, 3)):
        density = [p * math.exp(-0.5 * (x - m) @ np.linalg.inv(f @ f.T) @ (x - m)) / math.sqrt(np.linalg.det(f @ f.T))
                   for p, m, f in zip((0.3, 0.7), means, factors)]
        assert model.scores(x[None])[0] == pytest.approx(density[1] / sum(density), abs=1e-8)


def test_statistics_do_not_depend_on_pieces():
    text = ("Some words, SOME words; 12 | times!! again again\nsame line\nsame line\n" * 30).encode()
    whole = quality.statistics(text)
    for piece in (16, 100, 1000):
        assert quality.statistics(text, piece)[:len(quality.CLASSES)] == pytest.approx(whole[:len(quality.CLASSES)], abs=0.05)


def test_ngrams_of_long_texts_are_counted_in_pieces():
    texts = pa.array(["ab cdé" * 50, None, "", "Xy" * 400, "zz top " * 300])
    column, width = np.arange(1 << 10), 1 << 10
    want = {}
    for i, j, keys, n in toxicity.counted(texts, (3, 4), 10, column, width):
        for k, c in zip(keys.tolist(), n.tolist()):
            want[i + k // width, k % width] = c
    got = {}
    for i, j, keys, n in toxicity.counted(texts, (3, 4), 10, column, width, limit=40):
        for k, c in zip(keys.tolist(), n.tolist()):
            got[i + k // width, k % width] = c
    assert got == want


def test_naive_bayes_ratios_from_plain_counts(spark):
    rows = [(1, "bad idiot"), (1, "idiot"), (0, "fine day"), (0, "good day"), (0, "day")]
    totals, chosen = toxicity._ratios(spark.createDataFrame(rows, "y long, text string"), (5,), 16, 50)
    assert (totals["without"], totals["with"]) == (3, 2)
    seen = [{}, {}]
    for y, t in rows:
        for _, _, keys, _ in toxicity.counted(pa.array([t]), (5,), 16, np.arange(1 << 16), 1 << 16):
            for k in keys.tolist():
                seen[y][k] = seen[y].get(k, 0) + 1
    for r in chosen:
        b = r["bucket"]
        assert r["ratio"] == pytest.approx(math.log(((seen[1].get(b, 0) + 1) / 4) / ((seen[0].get(b, 0) + 1) / 5)))


def test_projected_gradient_meets_targets(spark):
    rng = np.random.default_rng(3)
    share = rng.dirichlet((0.3, 0.3, 0.3), 200)
    tokens = rng.integers(1, 500, 200)
    table = spark.createDataFrame([(int(n), [float(x) for x in s]) for n, s in zip(tokens, share)], "tokens int, posterior array<double>")
    goal = {"a": 0.7, "b": 0.2, "c": 0.1}
    steps = mixing.fitted_steps(table, ("a", "b", "c"), goal)
    r = np.ones(200)
    for s in steps:
        r = np.maximum(0, r - share @ np.array(s))
    got = [x["rate"] for x in table.select(mixing.rate(steps).alias("rate")).collect()]
    assert got == pytest.approx(r.tolist()) and min(got) >= 0
    assert (tokens * r) @ share / tokens.sum() == pytest.approx([0.7, 0.2, 0.1], abs=1e-3)
    kept = mixing.fitted_steps(table, ("a", "b", "c"), goal, keep="a")
    r, least = np.ones(200), (share[:, 0] >= share.max(1)).astype(float)
    for s in kept:
        r = np.maximum(least, r - share @ np.array(s))
    got = [x["rate"] for x in table.select(mixing.rate(kept, 0).alias("rate")).collect()]
    assert got == pytest.approx(r.tolist()) and min(g for g, one in zip(got, least) if one) >= 1
    assert ((tokens * r) @ share)[0] == pytest.approx(tokens @ share[:, 0], rel=1e-2)


@tables
def test_posteriors_tell_domains_apart(spark):
    rates = QUERIES["op1_mixing"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert np.allclose(rates.p_good + rates.p_poor + rates.p_toxic, 1)
    assert (rates[rates.quality == 0].p_poor.mean() > 0.6) and (rates[(rates.quality == 1) & (rates.toxic == 0)].p_good.mean() > 0.8)
    assert (rates.rate >= 0).all() and (abs(rates.copies - rates.rate) < 1).all()


def test_mixing_edge_rows(spark):
    docs = edge_docs(spark)
    examples = spark.createDataFrame([(0, "good"), (1, "poor"), (1, "poor"), (5, "good")], "_id long, domain string")
    for given in (examples, examples.limit(0), examples.where("domain = 'good'")):
        rates, model, _ = mixing.mixing_rates(docs, given, {"good": 0.5, "poor": 0.5}, least_docs=1)
        rows = rates.collect()
        assert len(rows) == 8 and all(r["rate"] >= 0 and sum(r["posterior"]) == pytest.approx(1) for r in rows)
        out = mixing.mixed(docs, given, {"good": 0.5, "poor": 0.5}, least_docs=1)
        assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").where(F.col("doc_id").isNotNull()).count() == 0
    assert mixing.mixed(docs.limit(0), examples, {"good": 1.0}).count() == 0


def test_copies_follow_rates(spark):
    got = spark.range(20000).select(mixing.copies(F.lit(1.25), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert got[0] == pytest.approx(1.25, abs=0.02) and (got[1], got[2]) == (1, 2)
