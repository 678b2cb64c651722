"""Several templates in one leaf, and short lines that only start alike."""

from tremorline.llm.templates import drop_recurring_lines

LETTERS = "abcdefghijklmnop"


def dropped(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["dropped"] for r in drop_recurring_lines(rows).collect()}


def test_recurring_lines_of_one_leaf_do_not_hide_each_other(spark):
    one, two = "please read our terms before using this", "please read our policy about cookies and data"
    two = " ".join(two.split()[:7])
    names = "please read our guide written by {}"
    texts = [f"{one}\n{two}\n{names.format('writer' + c)}\nplease read our {c}a {c}b {c}c {c}d\nplease read our {c}e {c}f {c}g {c}h" for c in LETTERS]
    assert dropped(spark, texts) == {i: [0, 1, 2] for i in range(16)}


def test_an_exact_line_of_many_digits_recurs(spark):
    texts = [f"page 1 of 2 on 3 4 5\n{i} {i}" for i in range(12)]
    assert dropped(spark, texts) == {i: [0] for i in range(12)}


def test_short_unique_lines_that_start_alike_stay(spark):
    texts = [f"the end of {c}x\nthe end of {c}y {c}z\nthe end of story\nthe end of our story" for c in LETTERS]
    assert dropped(spark, texts) == {i: [2, 3] for i in range(16)}
