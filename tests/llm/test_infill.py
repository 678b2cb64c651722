import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tremorline.llm.infill import BlockTree, fill_in_middle, rearranged, restored, unit_starts

SCHEMA = "doc_id long, text string, output string, form int, n string"
ALPHABET = st.sampled_from("ab é日😀\n<PSM>")


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=80), st.integers(1, 9), st.integers(0, 90))
def test_cut_against_slices(text, size, k):
    data = np.frombuffer(text.encode(), np.uint8)
    tree = BlockTree(data, unit_starts(data), size)
    assert tree.n == len(text)
    assert tree.cut_after(k) == (len(text[:k].encode()), min(k, len(text)))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é日 \n"), max_size=60), st.integers(1, 9), st.integers(0, 40))
def test_words_as_units(text, size, k):
    """A word with the white space behind it is one unit; so is white space before the first."""
    units = re.findall(r"^\s+|\S+\s*", text)
    data = np.frombuffer(text.encode(), np.uint8)
    tree = BlockTree(data, unit_starts(data, r"\S+"), size)
    before = "".join(units[:k])
    assert tree.n == len(units)
    assert tree.cut_after(k) == (len(before.encode()), len(before))


def plain(key, text, plain_from=90, spm_below=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_rows_against_slices(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab é日😀\n<>PSM", k=rng.choice([0, 1, 3, 50, 3000])))) for i in range(400)]
    rows += [(None, "abc"), (7, None), (7, None), (8, "with <S> inside"), (9, "<" * 50), (10, "<S" * 30), (11, "ä" * 300_000)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(3)
    made = fill_in_middle(df)
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output",
                      restored(F.col("form"), F.col("output")).alias("back")).collect()
    none_first = lambda r: tuple((x is not None, x) for x in r)
    want = [(k, *plain(k, t), t or "") for k, t in rows]
    assert sorted(map(tuple, got), key=none_first) == sorted(want, key=none_first)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_shares_of_forms():
    forms = [rearranged(b"some words of text", k, 1, 90, 20)[1] for k in range(4000)]
    assert abs(forms.count("plain") / 4000 - 0.1) < 0.02
    assert abs(forms.count("spm") / (4000 - forms.count("plain")) - 0.2) < 0.03


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
