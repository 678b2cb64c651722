"""Repeated strings of bytes against a loop over all windows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tremorline.llm.repeats import grain_of, remove_repeats, window_runs


def plain(docs, window):
    seen, out = {}, {}
    for i, (d, t) in enumerate(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen.setdefault(b[p:p + window], (i, p)) != (i, p):
                gone[p:p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    rows = df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"),
                     F.sha2("kept", 256).alias("h")).collect()
    return {r[0]: tuple(r[1:]) for r in rows}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde é") for _ in range(200)) for _ in range(6)]
    parts = [lambda: rng.choice(base)[rng.randint(0, 50):rng.randint(60, 200)], lambda: "ab" * rng.randint(1, 90),
             lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 120)))]
    return [(i, "".join(rng.choice(parts)() for _ in range(rng.randint(0, 5)))) for i in range(100)]


@pytest.mark.parametrize("window", [2, 10, 37, 100])
@pytest.mark.parametrize("crowd", [1, 4000])
def test_against_all_windows(spark, texts, window, crowd):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert result(remove_repeats(docs, window=window, crowd=crowd)) == plain(texts, window)


def test_small_arrow_batches_change_nothing(spark, texts, monkeypatch):
    monkeypatch.setattr("tremorline.llm.repeats.small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3"))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    assert result(remove_repeats(docs, window=30)) == plain(texts, 30)


def test_runs_cover_every_window_once_in_any_pieces():
    import numpy as np

    data = np.frombuffer(("xyz" * 40 + "".join(chr(97 + i * i % 26) for i in range(300))).encode(), np.uint8)
    for piece in (1, 50, 1 << 19):
        windows = {}
        for at, n, lead, digit in window_runs(data, 60, piece):
            for a, k, x, d in zip(at.tolist(), n.tolist(), lead.tolist(), digit.tolist()):
                for p in range(a, a + k):
                    assert p not in windows and 0 <= x - (p - a) <= 60 - grain_of(60)
                    windows[p] = d
        assert sorted(windows) == list(range(len(data) - 59))


def test_edge_rows(spark):
    long, short = "0123456789" * 30, "abcdefghij" * 3
    rows = [(1, long, 0), (1, long, 0), (1, short, 0), (None, short + "X", 0), (None, None, None), (2, "", 1), (3, short, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = remove_repeats(docs, window=20).collect()
    assert len(got) == len(rows)
    assert {bytes(r["kept"]) for r in got if r["doc_id"] is None} == {b"", b"abcdefghijX"}
    twins = [bytes(r["kept"]) for r in got if r["n_bytes"] == 300]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert [bytes(r["kept"]) for r in got if r["doc_id"] == 3] == [b""]
    assert remove_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, window=1)
