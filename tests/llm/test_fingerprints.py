"""Content-defined chunks and the comparison with the next document."""

import hashlib
import random

import numpy as np
import pytest

from tremorline.llm.fingerprint import (GEAR, LEAST, LOOK_BACK, MOST, NORMAL, BITS, boundaries, chunk_set,
                                        compared_with_next, containment, fingerprints, read, written)


def plain_boundaries(data):
    """One byte after the other."""
    ends, c = [], 0
    while c < len(data):
        e = c + 1
        while e < len(data) and e - c < MOST:
            if e - c >= LEAST:
                h = sum(int(GEAR[b]) << k for k, b in enumerate(reversed(data[max(0, e - LOOK_BACK):e]))) & 0xFFFFFFFF
                bits = BITS + 1 if e - c < NORMAL else BITS - 1
                if not (h >> (LOOK_BACK - bits)) & ((1 << bits) - 1):
                    break
            e += 1
        ends.append(e)
        c = e
    return ends


def test_boundaries():
    rng = random.Random(6)
    for n in (0, 1, 3, 4, 5, 16, 64, 65, 700):
        data = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        want = plain_boundaries(data)
        for piece in (17, 64, 1 << 20):
            assert boundaries(np.frombuffer(data, np.uint8), piece) == want


def test_an_edit_changes_few_chunks():
    rng = random.Random(7)
    text = bytes(rng.choice(b"abcdefgh \n") for _ in range(4000))
    moved = b"inserted " + text
    assert containment(chunk_set(text), chunk_set(moved)) > 0.97


def test_written_sets_read_back():
    chunks = chunk_set(b"some text of a few words, and some more of it" * 3)
    assert read(written(chunks)) == chunks and read(written({})) == {}
    assert containment({}, {}) == 1 and containment({}, chunks) == 0 and containment(chunks, {}) == 0


def plain(docs):
    order = sorted(docs, key=lambda x: (-x[0], x[1] or ""))
    out = []
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[:len(t) - cut] + following[:cut]
        a, b, c = (chunk_set(x.encode()) for x in (t, edited, following))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), written(a), written(b), containment(a, b), containment(a, c)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_against_plain_order(spark, parts, monkeypatch):
    rng = random.Random(9)
    docs = [(rng.randint(-10 ** 12, 10 ** 12) if i % 3 else i, rng.choice([None, "", "é€ x" * rng.randint(1, 40), "word " * rng.randint(1, 90)]))
            for i in range(120)]
    docs += [docs[4], (docs[5][0], "another text of the same id"), (200, "y" * 5000)]
    import tremorline.llm.fingerprint as module

    given = module.with_next
    monkeypatch.setattr(module, "with_next", lambda d, c: given(d, c, 1000 if parts == 1 else 20))
    df = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, fingerprint string")
    assert sorted(tuple(r) for r in compared_with_next(df).collect()) == plain(docs)


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, "only")], "doc_id long, text string")
    row = compared_with_next(df).first()
    assert row["doc_id"] is None and row["near_next"] == 1.0
    assert compared_with_next(df.limit(0)).count() == 0
    assert [r["fingerprint"] for r in fingerprints(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [""]
