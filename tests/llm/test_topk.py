import math
import random

import numpy as np
import pytest

from tremorline.llm.topk import Block, top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"
INF = float("inf")


def plain(rows, k, every):
    """All pairs of rows, in Python integers."""
    whole = [(i, v, [math.floor(1024 * x) for x in map(float, np.float32(v))]) for i, v in rows
             if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, _, q) in enumerate(whole):
        if i is None or i % every:
            continue
        scores = [(sum(x * y for x, y in zip(q, c)), j) for b, (j, _, c) in enumerate(whole) if a != b and len(c) == len(q)]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(i, r, j, s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, every=5, **how):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    got = top_k(df, f"id % {every} = 0", **how).select("query_id", "rank", "vec_id", "score")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed,spread,per_block,per_chunk", [(1, 1.0, 1 << 17, 1024), (2, 0.01, 40, 7), (3, 1.0, 64, 3)])
def test_against_all_pairs(spark, seed, spread, per_block, per_chunk):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(4)]) for i in range(150)]
    rows += [(i + 150, rows[3][1]) for i in range(40)]  # copies tie
    rows += [(200 + i, [0.0] * 4) for i in range(7)] + [(3, rows[9][1]), (5, rows[5][1]), (5, rows[5][1]), (None, rows[8][1])]
    rows += [(300, None), (305, [1.0, None, 2.0, 0.0]), (310, [1.0, INF, 0.0, 0.0]), (315, [float("nan")] * 4)]
    rows += [(400, [1.0, 2.0]), (401, [3.0, -1.0]), (405, []), (406, []), (410, [1.0, 2.0, 3.0])]  # other lengths
    assert found(spark, rows, per_block=per_block, per_chunk=per_chunk) == plain(rows, 10, 5)


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (5, [2.0, 2.0])]
    assert found(spark, rows) == plain(rows, 10, 5)
    assert found(spark, [(0, [1.0])]) == found(spark, []) == []


def test_scores_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, [1e30, 1.0]), (1, [1e30, 1.0])])


@pytest.mark.parametrize("seed", range(20))
def test_bounds_never_lose_a_candidate(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-9, 10, (200, 6)) * rng.integers(0, 2, (200, 1)) if seed % 2 else rng.integers(-999, 1000, (200, 6))
    places = np.argsort(x.T, 1, kind="stable")
    block = Block(places, np.take_along_axis(x.T, places, 1))
    asked = np.arange(0, 200, 20)
    for i, found in zip(asked, block.candidates(x[asked], 10, asked, step=8)):
        scores = x @ x[i]
        scores[i] = -10**9
        tenth = np.sort(scores)[-10]
        assert set(np.flatnonzero(scores >= tenth)) <= set(found) | {i}


def test_reading_stops_before_the_end():
    """Where one dimension decides, the winners show at the heads of the lists."""
    rng = np.random.default_rng(1)
    x = np.c_[(1000 * rng.pareto(1.0, 2000)).astype(np.int64), rng.integers(0, 10, (2000, 2))]
    places = np.argsort(x.T, 1, kind="stable")
    block = Block(places, np.take_along_axis(x.T, places, 1))
    block.candidates(np.array([[50, 1, 1], [20, -1, 0]]), 10, np.array([-1, 7]), step=50)
    assert max(block.depth_read) < 0.3 * len(x)
