"""Signatures bound the overlap of two sets from above, so few unrelated pairs travel."""

import random

import pytest
from pyspark.sql import functions as F

from tremorline.operators.similarity import LONGS, enough_shared, signature, similar_sets


def sets_of(spark, seed=5):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 20, 90]))] for _ in range(150)]
    near = [[w for w in s if rng.random() < 0.7] + ["more"] for s in base]
    listed = sorted({tuple(sorted(set(s) | {"common"})) for s in base + near})
    return listed, spark.createDataFrame([(i, list(s)) for i, s in enumerate(listed)], "set_key int, tokens array<string>")


@pytest.mark.parametrize("threshold", [0.25, 0.4, 0.85])
def test_no_similar_pair_is_lost_and_few_others_pass(spark, threshold):
    listed, sets = sets_of(spark)
    signed = sets.select("set_key", F.size("tokens").alias("size"), signature(F.col("tokens")).alias("sign"))
    assert {len(r["sign"]) for r in signed.collect()} == {LONGS}
    a, b = (signed.toDF(*(f"{side}_{c}" for c in ("key", "size", "sign"))) for side in "ab")
    passed = {tuple(r) for r in a.crossJoin(b).where(enough_shared(
        threshold, "a_sign", F.col("a_size"), "b_sign", F.col("b_size"))).select("a_key", "b_key").collect()}
    own = [set(s) for s in listed]
    want = {(i, j) for i, x in enumerate(own) for j, y in enumerate(own) if len(x & y) >= threshold * len(x | y)}
    assert want <= passed and len(passed - want) < 0.05 * len(own) ** 2
    side = sets.select("set_key", F.lit(1).alias("block"))
    assert {(r["a"], r["b"]) for r in similar_sets(side, side, ["block"], sets, threshold).collect()} == want
