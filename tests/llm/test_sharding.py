"""Slot maps, balance, numbering."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

from tremorline.llm.sharding import (SLOTS, edited_map, load_map, numbered, shard_documents, slot_loads, store_map,
                                     with_shards, with_slots)


def plain_map(loads, shards):
    """Largest slot first, each to the shard with the fewest bytes."""
    total, owner = [0] * shards, {}
    for slot in sorted(range(SLOTS), key=lambda s: (-loads.get(s, 0), s)):
        k = total.index(min(total))
        total[k] += loads.get(slot, 0)
        owner[slot] = k
    return owner, total


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "x" * (i * i % 997), "s") for i in range(3000)] + [(None, None, None), (7, "twice", "s"), (7, "twice", "s"), (8, "é" * 900, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)


def test_first_map_is_greedy(spark, docs):
    loads = slot_loads(with_slots(docs))
    want, _ = plain_map({r[0]: r[1] for r in loads.collect()}, 5)
    got = edited_map(loads, 5).collect()
    assert {r["version"] for r in got} == {0} and {r["virtual_slot"]: r["shard"] for r in got} == want


def test_versions_move_few_slots(spark, docs, tmp_path):
    path, loads = str(tmp_path / "map"), slot_loads(with_slots(docs))
    store_map(edited_map(loads, 5), path)
    store_map(edited_map(loads, 6, load_map(spark, path)), path)
    store_map(edited_map(loads, 4, load_map(spark, path)), path)
    sizes = {r[0]: r[1] for r in loads.collect()}
    maps = [{r["virtual_slot"]: r["shard"] for r in load_map(spark, path, v).collect()} for v in (0, 1, 2)]
    assert load_map(spark, path).first()["version"] == 2 and all(len(m) == SLOTS for m in maps)
    for m, n in zip(maps, (5, 6, 4)):
        shard = collections.Counter()
        for s, k in m.items():
            shard[k] += sizes.get(s, 0)
        assert len(shard) == n and max(shard.values()) - min(shard.values()) <= max(sizes.values())
    moved = sum(sizes.get(s, 0) for s in maps[0] if maps[0][s] != maps[1][s])
    assert moved <= sum(sizes.values()) / 6 + 12 * max(sizes.values())


def test_rows_and_places(spark, docs):
    placed = shard_documents(docs, 5)
    assert placed.count() == docs.count() and {"size", "virtual_slot", "shard"} <= set(placed.columns)
    got = numbered(placed.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")))), ["doc_id", "crc"], rows_per_group=1).collect()
    places = collections.defaultdict(list)
    for r in got:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["crc"] == zlib.crc32(raw)
        places[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1


def test_empty_table(spark, docs):
    assert shard_documents(docs.limit(0), 3).count() == 0
    assert numbered(with_shards(with_slots(docs.limit(0)), edited_map(slot_loads(with_slots(docs.limit(0))), 3)), ["doc_id"]).count() == 0
