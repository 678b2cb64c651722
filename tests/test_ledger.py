"""Ledgers and published versions: equality with whole recomputation, what is read, readers between two writes."""

import random

import pytest
from pyspark.sql import functions as F

from tremorline.sources import ledger
from tremorline.sources.ledger import Ledger, publish, published
from tremorline.streaming import live

COUNTS = "event_id long, independent long, syndicated long"


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_after_random_batches_retries_and_merges(spark, tmp_path, seed):
    rnd, held = random.Random(seed), {}
    book = Ledger(str(tmp_path), COUNTS, live.summed_counts)
    for batch in range(7):
        for _ in range(rnd.choice([1, 1, 2])):  # the newest batch may be run again, with other rows
            held[batch] = [(rnd.randrange(5), rnd.randrange(3), rnd.randrange(3)) for _ in range(rnd.randrange(4))]
            book.add(spark.createDataFrame(held[batch], COUNTS), batch)
        if rnd.random() < 0.5:
            book.merge(spark)
        want = {}
        for e, i, s in (r for rows in held.values() for r in rows):
            a, b = want.get(e, (0, 0))
            want[e] = (a + i, b + s)
        assert {r[0]: (r[1], r[2]) for r in live.summed_counts(book.read(spark)).collect()} == want
    book.merge(spark)
    with pytest.raises(ValueError, match="merged already"):
        book.add(spark.createDataFrame([], COUNTS), 3)


def test_reading_touches_the_base_and_the_open_batches_only(spark, tmp_path):
    book = Ledger(str(tmp_path), COUNTS, live.summed_counts)
    for batch in range(5):
        book.add(spark.createDataFrame([(1, 1, 0)], COUNTS), batch)
    book.merge(spark)
    files = book.read(spark).inputFiles()
    assert {f.split("/")[-2] for f in files} == {"version=000000000001", "batch=000000000004"}


def test_a_batch_reads_its_buckets_of_the_ids(spark, tmp_path):
    store = live.Store(str(tmp_path))
    old = spark.range(500).select(F.concat(F.lit("gdelt-"), "id").alias("source_id"))
    store.ids("gdelt").add(live.id_rows(old), 1)
    batch = spark.createDataFrame([("gdelt-7",), ("gdelt-9999",), (None,), ("",)], "source_id string")
    known = store.stored_ids(batch, "gdelt", 2)
    buckets = {r[0] for r in batch.limit(2).select(live.id_bucket(F.col("source_id"))).collect()}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "title" not in plan  # no column of the incidents is read
    got = {r[0] for r in known.collect()}
    assert got == {r["source_id"] for r in old.where(live.id_bucket(F.col("source_id")).isin(buckets)).collect()}
    assert "gdelt-7" in got and "gdelt-9999" not in got
    assert store.stored_ids(batch, "gdelt", 1).count() == 0  # what an earlier attempt at the batch wrote does not count


def one(spark, n):
    return spark.createDataFrame([(n,)], "v int")


def test_readers_see_all_tables_of_a_version_or_none(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert published(spark, root, "a") is None
    publish(spark, root, {"a": one(spark, 1), "b": one(spark, 1)})

    def fails(*_):
        raise RuntimeError("stopped between the tables and the manifest")

    with monkeypatch.context() as m:
        m.setattr(ledger, "write_manifest", fails)
        with pytest.raises(RuntimeError):
            publish(spark, root, {"a": one(spark, 2), "b": one(spark, 2)})
    assert [published(spark, root, t).first()["v"] for t in "ab"] == [1, 1]
    publish(spark, root, {"a": one(spark, 3), "b": one(spark, 3)})
    publish(spark, root, {"a": one(spark, 4)})
    assert [published(spark, root, t).first()["v"] for t in "ab"] == [4, 3]


def test_old_versions_go(spark, tmp_path):
    root = str(tmp_path)
    publish(spark, root, {"b": one(spark, 0)})
    for n in range(1, 6):
        publish(spark, root, {"a": one(spark, n)}, keep=2)
    assert sorted(p.name for p in (tmp_path / "a").iterdir() if p.name.startswith("version")) == [
        f"version={n:012d}" for n in (5, 6)]
    assert published(spark, root, "b").first()["v"] == 0  # still named, however old
    assert len(ledger.manifests(spark, f"{root}/_published")) == 2


def test_a_trend_batch_writes_the_days_it_changed(spark, tmp_path):
    store = live.Store(str(tmp_path / "store"))
    landed = tmp_path / "landed"
    schema = "event_type string, occurred_at timestamp"

    def land(*times):
        rows = spark.createDataFrame([("protest", t) for t in times], "event_type string, t string")
        rows.select("event_type", F.col("t").cast("timestamp").alias("occurred_at")).coalesce(1).write.mode("append").parquet(str(landed))
        live.run_trend_windows(spark.readStream.schema(schema).parquet(str(landed)), store, ["event_type"], "5 days")

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "trend_windows").rglob("*.parquet")}

    land("2025-03-14 01:00:00", "2025-03-15 01:00:00", "2025-03-15 09:00:00")
    first = files()
    land("2025-03-15 02:00:00")
    second = files()
    assert {p.parent.name for p in first if p in second} == {"window_date=2025-03-14"}
    got = {str(r["window_start"]): r["event_count"] for r in store.trends(spark).collect()}
    assert got == {"2025-03-14 00:00:00": 1, "2025-03-15 00:00:00": 2, "2025-03-15 08:00:00": 1}
