"""Greedy clusters against the sequential rule, and hotspots of the sample incidents."""

import math
import random
from datetime import datetime, timedelta

import pytest

from tremorline.operators.anchors import anchor_clusters
from tremorline.operators.clustering import greedy_clusters
from tremorline.operators.hotspots import assign_clusters, compute_hotspots, hotspot_names
from tremorline.schemas import as_events
from tremorline.sources.samples import sample_events
from pyspark.sql import functions as F

NOW = datetime(2026, 3, 27, 12)
SHAPE = "id long, latitude double, longitude double, city string, state string, occurred_at timestamp"


def miles(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(min(1, h)))


def sequential(rows, radius=75.0):
    clusters, out = [], {}
    for i, la, lo, city, state, ts in sorted(rows, key=lambda r: (-r[5].timestamp(), r[0])):
        near = min(clusters, key=lambda c: miles(la, lo, c[1], c[2]), default=None)
        if near is not None and miles(la, lo, near[1], near[2]) <= radius:
            n = near[3]
            near[1], near[2], near[3] = (near[1] * n + la) / (n + 1), (near[2] * n + lo) / (n + 1), n + 1
        else:
            near = [i, la, lo, 1]
            clusters.append(near)
        out[i] = near[0]
    return out


def layout(seed, n, spread):
    rnd = random.Random(seed)
    centres = [(rnd.uniform(30, 30 + spread), rnd.uniform(-115, -115 + 2 * spread)) for _ in range(12)]
    rows = []
    for i in range(n):
        la, lo = rnd.choice(centres)
        hot = rnd.random() < 0.33  # a third of all rows at one instant
        ts = NOW - timedelta(hours=12) if hot else NOW - timedelta(minutes=rnd.randint(0, 4000))
        rows.append((i, la + rnd.gauss(0, 0.6), lo + rnd.gauss(0, 0.8), "Town", "XX", ts))
    return rows


@pytest.mark.parametrize("seed,spread,rows_per_task", [
    (1, 15, 10_000), (2, 15, 10_000), (3, 5, 10_000), (4, 15, 37), (5, 5, 50), (6, 2, 64)])
def test_greedy_agrees_with_the_sequential_rule(spark, seed, spread, rows_per_task):
    rows = layout(seed, 300, spread)
    got = greedy_clusters(spark.createDataFrame(rows, SHAPE), rows_per_task=rows_per_task).collect()
    assert {r["id"]: r["seed"] for r in got} == sequential(rows)


def test_imprecise_incidents_do_not_cluster(spark):
    rows = [(1, 47.6, -122.3, "Washington", "WA", NOW), (2, 47.6, -122.3, "TX", "TX", NOW),
            (3, 47.6, -122.3, "United States", None, NOW), (4, 47.6, -122.3, None, None, NOW)]
    got = greedy_clusters(spark.createDataFrame(rows, SHAPE)).collect()
    assert [(r["id"], r["seed"]) for r in got] == [(4, 4)]


def test_nothing_to_cluster(spark):
    assert greedy_clusters(spark.createDataFrame([], SHAPE)).count() == 0


def test_sample_incidents(spark):
    """16 sample incidents make exactly two hotspots."""
    events = as_events(sample_events(spark, NOW), F.lit(NOW).cast("timestamp")).withColumn(
        "id", F.xxhash64("source_id"))
    hotspots, membership = compute_hotspots(events, NOW)
    got = [(r["id"], r["name"], r["event_count"], r["severity_score"], r["confidence_score"], r["momentum_score"],
            r["priority_score"], r["trend_state"], r["status_label"]) for r in hotspots.orderBy("id").collect()]
    assert got == [
        (1, "Seattle, WA", 3, 0.875, 0.883, 0.704, 0.769, "escalating", "Elevated Activity"),
        (2, "Chicago, IL", 3, 0.975, 0.857, 0.756, 0.834, "escalating", "Active Hotspot")]
    after = assign_clusters(events, membership)
    assert {(r["cluster_id"], r["trend_state"]) for r in after.filter("city = 'Seattle'").collect()} == {(1, "escalating")}
    assert after.filter("cluster_id is not null").count() == 6


def test_sample_ids(spark):
    ids = [r["source_id"] for r in sample_events(spark, NOW).collect()]
    assert len(set(ids)) == 16 and "mock-seattle-wa-03" in ids and "mock-san-antonio-tx-01" in ids


def test_state_groups_form_hotspots(spark):
    rows = [(i, "texas event", "protest", "TX", "TX", 31.0, -100.0, NOW, NOW, "mock", 1, 0.5, 0.5, True) for i in range(3)]
    events = spark.createDataFrame(rows, "id long, title string, event_type string, city string, state string, latitude "
                                   "double, longitude double, occurred_at timestamp, ingested_at timestamp, source_name "
                                   "string, source_count int, confidence_score double, severity_score double, is_active "
                                   "boolean").withColumn("location_precision", F.lit("state"))
    row = compute_hotspots(events, NOW)[0].first()
    assert (row["name"], row["event_count"]) == ("Texas region", 3)


NAMES = [
    ([("Fort Worth", "TX"), ("Fort Worth", "TX"), ("Dallas", "TX")], "Fort Worth, TX"),
    ([("California", "CA"), ("Fresno", "CA")], "Fresno, CA"),
    ([("Reno", None)], "Reno"),
    ([("Harris County", "TX"), ("Texas", "TX")], "Harris County, TX"),
    ([("Orleans Parish", "LA")], "Orleans Parish, LA"),
    ([("TX", "TX"), (None, "TX"), (None, "CA")], "Texas region"),
    ([(None, "DC")], "Washington, D.C. region"),
    ([(None, None), ("United States", None)], "Cluster (32.5°N, 97.0°W)"),
]


@pytest.mark.parametrize("i", range(len(NAMES)))
def test_names(spark, i):
    members, want = NAMES[i]
    rows = [(k, "g", c, s, 32.5, -97.0, NOW, 32.5, -97.0) for k, (c, s) in enumerate(members)]
    df = spark.createDataFrame(rows, "id long, grp string, city string, state string, latitude double, longitude double, "
                                     "occurred_at timestamp, centroid_lat double, centroid_lon double")
    assert hotspot_names(df, "grp").first()["name"] == want


def anchored(rows, radius=75.0):
    """The rounds of contenders on plain lists."""
    size, earth = radius / 1.8, 3958.8
    places = {}
    for i, la, lo, _, _, ts in rows:
        n, last, first = places.get((la, lo), (0, 0, i))
        places[la, lo] = n + 1, max(last, ts.timestamp()), min(first, i)

    def cube(p):
        la, lo = map(math.radians, p)
        return tuple(math.floor(earth * v / size) for v in (math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)))

    def rank(p):
        return -places[p][0], -places[p][1], p

    uncovered, anchors = set(places), []
    while uncovered:
        best = {}
        for p in uncovered:
            best[cube(p)] = min(best.get(cube(p), p), p, key=rank)
        new = [p for p in best.values() if not any(rank(q) < rank(p) and miles(*p, *q) <= radius for q in best.values())]
        anchors += new
        uncovered = {p for p in uncovered if not any(miles(*p, *a) <= radius for a in new)}
    return {r[0]: places[min((a for a in anchors if miles(r[1], r[2], *a) <= radius), key=lambda a: (miles(r[1], r[2], *a), rank(a)))][2]
            for r in rows}


@pytest.mark.parametrize("seed,spread", [(1, 15), (5, 5), (6, 2)])
def test_anchors_agree_with_plain_rounds(spark, seed, spread):
    rows = layout(seed, 300, spread) + [(1000 + k, 30.0, -100.0, "Town", "XX", NOW) for k in range(150)]
    df = spark.createDataFrame(rows, SHAPE)
    want = anchored(rows)
    for parts in (1, 7):
        assert dict(anchor_clusters(df.repartition(parts)).collect()) == want


def test_anchors_across_the_date_line_and_without_places(spark):
    rows = [(i, 10.0, lon, "Town", "XX", NOW) for i, lon in enumerate((179.9, -179.9, 0.1, 179.8))]
    got = dict(anchor_clusters(spark.createDataFrame([*rows, (9, None, None, "Town", "XX", NOW)], SHAPE)).collect())
    assert got[0] == got[1] == got[3] and got[2] == 2 and 9 not in got
    assert anchor_clusters(spark.createDataFrame([], SHAPE)).count() == 0
    plan = anchor_clusters(spark.createDataFrame(rows, SHAPE))._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
