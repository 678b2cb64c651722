"""Scores, dates, geography, locations."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tremorline.functions import scores as S
from tremorline.functions import timefn as D
from tremorline.functions.geo import coded_cell, explode_cells, haversine_miles, is_state_level
from tremorline.functions.nested import extract_location, json_field


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("score,precision,want", [(0.8, "venue", 0.58), (0.8, "city", 0.54), (0.6, "state", 0.42),
                                                  (1.0, "venue", 0.62), (0.0, "other", 0.3)])
def test_initial_confidence(spark, score, precision, want):
    assert one(spark, S.initial_confidence(F.lit(score), F.lit(precision))) == pytest.approx(want)


@pytest.mark.parametrize("conf,precision,cap,want", [(0.8, "venue", 0.58, 0.58), (0.8, "venue", 0.9, 0.62),
                                                     (0.8, "city", 0.9, 0.58), (0.8, "state", 0.58, 0.45),
                                                     (0.4, "city", 0.58, 0.4), (0.8, "x", 0.9, 0.45), (0.8, "venue", 0.3, 0.3)])
def test_uncorroborated_cap(spark, conf, precision, cap, want):
    assert one(spark, S.uncorroborated_cap(F.lit(conf), F.lit(precision), cap)) == pytest.approx(want)


def test_uplift(spark):
    assert one(spark, S.corroboration_uplift(F.lit(0.5), F.lit(3))) == pytest.approx(0.74)
    assert one(spark, S.corroboration_uplift(F.lit(0.98), F.lit(1))) == 1.0
    assert one(spark, S.corroboration_uplift(F.lit(0.12345), F.lit(0))) == 0.12345


@pytest.mark.parametrize("text,want", [("-10", 1.0), ("10", 0.0), ("0", 0.5), ("bad", 0.5), ("-15", 1.0), (" -2.5 ", 0.625)])
def test_goldstein(spark, text, want):
    assert one(spark, S.goldstein_severity(F.lit(text))) == pytest.approx(want)


@pytest.mark.parametrize("text,want", [("1", 0.5), ("3", 0.7), ("9", 1.0), ("", 0.5), ("0", 0.4), ("2.5", 0.5)])
def test_source_confidence(spark, text, want):
    assert one(spark, S.source_count_confidence(F.lit(text))) == pytest.approx(want)


@pytest.mark.parametrize("a,b,want", [("violence", "riot", True), ("riot", "violence", False), ("other", "other", True),
                                      ("other", "riot", False), ("novel", "novel", True), ("novel", "riot", False),
                                      ("protest", "police_clash", True), ("protest", None, False)])
def test_types_compatible(spark, a, b, want):
    assert one(spark, S.types_compatible(F.lit(a), F.lit(b).cast("string"))) is want


@pytest.mark.parametrize("p,m,want", [("venue", "city", True), ("city", "city", True), ("state", "city", False),
                                      ("odd", "city", False), ("odd", "odd", True), ("country", "odd", True)])
def test_precision(spark, p, m, want):
    assert one(spark, S.precision_passes(F.lit(p), m)) is want


@pytest.mark.parametrize("pri,trend,want", [(0.8, "escalating", "Active Hotspot"), (0.8, "stable", "Elevated Activity"),
                                            (0.6, "escalating", "Elevated Activity"), (0.5, "escalating", "Emerging"),
                                            (0.5, "declining", "De-escalating"), (0.5, "stable", "Monitored")])
def test_status(spark, pri, trend, want):
    assert one(spark, S.status_label(F.lit(pri), F.lit(trend))) == want


@pytest.mark.parametrize("r,e,rs,es,want", [(2, 1, 0.5, 0.5, "escalating"), (2, 3, 0.7, 0.5, "escalating"),
                                            (1, 0, 0.9, 0.0, "stable"), (1, 3, 0.4, 0.5, "declining"),
                                            (1, 3, 0.5, 0.4, "stable"), (0, 1, 0.0, 0.2, "declining"),
                                            (2, 2, 0.5, 0.5, "stable")])
def test_trend(spark, r, e, rs, es, want):
    assert one(spark, S.trend_state(F.lit(r), F.lit(e), F.lit(rs), F.lit(es))) == want


@pytest.mark.parametrize("text,want", [
    ("2024-03-01T12:30:00Z", "2024-03-01 12:30:00"), ("2024-03-01T12:30:00+05:00", "2024-03-01 12:30:00"),
    ("2024-03-01T12:30:00.250-0800", "2024-03-01 12:30:00"), ("2024-03-01", "2024-03-01 12:00:00"),
    ("2024-03-01 09:00", "2024-03-01 12:00:00"), ("2024-13-01", "2024-05-05 00:00:00"), ("T", "2024-05-05 00:00:00"),
    ("", "2024-05-05 00:00:00"), (None, "2024-05-05 00:00:00")])
def test_parse_published(spark, text, want):
    ts = D.parse_published(F.lit(text).cast("string"), "2024-05-05 00:00:00")
    assert one(spark, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")) == want


def test_convert_offset(spark):
    ts = D.parse_published(F.lit("2024-03-01T12:30:00+05:00"), "2024-05-05", convert_offset=True)
    assert one(spark, F.date_format(ts, "HH:mm")) == "07:30"


@pytest.mark.parametrize("day,want", [("20240229", "2024-02-29 12:00"), ("20240230", None), ("2024-02-01", None), ("", None)])
def test_day_noon(spark, day, want):
    assert one(spark, F.date_format(D.day_noon(F.lit(day)), "yyyy-MM-dd HH:mm")) == want


def test_floor_15(spark):
    ts = F.lit("2024-03-01 12:44:59").cast("timestamp")
    assert one(spark, F.date_format(D.floor_15(ts), "HH:mm:ss")) == "12:30:00"


def test_haversine(spark):
    d = one(spark, haversine_miles(F.lit(47.6062), F.lit(-122.3321), F.lit(45.5231), F.lit(-122.6765)))
    assert d == pytest.approx(145, abs=1.0)
    half = one(spark, haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert half == pytest.approx(math.pi * 3958.8)


def test_cells_cover_the_neighbourhood(spark):
    """Any point within the radius, also across the date line and at a pole, lies in one of the listed cells."""
    places = [(47.6, -122.3), (0.0, 179.99), (89.9, 10.0), (-33.0, 0.0), (60.0, -180.0)]
    rows = []
    for k, (lat, lon) in enumerate(places):
        for step in range(60):
            bearing, arc = step * 0.7, (step % 6 + 1) * 8.3 / 3958.8
            p1, l1 = math.radians(lat), math.radians(lon)
            p2 = math.asin(math.sin(p1) * math.cos(arc) + math.cos(p1) * math.sin(arc) * math.cos(bearing))
            l2 = l1 + math.atan2(math.sin(bearing) * math.sin(arc) * math.cos(p1), math.cos(arc) - math.sin(p1) * math.sin(p2))
            rows.append((k, lat, lon, math.degrees(p2), (math.degrees(l2) + 180) % 360 - 180))
    df = spark.createDataFrame(rows, "k int, lat double, lon double, lat2 double, lon2 double")
    near = explode_cells(df.select("k", "lat", "lon").distinct(), "lat", "lon", 100.0, 50.0).select("k", "cell")
    missed = df.withColumn("cell", coded_cell(F.col("lat2"), F.col("lon2"), 100.0)).join(near, ["k", "cell"], "left_anti")
    assert missed.count() == 0


def test_state_level(spark):
    assert one(spark, is_state_level(F.lit("New York"), F.lit("NY")))
    assert one(spark, is_state_level(F.lit("TX"), F.lit("TX")))
    assert not one(spark, is_state_level(F.lit(None).cast("string"), F.lit("TX")))


LOCATIONS = [
    ({"type": {"type": "city"}, "label": {"eng": "Seattle, Washington, United States"}, "lat": 47.6, "long": -122.3},
     (47.6, -122.3, "Seattle", "WA", "city")),
    ({"type": "place", "label": "Pioneer Square, Seattle, WA", "lat": "47.6", "long": "-122.3"},
     (47.6, -122.3, "Pioneer Square", "WA", "venue")),
    ({"type": {"type": "admin1"}, "label": {"eng": "Minnesota"}}, (46.4, -93.1, None, "MN", "state")),
    ({"type": {"type": "city"}, "label": {"eng": "St. Paul, Minnesota, United States"}},
     (46.4, -93.1, "St. Paul", "MN", "state")),
    ({"type": {"type": "country"}, "label": {"eng": "United States"}, "lat": 1, "long": 1}, None),
    ({"type": {"type": "city"}, "label": {"eng": "Paris, France"}}, None),
    ({"type": {"type": "city"}, "label": {"eng": "Paris, France"}, "lat": 48.8, "long": 2.3},
     (48.8, 2.3, "Paris", None, "city")),
    ({"label": {"eng": "Nowhere"}, "lat": 0, "long": 0}, None),
    ({"type": {"type": "city"}, "label": {"eng": "Reno, Nevada"}, "lat": "bad", "long": 1},
     (39.3, -116.6, "Reno", "NV", "state")),
    ({"type": {}, "label": {"eng": "United States"}, "lat": 39.0, "long": -98.0},
     (39.0, -98.0, "United States", None, "city")),
    ({}, None), (None, None),
]


@pytest.mark.parametrize("i", range(len(LOCATIONS)))
def test_extract_location(spark, i):
    raw, want = LOCATIONS[i]
    got = one(spark, extract_location(F.lit(json.dumps(raw) if raw is not None else None).cast("string")))
    assert (tuple(got) if got is not None else None) == want


def test_json_field(spark):
    assert one(spark, json_field(F.lit('{"er_event_uri": "eng-1"}'), "er_event_uri")) == "eng-1"
    assert one(spark, json_field(F.lit("{broken"), "er_event_uri")) is None
