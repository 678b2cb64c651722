"""Sample incidents for demonstrations and tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tremorline.functions import constants as C
from tremorline.functions.text import slug
from tremorline.functions.timefn import instant
from tremorline.schemas import NEW_EVENT, conform

#: Own headlines; place, numbers and hours decide the results: type, severity, confidence, latitude, longitude, city,
#: state and hours ago are fixed values.
SAMPLES = [
    ("Fight breaks out between rival marches downtown", "violence", 0.9, 0.88, 47.6062, -122.3321, "Seattle", "WA", 1),
    ("Marchers close the southbound lanes", "disruption", 0.7, 0.92, 47.5952, -122.3318, "Seattle", "WA", 3),
    ("Crowd scuffles with officers at the station", "violence", 0.85, 0.85, 47.6205, -122.3492, "Seattle", "WA", 6),
    ("Fire bomb damages a courthouse entrance", "violence", 0.95, 0.8, 45.5231, -122.6765, "Portland", "OR", 2),
    ("Tents fill the avenue for a third day", "disruption", 0.5, 0.95, 45.5122, -122.6587, "Portland", "OR", 8),
    ("Gunman surrounded near an apartment tower", "violence", 1.0, 0.9, 41.8781, -87.6298, "Chicago", "IL", 2),
    ("Night of disorder after a fatal arrest", "unrest", 0.9, 0.85, 41.8827, -87.6233, "Chicago", "IL", 4),
    ("Bystanders hurt as rival groups exchange fire", "violence", 0.85, 0.82, 41.865, -87.6412, "Chicago", "IL", 7),
    ("Dock walkout ends in pushing at the gates", "disruption", 0.6, 0.88, 29.7604, -95.3698, "Houston", "TX", 5),
    ("Students hold a sit-in at the county offices", "protest", 0.5, 0.91, 29.7537, -95.3673, "Houston", "TX", 9),
    ("Walk against new border rules stops traffic", "protest", 0.65, 0.78, 29.4241, -98.4936, "San Antonio", "TX", 11),
    ("Thousands rally on the Mall", "protest", 0.3, 0.95, 38.9072, -77.0369, "Washington", "DC", 3),
    ("Sanitation crews strike at the mayor's office", "protest", 0.4, 0.9, 40.7128, -74.006, "New York", "NY", 6),
    ("March delays buses and trolleys", "disruption", 0.45, 0.87, 39.9526, -75.1652, "Philadelphia", "PA", 10),
    ("Sit-down on the ramp stops evening traffic", "disruption", 0.6, 0.93, 34.0522, -118.2437, "Los Angeles", "CA", 4),
    ("Truck drivers' picket turns heated", "disruption", 0.5, 0.85, 33.7515, -118.231, "Los Angeles", "CA", 12),
]


def sample_events(spark: SparkSession, now: datetime | str | Column) -> DataFrame:
    """16 incidents with ids that stay the same from run to run."""
    rows = [(i, *sample) for i, sample in enumerate(SAMPLES)]
    df = spark.createDataFrame(rows, "ord int, title string, event_type string, severity_score double, "
                                     "confidence_score double, latitude double, longitude double, city string, "
                                     "state string, hours_ago int")
    place = slug(F.col("city"), F.col("state"))
    number = F.row_number().over(Window.partitionBy(place).orderBy("ord"))
    out = df.withColumns({
        "source_id": F.format_string(f"{C.SAMPLE_FEED}-%s-%02d", place, number),
        "occurred_at": instant(now) - F.make_dt_interval(F.lit(0), F.col("hours_ago")),
        "source_name": F.lit(C.SAMPLE_FEED)})
    return conform(out, NEW_EVENT, {"country": "US", "source_count": 1})
