"""Declared table schemas, and the checks and casts that keep DataFrames on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def _fields(spec: str) -> T.StructType:
    """``name type`` pairs, one per comma; a trailing ``!`` marks a column that may not be null."""
    types = {"long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(),
             "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
    out = []
    for item in spec.replace("\n", " ").split(","):
        name, kind = item.split()
        out.append(T.StructField(name, types[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(out)


EVENT = _fields("""
    id long, external_id string, source_id string, title string!, summary string, event_type string!, city string,
    state string, country string!, latitude double!, longitude double!, occurred_at timestamp!,
    ingested_at timestamp!, source_url string, source_name string!, source_count int!, confidence_score double!,
    severity_score double!, cluster_id long, trend_state string, is_active boolean!, location_precision string,
    raw_payload_json string""")

HOTSPOT = _fields("""
    id long!, name string!, centroid_lat double!, centroid_lon double!, event_count long!,
    confidence_score double!, severity_score double!, momentum_score double!, priority_score double!,
    trend_state string, status_label string, last_computed_at timestamp""")

EVENT_SOURCE = _fields("""
    id long, event_id long!, source_type string!, source_record_id string, source_name string, source_url string,
    source_title string, source_published_at timestamp, source_trust_weight double!, location_precision string,
    metadata_json string, created_at timestamp!""")

INGEST_RUN = _fields("""
    id long, started_at timestamp!, finished_at timestamp, status string!, events_inserted long!,
    error_message string, ingest_source string""")

# What a source adapter has to deliver; the remaining event columns get the defaults below.
NEW_EVENT = _fields("""
    source_id string, title string!, summary string, event_type string!, city string, state string,
    country string!, latitude double!, longitude double!, occurred_at timestamp!, source_url string,
    source_name string!, source_count int!, confidence_score double!, severity_score double!,
    location_precision string, raw_payload_json string""")

EVENT_DEFAULTS = {"country": "US", "source_count": 1, "confidence_score": 1.0, "severity_score": 0.0,
                  "is_active": True}

# ``location`` stays text: its ``type`` and ``label`` are objects in some articles and strings in others.
ARTICLE = T.StructType([
    T.StructField("uri", T.StringType()), T.StructField("eventUri", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("body", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("dateTimePub", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("source", T.StructType([T.StructField("title", T.StringType())])),
    T.StructField("location", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StructType([
        T.StructField("uri", T.StringType()), T.StructField("label", T.StringType())]))),
    T.StructField("concepts", T.ArrayType(T.StructType([T.StructField("uri", T.StringType())]))),
])


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Raise unless ``df`` has every column of ``schema`` with the declared type; returns ``df``."""
    have = {f.name: f.dataType for f in df.schema.fields}
    problems = [f"{f.name}: missing" for f in schema.fields if f.name not in have]
    problems += [f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}"
                 for f in schema.fields if f.name in have and have[f.name] != f.dataType]
    if problems:
        raise ValueError("schema mismatch: " + "; ".join(problems))
    return df


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Add columns that were introduced later (null, or the default), cast the rest, order as declared."""
    defaults = defaults or {}
    have = set(df.columns)

    def column(f: T.StructField) -> Column:
        default = F.lit(defaults.get(f.name)).cast(f.dataType)
        if f.name not in have:
            return default.alias(f.name)
        value = F.col(f.name).cast(f.dataType)
        return (F.coalesce(value, default) if f.name in defaults else value).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


def as_events(new_events: DataFrame, ingested_at: Column) -> DataFrame:
    """Complete adapter rows to full event rows."""
    return conform(new_events.withColumn("ingested_at", ingested_at), EVENT, EVENT_DEFAULTS)
