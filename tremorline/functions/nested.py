"""Nested and JSON columns of articles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import lookup, state_centroid, state_code


def location_type(location: Column) -> Column:
    """``location.type.type`` or, where the type is plain text, ``location.type``."""
    plain = F.get_json_object(location, "$.type")
    return F.coalesce(F.get_json_object(location, "$.type.type"),
                      F.when(~plain.startswith("{"), plain), F.lit(""))


def location_label(location: Column) -> Column:
    """``location.label.eng`` or, where the label is plain text, ``location.label``."""
    plain = F.get_json_object(location, "$.label")
    return F.coalesce(F.get_json_object(location, "$.label.eng"),
                      F.when(~plain.startswith("{"), plain), F.lit(""))


def label_parts(label: Column) -> Column:
    """Trimmed comma-separated parts, without a trailing country part."""
    parts = F.transform(F.split(label, ","), lambda p: F.trim(p))
    has_country = (F.size(parts) > 1) & F.lower(F.element_at(parts, -1)).contains("united states")
    return F.when(has_country, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def extract_location(location: Column) -> Column:
    """Place of an article from its ``location`` JSON text: ``latitude, longitude, city, state, precision``, or null.

    Country-level places are rejected.  Without coordinates the centroid of the state stands in, and precision
    drops to ``state``; without a known state the article has no location.
    """
    kind = location_type(location)
    stated = lookup(kind, C.LOCATION_TYPE_PRECISION, "city")
    parts = label_parts(location_label(location))
    first, last = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(-1))
    state = F.when(stated == "state", state_code(first)).when(F.size(parts) >= 2, state_code(last))
    city = F.when(stated != "state", first)

    lat = F.get_json_object(location, "$.lat").try_cast("double")
    lon = F.get_json_object(location, "$.long").try_cast("double")
    given = lat.isNotNull() & lon.isNotNull()
    centroid_lat, centroid_lon = state_centroid(state)
    latitude = F.when(given, lat).otherwise(centroid_lat)
    longitude = F.when(given, lon).otherwise(centroid_lon)
    usable = ((kind != "country") & latitude.isNotNull() & longitude.isNotNull()
              & ~((latitude == 0.0) & (longitude == 0.0)))
    return F.when(usable, F.struct(
        latitude.alias("latitude"), longitude.alias("longitude"), city.alias("city"), state.alias("state"),
        F.when(given, stated).otherwise(F.lit("state")).alias("precision")))


def json_field(text: Column, field: str) -> Column:
    """A top-level field of JSON text; null for missing fields and malformed text."""
    return F.get_json_object(text, f"$.{field}")


def first_labels(categories: Column, n: int | None = 5) -> Column:
    labels = F.transform(categories, lambda c: c["label"])
    return labels if n is None else F.slice(labels, 1, n)


def payload(**fields: Column) -> Column:
    """JSON text that keeps null fields."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})
