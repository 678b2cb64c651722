"""Time columns.  Timestamps are UTC."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from tremorline.functions import constants as C


def instant(value: datetime | str | Column) -> Column:
    """A timestamp column from a Python value; columns pass through."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def age_seconds(ts: Column, now: datetime | str | Column) -> Column:
    return seconds_between(instant(now), ts)


def floor_15(ts: Column) -> Column:
    """The quarter hour at or before ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 900) * 900)


def hours(n: int | float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n) * 3600).cast("decimal(18,6)"))


def day_noon(day: Column, fmt: str = "yyyyMMdd") -> Column:
    """Noon UTC of a day given as text; null when the text is no such day."""
    well_formed = F.when(F.trim(day).rlike(r"^\d{8}$" if fmt == "yyyyMMdd" else r"^\d{4}-\d{2}-\d{2}$"), F.trim(day))
    return F.try_to_timestamp(well_formed, F.lit(fmt)) + hours(12)


def parse_published(text: Column, now: datetime | str | Column, convert_offset: bool = False) -> Column:
    """Publication time of an article.

    With a ``T`` the text is an ISO date-time; its offset is dropped, not applied, unless ``convert_offset``.
    Otherwise the first ten characters are a day, taken at noon.  Anything else means ``now``.
    """
    local = text if convert_offset else F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    iso = local.try_cast("timestamp") if convert_offset else local.try_cast("timestamp_ntz").cast("timestamp")
    parsed = F.when(text.contains("T"), iso).otherwise(day_noon(F.substring(text, 1, 10), "yyyy-MM-dd"))
    return F.coalesce(parsed, instant(now))


def is_stale(last_success: Column, now: datetime | str | Column, interval_seconds: int = C.POLL_SECONDS) -> Column:
    """No success yet, or the last one is more than two intervals old."""
    return F.coalesce(age_seconds(last_success, now) > 2 * interval_seconds, F.lit(True))
