"""Score columns.  All arithmetic is on doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tremorline.functions import constants as C
from tremorline.functions.geo import lookup


def round_to(x: Column, digits: int) -> Column:
    """Half-up rounding as ``floor(x * 10^n + 0.5) / 10^n``, the same on every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def round3(x: Column) -> Column:
    return round_to(x, 3)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def goldstein_severity(scale: Column) -> Column:
    """-10 (destabilising) .. 10 (stabilising) to 1 .. 0; text that is no number counts as 0."""
    g = F.coalesce(scale.try_cast("double"), F.lit(0.0))
    return clamp((F.lit(10.0) - g) / F.lit(20.0), 0.0, 1.0)


def source_count(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(1))


def source_count_confidence(text: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.5) + (source_count(text) - 1).cast("double") * F.lit(0.1))


def initial_confidence(score: Column, precision: Column) -> Column:
    bonus = lookup(precision, C.PRECISION_BONUS, 0.0)
    return round3(clamp(F.lit(0.30) + F.lit(0.20) * score + bonus, 0.15, 1.0))


def uncorroborated_cap(confidence: Column, precision: Column, max_cap: float = C.UNCORROBORATED_CAP) -> Column:
    """Cap by precision tier; ``max_cap`` can only tighten it."""
    tier = lookup(precision, C.PRECISION_CAP, C.DEFAULT_PRECISION_CAP)
    return round3(F.least(confidence, tier, F.lit(float(max_cap))))


def corroboration_uplift(confidence: Column, n: Column, step: float = C.CORROBORATION_UPLIFT) -> Column:
    """Confidence after ``n`` independent sources; unchanged when there are none."""
    lifted = round3(F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)) + F.lit(step) * n.cast("double")))
    return F.when(n > 0, lifted).otherwise(confidence)


def type_severity(event_type: Column) -> Column:
    return lookup(event_type, C.TYPE_SEVERITY, C.DEFAULT_SEVERITY)


def geo_type_precision(geo_type: Column) -> Column:
    return lookup(geo_type, C.GEO_TYPE_PRECISION, "city")


def precision_rank(precision: Column) -> Column:
    return lookup(precision, {p: i for i, p in enumerate(C.PRECISIONS)}, 99)


def precision_passes(precision: Column, minimum: Column | str) -> Column:
    minimum = F.lit(minimum) if isinstance(minimum, str) else minimum
    return precision_rank(precision) <= precision_rank(minimum)


def types_compatible(first: Column, second: Column, table: dict[str, list[str]] = C.COMPATIBLE_TYPES) -> Column:
    """May an article of type ``first`` describe an incident of type ``second``?  Directional; an unknown first
    type is compatible with itself only."""
    listed = [f"{a}>{b}" for a, others in table.items() for b in others]
    known = F.coalesce(first.isin(list(table)), F.lit(False))
    pair = F.concat(first, F.lit(">"), F.coalesce(second, F.lit("")))
    return F.coalesce(pair.isin(listed) | (~known & (first == second)), F.lit(False))


def cluster_priority(severity: Column, momentum: Column, n: Column) -> Column:
    return round3(F.lit(0.5) * severity + F.lit(0.3) * momentum
                  + F.lit(0.2) * F.least(F.lit(1.0), n.cast("double") / F.lit(5.0)))


def trend_state(recent: Column, earlier: Column, recent_severity: Column, earlier_severity: Column) -> Column:
    """Trend from counts and mean severities of the last 8 hours and of the 16 hours before."""
    up = (recent >= 2) & ((recent > earlier) | (recent_severity > earlier_severity + F.lit(0.15)))
    down = (earlier > recent * 2) & (earlier_severity > recent_severity)
    return F.when(up, F.lit("escalating")).when(down, F.lit("declining")).otherwise(F.lit("stable"))


def status_label(priority: Column, trend: Column) -> Column:
    return (F.when((priority >= F.lit(0.8)) & (trend == "escalating"), F.lit("Active Hotspot"))
            .when(priority >= F.lit(0.6), F.lit("Elevated Activity"))
            .when(trend == "escalating", F.lit("Emerging"))
            .when(trend == "declining", F.lit("De-escalating"))
            .otherwise(F.lit("Monitored")))


def severity_bucket(severity: Column) -> Column:
    return (F.when(severity >= F.lit(0.8), F.lit("critical")).when(severity >= F.lit(0.6), F.lit("high"))
            .when(severity >= F.lit(0.4), F.lit("medium")).otherwise(F.lit("low")))


def heat_weight(severity: Column) -> Column:
    """Linear from 0.5 at severity 0 to 1.5 at severity 1, flat outside."""
    return F.lit(0.5) + clamp(severity, 0.0, 1.0)
