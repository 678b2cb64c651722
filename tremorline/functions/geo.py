"""Geography columns: distance, spatial cells, state look-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tremorline.functions import constants as C


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """Value of ``key`` in a small constant table, else ``default``.

    The table is one text literal that Spark folds to a constant map, so plans stay small.
    """
    kind = {str: "string", float: "double", int: "int"}[type(next(iter(table.values())))]
    text = "\x1f".join(f"{k}\x1e{v}" for k, v in table.items())
    found = F.try_element_at(F.str_to_map(F.lit(text), F.lit("\x1f"), F.lit("\x1e")), key).cast(kind)
    return found if default is None else F.coalesce(found, F.lit(default))


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the argument of the arc sine is kept at or below 1 against rounding."""
    half_dlat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(2 * C.EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def sphere_point(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Position in miles from the centre of the earth.

    A straight line between two points is never longer than the arc, so points within ``r`` miles differ by at
    most ``r`` on each axis.  Unlike latitude/longitude cells this needs no care at poles or the date line.
    """
    r = F.lit(C.EARTH_RADIUS_MILES)
    return (r * F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
            r * F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
            r * F.sin(F.radians(lat)))


def cell(lat: Column, lon: Column, size: float) -> Column:
    """The cube of ``size`` miles a point lies in."""
    x, y, z = [F.floor(v / F.lit(float(size))) for v in sphere_point(lat, lon)]
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def cell_code(x: Column, y: Column, z: Column) -> Column:
    """A cube as one number; good for cubes down to a few yards."""
    half = 1 << 20
    return F.shiftleft(x + half, 42) + F.shiftleft(y + half, 21) + (z + half)


def coded_cell(lat: Column, lon: Column, size: float) -> Column:
    return cell_code(*[F.floor(v / F.lit(float(size))) for v in sphere_point(lat, lon)])


def explode_cells(df: DataFrame, lat: str, lon: str, size: float, radius: float) -> DataFrame:
    """One row per cube (``cell``) that can hold a point within ``radius`` miles: at most 8 when
    ``size >= 2 * radius``."""
    slack = radius * (1 + 1e-9) + 1e-6
    df = df.withColumns(dict(zip(("_x", "_y", "_z"), sphere_point(F.col(lat), F.col(lon)))))
    for axis in ("_x", "_y", "_z"):
        df = df.withColumn(axis, F.explode(F.sequence(
            F.floor((F.col(axis) - slack) / F.lit(float(size))), F.floor((F.col(axis) + slack) / F.lit(float(size))))))
    return df.withColumn("cell", cell_code(F.col("_x"), F.col("_y"), F.col("_z"))).drop("_x", "_y", "_z")


def grid_index(degrees: Column, cell_degrees: float) -> Column:
    return F.floor(degrees / F.lit(float(cell_degrees)))


def is_country_level(city: Column, labels: Sequence[str] = C.COUNTRY_LABELS) -> Column:
    return F.coalesce(city.isin(list(labels)), F.lit(False))


def is_state_level(city: Column, state: Column, names: Sequence[str] = C.STATE_NAMES) -> Column:
    return F.coalesce(city.isin(list(names)), F.lit(False)) | F.coalesce(city == state, F.lit(False))


def is_county(city: Column) -> Column:
    return F.lower(city).contains("county") | F.lower(city).contains("parish")


def state_code(name: Column) -> Column:
    """Abbreviation of a state name; any two-character text passes as it is; else null."""
    return F.coalesce(lookup(name, C.STATE_ABBREVIATION), F.when(F.length(name) == 2, name))


def state_centroid(code: Column) -> tuple[Column, Column]:
    return (lookup(code, {k: v[0] for k, v in C.STATE_CENTROID.items()}),
            lookup(code, {k: v[1] for k, v in C.STATE_CENTROID.items()}))


def adm1_state(adm1: Column) -> Column:
    """``xx`` of a four-character ``USxx`` region code, else null."""
    return F.when(adm1.startswith("US") & (F.length(adm1) == 4), F.substring(adm1, 3, 2))


def first_place(full_name: Column) -> Column:
    """First comma-separated part of a place name, or null when empty."""
    part = F.trim(F.split_part(full_name, F.lit(","), F.lit(1)))
    return F.when(F.length(part) > 0, part)
