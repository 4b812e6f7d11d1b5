"""Column functions on positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km on a sphere of 6 371 km."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def geo_cell(degrees: Column, size: float = 0.001) -> Column:
    return F.floor(degrees / F.lit(size))


def near_null_island(lat: Column, lon: Column) -> Column:
    """The wide test for a void fix: both values within 0.001 degree of 0."""
    return (F.abs(lat) < 1e-3) & (F.abs(lon) < 1e-3)


def at_null_island(lat: Column, lon: Column) -> Column:
    """The strict test for a void fix: both values exactly 0."""
    return (lat == 0.0) & (lon == 0.0)


def interpolate(before: Column, after: Column, share: Column) -> Column:
    return before + share * (after - before)


def hemisphere(degrees: Column, ref: Column) -> Column:
    """Applies S or W to a positive value; a negative value keeps its sign."""
    flips = F.upper(F.left(F.btrim(ref), F.lit(1))).isin("S", "W")
    return F.when(flips & (degrees > 0), -degrees).otherwise(degrees)


def gps_patch(lat: Column, lon: Column) -> Column:
    """The four tags that store a position, six decimals and reference letters."""
    return F.create_map(
        F.lit("GPSLatitude"), F.format_string("%.6f", lat),
        F.lit("GPSLatitudeRef"), F.when(lat >= 0, "N").otherwise("S"),
        F.lit("GPSLongitude"), F.format_string("%.6f", lon),
        F.lit("GPSLongitudeRef"), F.when(lon >= 0, "E").otherwise("W"),
    )
