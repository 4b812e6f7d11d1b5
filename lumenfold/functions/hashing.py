"""Column functions for keys and checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_checksum(path: Column) -> Column:
    return F.sha1(F.concat(F.lit("path:"), path))


def stable_key(lat: Column, lon: Column, day: Column) -> Column:
    """12 hex digits of the centre to three decimals and the first day of an event."""
    return F.left(
        F.sha1(F.concat(F.format_string("%.3f,%.3f|", lat, lon), F.date_format(day, "yyyy-MM-dd"))), F.lit(12)
    )


def patch_hash(patch: Column) -> Column:
    """16 hex digits of a patch map, independent of the order of its keys."""
    entries = F.array_sort(F.map_entries(patch))
    return F.left(F.sha2(F.to_json(F.map_from_entries(entries)), 256), F.lit(16))
