"""Column functions on capture dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_YEAR = 1990


def exif_timestamp(text: Column) -> Column:
    """Wall clock of ``yyyy:MM:dd HH:mm:ss`` (or slashes) or ``yyyy-MM-ddTHH:mm:ss``, else null."""
    head = F.left(F.replace(F.btrim(text), F.lit("/"), F.lit(":")), F.lit(19))
    return F.coalesce(
        F.when(head.rlike(r"^\d{4}:\d{2}:\d{2} "), F.try_to_timestamp(head, F.lit("yyyy:MM:dd HH:mm:ss"))),
        F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss"))),
    )


def is_plausible(when: Column, last_year: int) -> Column:
    return F.coalesce(F.year(when).between(LEAST_YEAR, last_year), F.lit(False))


def name_timestamp(path: Column) -> Column:
    """Date and time written in a camera file name, such as IMG_20240415_120000."""
    parts = r"(?:VID|IMG|DJI|MVI|PXL)[_-]?(\d{8})[_-]?(\d{6})"
    joined = F.concat(F.regexp_extract(path, parts, 1), F.regexp_extract(path, parts, 2))
    return F.when(F.length(joined) == 14, F.try_to_timestamp(joined, F.lit("yyyyMMddHHmmss")))


def capture_authority(candidates: list[tuple[str, Column]], fallback: tuple[str, Column], last_year: int) -> Column:
    """struct(dt, source): the first plausible candidate, else the fallback as it is."""
    steps = [
        F.when(is_plausible(when, last_year), F.struct(when.alias("dt"), F.lit(source).alias("source")))
        for source, when in candidates
    ]
    source, when = fallback
    return F.coalesce(
        *steps, F.when(when.isNotNull(), F.struct(when.alias("dt"), F.lit(source).alias("source")))
    )


def date_range_name(start: Column, end: Column) -> Column:
    """``15 Apr 2024``, ``15–17 Apr 2024``, ``29 Apr – 3 May 2024`` or with both years."""

    def shown(when: Column, pattern: str) -> Column:
        return F.date_format(when, pattern)

    whole = "d MMM yyyy"
    same_year = F.year(start) == F.year(end)
    return (
        F.when(F.to_date(start) == F.to_date(end), shown(start, whole))
        .when(same_year & (F.month(start) == F.month(end)), F.concat(shown(start, "d"), F.lit("–"), shown(end, whole)))
        .when(same_year, F.concat(shown(start, "d MMM"), F.lit(" – "), shown(end, whole)))
        .otherwise(F.concat(shown(start, whole), F.lit(" – "), shown(end, whole)))
    )


def event_name(city: Column, country: Column, start: Column, end: Column) -> Column:
    """Place and date range of an event; absent parts are left out."""
    place = F.nullif(F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(country, F.lit(""))), F.lit(""))
    return F.concat_ws(" — ", place, date_range_name(start, end))


def format_offset(seconds: Column) -> Column:
    """Offset from UTC as ±HH:MM."""
    size = F.abs(seconds)
    return F.format_string(
        "%s%02d:%02d",
        F.when(seconds < 0, "-").otherwise("+"),
        F.floor(size / 3600),
        F.floor(size / 60) % 60,
    )


def format_delta(seconds: Column) -> Column:
    """Signed shift of a clock as ±HHhMMm."""
    size = F.abs(seconds)
    return F.format_string(
        "%s%02dh%02dm", F.when(seconds < 0, "-").otherwise("+"), F.floor(size / 3600), F.floor(size / 60) % 60
    )


def has_zone_suffix(text: Column) -> Column:
    return F.coalesce(F.btrim(text).rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.lit(False))


#: Seconds from 1970 to 2001, and the years of a believable tag.
EPOCH_2001 = 978_307_200
LEAST_TAG_YEAR, LAST_TAG_YEAR = 1970, 2100
#: The order in which tags are asked for a date, by two stages.
AUTHORITY_TAGS = ("XMP:DateTimeOriginal", "EXIF:DateTimeOriginal", "QuickTime:CreateDate", "EXIF:CreateDate", "EXIF:ModifyDate")
INGEST_TAGS = ("EXIF:DateTimeOriginal", "XMP:DateTimeOriginal", "QuickTime:CreateDate", "EXIF:CreateDate")


def timestamp_2001(seconds: Column) -> Column:
    """Instant of seconds since 2001."""
    return F.timestamp_seconds(seconds + EPOCH_2001)


def tag_time(text: Column) -> Column:
    """struct(secs, kind) of ``yyyy:MM:dd HH:mm:ss`` with or without ±HH:MM; null outside the believable years.

    kind utc: secs is the instant; local: secs is the wall clock.
    """
    tidy = F.btrim(text)
    offset = F.regexp_extract(tidy, r"^.{19}.*([+-]\d{2}:\d{2})$", 1)
    wall = F.when(offset != "", F.btrim(F.regexp_replace(tidy, r"[+-]\d{2}:\d{2}$", ""))).otherwise(tidy)
    when = F.when(wall.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(wall, F.lit("yyyy:MM:dd HH:mm:ss")))
    size = F.substring(offset, 2, 2).cast("int") * 3600 + F.substring(offset, 5, 2).cast("int") * 60
    east = F.when(offset.startswith("-"), -size).otherwise(size)
    return F.when(
        F.year(when).between(LEAST_TAG_YEAR, LAST_TAG_YEAR),
        F.struct(
            F.when(offset != "", F.unix_seconds(when) - east).otherwise(F.unix_seconds(when)).alias("secs"),
            F.when(offset != "", "utc").otherwise("local").alias("kind"),
        ),
    )


def first_tag_time(tags: Column, keys: tuple[str, ...] = INGEST_TAGS) -> Column:
    """The first readable tag_time among tags, in the order of ``keys``."""
    return F.coalesce(*(tag_time(tags[key]) for key in keys))


def capture_time(telemetry: Column, embedded: Column, named: Column, container: Column) -> Column:
    """struct(secs, source, kind): telemetry (an instant), embedded tag_time, name (wall clock), container (an instant)."""

    def step(secs: Column, source: str, kind: Column) -> Column:
        return F.when(secs.isNotNull(), F.struct(secs.alias("secs"), F.lit(source).alias("source"), kind.alias("kind")))

    return F.coalesce(
        step(telemetry, "telemetry", F.lit("utc")),
        step(embedded["secs"], "embedded", embedded["kind"]),
        step(named, "name", F.lit("local")),
        step(container, "container", F.lit("utc")),
    )


def date_key(path: Column, months: bool = False) -> Column:
    """The yyyyMMdd (or yyyyMM) written in a file name between underscores or hyphens, else null."""
    found = F.regexp_extract(path, r"(?:^|[/_-])(20\d{6})[_-][^/]*$", 1)
    return F.nullif(F.left(found, F.lit(6)) if months else found, F.lit(""))
