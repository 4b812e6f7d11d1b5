"""Readers of media folders, telemetry subtitles, tracks and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File kinds that count as media.
MEDIA_EXTENSIONS = (
    "jpg", "jpeg", "heic", "heif", "png", "webp", "tif", "tiff", "dng", "cr2", "cr3", "arw", "nef", "raf", "rw2", "orf",
    "mp4", "mov", "m4v", "avi", "mkv", "mts", "m2ts", "insv", "insp", "lrv",
)
#: Notes of a folder, best first.
NOTES = ("TRIP.md", "README.md")


def list_media(spark: SparkSession, root: str, skip: str = "/.audit/") -> DataFrame:
    """path, bytes, mtime of media files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(ext.isin(*MEDIA_EXTENSIONS) & ~F.col("path").contains(skip)).select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")
    )


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """path, body of whole text files."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(pattern).select(
        F.input_file_name().alias("path"), F.col("value").alias("body")
    )


def _number(text: Column, names: str) -> Column:
    return F.regexp_extract(text, rf"(?i)\b(?:{names})\s*:\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def telemetry_frames(texts: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """key, frame, offset_s, at, lat, lon, rel_alt, abs_alt, iso, shutter, fnum, ev, focal_len.

    One row per block of a telemetry subtitle, numbered from 1; blank blocks count for
    nothing. Values that are missing or unreadable are null; (0, 0) is no position.
    """
    tidy = F.regexp_replace(F.col(body), r"\r\n?", "\n")
    blocks = F.filter(F.split(F.btrim(tidy), r"\n\s*\n"), lambda b: F.btrim(b) != "")
    rows = texts.select(F.col(key).alias(key), F.posexplode(blocks).alias("n", "block"))
    b = F.regexp_replace("block", "<[^>]*>", "")
    start = [F.regexp_extract(b, r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->", n).try_cast("int") for n in range(1, 5)]
    lat, lon = _number(b, "latitude|lat"), _number(b, "longitude|longtitude|lon")
    void = F.coalesce((lat == 0) & (lon == 0), F.lit(True))
    stamp = F.regexp_extract(b, r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    return rows.select(
        key,
        (F.col("n") + 1).alias("frame"),
        (start[0] * 3600 + start[1] * 60 + start[2] + start[3] / 1000).alias("offset_s"),
        F.when(stamp != "", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))).alias("at"),
        F.when(~void, lat).alias("lat"),
        F.when(~void, lon).alias("lon"),
        _number(b, "rel_alt").alias("rel_alt"),
        _number(b, "abs_alt|altitude").alias("abs_alt"),
        _number(b, "iso").alias("iso"),
        F.nullif(F.regexp_extract(b, r"(?i)\bshutter\s*:\s*([0-9/.]+)", 1), F.lit("")).alias("shutter"),
        _number(b, "fnum").alias("fnum"),
        _number(b, "ev").alias("ev"),
        _number(b, "focal_len").alias("focal_len"),
    )


def first_fix(frames: DataFrame, key: str = "path") -> DataFrame:
    """key, lat, lon, altitude, at: first position and first time of each track."""
    fix = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return frames.groupBy(key).agg(
        F.min_by("lat", F.when(fix, F.col("frame"))).alias("lat"),
        F.min_by("lon", F.when(fix, F.col("frame"))).alias("lon"),
        F.min_by("abs_alt", F.when(fix, F.col("frame"))).alias("altitude"),
        F.min_by("at", F.when(F.col("at").isNotNull(), F.col("frame"))).alias("at"),
    )


def track_points(texts: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """key, at, lat, lon of the points of GPX tracks, in any namespace; incomplete ones are dropped."""
    points = F.regexp_extract_all(F.col(body), F.lit(r"(?s)<(?:\w+:)?trkpt\b.*?</(?:\w+:)?trkpt>"), 0)
    rows = texts.select(F.col(key).alias(key), F.explode(points).alias("p"))
    return rows.select(
        key,
        F.try_to_timestamp(
            F.regexp_replace(F.regexp_extract("p", r"<(?:\w+:)?time>\s*([^<]*?)\s*</", 1), r"\.\d+", "")
        ).alias("at"),
        F.regexp_extract("p", r'\blat="([^"]*)"', 1).try_cast("double").alias("lat"),
        F.regexp_extract("p", r'\blon="([^"]*)"', 1).try_cast("double").alias("lon"),
    ).dropna()


def front_matter(texts: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """key, field, value of the scalars, inline lists, nested maps and block lists between the opening fences.

    Fields of a nested map are named after their parent (``location.coords``); the items
    of a block list come as one inline list. A text without front matter has no row.
    Lines are put in order within their own text only.
    """
    block = F.regexp_extract(body, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    held = texts.select(F.col(key).alias(key), block.alias("b")).where("b <> ''")
    lines = held.select(key, F.posexplode(F.split("b", r"\r?\n")).alias("n", "line"))

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))

    top, nested, item = r"^([A-Za-z_][\w-]*):\s*(.*?)\s*$", r"^\s+([A-Za-z_][\w-]*):\s*(.+?)\s*$", r"^\s*-\s+(.+?)\s*$"
    above = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    read = lines.select(
        key,
        "n",
        F.last(part(top, 1), ignorenulls=True).over(above).alias("parent"),
        part(nested, 1).alias("child"),
        F.coalesce(part(top, 2), part(nested, 2), part(item, 1)).alias("value"),
        part(item, 1).isNotNull().alias("listed"),
    ).where("value is not null and parent is not null")
    field = F.concat_ws(".", "parent", "child")
    bare = F.regexp_replace("value", r"^[\"']|[\"']$", "")
    grouped = read.groupBy(key, field.alias("field")).agg(
        F.min(F.when(~F.col("listed"), bare)).alias("one"),
        F.array_sort(F.collect_list(F.when(F.col("listed"), F.struct("n", bare.alias("v"))))).alias("items"),
    )
    whole = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["v"]), ", "), F.lit("]"))
    return grouped.select(key, "field", F.coalesce("one", whole).alias("value"))


def preferred_notes(files: DataFrame) -> DataFrame:
    """folder, path: the best notes file of each folder."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rank = F.array_position(F.array(*(F.lit(n) for n in NOTES)), name)
    return files.where(rank > 0).groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).agg(
        F.min_by("path", rank).alias("path")
    )


def merge_sidecars(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """media (path, tags) with the XMP tags of the same-stem sidecar where a key is absent."""
    from ..functions.maps import merge_missing

    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    side = sidecars.select(stem.alias("__stem"), F.col("tags").alias("__tags"))
    met = media.withColumn("__stem", stem).join(side, "__stem", "left")
    return met.withColumn("tags", merge_missing(F.col("tags"), F.col("__tags"), "XMP:")).drop("__stem", "__tags")


def companion_json(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """path, json_path: the JSON companion of each file.

    The exact name first, then the supplemental one, then a name in the same folder of
    which the first 20 characters agree and one stem is the beginning of the other.
    """
    folder, name = F.regexp_replace("path", r"/[^/]*$", ""), F.regexp_extract("path", r"([^/]*)$", 1)
    files = media.select("path", folder.alias("dir"), name.alias("name"), F.left(name, F.lit(20)).alias("head"))
    base = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?:\.supplemental-metadata)?\.json$", "")
    side = sidecars.select(
        F.col("path").alias("json_path"), folder.alias("dir"), base.alias("base"), F.left(base, F.lit(20)).alias("head"),
        F.col("path").endswith(".supplemental-metadata.json").alias("supplemental"),
    )
    met = files.join(side, ["dir", "head"])
    rank = (
        F.when((F.col("base") == F.col("name")) & ~F.col("supplemental"), 0)
        .when(F.col("base") == F.col("name"), 1)
        .when(F.col("name").startswith(F.col("base")) | F.col("base").startswith(F.col("name")), 2)
    )
    return met.withColumn("rank", rank).where("rank is not null").groupBy("path").agg(
        F.min_by("json_path", F.struct("rank", "json_path")).alias("json_path")
    )


def sibling_telemetry(media: DataFrame, listing: DataFrame) -> DataFrame:
    """path, telemetry_path: the telemetry subtitle beside each file, .SRT before .srt; other spellings do not count."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    ending = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    side = listing.where(ending.isin(".SRT", ".srt")).groupBy(stem.alias("stem")).agg(
        F.min_by("path", F.when(ending == ".SRT", 0).otherwise(1)).alias("telemetry_path")
    )
    return media.select("path", stem.alias("stem")).join(side, "stem").select("path", "telemetry_path")
