"""Metadata rules: a registry of proposals, precedence, ledger and the loop to a fixed point.

A rule looks either at one file (its fields are columns over the media table) or at a
folder (a function of the media table). All rules of the first kind are one pass over
the media, which yields an array of findings per file; those of the second kind read
the few columns they need. A finding has path, tier, field, value; per tier the first
rule, in order of registration, keeps each field of a path.

Media: folder, path, tags MAP, and of the folder's notes, where known: notes_lat,
notes_lon, notes_path, notes_zone, notes_tags ARRAY, notes_suggest (false: no tag
suggestions). Columns that are absent count as null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import file_camera, gear_tags, leaf_names
from ..functions.dates import exif_timestamp, format_offset, has_zone_suffix, name_timestamp
from ..functions.maps import first_present, missing_tags
from ..functions.text import extension, file_name, file_stem
from ..session import Scratch
from .asof import bracket, locate, nearest
from .library import zone_of_points
from .robust import dominant
from .timestamps import wall_to_utc, zone_offset

TIERS = ("high", "medium", "low")
FINDINGS = "rule string, ordinal int, tier string, path string, field string, value string"
#: Tags that hold a capture date, and a position.
DATE_TAGS = ("XMP:DateTimeOriginal", "EXIF:DateTimeOriginal", "QuickTime:CreateDate", "EXIF:CreateDate")
SHOWN_TAGS = ("XMP:DateTimeOriginal", "EXIF:DateTimeOriginal", "QuickTime:CreateDate")
OFFSET_TAGS = ("EXIF:OffsetTimeOriginal", "XMP:OffsetTimeOriginal")
GPS_TAGS = ("EXIF:GPSLatitude", "Composite:GPSLatitude", "XMP:GPSLatitude")
#: What marks a video as a source to keep.
KEPT_EXTENSIONS = ("insv", "insp", "lrv", "lrf", "mts", "dng", "braw")
KEPT_PREFIXES = ("DJI_", "GX", "GH", "GOPR", "MAH", "MVI_", "C0", "LRV_", "PRO_", "DSC_")
KEPT_CODECS = ("prores", "dnxh", "cineform", "ffv1", "raw", "cine", "apch", "apcn", "apcs", "apco", "ap4h", "ap4x")
KEPT_FOLDERS = ("raw", "source", "edit", "project", "insta360")
#: Columns of the media table that rules may use, with their types.
NOTES = {
    "notes_lat": "double", "notes_lon": "double", "notes_path": "string", "notes_zone": "string",
    "notes_tags": "array<string>", "notes_suggest": "boolean",
}


@dataclass(frozen=True)
class Rule:
    name: str
    tier: str
    propose: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None
    fields: Callable[[], dict[str, Column]] | None = None


REGISTRY: list[Rule] = []


def _checked(tier: str) -> str:
    if tier not in TIERS:
        raise ValueError(f"tier must be one of {TIERS}")
    return tier


def folder_rule(name: str, tier: str):
    """Registers a function of the media table and a table of tracks; the order of registration is its precedence.

    It returns path, field, value and, where the tier differs by finding, tier.
    """

    def add(function: Callable[[DataFrame, DataFrame | None], DataFrame]):
        REGISTRY.append(Rule(name, _checked(tier), propose=function))
        return function

    return add


def file_rule(name: str, tier: str):
    """Registers a function that returns the fields of a file as columns; null proposes nothing."""

    def add(function: Callable[[], dict[str, Column]]):
        REGISTRY.append(Rule(name, _checked(tier), fields=function))
        return function

    return add


def has_date(tags: Column) -> Column:
    out = F.lit(False)
    for key in DATE_TAGS:
        out = out | F.coalesce(F.year(exif_timestamp(tags[key])) >= 1970, F.lit(False))
    return out


def has_gps(tags: Column) -> Column:
    return F.coalesce(F.btrim(first_present(tags, *GPS_TAGS)) != "", F.lit(False))


def evaluate(media: DataFrame, rules: list[Rule] | None = None, tracks: DataFrame | None = None) -> DataFrame:
    """Findings of all rules over the media table; ``tracks`` (folder, t, lat, lon) hold recorded positions."""
    chosen = list(enumerate(REGISTRY if rules is None else rules))
    for name, kind in NOTES.items():
        if name not in media.columns:
            media = media.withColumn(name, F.lit(None).cast(kind))
    entries = [
        F.struct(
            F.lit(one.name).alias("rule"), F.lit(ordinal).alias("ordinal"), F.lit(one.tier).alias("tier"), F.lit(field).alias("field"),
            value.cast("string").alias("value"),
        )
        for ordinal, one in chosen
        if one.fields
        for field, value in one.fields().items()
    ]
    out = media.sparkSession.createDataFrame([], FINDINGS)
    if entries:
        offered = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
        # What several rules ask is worked out once per file.
        tags = F.col("tags")
        known = media.withColumns(
            {"__dated": has_date(tags), "__placed": has_gps(tags), "__text": first_present(tags, *SHOWN_TAGS), "__camera": _camera(tags)}
        ).withColumn("__when", exif_timestamp(F.col("__text")))
        found = known.select("path", F.explode(offered).alias("f"))
        out = found.select("f.rule", "f.ordinal", "f.tier", "path", "f.field", "f.value")
    for ordinal, one in chosen:
        if one.propose:
            found = one.propose(media, tracks)
            tier = F.col("tier") if "tier" in found.columns else F.lit(one.tier)
            out = out.unionByName(found.select(F.lit(one.name).alias("rule"), F.lit(ordinal).alias("ordinal"), tier.alias("tier"), "path", "field", "value"))
    return out


def resolve(findings: DataFrame) -> DataFrame:
    """The first finding, by rule order and value, of each path and field within its best tier.

    High comes before medium before low; a field taken by a better tier is not
    offered again.
    """
    place = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    order = Window.partitionBy("path", "field").orderBy(place, "ordinal", "value")
    return findings.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def pending(resolved: DataFrame, ledger: DataFrame) -> DataFrame:
    """Findings of the high and medium tier that the ledger (path, rule, field, value) does not hold."""
    open_tiers = resolved.where(F.col("tier").isin("high", "medium"))
    return open_tiers.join(ledger, ["path", "rule", "field", "value"], "left_anti")


def apply(media: DataFrame, findings: DataFrame) -> DataFrame:
    """The media table with the findings written into its tags, under XMP."""
    patches = findings.groupBy("path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("XMP:"), F.col("field")), "value")))).alias("patch")
    )
    kept = F.map_filter(F.col("tags"), lambda k, v: ~F.map_contains_key(F.col("patch"), k))
    after = F.when(F.col("patch").isNull(), F.col("tags")).otherwise(F.map_concat(kept, F.col("patch")))
    return media.join(patches, "path", "left").withColumn("tags", after).drop("patch")


def apply_to_fixpoint(media: DataFrame, rules: list[Rule] | None = None, most_passes: int = 5) -> tuple[DataFrame, DataFrame]:
    """Media and ledger after applying high-tier findings until none is pending."""
    spark = media.sparkSession
    scratch = Scratch(spark, "rules")
    ledger = spark.createDataFrame([], "path string, rule string, field string, value string")
    for _ in range(most_passes):
        todo = pending(resolve(evaluate(media, rules)), ledger).where("tier = 'high'")
        todo = scratch.keep(todo, "todo")
        if todo.isEmpty():
            break
        media = scratch.keep(apply(media, todo), "media")
        ledger = scratch.keep(ledger.unionByName(todo.select("path", "rule", "field", "value")), "ledger")
    return media, ledger


def _camera(tags: Column) -> Column:
    return file_camera(tags["EXIF:Make"], tags["EXIF:Model"], F.col("path"))


def _as_fields(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()))
    kept = [c for c in ("tier",) if c in df.columns]
    return df.select("path", *kept, F.explode(pairs).alias("f")).select("path", *kept, "f.field", "f.value").where("value is not null")


def _position(lat: Column, lon: Column, condition: Column | None = None) -> dict[str, Column]:
    """The four tags of a position, null where the condition does not hold."""
    fields = {
        "GPSLatitude": F.format_string("%.6f", F.abs(lat)),
        "GPSLatitudeRef": F.when(lat >= 0, "N").otherwise("S"),
        "GPSLongitude": F.format_string("%.6f", F.abs(lon)),
        "GPSLongitudeRef": F.when(lon >= 0, "E").otherwise("W"),
    }
    usable = lat.isNotNull() & lon.isNotNull()
    return {k: F.when(usable if condition is None else usable & condition, v) for k, v in fields.items()}


def _number(tags: Column, *keys: str) -> Column:
    """The first of the tags that is a number."""
    return F.coalesce(*(tags[k].try_cast("double") for k in keys))


def _shown(when: Column) -> Column:
    return F.date_format(when, "yyyy:MM:dd HH:mm:ss")


@file_rule("gps-from-companion", "high")
def gps_from_companion() -> dict[str, Column]:
    tags = F.col("tags")
    lat, lon, height = (tags[f"Companion:{k}"].try_cast("double") for k in ("Lat", "Lon", "Altitude"))
    lacking = ~F.col("__placed") & ~((lat == 0) & (lon == 0))
    found = lat.isNotNull() & lon.isNotNull() & lacking
    return {**_position(lat, lon, lacking), "GPSAltitude": F.when(found & height.isNotNull(), F.format_string("%.2f", height))}


@file_rule("date-from-companion", "high")
def date_from_companion() -> dict[str, Column]:
    return {"DateTimeOriginal": F.when(~F.col("__dated"), F.col("tags")["Companion:DateTime"])}


@file_rule("date-from-name", "high")
def date_from_name() -> dict[str, Column]:
    return {"DateTimeOriginal": F.when(~F.col("__dated"), _shown(name_timestamp(F.col("path"))))}


@folder_rule("lens-pair", "high")
def lens_pair(media: DataFrame, tracks: DataFrame | None) -> DataFrame:
    """Full video and preview of one recording, by the time and serial in their names; each names the other."""
    pattern = r"(?i)^(PRO_)?(?:VID|LRV)_(\d{8}_\d{6})_\d{2}_(\d+)$"
    stem, kind = file_stem(F.col("path")), extension(F.col("path"))
    keyed = media.where(kind.isin("insv", "lrv") & stem.rlike(pattern)).select(
        "folder", "path", kind.alias("kind"), *(F.lower(F.regexp_extract(stem, pattern, n)).alias(f"k{n}") for n in (1, 2, 3))
    )
    pairs = keyed.groupBy("folder", "k1", "k2", "k3").agg(
        F.min(F.when(F.col("kind") == "insv", F.col("path"))).alias("full"), F.min(F.when(F.col("kind") == "lrv", F.col("path"))).alias("preview")
    ).where("full is not null and preview is not null")
    both = F.array(F.struct(F.col("full").alias("path"), F.col("preview").alias("value")), F.struct(F.col("preview").alias("path"), F.col("full").alias("value")))
    return pairs.select(F.explode(both).alias("p")).select("p.path", F.lit("Pair").alias("field"), "p.value")


@folder_rule("gps-from-track", "high")
def gps_from_track(media: DataFrame, tracks: DataFrame | None) -> DataFrame:
    """The track point nearest in time, within 5 min, for files without a position whose clock has a zone."""
    if tracks is None:
        return _as_fields(media.where("false"), {"GPSLatitude": F.col("path")})
    tags = F.col("tags")
    text = first_present(tags, *SHOWN_TAGS)
    when = F.unix_seconds(F.coalesce(exif_timestamp(text), name_timestamp(F.col("path"))))
    own = F.coalesce(zone_offset(first_present(tags, *OFFSET_TAGS)), F.when(has_zone_suffix(text), zone_offset(F.regexp_extract(F.btrim(text), r"([+-]\d{2}:\d{2})$", 1))))
    at = F.coalesce(when - own, F.when(F.col("notes_zone").isNotNull(), wall_to_utc(when, F.col("notes_zone"))))
    targets = media.where(~has_gps(tags)).select("folder", F.col("path").alias("id"), at.alias("t")).where("t is not null")
    found = nearest(bracket(targets, tracks.select("folder", "t", "lat", "lon"), ["folder"]), 300)
    return _as_fields(found.select(F.col("id").alias("path"), "fix.lat", "fix.lon"), _position(F.col("lat"), F.col("lon")))


@folder_rule("gps-from-siblings", "medium")
def gps_from_siblings(media: DataFrame, tracks: DataFrame | None) -> DataFrame:
    """Positions from the fixes around a file's time in its folder, if it has five fixes or more."""
    tags = F.col("tags")
    lat, lon = _number(tags, "Composite:GPSLatitude"), _number(tags, "Composite:GPSLongitude")
    when = F.unix_seconds(exif_timestamp(first_present(tags, *DATE_TAGS)))
    rows = media.select("folder", F.col("path").alias("id"), when.alias("t"), lat.alias("lat"), lon.alias("lon")).where("t is not null")
    usable = (F.abs("lat") >= 1e-3) | (F.abs("lon") >= 1e-3)
    rows = rows.withColumn("good", F.coalesce(usable, F.lit(False)))
    rich = rows.where("good").groupBy("folder").count().where("count >= 5").select("folder")
    rows = rows.join(rich, "folder", "left_semi")
    fixes, targets = rows.where("good").select("folder", "t", "lat", "lon"), rows.where("not good").select("folder", "id", "t")
    found = locate(bracket(targets, fixes, ["folder"])).where("confidence is not null")
    return _as_fields(found.select(F.col("id").alias("path"), F.col("confidence").alias("tier"), "lat", "lon"), _position(F.col("lat"), F.col("lon")))


@file_rule("gps-anchor", "high")
def gps_anchor() -> dict[str, Column]:
    """The position of the folder's notes for every file without one."""
    return _position(F.col("notes_lat"), F.col("notes_lon"), ~F.col("__placed"))


@file_rule("tags-from-notes", "high")
def tags_from_notes() -> dict[str, Column]:
    """The tags of the notes that apply to the file's camera, whole and by their last parts."""
    usable = F.filter("notes_tags", lambda t: F.coalesce(F.btrim(t) != "", F.lit(False)))
    mine = gear_tags(F.col("notes_tags"), F.col("__camera"))
    some = (F.size(usable) > 0) & (F.size(mine) > 0)
    return {"HierarchicalSubject": F.when(some, F.array_join(mine, "|")), "Subject": F.when(some, F.array_join(leaf_names(mine), "|"))}


@folder_rule("zone-guess", "high")
def zone_guess(media: DataFrame, tracks: DataFrame | None) -> DataFrame:
    """The zone of the notes' position, else the one in which at least twice as many files lie as in any other."""
    lat, lon = (_number(F.col("tags"), f"Composite:GPS{k}", f"EXIF:GPS{k}") for k in ("Latitude", "Longitude"))
    noted = media.where("notes_path is not null and coalesce(trim(notes_zone), '') = ''").select("notes_path", "notes_lat", "notes_lon", lat.alias("lat"), lon.alias("lon"))
    anchors = noted.where("notes_lat is not null and notes_lon is not null").groupBy("notes_path").agg(F.min(F.struct("notes_lat", "notes_lon")).alias("n"))
    stated = zone_of_points(anchors.select("notes_path", "n.*"), "notes_path", "notes_lat", "notes_lon")
    voters = noted.where("notes_lat is null or notes_lon is null").where("lat is not null and lon is not null and not (lat = 0 and lon = 0)")
    voted = dominant(zone_of_points(voters, "notes_path", "lat", "lon"), ["notes_path"], "zone", 2.0).where("winner is not null")
    voted = voted.join(stated.select("notes_path"), "notes_path", "left_anti").select("notes_path", F.col("winner").alias("zone"))
    return stated.unionByName(voted).select(F.col("notes_path").alias("path"), F.lit("timezone").alias("field"), F.col("zone").alias("value"))


@file_rule("zone-suffix", "high")
def zone_suffix() -> dict[str, Column]:
    """The date with the offset of the notes' zone at that time, unless the file has an offset of its own."""
    tags = F.col("tags")
    text, when = F.col("__text"), F.col("__when")
    wall = F.unix_seconds(when)
    before = F.unix_seconds(F.to_utc_timestamp(when, F.col("notes_zone")))
    plain = F.col("notes_zone").isNotNull() & ~has_zone_suffix(text) & (F.coalesce(first_present(tags, *OFFSET_TAGS), F.lit("")) == "")
    return {"DateTimeOriginal": F.when(plain, F.concat(_shown(when), format_offset(wall - before)))}


@folder_rule("clock-drift", "medium")
def clock_drift(media: DataFrame, tracks: DataFrame | None) -> DataFrame:
    """In folders of one camera with three dated files or more: those a day off the median get it."""
    when = exif_timestamp(first_present(F.col("tags"), *DATE_TAGS))
    dated = media.select("folder", "path", F.unix_seconds(when).alias("t"), F.col("tags")["EXIF:Model"].alias("camera")).where("t is not null")
    typical = dated.groupBy("folder").agg(
        F.median("t").alias("middle"), F.count(F.lit(1)).alias("n"), F.min("camera").alias("one"), F.max("camera").alias("last")
    ).where("n >= 3 and one = last")
    off = dated.join(typical.select("folder", "middle"), "folder").where(F.abs(F.col("t") - F.col("middle")) >= 86400)
    return _as_fields(off, {"DateTimeOriginal": _shown(F.timestamp_seconds(F.floor("middle")))})


@folder_rule("camera-drift", "medium")
def camera_drift(media: DataFrame, tracks: DataFrame | None) -> DataFrame:
    """Cameras of a folder whose median is 5 min to 14 d off the reference camera's are shifted.

    Cameras need three dated files; the reference has the most positions, then the
    most files, then the earliest path.
    """
    when = exif_timestamp(first_present(F.col("tags"), *DATE_TAGS))
    dated = media.select("folder", "path", F.unix_seconds(when).alias("t"), F.col("tags")["EXIF:Model"].alias("camera"), has_gps(F.col("tags")).alias("placed"))
    dated = dated.where("t is not null and camera is not null")
    cameras = dated.groupBy("folder", "camera").agg(
        F.median("t").alias("middle"), F.count(F.lit(1)).alias("n"), F.count_if("placed").alias("fixes"), F.min("path").alias("seen")
    ).where("n >= 3")
    reference = cameras.groupBy("folder").agg(
        F.min(F.struct((-F.col("fixes")).alias("a"), (-F.col("n")).alias("b"), "seen", "camera", "middle")).alias("r"), F.count(F.lit(1)).alias("cameras")
    ).where("cameras >= 2")
    shift = F.col("r.middle") - F.col("middle")
    drifting = cameras.join(reference, "folder").withColumn("shift", shift).where(
        (F.col("camera") != F.col("r.camera")) & F.abs(F.col("shift")).between(300, 14 * 86400)
    )
    moved = dated.join(drifting.select("folder", "camera", "shift"), ["folder", "camera"])
    return _as_fields(moved, {"DateTimeOriginal": _shown(F.timestamp_seconds(F.floor(F.col("t") + F.col("shift"))))})


@folder_rule("tags-missing", "medium")
def tags_missing(media: DataFrame, tracks: DataFrame | None) -> DataFrame:
    """Tags that the files of a folder suggest and its notes lack, by tag and by category; notes without a list get none."""
    tags = F.col("tags")
    noted = media.where("notes_path is not null and notes_tags is not null and coalesce(notes_suggest, true)")
    camera = _camera(tags)
    prefix = F.nullif(F.upper(F.regexp_extract(file_name(F.col("path")), r"^([A-Za-z]{1,6})", 1)), F.lit(""))
    seen = noted.select("notes_path", "notes_tags", camera.alias("camera"), prefix.alias("prefix")).distinct().groupBy("notes_path").agg(
        F.min("notes_tags").alias("have"),
        F.array_sort(F.collect_set("camera")).alias("cameras"),
        F.array_sort(F.collect_set("prefix")).alias("prefixes"),
    )
    name = F.regexp_extract("notes_path", r"([^/]*)/[^/]*$", 1)
    wanted = F.concat(
        F.array(F.concat(F.lit("Events/"), name)),
        F.transform("cameras", lambda c: F.concat(F.lit("Gear/Camera/"), c)),
        F.transform("prefixes", lambda p: F.concat(F.lit("Source/"), p)),
    )
    lacking = missing_tags(wanted, F.col("have"))
    return seen.where(F.size(lacking) > 0).select(F.col("notes_path").alias("path"), F.lit("add_tags").alias("field"), F.array_join(lacking, "|").alias("value"))


@file_rule("export-date-trap", "low")
def export_date_trap() -> dict[str, Column]:
    tags = F.col("tags")
    return {"Note": F.when(~F.col("__dated") & tags["EXIF:ModifyDate"].isNotNull(), "only a modification date")}


@file_rule("bloat-candidate", "low")
def bloat_candidate() -> dict[str, Column]:
    """Videos with more bits a pixel than their codec needs; sources to keep, by name, kind, codec or folder, are left out."""
    tags, path = F.col("tags"), F.col("path")
    codec = F.lower(first_present(tags, "QuickTime:CompressorID", "QuickTime:VideoCodec"))
    limit = F.when(codec.rlike("hvc1|hev1|hevc|h265|x265"), 0.08).when(codec.rlike(r"avc1|h264|h\.264|x264"), 0.15)
    width, height = _number(tags, "QuickTime:ImageWidth", "Composite:ImageWidth"), _number(tags, "QuickTime:ImageHeight", "Composite:ImageHeight")
    fps = _number(tags, "QuickTime:VideoFrameRate", "Composite:VideoFrameRate")
    stated = _number(tags, "Composite:AvgBitrate", "QuickTime:AvgBitrate")
    worked_out = F.try_divide(_number(tags, "File:FileSize") * 8, F.nullif(_number(tags, "QuickTime:Duration"), F.lit(0.0)))
    bits = F.try_divide(F.coalesce(stated, worked_out), width * height * fps)
    name = F.upper(file_name(path))
    kept = (
        F.lower("folder").rlike("|".join(KEPT_FOLDERS))
        | extension(path).isin(*KEPT_EXTENSIONS)
        | name.rlike("^(?:" + "|".join(KEPT_PREFIXES) + r"|(?:VID|IMG)_\d{8})")
        | codec.rlike("|".join(KEPT_CODECS))
        | F.lower(F.concat_ws(" ", *(tags[k] for k in ("QuickTime:Make", "EXIF:Make", "XMP:Make", "QuickTime:HandlerDescription")))).contains("insta360")
    )
    tier = F.when(bits >= 2 * limit, "obscene").when(bits >= limit, "fat")
    return {"Bloat": F.when(~F.coalesce(kept, F.lit(False)), tier)}


@file_rule("makernote-present", "low")
def makernote_present() -> dict[str, Column]:
    return {"MakerNote": F.when(F.exists(F.map_keys("tags"), lambda k: k.startswith("MakerNotes:")), "present")}
