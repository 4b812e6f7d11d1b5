"""Column functions that classify files, cameras, captions and review reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import JPEG_EXTENSIONS, RAW_EXTENSIONS
from .text import extension, file_name, file_stem, join_make_model

#: Makers by the beginning of a file name, for files without camera tags.
NAME_MAKERS = (("DJI_", "DJI"), ("GOPR", "GoPro"), ("GX01", "GoPro"), ("GH01", "GoPro"))
AI_PREFIX = "AI: "
#: Three different lists of video kinds; each stage has its own.
VIDEO_INGEST = ("mp4", "mov", "m4v", "avi", "mkv", "mts", "m2ts", "insv", "lrv")
VIDEO_MATCH = ("mp4", "mov", "m4v", "avi", "mkv", "webm", "insv", "lrv")
#: Lower bounds of the bands of a pixel score, best first.
PIXEL_BANDS = ((0.90, "likely same frame"), (0.85, "ambiguous upper"), (0.80, "ambiguous lower"), (0.75, "lean distinct"))


def file_role(path: Column) -> Column:
    """raw, preview, master, proxy or other, by the extension."""
    ext = extension(path)
    return (
        F.when(ext.isin(*RAW_EXTENSIONS), "raw")
        .when(ext.isin(*JPEG_EXTENSIONS), "preview")
        .when(ext.isin("lrf", "lrv"), "proxy")
        .when(ext.isin("mp4", "mov", "m4v", "insv"), "master")
        .otherwise("other")
    )


def file_camera(make: Column, model: Column, path: Column) -> Column:
    """Make and model, else the maker that the file name begins with, else null."""
    out = F.lit(None).cast("string")
    for prefix, maker in reversed(NAME_MAKERS):
        out = F.when(file_name(path).startswith(prefix), maker).otherwise(out)
    return F.coalesce(join_make_model(make, model), out)


def is_device_encoder(encoder: Column) -> Column:
    """True if an encoder string names a device and not a muxer."""
    tidy = F.btrim(encoder)
    return F.coalesce((tidy != "") & ~tidy.rlike(MUXER_PATTERN), F.lit(False))


def is_ai_text(description: Column) -> Column:
    return F.coalesce(description.startswith(AI_PREFIX), F.lit(False))


def is_camera_text(description: Column, path: Column) -> Column:
    """True for descriptions that cameras write: default, a DCIM path, the file's own name or stem."""
    tidy = F.btrim(description)
    return F.coalesce(
        (tidy != "")
        & (
            (F.lower(tidy) == "default")
            | tidy.startswith("DCIM\\")
            | tidy.startswith("DCIM/")
            | (tidy == file_name(path))
            | (tidy == file_stem(path))
        ),
        F.lit(False),
    )


def caption_gate(description: Column, path: Column, has_preview: Column, done: Column) -> Column:
    """action and reason of captioning a file: the first reason that holds decides."""
    user_text = (F.coalesce(F.btrim(description), F.lit("")) != "") & ~is_ai_text(description) & ~is_camera_text(description, path)
    reason = (
        F.when(done, "already done")
        .when(user_text, "user text")
        .when(extension(path).isin(*VIDEO_INGEST) & ~has_preview, "no preview")
    )
    return F.struct(F.when(reason.isNull(), "caption").otherwise("skip").alias("action"), reason.alias("reason"))


def gear_tags(tags: Column, camera: Column, prefix: str = "Gear/Camera/") -> Column:
    """The tags of notes that apply to a file of ``camera``, and one made for it if none names it.

    A gear tag applies if one of the two names contains the other; other tags apply to
    every file. Null and blank tags are left out.
    """
    usable = F.filter(tags, lambda t: F.coalesce(F.btrim(t) != "", F.lit(False)))
    base = F.filter(usable, lambda t: ~t.startswith(prefix))

    def name(tag: Column) -> Column:
        return F.btrim(F.substring(tag, len(prefix) + 1, 1000))

    gear = F.filter(
        usable,
        lambda t: t.startswith(prefix)
        & F.coalesce((name(t) != "") & (F.contains(camera, name(t)) | F.contains(name(t), camera)), F.lit(False)),
    )
    made = F.when(camera.isNotNull() & (F.size(gear) == 0), F.array(F.concat(F.lit(prefix), camera)))
    return F.array_distinct(F.concat(base, gear, F.coalesce(made, F.array().cast("array<string>"))))


def leaf_names(tags: Column) -> Column:
    """Sorted distinct last parts of hierarchical tags."""
    return F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.regexp_extract(t, r"([^/]*)$", 1))))


def pixel_band(score: Column) -> Column:
    out = F.when(score.isNotNull(), "likely distinct")
    for low, name in reversed(PIXEL_BANDS):
        out = F.when(score >= low, name).otherwise(out)
    return out


def twin_key(path: Column) -> Column:
    """Stem without the two-digit lens number of paired 360-degree files."""
    return F.regexp_replace(file_stem(path), r"_(?:00|10)_(\d+)$", "_$1")


def bucket_path(asset_id: Column) -> Column:
    """Folder of an asset: two levels of two characters of its id."""
    return F.concat_ws("/", F.substring(asset_id, 1, 2), F.substring(asset_id, 3, 2))


def format_duration(seconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    ms = F.bround(seconds * 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def vector_literal(vec: Column, digits: int = 8) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vec, lambda x: F.format_string(f"%.{digits}f", x)), ","), F.lit("]"))


def gpx_text(points: Column) -> Column:
    """A GPX document of an array of struct(lat, lon, at)."""
    body = F.array_join(
        F.transform(
            points,
            lambda p: F.concat(
                F.format_string('<trkpt lat="%.6f" lon="%.6f"><time>', p["lat"], p["lon"]),
                F.date_format(p["at"], "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                F.lit("</time></trkpt>"),
            ),
        ),
        "",
    )
    return F.concat(F.lit('<gpx version="1.1"><trk><trkseg>'), body, F.lit("</trkseg></trk></gpx>"))


#: Encoder strings of software, makes that record no sound, and camera codes with their names.
MUXER_PATTERN = r"(?i)^(lavf|libav|x26[45]|ffmpeg|handbrake|gopro)"
SILENT_MAKES = ("dji",)
DEVICE_NAMES = {
    "FC3170": ("DJI", "Mavic Air 2"),
    "FC3582": ("DJI", "Mini 3 Pro"),
    "FC8282": ("DJI", "Air 3"),
    "FC8482": ("DJI", "Mini 4 Pro"),
    "FC9313": ("DJI", "Mini 5 Pro"),
    "L2D-20c": ("DJI", "Mavic 3"),
    "FC4170": ("DJI", "Mavic 3 Tele"),
    "AC002": ("DJI", "Osmo Action 3"),
    "DJIMavic3Cine": ("DJI", "Mavic 3 Cine"),
    "DJI Mini4 Pro": ("DJI", "Mini 4 Pro"),
    "DJI Mini3 Pro": ("DJI", "Mini 3 Pro"),
    "DJI Mini5Pro": ("DJI", "Mini 5 Pro"),
}
DEVICE_PREFIXES = ("FC", "L2D", "DJI")


def device(make: Column, model: Column, encoder: Column) -> Column:
    """struct(make, model): the model, else an encoder that names a device, with known codes by their names.

    Codes match in any letter case; an unknown code of a known family gives the make only.
    """
    make = F.nullif(F.btrim(make), F.lit(""))
    model = F.coalesce(F.nullif(F.btrim(model), F.lit("")), F.when(is_device_encoder(encoder), F.btrim(encoder)))
    known = F.create_map(*(F.lit(v) for code, (maker, name) in DEVICE_NAMES.items() for v in (code.lower(), name)))
    makers = F.create_map(*(F.lit(v) for code, (maker, name) in DEVICE_NAMES.items() for v in (code.lower(), maker)))
    code = F.lower(model)
    family = F.lit(False)
    for prefix in DEVICE_PREFIXES:
        family = family | F.upper(model).startswith(prefix)
    return F.struct(
        F.coalesce(make, makers[code], F.when(family, "DJI")).alias("make"), F.coalesce(known[code], model).alias("model")
    )


def camera_key(make: Column, model: Column) -> Column:
    """Make and model as one key, null if both are blank."""
    return F.nullif(F.btrim(F.concat_ws(" ", F.btrim(make), F.btrim(model))), F.lit(""))


def name_prefix(path: Column) -> Column:
    """The letters and underscores that a file name begins with, in capitals."""
    return F.nullif(F.upper(F.regexp_extract(file_name(path), r"^([A-Za-z]+)", 1)), F.lit(""))


def clamp_language(detected: Column, candidates: tuple[str, ...]) -> Column:
    """The detected language if it is a candidate, else the first candidate; null stays null."""
    if not candidates:
        return detected
    return F.when(detected.isin(*candidates), detected).when(detected.isNotNull(), F.lit(candidates[0]))


def is_silent_make(make: Column) -> Column:
    """True for makes whose videos hold no sound."""
    out = F.lit(False)
    for prefix in SILENT_MAKES:
        out = out | F.lower(F.btrim(make)).startswith(prefix)
    return F.coalesce(out, F.lit(False))


def open_for_caption(description: Column) -> Column:
    """Whether the side-by-side captioner queues a file: only without text, or with text of its own kind."""
    return (F.coalesce(F.btrim(description), F.lit("")) == "") | is_ai_text(description)


def replaceable_caption(description: Column, path: Column) -> Column:
    """Whether the one-by-one captioner writes: what cameras write may be replaced as well."""
    return open_for_caption(description) | is_camera_text(description, path)
