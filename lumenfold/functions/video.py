"""Column functions on videos and boxes: playability, quality, savings, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a browser plays as it is, and the tallest preview.
WEB_VIDEO = ("h264",)
WEB_AUDIO = ("aac", "mp3", "")
WEB_CONTAINERS = ("mp4", "mov", "m4v")
PREVIEW_HEIGHT = 720
#: Decibels from which a copy is good, and from which it is worth a look.
PSNR_GOOD, PSNR_LOOK = 30.0, 25.0
#: Fixed value: least share of a file that a smaller copy must save.
LEAST_SAVING = 0.20


def needs_transcode(video: Column, audio: Column, extension: Column, height: Column) -> Column:
    """True unless codec, sound, container and height all play in a browser; null sound is silence."""
    plays = (
        F.lower(video).isin(*WEB_VIDEO)
        & F.lower(F.coalesce(audio, F.lit(""))).isin(*WEB_AUDIO)
        & F.lower(extension).isin(*WEB_CONTAINERS)
        & (height <= PREVIEW_HEIGHT)
    )
    return ~F.coalesce(plays, F.lit(False))


def psnr_verdict(decibels: Column) -> Column:
    """ok, review, fail, or unknown without a measure."""
    return (
        F.when(decibels.isNull(), "unknown")
        .when(decibels >= PSNR_GOOD, "ok")
        .when(decibels >= PSNR_LOOK, "review")
        .otherwise("fail")
    )


def estimated_size(size: Column, bitrate: Column, target: Column) -> Column:
    """Whole bytes of a copy at the target bit rate."""
    return (target * (size / F.greatest(bitrate, F.lit(1)))).cast("bigint")


def saved_share(size: Column, estimated: Column) -> Column:
    """Share of the file that the copy saves; 0 for an empty file, never negative."""
    return F.when(size > 0, F.greatest(size - estimated, F.lit(0)) / size).otherwise(F.lit(0.0))


def format_bitrate(bits: Column) -> Column:
    """Mbps with one digit from a million on, else whole kbps."""
    return F.when(bits >= 1_000_000, F.format_string("%.1f Mbps", bits / 1_000_000)).otherwise(F.format_string("%.0f kbps", bits / 1_000))


def corner_box(centre_x: Column, centre_y: Column, size: Column) -> Column:
    """struct(x1, y1, x2, y2) from the top left, of a box by centre and size from the bottom left; null without a size."""
    half = size / 2
    return F.when(
        size > 0,
        F.struct(
            (centre_x - half).alias("x1"),
            (1 - (centre_y + half)).alias("y1"),
            (centre_x + half).alias("x2"),
            (1 - (centre_y - half)).alias("y2"),
        ),
    )


def unit_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The box in parts of the picture; null unless the picture has a size."""
    return F.when(
        (width > 0) & (height > 0),
        F.struct((x1 / width).alias("x1"), (y1 / height).alias("y1"), (x2 / width).alias("x2"), (y2 / height).alias("y2")),
    )
