"""Column functions on media records: fingerprints, scores, shapes and bit rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the winner score and of the format families.
SOURCE_WEIGHT = {"originals": 120.0, "icloud": 100.0, "google": 30.0}
OTHER_SOURCE_WEIGHT = 50.0
BONUS_FORMATS = ("heic", "heif", "dng", "cr2", "cr3", "arw", "nef", "raf", "rw2", "orf")
FORMAT_BONUS = 20.0
RAW_EXTENSIONS = ("dng", "cr2", "cr3", "arw", "nef", "raf", "rw2", "orf")
JPEG_EXTENSIONS = ("jpg", "jpeg", "heic", "heif")
VIDEO_EXTENSIONS = ("mp4", "mov", "m4v", "avi", "mkv", "mts", "m2ts", "insv", "lrv", "lrf")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_to_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hash_from_hex(text: Column) -> Column:
    """Signed 64-bit number of 16 hex digits."""
    return F.conv(text, 16, -10).try_cast("bigint")


def winner_score(source: Column, width: Column, height: Column, size: Column, fields: Column, fmt: Column) -> Column:
    """Weight of source, pixels, bytes, metadata fields and format; unknown sizes count as 1."""
    weight = F.lit(OTHER_SOURCE_WEIGHT)
    for name, value in SOURCE_WEIGHT.items():
        weight = F.when(source == name, value).otherwise(weight)

    def or_one(number: Column) -> Column:
        return F.when(number.isNull() | (number == 0), 1).otherwise(number).cast("double")

    pixels = F.greatest(or_one(width) * or_one(height), F.lit(1.0))
    return (
        weight
        + F.log10(pixels) * 10
        + F.log10(F.greatest(F.coalesce(size, F.lit(1)).cast("double"), F.lit(1.0))) * 5
        + F.coalesce(fields, F.lit(0)) * 2
        + F.when(fmt.isin(*BONUS_FORMATS), FORMAT_BONUS).otherwise(0.0)
    )


def _known(*dims: Column) -> Column:
    out = F.lit(True)
    for dim in dims:
        out = out & dim.isNotNull() & (dim != 0)
    return out


def aspect_change(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Relative change of the aspect ratio; 0 if a dimension is unknown."""
    one, two = w1 / h1, w2 / h2
    return F.when(_known(w1, h1, w2, h2), F.abs(one - two) / F.greatest(one, two)).otherwise(0.0)


def is_rotation_swap(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float = 0.03) -> Column:
    swapped = (F.abs(w1 - h2) / F.greatest(w1, h2) < tolerance) & (F.abs(h1 - w2) / F.greatest(h1, w2) < tolerance)
    return F.when(_known(w1, h1, w2, h2), swapped).otherwise(False)


def bits_per_pixel(bitrate: Column, width: Column, height: Column, fps: Column) -> Column:
    return bitrate / (width * height * fps)


def target_bitrate(width: Column, height: Column, fps: Column, per_pixel: float = 0.06, step: int = 500_000) -> Column:
    """Bit rate for delivery, rounded half to even to the step, one step at least."""
    steps = F.bround(width * height * fps * per_pixel / step)
    return F.greatest(steps, F.lit(1.0)).cast("bigint") * step


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two arrays; null if either has no length."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x
        )

    size = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(size > 0, dot(u, v) / size)


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(x))


def correlation(u: Column, v: Column) -> Column:
    """Normalised cross-correlation of two pixel arrays; null if either is flat or sizes differ."""
    n = F.size(u)

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / n

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)

    def centred(a: Column) -> Column:
        return F.transform(a, lambda x: x - mean(a))

    top = total(F.zip_with(centred(u), centred(v), lambda x, y: x * y))
    size = F.sqrt(total(F.transform(centred(u), lambda x: x * x)) * total(F.transform(centred(v), lambda x: x * x)))
    return F.when((n == F.size(v)) & (size > 0), top / size)


def perceptual_hash(pixels: Column) -> Column:
    """64-bit hash of 1 024 grey values (32 x 32): signs of the low DCT terms against their median.

    The constant term is left out of the median but has its bit; other sizes give null.
    """

    def hashed(series: pd.Series) -> pd.Series:
        k = np.arange(32)
        basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)

        def one(values) -> int | None:
            if values is None or len(values) != 1024:
                return None
            low = (basis @ np.asarray(values, "f8").reshape(32, 32) @ basis.T)[:8, :8].ravel()
            bits = (low > np.median(low[1:])).astype("u1")
            return int(np.packbits(bits).view(">i8")[0])

        return series.map(one).astype("Int64")

    return F.pandas_udf(hashed, "bigint")(pixels)


def word_ratio(one: Column, two: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts by words, to three decimals."""

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series(
            [
                None if x is None or y is None else round(SequenceMatcher(None, x.split(), y.split()).ratio(), 3)
                for x, y in zip(a, b)
            ],
            dtype="float64",
        )

    return F.pandas_udf(ratio, "double")(one, two)
