"""Decision on duplicate clusters: keep all, review or merge, as one cascade over group flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media

COSINE_BAR = 0.98
STRONG_BITS = 6


def decide_clusters(rows: DataFrame) -> DataFrame:
    """cluster_id, decision, winner_id, confidence of clusters with two members or more.

    ``rows``: cluster_id, id, source, format, media_type, width, height, bytes,
    exif_fields, phash, epoch, gps_lat, gps_lon, stem, burst_uuid, edited,
    clip_cos_sim. Guards in order: a burst, or three dated shots within a second at one
    size, keeps all; edited next to unedited, a crop, an original that would lose, weak
    visual evidence without a cosine past the bar, videos of other sizes, or metadata
    that does not agree send it to review. Equal scores: the smaller id wins.
    """
    score = F.round(
        media.winner_score(*(F.col(c) for c in ("source", "width", "height", "bytes", "exif_fields", "format"))), 9
    )
    scored = rows.withColumn("score", score)
    inside = Window.partitionBy("cluster_id")
    traits = ("id", "width", "height", "phash", "bytes", "epoch", "gps_lat", "gps_lon", "stem")
    winner = F.min(F.struct((-F.col("score")).alias("low"), *traits)).over(inside)
    met = scored.withColumn("w", winner).withColumn("loses", F.col("id") != F.col("w.id"))
    apart = media.hamming(F.col("phash"), F.col("w.phash"))
    crop = media.aspect_change(F.col("w.width"), F.col("w.height"), F.col("width"), F.col("height")) > 0.05
    visual = F.when(
        F.col("media_type") == "image",
        F.coalesce(apart <= STRONG_BITS, F.lit(False)) | F.coalesce(F.col("clip_cos_sim") >= COSINE_BAR, F.lit(False)),
    ).otherwise(F.coalesce(F.col("bytes") == F.col("w.bytes"), F.lit(False)))
    agrees = (
        F.coalesce(F.abs(F.col("epoch") - F.col("w.epoch")) <= 3, F.lit(False))
        | F.coalesce(
            (F.abs(F.col("gps_lat") - F.col("w.gps_lat")) < 0.001) & (F.abs(F.col("gps_lon") - F.col("w.gps_lon")) < 0.001),
            F.lit(False),
        )
        | (F.col("stem") == F.col("w.stem"))
    )
    doubt = F.col("loses") & (crop | (F.col("source") == "originals") | ~visual | ~agrees)
    edited = F.coalesce(F.col("edited"), F.lit(False))
    groups = met.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce(F.col("burst_uuid") != "", F.lit(False))).alias("burst"),
        F.count("epoch").alias("dated"),
        (F.max("epoch") - F.min("epoch")).alias("spread"),
        F.count_distinct(F.struct("width", "height")).alias("shapes"),
        F.bool_or(edited).alias("any_edited"),
        F.bool_and(edited).alias("all_edited"),
        F.bool_or(doubt).alias("doubt"),
        F.max(F.when(F.col("loses"), apart)).alias("most_apart"),
        F.min("w.id").alias("winner_id"),
    )
    decision = (
        F.when(F.col("burst"), "kept_all")
        .when((F.col("dated") >= 3) & (F.col("spread") <= 1) & (F.col("shapes") == 1), "kept_all")
        .when(F.col("any_edited") & ~F.col("all_edited"), "review")
        .when(F.col("doubt"), "review")
        .otherwise("auto")
    )
    confidence = F.coalesce(1 - F.col("most_apart") / 64.0, F.lit(0.5))
    return groups.where("n >= 2").select(
        "cluster_id", decision.alias("decision"), "winner_id", confidence.alias("confidence")
    )
