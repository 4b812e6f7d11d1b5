"""Duplicate tiers of incoming files against a library, by ranked lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("fast", "verify", "thorough")


def classify_files(inbound: DataFrame, library: DataFrame, mode: str = "verify") -> DataFrame:
    """path, verdict, match_id of each inbound file (path, filename, size_bytes, checksum).

    Name and size agree: likely in fast mode or when no candidate has a checksum,
    exact when a checksum agrees, else name-only. Only the name agrees: name-only.
    In thorough mode a checksum alone makes a file exact, renamed or not. The match is
    the smallest asset_id of the deciding lookup. Null sizes and checksums match
    nothing. The lookups are aggregated per key before the join, so a frequent name
    costs one row.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    by_both = library.where(F.col("size_bytes").isNotNull()).groupBy("filename", "size_bytes").agg(
        F.min("asset_id").alias("both_id"), F.count("checksum").alias("hashed")
    )
    by_content = library.where(F.col("checksum").isNotNull()).groupBy("filename", "size_bytes", "checksum").agg(
        F.min("asset_id").alias("content_id")
    )
    by_name = library.groupBy("filename").agg(F.min("asset_id").alias("name_id"))
    by_hash = library.where(F.col("checksum").isNotNull()).groupBy("checksum").agg(F.min("asset_id").alias("hash_id"))
    met = (
        inbound.join(by_both, ["filename", "size_bytes"], "left")
        .join(by_content, ["filename", "size_bytes", "checksum"], "left")
        .join(by_name, "filename", "left")
    )
    met = met.join(by_hash, "checksum", "left") if mode == "thorough" else met.withColumn("hash_id", F.lit(None).cast("bigint"))
    both, content = F.col("both_id").isNotNull(), F.col("content_id").isNotNull()
    likely = both & (F.lit(mode == "fast") | (F.col("hashed") == 0))
    exact_by_hash = ~both & F.col("hash_id").isNotNull()
    verdict = (
        F.when(likely, "likely")
        .when(both & content, "exact")
        .when(both, "name-only")
        .when(exact_by_hash, "exact")
        .when(F.col("name_id").isNotNull(), "name-only")
        .otherwise("no-match")
    )
    match = (
        F.when(likely, F.col("both_id"))
        .when(both & content, F.col("content_id"))
        .when(both, F.col("both_id"))
        .when(exact_by_hash, F.col("hash_id"))
        .otherwise(F.col("name_id"))
    )
    return met.select("path", "size_bytes", verdict.alias("verdict"), match.alias("match_id"))


def roll_up(classified: DataFrame) -> DataFrame:
    """verdict, files, bytes with a row for every verdict."""
    spark = classified.sparkSession
    verdicts = spark.createDataFrame(
        [("exact", 1), ("likely", 2), ("name-only", 3), ("no-match", 4)], "verdict string, place int"
    )
    sums = classified.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")
    )
    return F.broadcast(verdicts).join(sums, "verdict", "left").select(
        "verdict", "place", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes")
    )
