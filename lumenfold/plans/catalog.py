"""Plans of changes as tables: what would be written where, and why not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def date_plan(files: DataFrame, library: DataFrame, retime: bool = False) -> DataFrame:
    """path, mode, id, local_s, utc_s, zone of files that lack a date in the library.

    ``files``: path, local_s (wall clock), utc_s (instant), clip_zone, folder_zone,
    override_zone; ``library``: path, id, dated. Files without a source date, and those
    already dated unless ``retime``, have no row. mode: insert without a library row,
    update for an undated one, retime for a dated one. The first zone of override, clip
    and folder is kept.
    """
    met = files.where("local_s is not null or utc_s is not null").join(library, "path", "left")
    mode = F.when(F.col("id").isNull(), "insert").when(~F.coalesce("dated", F.lit(False)), "update").when(F.lit(retime), "retime")
    return met.withColumn("mode", mode).where("mode is not null").select(
        "path", "mode", "id", "local_s", "utc_s", F.coalesce("override_zone", "clip_zone", "folder_zone").alias("zone")
    )


def apply_date_plan(dates: DataFrame, plan: DataFrame) -> DataFrame:
    """dates (id, local_s, zone) after a plan: updates keep a zone that is there, retimes do not."""
    changes = plan.where("id is not null").select("id", "mode", F.col("local_s").alias("new_s"), F.col("zone").alias("new_zone"))
    met = dates.join(changes, "id", "left")
    writes = (F.col("mode") == "retime") | ((F.col("mode") == "update") & F.col("local_s").isNull())
    hit = F.coalesce(writes, F.lit(False))
    return met.select(
        "id",
        F.when(hit, F.col("new_s")).otherwise(F.col("local_s")).alias("local_s"),
        F.when(hit & (F.col("mode") == "retime"), F.coalesce("new_zone", "zone"))
        .when(hit, F.coalesce("zone", "new_zone"))
        .otherwise(F.col("zone"))
        .alias("zone"),
        hit.alias("written"),
    )


def camera_plan(files: DataFrame, library: DataFrame) -> DataFrame:
    """path, id, status of writing camera names (camera from the file, have and locked from the library).

    A locked value is ours and may be corrected; a foreign one is left alone.
    """
    met = files.join(library, "path", "left")
    status = (
        F.when(F.col("camera").isNull(), "no-signal")
        .when(F.col("id").isNull(), "no-asset")
        .when(F.col("have").isNull(), "would-write")
        .when(F.col("have") == F.col("camera"), "skip-has-camera")
        .when(F.coalesce("locked", F.lit(False)), "would-correct")
        .otherwise("skip-has-camera")
    )
    return met.select("path", "id", status.alias("status"))


def unordered_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair once, whichever way round it is proposed, smaller name first."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def accept(findings: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings whose group, or path if they have none, is among the accepted decisions."""
    return findings.withColumn("decision", F.coalesce("group", "path")).join(accepted, "decision", "left_semi").drop("decision")


def sweep_ids(clusters: DataFrame, metric: str, threshold: float, above: bool, action: str) -> DataFrame:
    """Ids that a bulk action takes, in order of the metric.

    Merging asks for a threshold above 0.9, keeping all for one below 0.9.
    """
    if action == "merge" and not (above and threshold > 0.9):
        raise ValueError("a bulk merge needs scores above 0.9")
    if action == "keep_all" and (above or threshold >= 0.9):
        raise ValueError("keeping all in bulk needs scores below 0.9")
    hit = F.col(metric) >= threshold if above else F.col(metric) < threshold
    return clusters.where(hit).select("id", metric).orderBy(F.desc(metric) if above else F.asc(metric), "id")


def caption_context(rows: DataFrame) -> DataFrame:
    """path, context from place, country and altitude (metres); null without any of them."""
    where = F.concat_ws(", ", F.nullif(F.btrim("place"), F.lit("")), F.nullif(F.btrim("country"), F.lit("")))
    height = F.when(F.col("altitude").isNotNull(), F.concat(F.lit("about "), F.bround("altitude").cast("bigint").cast("string"), F.lit(" m up")))
    return rows.select("path", F.nullif(F.concat_ws("; ", F.nullif(where, F.lit("")), height), F.lit("")).alias("context"))


def merge_notes(notes: DataFrame) -> DataFrame:
    """trip, title, tags over several notes (trip, place, title, tags): first title, all tags once, in order."""
    ordered = notes.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("place", "title", "tags"))).alias("n"))
    titles = F.filter(F.transform("n", lambda x: F.btrim(x["title"])), lambda t: F.coalesce(t != "", F.lit(False)))
    return ordered.select(
        "trip", F.get(titles, 0).alias("title"), F.array_distinct(F.flatten(F.array_compact(F.transform("n", lambda x: x["tags"])))).alias("tags")
    )


def apply_verdicts(files: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """files with the verdict given to any member of their twin group (the smallest, if several)."""
    one = files.join(verdicts, "path").groupBy(key).agg(F.min("verdict").alias("verdict"))
    return files.join(one, key, "left")
