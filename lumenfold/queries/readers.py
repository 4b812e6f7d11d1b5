"""Queries of the readers: notes, tracks, telemetry, sidecars, snapshots, and state kept beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog
from ..plans import catalog as plans
from ..session import Scratch, table
from ..sources import files, tables
from ..streaming.jobs import prune_state
from .registry import ledger, pings, query


@query(
    "merged_sidecars",
    """WITH a AS (SELECT DISTINCT id, path FROM asset)
       SELECT path, CASE WHEN id % 2 = 0 THEN 'own' WHEN id % 3 = 0 THEN 'side' END AS title, CASE WHEN id % 3 = 0 THEN '5' END AS rating, CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN 'x' END AS other FROM
         (SELECT path, id, count(*) OVER (PARTITION BY regexp_replace(path, '[.][^./]*$', '')) AS k FROM a) WHERE k = 1""",
)
def merged_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of files with those of a sidecar where they are absent; only tags of the sidecar's own kind are taken."""
    rows = table(spark, sf_dir, "asset").select("id", "path").distinct()
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    single = rows.groupBy(stem.alias("stem")).agg(F.count(F.lit(1)).alias("k"), F.min("path").alias("path"), F.min("id").alias("id")).where("k = 1")
    none = F.create_map().cast("map<string,string>")
    media = single.select("path", F.when(F.col("id") % 2 == 0, F.create_map(F.lit("XMP:Title"), F.lit("own"))).alias("tags"))
    side = single.where("id % 3 = 0").select(
        F.concat("stem", F.lit(".xmp")).alias("path"),
        F.map_concat(
            F.create_map(F.lit("XMP:Title"), F.lit("side"), F.lit("XMP:Rating"), F.lit("5"), F.lit("File:Name"), F.lit("no")),
            F.when(F.col("id") % 5 == 0, F.create_map(F.lit("XMP:Other"), F.lit("x"))).otherwise(none),
        ).alias("tags"),
    )
    met = files.merge_sidecars(media, side)
    return met.select("path", *(F.col("tags")[f"XMP:{k}"].alias(k.lower()) for k in ("Title", "Rating", "Other")))


@query(
    "gpx_points",
    """SELECT device_id, count(*) AS points, round(min(lat), 4) AS south, round(max(lon), 4) AS east, min(t)::BIGINT AS first_t FROM pings GROUP BY 1""",
    "pings",
)
def gpx_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks written as GPX and read again."""
    point = F.struct(F.col("t"), F.col("lat"), F.col("lon"), F.timestamp_seconds("t").alias("at"))
    day = F.floor(F.col("t") / 86400)
    written = pings(spark, sf_dir).groupBy("device_id", day.alias("day")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    texts = written.select(F.concat_ws("#", "device_id", F.col("day").cast("string")).alias("path"), catalog.gpx_text(F.col("points")).alias("body"))
    read = files.track_points(texts).withColumn("device_id", F.regexp_extract("path", r"^(.*)#-?\d+$", 1))
    return read.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.min("lat"), 4).alias("south"), F.round(F.max("lon"), 4).alias("east"), F.unix_seconds(F.min("at")).alias("first_t")
    )


@query(
    "telemetry_fields",
    """SELECT clip_id, 1 AS frame, 1.5::DOUBLE AS offset_s, epoch_us(datetime_original) // 1000000 AS secs, CASE WHEN NOT (round(latitude, 6) = 0 AND round(longitude, 6) = 0) THEN round(latitude, 6) END AS lat,
              round(altitude, 1) AS abs_alt, (clip_id % 800)::DOUBLE AS iso, '1/' || (clip_id % 500 + 1) AS shutter
       FROM (SELECT DISTINCT * FROM srt_telemetry) WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND altitude IS NOT NULL AND datetime_original IS NOT NULL""",
)
def telemetry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of a telemetry cue, from texts made of the stored values."""
    rows = table(spark, sf_dir, "srt_telemetry").distinct().where("latitude is not null and longitude is not null and altitude is not null and datetime_original is not null")
    body = F.concat(
        F.lit("1\n00:00:01,500 --> 00:00:02,000\n<font size='28'>"), F.date_format(F.col("datetime_original").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"),
        F.lit("\n[iso : "), (F.col("clip_id") % 800).cast("string"), F.lit("] [shutter : 1/"), (F.col("clip_id") % 500 + 1).cast("string"),
        F.format_string("] [latitude: %.6f] [longitude: %.6f] [rel_alt: 1.0 abs_alt: %.1f]</font>\n\n\n", "latitude", "longitude", "altitude"),
    )
    frames = files.telemetry_frames(rows.select(F.col("clip_id"), body.alias("body")), key="clip_id")
    return frames.select("clip_id", "frame", "offset_s", F.unix_seconds(F.col("at").cast("timestamp")).alias("secs"), "lat", "abs_alt", "iso", "shutter")


@query(
    "note_values",
    r"""WITH d AS (SELECT doc_id, regexp_extract(text, '^---[ \t]*\r?\n((?:.|\r|\n)*?)\r?\n---[ \t]*(?:\r?\n|$)', 1) AS b FROM documents WHERE text IS NOT NULL),
       v AS (SELECT doc_id, 'trip' AS field, regexp_extract(b, '(?m)^trip:[ \t]*(.+?)[ \t\r]*$', 1) AS value FROM d
             UNION ALL SELECT doc_id, 'location.name', regexp_extract(b, '(?m)^[ ]+name:[ \t]*(.+?)[ \t\r]*$', 1) FROM d
             UNION ALL SELECT doc_id, 'location.coords', regexp_extract(b, '(?m)^[ ]+coords:[ \t]*(.+?)[ \t\r]*$', 1) FROM d
             UNION ALL SELECT doc_id, 'tags', regexp_extract(b, '(?m)^tags:[ \t]*(.+?)[ \t\r]*$', 1) FROM d)
       SELECT doc_id, field, value FROM v WHERE value <> ''""",
)
def note_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of notes with nested fields and lists."""
    return files.front_matter(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")


@query(
    "folder_notes",
    """WITH f AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM asset)
       SELECT folder, folder || CASE WHEN length(folder) % 3 = 0 THEN '/TRIP.md' ELSE '/README.md' END AS path FROM f WHERE length(folder) % 3 = 0 OR length(folder) % 2 = 0""",
)
def folder_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best notes file of each folder."""
    folders = table(spark, sf_dir, "asset").select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).distinct()
    size = F.length("folder")
    names = F.array(F.when(size % 3 == 0, "TRIP.md"), F.when(size % 2 == 0, "README.md"), F.lit("other.md"))
    listing = folders.select(F.explode(F.transform(F.array_compact(names), lambda n: F.concat_ws("/", "folder", n))).alias("path"))
    return files.preferred_notes(listing)


@query(
    "json_companions",
    """WITH a AS (SELECT DISTINCT id, path FROM asset)
       SELECT path, path || CASE WHEN id % 3 = 0 THEN '.json' ELSE '.supplemental-metadata.json' END AS json_path FROM a WHERE id % 3 < 2""",
)
def json_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON companion of each file: its exact name before the supplemental one."""
    rows = table(spark, sf_dir, "asset").select("id", "path").distinct()
    exact = rows.where("id % 3 = 0").select(F.concat("path", F.lit(".json")).alias("path"))
    extra = rows.where("id % 3 < 2").select(F.concat("path", F.lit(".supplemental-metadata.json")).alias("path"))
    return files.companion_json(rows.where("id % 3 < 2").select("path"), exact.unionByName(extra))


@query("snapshot_rows", "SELECT id, path, bytes, NULL::VARCHAR AS note FROM (SELECT DISTINCT id, path, bytes FROM asset)")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot that is written, read behind its version, and migrated to a column it lacks."""
    path = Scratch(spark, "snapshot").path("catalog")
    tables.write_snapshot({"assets": table(spark, sf_dir, "asset").select("id", "path", "bytes").distinct()}, path)
    return tables.migrate(tables.read_snapshot(spark, path, "assets"), {"note": "string"})


@query(
    "pruned_state",
    """SELECT DISTINCT asset_id AS key, model AS worker FROM asset_embedding WHERE asset_id IN (SELECT id FROM asset WHERE status <> 'error')""",
)
def pruned_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker state of live assets only."""
    state = table(spark, sf_dir, "asset_embedding").select(F.col("asset_id").alias("key"), F.col("model").alias("worker")).distinct()
    live = table(spark, sf_dir, "asset").where("status <> 'error'").select(F.col("id").alias("key")).distinct()
    return prune_state(state, live)


@query(
    "applied_dates",
    """WITH n AS (SELECT id, epoch, CASE WHEN id % 2 = 0 THEN 'Z0' END AS zone FROM ledger)
       SELECT id, CASE WHEN id % 3 = 0 AND epoch IS NULL THEN id * 10 WHEN id % 3 = 1 THEN id * 10 ELSE epoch END AS local_s,
              CASE WHEN id % 3 = 0 AND epoch IS NULL THEN coalesce(zone, 'Z1') WHEN id % 3 = 1 THEN 'Z1' ELSE zone END AS zone,
              (id % 3 = 0 AND epoch IS NULL) OR id % 3 = 1 AS written FROM n""",
    "wall ledger",
)
def applied_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates after a plan: updates fill what is missing and keep a zone, retimes replace both."""
    now = ledger(spark, sf_dir).select("id", F.col("epoch").alias("local_s"), F.when(F.col("id") % 2 == 0, "Z0").alias("zone"))
    plan = now.where("id % 3 < 2").select(
        "id", F.when(F.col("id") % 3 == 0, "update").otherwise("retime").alias("mode"), (F.col("id") * 10).alias("local_s"), F.lit("Z1").alias("zone")
    )
    return plans.apply_date_plan(now, plan)
