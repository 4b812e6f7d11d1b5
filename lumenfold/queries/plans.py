"""Queries of the plan operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import file_camera
from ..operators.timestamps import parsed
from ..plans import catalog as plans
from ..session import table
from .registry import ledger, query

_WALL = """epoch(try_strptime(regexp_replace(regexp_replace(trim({c}), '([+-][0-9]{{2}}:[0-9]{{2}}|Z)$', ''), '[.][0-9]+$', ''),
    ['%Y-%m-%dT%H:%M:%S', '%Y:%m:%d %H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y%m%d_%H%M%S', '%Y/%m/%d %H:%M:%S', '%d-%b-%Y %H:%M:%S', '%Y%m%d-%H%M%S', '%Y%m%dT%H%M%S', '%Y%m%d%H%M%S', '%d %b %Y, %I:%M:%S %p']))::BIGINT"""


@query(
    "date_plan",
    f"""WITH f AS (SELECT original_path AS path, min({_WALL.format(c="local_date_time")}) AS local_s, min(trim(tz_name)) AS zone FROM date_candidate GROUP BY 1),
       a AS (SELECT path, min(id) AS id, bool_or(epoch IS NOT NULL) AS dated FROM ledger GROUP BY 1)
       SELECT f.path, CASE WHEN a.id IS NULL THEN 'insert' ELSE 'update' END AS mode, a.id, f.local_s, f.zone FROM f LEFT JOIN a ON a.path = f.path
       WHERE f.local_s IS NOT NULL AND NOT coalesce(a.dated, false)""",
    "wall ledger",
)
def date_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = parsed(F.col("local_date_time"), wall_only=True)["secs"]
    files = table(spark, sf_dir, "date_candidate").groupBy(F.col("original_path").alias("path")).agg(
        F.min(wall).alias("local_s"), F.min(F.trim("tz_name")).alias("folder_zone")
    )
    none = F.lit(None)
    files = files.select("path", "local_s", none.cast("bigint").alias("utc_s"), none.cast("string").alias("clip_zone"), "folder_zone", none.cast("string").alias("override_zone"))
    known = ledger(spark, sf_dir).groupBy("path").agg(F.min("id").alias("id"), F.bool_or(F.col("epoch").isNotNull()).alias("dated"))
    return plans.date_plan(files, known).select("path", "mode", "id", "local_s", "zone")


@query(
    "camera_plan",
    """WITH a AS (SELECT id, path, regexp_extract(path, '[^/]*$') AS f FROM ledger),
       c AS (SELECT id, path, CASE WHEN starts_with(f, 'DJI_') THEN 'DJI' WHEN starts_with(f, 'GOPR') OR starts_with(f, 'GX01') OR starts_with(f, 'GH01') THEN 'GoPro' END AS cam FROM a)
       SELECT status, count(*) AS n FROM (SELECT CASE WHEN cam IS NULL THEN 'no-signal' WHEN id % 5 = 0 THEN 'no-asset' WHEN id % 5 = 1 THEN 'would-write'
           WHEN id % 5 = 2 THEN 'skip-has-camera' WHEN id % 5 = 3 THEN 'would-correct' ELSE 'skip-has-camera' END AS status FROM c) GROUP BY 1""",
    "wall ledger",
)
def camera_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "path").distinct()
    none = F.lit(None).cast("string")
    files = rows.select("path", file_camera(none, none, F.col("path")).alias("camera"))
    turn = F.col("id") % 5
    known = rows.where(turn != 0).select(
        "path", "id",
        F.when(turn == 2, file_camera(none, none, F.col("path"))).when(turn >= 3, "other").alias("have"),
        (turn == 3).alias("locked"),
    )
    return plans.camera_plan(files, known).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unordered_pairs",
    "SELECT DISTINCT least(asset_a, asset_b) AS asset_a, greatest(asset_a, asset_b) AS asset_b FROM match_pair WHERE asset_a <> asset_b",
)
def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.unordered_pairs(table(spark, sf_dir, "match_pair"), "asset_a", "asset_b")


@query(
    "sweep_ids",
    "SELECT DISTINCT id, clip_cos_sim FROM dedup_cluster WHERE decision = 'review' AND clip_cos_sim >= 0.95 ORDER BY clip_cos_sim DESC, id",
)
def sweep_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = table(spark, sf_dir, "dedup_cluster").where("decision = 'review'").select("id", "clip_cos_sim").distinct()
    return plans.sweep_ids(review, "clip_cos_sim", 0.95, True, "merge")


@query(
    "accepted_findings",
    """WITH f AS (SELECT DISTINCT id, path, CASE WHEN id % 2 = 0 THEN source END AS grp FROM asset)
       SELECT path, grp AS "group" FROM f WHERE coalesce(grp, path) IN (SELECT DISTINCT coalesce(CASE WHEN id % 2 = 0 THEN source END, path) FROM asset WHERE id % 7 = 0 AND (id % 2 = 1 OR source = 'icloud'))""",
)
def accepted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "path", "source").distinct()
    findings = rows.select("id", "path", F.when(F.col("id") % 2 == 0, F.col("source")).alias("group"))
    yes = rows.where("id % 7 = 0 and (id % 2 = 1 or source = 'icloud')").select(
        F.coalesce(F.when(F.col("id") % 2 == 0, F.col("source")), F.col("path")).alias("decision")
    )
    return plans.accept(findings, yes).select("path", "group")


@query(
    "caption_contexts",
    """SELECT point_id AS path, nullif(concat_ws('; ', nullif(concat_ws(', ', nullif(trim(city), ''), nullif(trim(country), '')), ''),
           CASE WHEN point_id % 3 = 0 THEN 'about ' || round_even(lat * 10, 0)::BIGINT || ' m up' END), '') AS context FROM (SELECT DISTINCT point_id, city, country, lat FROM asset_point WHERE lat IS NOT NULL)""",
)
def caption_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset_point").where("lat is not null").select("point_id", "city", "country", "lat").distinct()
    return plans.caption_context(
        rows.select(F.col("point_id").alias("path"), F.col("city").alias("place"), "country", F.when(F.col("point_id") % 3 == 0, F.col("lat") * 10).alias("altitude"))
    )


@query(
    "worst_first",
    """SELECT doc_id, (length(text) - length(replace(text, ' ', ''))) / length(text)::DOUBLE AS score FROM documents WHERE source = 'transcript' AND length(text) > 0 ORDER BY score, doc_id""",
)
def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    blanks = size - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rows = table(spark, sf_dir, "documents").where("source = 'transcript' and length(text) > 0")
    return rows.select("doc_id", (blanks / size).alias("score")).orderBy("score", "doc_id")


@query(
    "merged_notes",
    """WITH n AS (SELECT o_custkey AS trip, o_orderkey AS place, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS title, o_orderstatus AS tag FROM orders)
       SELECT trip, arg_min(title, place) FILTER (trim(title) <> '') AS title, count(DISTINCT tag) AS tags FROM n GROUP BY 1""",
)
def merged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("trip"), F.col("o_orderkey").alias("place"),
        F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"), F.array("o_orderstatus").alias("tags"),
    )
    return plans.merge_notes(rows).select("trip", "title", F.size("tags").cast("bigint").alias("tags"))


@query(
    "twin_verdicts",
    """WITH f AS (SELECT doc_id, md5(text) AS k FROM documents), v AS (SELECT k, min(CASE WHEN doc_id % 2 = 0 THEN 'keep' ELSE 'drop' END) AS verdict FROM f WHERE doc_id % 3 = 0 GROUP BY 1)
       SELECT f.doc_id AS path, v.verdict FROM f LEFT JOIN v USING (k)""",
)
def twin_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("k"))
    given = files.where("path % 3 = 0").select("path", F.when(F.col("path") % 2 == 0, "keep").otherwise("drop").alias("verdict"))
    return plans.apply_verdicts(files, given, "k").select("path", "verdict")


@query("zone_offsets")
def zone_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset to append to a wall clock at its instant in the trip's zone (no SQL: zone rules of the JVM)."""
    from ..functions.dates import format_offset
    from ..operators.timestamps import resolve_instants

    rows = table(spark, sf_dir, "date_candidate").select("candidate_id", "tz_name", parsed(F.col("local_date_time")).alias("p")).distinct()
    known = resolve_instants(rows.where("p is not null and not p.fixed"), "p", "tz_name", "instant")
    return known.select("candidate_id", format_offset(F.col("p.secs") - F.col("instant")).alias("zone"))
