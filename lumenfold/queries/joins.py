"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media
from ..functions.geo import geo_cell, haversine_km
from ..functions.text import extension, file_name, file_stem, normalized_stem, parent_dir
from ..operators.asof import bracket, locate, nearest
from ..operators.timestamps import parsed
from ..operators.range_join import block_pairs, near_pairs_in_time, range_join
from ..operators.skew import blocked_join
from ..operators.tiered import classify_files, roll_up
from ..session import table
from .registry import inbound, ledger, library, members, pings, query

_TIERS_SQL = """
    SELECT i.path, i.size_bytes,
        CASE WHEN b.id IS NOT NULL AND ({fast} OR b.hashed = 0) THEN 'likely'
             WHEN b.id IS NOT NULL AND c.id IS NOT NULL THEN 'exact'
             WHEN b.id IS NOT NULL THEN 'name-only'
             WHEN {thorough} AND h.id IS NOT NULL THEN 'exact'
             WHEN n.id IS NOT NULL THEN 'name-only' ELSE 'no-match' END AS verdict,
        CASE WHEN b.id IS NOT NULL AND ({fast} OR b.hashed = 0) THEN b.id
             WHEN b.id IS NOT NULL THEN coalesce(c.id, b.id)
             WHEN {thorough} AND h.id IS NOT NULL THEN h.id ELSE n.id END AS match_id
    FROM inbound i
    LEFT JOIN (SELECT filename, size_bytes, min(asset_id) AS id, count(checksum) AS hashed FROM library GROUP BY ALL) b
        ON b.filename = i.filename AND b.size_bytes = i.size_bytes
    LEFT JOIN (SELECT filename, size_bytes, checksum, min(asset_id) AS id FROM library GROUP BY ALL) c
        ON c.filename = i.filename AND c.size_bytes = i.size_bytes AND c.checksum = i.checksum
    LEFT JOIN (SELECT filename, min(asset_id) AS id FROM library GROUP BY ALL) n ON n.filename = i.filename
    LEFT JOIN (SELECT checksum, min(asset_id) AS id FROM library WHERE checksum IS NOT NULL GROUP BY ALL) h
        ON h.checksum = i.checksum
"""
_VERIFY = _TIERS_SQL.format(fast="false", thorough="false")


def _tiers(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return classify_files(inbound(spark, sf_dir), library(spark, sf_dir), mode)


@query("dup_tiers", _VERIFY, "wall ledger library inbound")
def dup_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir, "verify")


@query("dup_tiers_fast", _TIERS_SQL.format(fast="true", thorough="false"), "wall ledger library inbound")
def dup_tiers_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir, "fast")


@query("dup_tiers_thorough", _TIERS_SQL.format(fast="false", thorough="true"), "wall ledger library inbound")
def dup_tiers_thorough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiers(spark, sf_dir, "thorough")


@query(
    "dup_rollup",
    f"""WITH tiers AS ({_VERIFY})
    SELECT v.verdict, v.place::INT AS place, count(t.path) AS files, coalesce(sum(t.size_bytes), 0)::BIGINT AS bytes
    FROM (VALUES ('exact', 1), ('likely', 2), ('name-only', 3), ('no-match', 4)) v(verdict, place)
    LEFT JOIN tiers t ON t.verdict = v.verdict GROUP BY 1, 2""",
    "wall ledger library inbound",
)
def dup_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(_tiers(spark, sf_dir, "verify"))


@query(
    "assets_left_cluster",
    "SELECT l.id, l.bytes, m.cluster_id FROM ledger l LEFT JOIN members m ON m.asset_id = l.id WHERE l.status <> 'error'",
    "wall ledger members",
)
def assets_left_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "asset").select("id", "bytes", "status").distinct().where("status <> 'error'")
    linked = members(spark, sf_dir).withColumnRenamed("asset_id", "id")
    return known.join(linked, "id", "left").select("id", "bytes", "cluster_id")


@query(
    "geo_dated_assets",
    "SELECT id, epoch, gps_lat, gps_lon FROM ledger WHERE fix AND epoch IS NOT NULL",
    "wall ledger",
)
def geo_dated_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).where("fix and epoch is not null").select("id", "epoch", "gps_lat", "gps_lon")


@query(
    "name_size_lookup",
    """SELECT i.id, l.asset_id FROM inbound i JOIN library l
       ON l.filename = i.filename AND l.size_bytes = i.size_bytes""",
    "wall ledger library inbound",
)
def name_size_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbound(spark, sf_dir).join(library(spark, sf_dir).drop("checksum"), ["filename", "size_bytes"]).select(
        "id", "asset_id"
    )


@query(
    "checksum_lookup",
    "SELECT i.id, l.asset_id FROM inbound i JOIN library l ON l.checksum = i.checksum",
    "wall ledger library inbound",
)
def checksum_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbound(spark, sf_dir).select("id", "checksum").join(
        library(spark, sf_dir).select("asset_id", "checksum"), "checksum"
    ).select("id", "asset_id")


@query(
    "known_membership",
    "SELECT cluster_id, asset_id FROM members m WHERE cluster_id IN (SELECT id FROM dedup_cluster)",
    "members",
)
def known_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = table(spark, sf_dir, "dedup_cluster").select(F.col("id").alias("cluster_id"))
    return members(spark, sf_dir).join(clusters, "cluster_id", "left_semi")


@query(
    "raw_preview_anti",
    """SELECT j.id FROM ledger j WHERE lower(regexp_extract(j.path, '[.]([^./]+)$', 1)) IN ('jpg','jpeg','heic','heif')
       AND NOT EXISTS (SELECT 1 FROM ledger r
           WHERE lower(regexp_extract(r.path, '[.]([^./]+)$', 1)) IN ('dng','cr2','cr3','arw','nef','raf','rw2','orf')
           AND regexp_replace(r.path, '/[^/]*$', '') = regexp_replace(j.path, '/[^/]*$', '')
           AND lower(regexp_replace(regexp_extract(r.path, '[^/]*$'), '[.][^.]+$', ''))
             = lower(regexp_replace(regexp_extract(j.path, '[^/]*$'), '[.][^.]+$', '')))""",
    "wall ledger",
)
def raw_preview_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "asset").select("id", "path").distinct().select(
        "id",
        parent_dir(F.col("path")).alias("dir"),
        F.lower(file_stem(F.col("path"))).alias("stem"),
        extension(F.col("path")).alias("ext"),
    )
    raw = files.where(F.col("ext").isin(*media.RAW_EXTENSIONS)).select("dir", "stem")
    return files.where(F.col("ext").isin(*media.JPEG_EXTENSIONS)).join(raw, ["dir", "stem"], "left_anti").select("id")


@query(
    "proxy_pairs",
    """WITH f AS (SELECT id, path, regexp_replace(path, '/[^/]*$', '') AS dir,
           lower(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')) AS stem,
           lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS ext FROM ledger),
       proxy AS (SELECT dir, stem, min(path) AS proxy_path FROM f WHERE ext = 'm4v' GROUP BY ALL)
       SELECT m.id, p.proxy_path FROM f m JOIN proxy p USING (dir, stem) WHERE m.ext IN ('mov', 'mp4')""",
    "wall ledger",
)
def proxy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "asset").select("id", "path").distinct().select(
        "id",
        "path",
        parent_dir(F.col("path")).alias("dir"),
        F.lower(file_stem(F.col("path"))).alias("stem"),
        extension(F.col("path")).alias("ext"),
    )
    proxy = files.where("ext = 'm4v'").groupBy("dir", "stem").agg(F.min("path").alias("proxy_path"))
    return files.where("ext in ('mov', 'mp4')").join(proxy, ["dir", "stem"]).select("id", "proxy_path")


@query(
    "claimed_anti",
    "SELECT id FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.asset_id = l.id)",
    "wall ledger members",
)
def claimed_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = members(spark, sf_dir).select(F.col("asset_id").alias("id"))
    return table(spark, sf_dir, "asset").select("id").distinct().join(claimed, "id", "left_anti")


@query(
    "unclaimed_or_originals",
    """SELECT id FROM ledger l WHERE source = 'originals'
       OR NOT EXISTS (SELECT 1 FROM members m WHERE m.asset_id = l.id)""",
    "wall ledger members",
)
def unclaimed_or_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = members(spark, sf_dir).select(F.col("asset_id").alias("id")).distinct().withColumn("claimed", F.lit(True))
    known = table(spark, sf_dir, "asset").select("id", "source").distinct()
    return known.join(claimed, "id", "left").where("claimed is null or source = 'originals'").select("id")


@query(
    "unembedded_images",
    """SELECT id FROM ledger l WHERE media_type = 'image' AND NOT EXISTS (
           SELECT 1 FROM asset_embedding e WHERE e.asset_id = l.id AND e.vec IS NOT NULL)""",
    "wall ledger",
)
def unembedded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "asset_embedding").where("vec is not null").select(F.col("asset_id").alias("id"))
    images = table(spark, sf_dir, "asset").where("media_type = 'image'").select("id").distinct()
    return images.join(done, "id", "left_anti")


@query(
    "unscored_review",
    "SELECT DISTINCT id FROM dedup_cluster WHERE decision = 'review' AND clip_cos_sim IS NULL",
)
def unscored_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dedup_cluster").where("decision = 'review' and clip_cos_sim is null").select("id").distinct()


@query(
    "time_block_pairs",
    """SELECT a.id AS id_a, b.id AS id_b FROM ledger a JOIN ledger b
       ON a.id < b.id AND abs(a.epoch - b.epoch) <= 3
       WHERE a.taken_src IN ('exif', 'json') AND b.taken_src IN ('exif', 'json')""",
    "wall ledger",
)
def time_block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = ledger(spark, sf_dir).where("taken_src in ('exif', 'json')").select("id", "epoch")
    return near_pairs_in_time(dated, "id", "epoch", 3)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir)
    stem = normalized_stem(F.col("path"))
    cell = F.when(
        F.col("fix") & F.col("epoch").isNotNull(),
        F.concat_ws(
            "|", F.lit("geo"), F.floor(F.col("epoch") / 86400), geo_cell(F.col("gps_lat")), geo_cell(F.col("gps_lon"))
        ),
    )
    blocks = F.array(F.when(F.length(stem) >= 4, F.concat(F.lit("stem|"), stem)), cell)
    return block_pairs(rows, "id", blocks)


_BLOCKS_SQL = """blocks AS (
        SELECT id, 'stem|' || stem AS block FROM (SELECT id, trim(regexp_replace(regexp_replace(lower(
            regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')), '-(edited|effects)$', ''), '[(][0-9]+[)]$', ''),
            ' ._-') AS stem FROM ledger) WHERE length(stem) >= 4
        UNION SELECT id, 'geo|' || floor(epoch / 86400.0)::BIGINT || '|' || floor(gps_lat / 0.001::DOUBLE)::BIGINT || '|'
            || floor(gps_lon / 0.001::DOUBLE)::BIGINT FROM ledger WHERE fix AND epoch IS NOT NULL),
    kept AS (SELECT b.* FROM blocks b JOIN (
        SELECT block FROM blocks GROUP BY block HAVING count(*) BETWEEN 2 AND 200) USING (block)),
    blocked AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM kept a JOIN kept b ON a.block = b.block AND a.id < b.id)"""


@query("blocked_pairs", f"WITH {_BLOCKS_SQL} SELECT * FROM blocked", "wall ledger")
def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


@query(
    "pair_evidence",
    f"""WITH {_BLOCKS_SQL},
    lite AS (SELECT id, media_type, format, phash, bytes, epoch, taken_src, regexp_replace(path, '/[^/]*$', '') AS dir,
        trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')),
        '-(edited|effects)$', ''), '[(][0-9]+[)]$', ''), ' ._-') AS stem FROM ledger),
    pairs AS (SELECT p.id_a, p.id_b, CASE
        WHEN ((a.format IN ('dng','cr2','cr3','arw','nef','raf','rw2','orf') AND b.format IN ('jpg','jpeg','heic','heif'))
           OR (b.format IN ('dng','cr2','cr3','arw','nef','raf','rw2','orf') AND a.format IN ('jpg','jpeg','heic','heif')))
           AND a.dir = b.dir AND a.stem = b.stem THEN NULL
        WHEN a.media_type = 'image' AND b.media_type = 'image' THEN
            CASE WHEN bit_count(xor(a.phash, b.phash)) <= 6 THEN 'strong'
                 WHEN bit_count(xor(a.phash, b.phash)) <= 10 THEN 'candidate' END
        WHEN a.media_type = 'video' AND b.media_type = 'video' THEN
            CASE WHEN a.bytes <> 0 AND a.bytes = b.bytes THEN 'strong'
                 WHEN a.taken_src IN ('exif','json','companion') AND b.taken_src IN ('exif','json','companion')
                  AND abs(a.epoch - b.epoch) <= 5184000 THEN 'candidate' END END AS evidence
        FROM blocked p JOIN lite a ON a.id = p.id_a JOIN lite b ON b.id = p.id_b)
    SELECT * FROM pairs WHERE evidence IS NOT NULL""",
    "wall ledger",
)
def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lite = ledger(spark, sf_dir).select(
        "id", "media_type", "format", "phash", "bytes", "epoch", "taken_src",
        parent_dir(F.col("path")).alias("dir"), normalized_stem(F.col("path")).alias("stem"),
    )
    a = lite.select(*(F.col(c).alias(f"{c}_a") for c in lite.columns))
    b = lite.select(*(F.col(c).alias(f"{c}_b") for c in lite.columns))
    met = _blocks(spark, sf_dir).join(a, "id_a").join(b, "id_b")
    raw, jpeg = media.RAW_EXTENSIONS, media.JPEG_EXTENSIONS
    one, two = F.col("format_a"), F.col("format_b")
    companion = (
        ((one.isin(*raw) & two.isin(*jpeg)) | (one.isin(*jpeg) & two.isin(*raw)))
        & (F.col("dir_a") == F.col("dir_b"))
        & (F.col("stem_a") == F.col("stem_b"))
    )
    apart = media.hamming(F.col("phash_a"), F.col("phash_b"))
    sure = ("exif", "json", "companion")
    dated = F.col("taken_src_a").isin(*sure) & F.col("taken_src_b").isin(*sure)
    images = (F.col("media_type_a") == "image") & (F.col("media_type_b") == "image")
    videos = (F.col("media_type_a") == "video") & (F.col("media_type_b") == "video")
    evidence = (
        F.when(companion, F.lit(None))
        .when(images, F.when(apart <= 6, "strong").when(apart <= 10, "candidate"))
        .when(
            videos,
            F.when((F.col("bytes_a") != 0) & (F.col("bytes_a") == F.col("bytes_b")), "strong").when(
                dated & (F.abs(F.col("epoch_a") - F.col("epoch_b")) <= 60 * 86400), "candidate"
            ),
        )
    )
    return met.select("id_a", "id_b", evidence.alias("evidence")).where("evidence is not null")


@query(
    "unique_interval_match",
    """WITH face AS (SELECT i.id, i.filename, i.size_bytes, w.epoch FROM inbound i LEFT JOIN wall w ON w.taken_at IS NOT DISTINCT FROM i.taken_at),
       lib AS (SELECT id AS asset_id, regexp_extract(path, '[^/]*$') AS filename, bytes, epoch FROM ledger WHERE status IN ('canonical', 'promoted')),
       near AS (SELECT f.id, min(l.asset_id) AS asset_id FROM face f JOIN lib l
           ON l.bytes = f.size_bytes AND abs(l.epoch - f.epoch) <= 5 GROUP BY f.id HAVING count(DISTINCT l.asset_id) = 1),
       named AS (SELECT f.id, min(l.asset_id) AS asset_id FROM face f JOIN lib l
           ON l.bytes = f.size_bytes AND l.filename = f.filename GROUP BY f.id HAVING count(DISTINCT l.asset_id) = 1)
       SELECT f.id, coalesce(n.asset_id, m.asset_id) AS asset_id FROM (SELECT DISTINCT id FROM face) f
       LEFT JOIN near n ON n.id = f.id LEFT JOIN named m ON m.id = f.id
       WHERE coalesce(n.asset_id, m.asset_id) IS NOT NULL""",
    "wall ledger inbound",
)
def unique_interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted asset of equal size within 5 s if there is one only, else the only one of that size and name."""
    faces = inbound(spark, sf_dir).select(
        "id", "filename", F.col("size_bytes").alias("size"), parsed(F.col("taken_at"), wall_only=True)["secs"].alias("at")
    )
    known = ledger(spark, sf_dir).where(F.col("status").isin("canonical", "promoted")).select(
        F.col("id").alias("asset_id"), file_name(F.col("path")).alias("filename"), F.col("bytes").alias("size"), "epoch"
    )
    return unique_match(faces, known, 5)


def unique_match(faces: DataFrame, known: DataFrame, seconds: float) -> DataFrame:
    """id, asset_id: the only known record (asset_id, filename, size, epoch) of a face's (id, filename, size, at) size and time,
    else the only one of its size and name.

    Names are counted per size before they are joined; times meet in buckets of equal size.
    """
    met = range_join(faces.select("id", "size", "at"), known.select("asset_id", "size", "epoch"), "at", "epoch", seconds, ["size"])
    near = met.groupBy("id").agg(F.count_distinct("asset_id").alias("n"), F.min("asset_id").alias("near_id")).where("n = 1")
    only = known.groupBy("size", "filename").agg(F.count_distinct("asset_id").alias("m"), F.min("asset_id").alias("named_id")).where("m = 1")
    named = faces.join(only, ["size", "filename"]).groupBy("id").agg(F.min("named_id").alias("named_id"))
    both = near.select("id", "near_id").join(named, "id", "full")
    return both.select("id", F.coalesce("near_id", "named_id").alias("asset_id"))


@query(
    "nearest_box",
    """WITH box AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, (l_partkey % 97) / 97.0::DOUBLE AS x,
           (l_suppkey % 89) / 89.0::DOUBLE AS y FROM lineitem),
       p AS (SELECT DISTINCT o_orderkey AS k, (o_custkey % 97) / 97.0::DOUBLE AS x, (o_custkey % 89) / 89.0::DOUBLE AS y FROM orders),
       d AS (SELECT b.k, b.n, sqrt((b.x - p.x) * (b.x - p.x) + (b.y - p.y) * (b.y - p.y)) AS dist FROM box b JOIN p USING (k))
       SELECT k AS order_key, n AS line_number, round(dist, 9) AS dist FROM (
           SELECT *, row_number() OVER (PARTITION BY k ORDER BY dist, n DESC) AS r FROM d WHERE dist <= 0.3) WHERE r = 1""",
)
def nearest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the boxes with the same key within a radius; a tie goes to the last one."""
    boxes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        (F.col("l_partkey") % 97 / 97.0).alias("x"),
        (F.col("l_suppkey") % 89 / 89.0).alias("y"),
    ).distinct()
    points = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        (F.col("o_custkey") % 97 / 97.0).alias("px"),
        (F.col("o_custkey") % 89 / 89.0).alias("py"),
    ).distinct()
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    met = boxes.join(points, "order_key").withColumn("dist", F.sqrt(dx * dx + dy * dy)).where("dist <= 0.3")
    order = Window.partitionBy("order_key").orderBy("dist", F.desc("line_number"))
    best = met.withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("order_key", "line_number", F.round("dist", 9).alias("dist"))


def _targets_and_fixes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = pings(spark, sf_dir)
    return points.where("id % 3 = 0").select("device_id", "id", "t"), points.where("id % 3 <> 0")


_ASOF_SQL = """f AS (SELECT * FROM pings WHERE id % 3 <> 0), g AS (SELECT * FROM pings WHERE id % 3 = 0),
    b AS (SELECT g.id, g.t, x.t AS bt, x.lat AS blat, x.lon AS blon, y.t AS nt, y.lat AS alat, y.lon AS alon
        FROM g ASOF LEFT JOIN f x ON x.device_id = g.device_id AND x.t < g.t
        ASOF LEFT JOIN f y ON y.device_id = g.device_id AND y.t >= g.t)"""


@query(
    "asof_nearest",
    f"""WITH {_ASOF_SQL}
    SELECT id, CASE WHEN bt IS NOT NULL AND (nt IS NULL OR t - bt <= nt - t) THEN bt ELSE nt END AS fix_t FROM b
    WHERE least(t - bt, nt - t) <= 300""",
    "pings",
)
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, fixes = _targets_and_fixes(spark, sf_dir)
    return nearest(bracket(targets, fixes, ["device_id"]), 300).select("id", F.col("fix.t").alias("fix_t"))


@query(
    "bracket_locate",
    f"""WITH {_ASOF_SQL},
    c AS (SELECT *, least(t - bt, nt - t) AS gap, coalesce(nt - bt <= 21600, false) AS closed,
        2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(alat - blat) / 2), 2)
          + cos(radians(blat)) * cos(radians(alat)) * pow(sin(radians(alon - blon) / 2), 2)))) AS km,
        CASE WHEN nt > bt THEN (t - bt) / (nt - bt)::DOUBLE ELSE 0 END AS share,
        (bt IS NOT NULL AND (nt IS NULL OR t - bt <= nt - t)) AS take_b FROM b)
    SELECT id, CASE WHEN gap <= 300 THEN 'high' ELSE 'medium' END AS confidence,
        round(CASE WHEN gap <= 300 OR NOT closed THEN CASE WHEN take_b THEN blat ELSE alat END
            ELSE blat + share * (alat - blat) END, 6) AS lat,
        round(CASE WHEN gap <= 300 OR NOT closed THEN CASE WHEN take_b THEN blon ELSE alon END
            ELSE blon + share * (alon - blon) END, 6) AS lon
    FROM c WHERE gap <= 300 OR (closed AND (km <= 2 OR gap <= 5400)) OR (NOT closed AND gap <= 5400)""",
    "pings",
)
def bracket_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets, fixes = _targets_and_fixes(spark, sf_dir)
    found = locate(bracket(targets, fixes, ["device_id"])).where("confidence is not null")
    return found.select("id", "confidence", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(
    "window_probe",
    """WITH m AS (SELECT DISTINCT m.cluster_id, l.epoch FROM members m JOIN ledger l ON l.id = m.asset_id WHERE epoch IS NOT NULL),
       d AS (SELECT DISTINCT id FROM dedup_cluster WHERE decision = 'auto'),
       r AS (SELECT DISTINCT id FROM dedup_cluster WHERE decision = 'review')
       SELECT a.cluster_id, min(b.cluster_id) AS near_cluster FROM m a JOIN r ON r.id = a.cluster_id
       JOIN m b ON abs(a.epoch - b.epoch) <= 30 AND a.cluster_id <> b.cluster_id JOIN d ON d.id = b.cluster_id GROUP BY 1""",
    "wall ledger members",
)
def window_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest decided cluster within 30 s of any member of a cluster under review."""
    dated = members(spark, sf_dir).join(
        ledger(spark, sf_dir).select(F.col("id").alias("asset_id"), "epoch"), "asset_id"
    ).select("cluster_id", "epoch").distinct()
    states = table(spark, sf_dir, "dedup_cluster").select(F.col("id").alias("cluster_id"), "decision").distinct()
    review = dated.join(states.where("decision = 'review'"), "cluster_id", "left_semi")
    auto = dated.join(states.where("decision = 'auto'"), "cluster_id", "left_semi").select(
        F.col("cluster_id").alias("near"), F.col("epoch").alias("other")
    )
    met = range_join(review, auto, "epoch", "other", 30).where("near <> cluster_id")
    return met.groupBy("cluster_id").agg(F.min("near").alias("near_cluster"))


@query(
    "twin_probe",
    """WITH m AS (SELECT DISTINCT m.cluster_id, l.epoch, l.phash FROM members m JOIN ledger l ON l.id = m.asset_id
           WHERE epoch IS NOT NULL AND phash IS NOT NULL)
       SELECT DISTINCT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b FROM m a JOIN m b
       ON a.cluster_id < b.cluster_id AND abs(a.epoch - b.epoch) <= 5 AND bit_count(xor(a.phash, b.phash)) <= 6""",
    "wall ledger members",
)
def twin_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).join(
        ledger(spark, sf_dir).where("phash is not null").select(F.col("id").alias("asset_id"), "epoch", "phash"), "asset_id"
    ).select("cluster_id", "epoch", "phash").distinct()
    one = rows.select(F.col("cluster_id").alias("cluster_a"), F.col("epoch").alias("at_a"), F.col("phash").alias("hash_a"))
    two = rows.select(F.col("cluster_id").alias("cluster_b"), F.col("epoch").alias("at_b"), F.col("phash").alias("hash_b"))
    met = range_join(one, two, "at_a", "at_b", 5)
    close = media.hamming(F.col("hash_a"), F.col("hash_b")) <= 6
    return met.where((F.col("cluster_a") < F.col("cluster_b")) & close).select("cluster_a", "cluster_b").distinct()


@query(
    "geo_knn",
    """WITH place AS (SELECT device_id || '/' || day AS city, avg(lat) AS lat, avg(lon) AS lon FROM (
           SELECT *, floor(t / 86400.0)::BIGINT AS day FROM pings WHERE id % 2 = 0) GROUP BY ALL),
       d AS (SELECT l.id, p.city, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - l.lat) / 2), 2)
           + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2)))) AS km
           FROM pings l JOIN place p ON l.id % 2 = 1 AND abs(p.lat - l.lat) < 0.5)
       SELECT id, city, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, city) AS r
           FROM d WHERE km <= 25) WHERE r = 1""",
    "pings",
)
def geo_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place within 25 km of each fix; places are the centres of the days of devices."""
    points = pings(spark, sf_dir)
    day = F.concat_ws("/", "device_id", F.floor(F.col("t") / 86400))
    places = points.where("id % 2 = 0").groupBy(day.alias("city")).agg(F.avg("lat").alias("plat"), F.avg("lon").alias("plon"))
    fixes = points.where("id % 2 = 1").select("id", F.col("lat").alias("gps_lat"), F.col("lon").alias("gps_lon"))
    return nearest_place(fixes, places, 25.0)


def nearest_place(points: DataFrame, places: DataFrame, most_km: float) -> DataFrame:
    """id, city, km: the nearest place of each point (id, gps_lat, gps_lon) within ``most_km``.

    Points and places meet in cells of a 3-D grid over the sphere of side 2 ``most_km``,
    so poles and the date line need no care.
    """
    side = 2.0 * most_km

    def axes(lat, lon):
        lat, lon = F.radians(lat), F.radians(lon)
        return (F.cos(lat) * F.cos(lon) * 6371.0, F.cos(lat) * F.sin(lon) * 6371.0, F.sin(lat) * 6371.0)

    home = points
    for name, value in zip("xyz", axes(F.col("gps_lat"), F.col("gps_lon"))):
        home = home.withColumn(name, F.floor(value / side))
    reach = places
    for name, value in zip("xyz", axes(F.col("plat"), F.col("plon"))):
        low, high = F.floor((value - most_km) / side), F.floor((value + most_km) / side)
        reach = reach.withColumn(name, F.explode(F.sequence(low, high)))
    km = haversine_km(F.col("gps_lat"), F.col("gps_lon"), F.col("plat"), F.col("plon"))
    met = blocked_join(home, reach, ["x", "y", "z"]).withColumn("km", km).where(F.col("km") <= most_km)
    best = met.groupBy("id").agg(F.min(F.struct("km", "city")).alias("best"))
    return best.select("id", F.col("best.city").alias("city"), F.round("best.km", 6).alias("km"))


@query(
    "phase_coverage",
    """WITH p AS (SELECT id, count(*) FILTER (WHERE k = 'embedded') AS embedded, count(*) FILTER (WHERE k = 'clustered') AS clustered
           FROM (SELECT DISTINCT asset_id AS id, 'embedded' AS k FROM asset_embedding
                 UNION ALL SELECT DISTINCT asset_id, 'clustered' FROM membership) GROUP BY id)
       SELECT CASE WHEN l.id IS NULL THEN 'stale' WHEN p.id IS NULL THEN 'untouched'
              WHEN embedded > 0 AND clustered > 0 THEN 'both' WHEN embedded > 0 THEN 'embedded' ELSE 'clustered' END AS state,
              count(*) AS n
       FROM (SELECT DISTINCT id FROM asset) l FULL OUTER JOIN p ON p.id = l.id GROUP BY 1""",
)
def phase_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger against work done: a full outer join, with stale work that has no record."""
    done = (
        table(spark, sf_dir, "asset_embedding").select(F.col("asset_id").alias("id"), F.lit("embedded").alias("k")).distinct()
        .unionByName(table(spark, sf_dir, "membership").select(F.col("asset_id").alias("id"), F.lit("clustered").alias("k")).distinct())
        .groupBy("id")
        .agg(F.count_if(F.col("k") == "embedded").alias("embedded"), F.count_if(F.col("k") == "clustered").alias("clustered"))
        .withColumn("worked", F.lit(True))
    )
    known = table(spark, sf_dir, "asset").select("id").distinct().withColumn("known", F.lit(True))
    state = (
        F.when(F.col("known").isNull(), "stale")
        .when(F.col("worked").isNull(), "untouched")
        .when((F.col("embedded") > 0) & (F.col("clustered") > 0), "both")
        .when(F.col("embedded") > 0, "embedded")
        .otherwise("clustered")
    )
    return known.join(done, "id", "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "drift",
    """WITH d AS (SELECT filename FROM inbound EXCEPT SELECT filename FROM library)
       SELECT count(*) AS drifted, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'drift' END AS state FROM d""",
    "wall ledger library inbound",
)
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = inbound(spark, sf_dir).select("filename").distinct().join(library(spark, sf_dir), "filename", "left_anti")
    return new.agg(F.count(F.lit(1)).alias("drifted")).withColumn("state", F.when(F.col("drifted") == 0, "ok").otherwise("drift"))


@query(
    "description_plan",
    """WITH loc AS (SELECT doc_id, text FROM documents WHERE source = 'caption'),
       srv AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 = 2 THEN 'AI: old' ELSE 'hand-written' END AS d
           FROM documents WHERE doc_id % 5 <> 0)
       SELECT l.doc_id, CASE WHEN l.text = s.d THEN 'skip' WHEN s.d = '' OR s.d LIKE 'AI: %' THEN 'write' ELSE 'review' END AS action
       FROM loc l JOIN srv s USING (doc_id)""",
)
def description_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    local = docs.where("source = 'caption'").select("doc_id", "text")
    turn = F.col("doc_id") % 4
    server = docs.where("doc_id % 5 <> 0").select(
        "doc_id",
        F.when(turn == 0, F.col("text")).when(turn == 1, "").when(turn == 2, "AI: old").otherwise("hand-written").alias("d"),
    )
    action = (
        F.when(F.col("text") == F.col("d"), "skip")
        .when((F.col("d") == "") | F.col("d").startswith("AI: "), "write")
        .otherwise("review")
    )
    return local.join(server, "doc_id").select("doc_id", action.alias("action"))
