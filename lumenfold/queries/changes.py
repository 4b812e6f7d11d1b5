"""Queries of rules, table changes, parsers and incremental jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, rules
from ..operators.library import ZONE_TOWNS
from ..session import Scratch, table
from ..sources.files import front_matter, telemetry_frames
from ..streaming import jobs
from .registry import ledger, query


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media table of the ledger, tags made from its columns, notes by the length of the folder's name."""
    rows = table(spark, sf_dir, "asset").select(
        "id", "path", "taken_at", "taken_src", "gps_lat", "gps_lon", "source", "exif_fields", "width", "height", "bytes", "media_type"
    ).distinct()
    key = F.col("id")
    lens = F.floor(key / 13).cast("string")
    folder = F.when(key % 13 < 2, "/in/lens").otherwise(F.regexp_replace("path", r"/[^/]*$", ""))
    rows = rows.withColumn("folder", folder)
    name = (
        F.when(key % 13 == 0, F.concat(F.lit("/in/lens/VID_20200101_000000_00_"), lens, F.lit(".insv")))
        .when(key % 13 == 1, F.concat(F.lit("/in/lens/LRV_20200101_000000_11_"), lens, F.lit(".lrv")))
        .when(key % 11 == 0, F.concat("folder", F.lit("/IMG_"), F.date_format(F.timestamp_seconds(1_500_000_000 + key), "yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .otherwise(F.col("path"))
    )
    size = F.length("folder")
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    clip, both = F.col("media_type") == "video", F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()
    entries = F.filter(
        F.array(
            entry("EXIF:DateTimeOriginal", F.when(F.col("taken_src") == "exif", F.col("taken_at"))),
            entry("Companion:DateTime", F.when(F.col("taken_src") == "json", F.col("taken_at"))),
            entry("EXIF:ModifyDate", F.when(F.col("taken_src") == "mtime", F.col("taken_at"))),
            entry("EXIF:GPSLatitude", F.when((key % 2 == 0) & both, F.col("gps_lat"))),
            entry("Composite:GPSLatitude", F.when((key % 2 == 0) & both, F.col("gps_lat"))),
            entry("Composite:GPSLongitude", F.when((key % 2 == 0) & both, F.col("gps_lon"))),
            entry("Companion:Lat", F.when((key % 10 == 3) & both, F.col("gps_lat"))),
            entry("Companion:Lon", F.when((key % 10 == 3) & both, F.col("gps_lon"))),
            entry("EXIF:Model", F.when((size % 2 == 0) & (key % 3 == 0), F.concat("source", F.lit(" B"))).otherwise(F.col("source"))),
            entry("QuickTime:CompressorID", F.when(clip, F.when(key % 2 == 0, "hvc1").otherwise("avc1"))),
            entry("QuickTime:ImageWidth", F.when(clip, F.col("width"))),
            entry("QuickTime:ImageHeight", F.when(clip, F.col("height"))),
            entry("QuickTime:VideoFrameRate", F.when(clip, 30)),
            entry("Composite:AvgBitrate", F.when(clip, F.col("bytes") * 8 / 10)),
            entry("MakerNotes:Any", F.when(F.col("exif_fields") > 40, F.lit("x"))),
        ),
        lambda e: e["value"].isNotNull(),
    )
    noted, anchored = size % 3 == 0, (key % 4 == 1) & both
    media = rows.select(
        "folder",
        name.alias("path"),
        F.map_from_entries(entries).alias("tags"),
        F.when(anchored, F.col("gps_lat")).alias("notes_lat"),
        F.when(anchored, F.col("gps_lon")).alias("notes_lon"),
        F.when(noted, F.concat("folder", F.lit("/TRIP.md"))).alias("notes_path"),
        F.when(size % 6 == 0, "Europe/Berlin").alias("notes_zone"),
        F.when(noted, F.array(F.lit("Family"), F.lit("Gear/Camera/google"))).alias("notes_tags"),
    )
    # The rules read a stored table, as they would read the tags of files.
    return Scratch(spark, "media").keep(media, "media")


_TOWNS = ", ".join(f"('{zone}', {lat}, {lon})" for zone, lat, lon in ZONE_TOWNS)
_SIX = "printf('%.6f', round(abs({v})::DECIMAL(18, 9), 6)::DOUBLE)"
_FOUR = "unnest(['GPSLatitude', 'GPSLatitudeRef', 'GPSLongitude', 'GPSLongitudeRef'])"


def _four(lat: str, lon: str) -> str:
    return (
        f"{_FOUR}, unnest([{_SIX.format(v=lat)}, CASE WHEN {lat} >= 0 THEN 'N' ELSE 'S' END, {_SIX.format(v=lon)}, CASE WHEN {lon} >= 0 THEN 'E' ELSE 'W' END])"
    )


def _apart(a: str, b: str) -> str:
    return f"""2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2)
        + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"""


_FINDINGS_SQL = f"""raw AS (SELECT DISTINCT id, path, taken_at, taken_src, gps_lat, gps_lon, source, exif_fields, width, height, bytes, media_type FROM asset),
    src AS (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN '/in/lens/VID_20200101_000000_00_' || (id // 13) || '.insv' WHEN id % 13 = 1 THEN '/in/lens/LRV_20200101_000000_11_' || (id // 13) || '.lrv'
          WHEN id % 11 = 0 THEN folder || '/IMG_' || strftime(make_timestamp((1500000000 + id) * 1000000), '%Y%m%d_%H%M%S') || '.jpg' ELSE path END AS path),
          CASE WHEN length(folder) % 2 = 0 AND id % 3 = 0 THEN source || ' B' ELSE source END AS model, length(folder) AS size,
          gps_lat IS NOT NULL AND gps_lon IS NOT NULL AS located
        FROM (SELECT *, CASE WHEN id % 13 < 2 THEN '/in/lens' ELSE regexp_replace(path, '/[^/]*$', '') END AS folder FROM raw)),
    h AS (SELECT *, left(replace(trim(taken_at), '/', ':'), 19) AS t, regexp_extract(path, '[^/]*$') AS f FROM src),
    d AS (SELECT *, CASE WHEN taken_src = 'exif' THEN coalesce(CASE WHEN regexp_matches(t, '^[0-9]{{4}}:[0-9]{{2}}:[0-9]{{2}} ') THEN try_strptime(t, '%Y:%m:%d %H:%M:%S') END,
        CASE WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T') THEN try_strptime(t, '%Y-%m-%dT%H:%M:%S') END) END AS e,
        id % 2 = 0 AND located AS placed, coalesce(nullif(trim(model), ''), CASE WHEN starts_with(f, 'DJI_') THEN 'DJI' WHEN starts_with(f, 'GOPR') OR starts_with(f, 'GX01') OR starts_with(f, 'GH01') THEN 'GoPro' END) AS cam,
        CASE WHEN size % 3 = 0 THEN folder || '/TRIP.md' END AS notes FROM h),
    n AS (SELECT *, coalesce(year(e) >= 1970, false) AS dated, epoch(e)::BIGINT AS s FROM d),
    good AS (SELECT folder, s AS t, min(struct_pack(lat := gps_lat, lon := gps_lon)) AS g FROM n WHERE placed AND (abs(gps_lat) >= 1e-3 OR abs(gps_lon) >= 1e-3) AND s IS NOT NULL
        AND folder IN (SELECT folder FROM n WHERE placed AND (abs(gps_lat) >= 1e-3 OR abs(gps_lon) >= 1e-3) AND s IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) GROUP BY folder, s),
    want AS (SELECT folder, path, s AS t FROM n WHERE s IS NOT NULL AND NOT (placed AND (abs(gps_lat) >= 1e-3 OR abs(gps_lon) >= 1e-3))),
    near AS (SELECT w.path, w.t, x.t AS bt, x.g.lat AS blat, x.g.lon AS blon, y.t AS nt, y.g.lat AS alat, y.g.lon AS alon FROM want w
        ASOF LEFT JOIN good x ON x.folder = w.folder AND x.t < w.t ASOF LEFT JOIN good y ON y.folder = w.folder AND y.t >= w.t),
    gaps AS (SELECT *, least(t - bt, nt - t) AS gap, coalesce(nt - bt <= 21600, false) AS closed, {_apart("b", "a")} AS km,
        CASE WHEN nt > bt THEN (t - bt) / (nt - bt)::DOUBLE ELSE 0 END AS share, (bt IS NOT NULL AND (nt IS NULL OR t - bt <= nt - t)) AS take_b FROM near),
    found AS (SELECT path, CASE WHEN gap <= 300 THEN 'high' ELSE 'medium' END AS tier,
        CASE WHEN gap <= 300 OR NOT closed THEN CASE WHEN take_b THEN blat ELSE alat END ELSE blat + share * (alat - blat) END AS lat,
        CASE WHEN gap <= 300 OR NOT closed THEN CASE WHEN take_b THEN blon ELSE alon END ELSE blon + share * (alon - blon) END AS lon
        FROM gaps WHERE gap <= 300 OR (closed AND (km <= 2 OR gap <= 5400)) OR (NOT closed AND gap <= 5400)),
    town AS (SELECT * FROM (VALUES {_TOWNS}) v(zone, lat, lon)),
    stated AS (SELECT notes, min(struct_pack(lat := gps_lat, lon := gps_lon)) AS g FROM n WHERE notes IS NOT NULL AND size % 6 <> 0 AND id % 4 = 1 AND located GROUP BY 1),
    points AS (SELECT notes, g.lat AS lat, g.lon AS lon, true AS firm, 0 AS id FROM stated
        UNION ALL SELECT notes, gps_lat, gps_lon, false, id FROM n WHERE notes IS NOT NULL AND size % 6 <> 0 AND NOT (id % 4 = 1 AND located) AND placed AND NOT (gps_lat = 0 AND gps_lon = 0)
            AND notes NOT IN (SELECT notes FROM stated)),
    zoned AS (SELECT p.notes, p.firm, p.id, arg_min(t.zone, ({_apart("p.", "t.")}, t.zone)) AS zone FROM points p CROSS JOIN town t GROUP BY p.notes, p.firm, p.id, p.lat, p.lon),
    votes AS (SELECT notes, zone, count(*) AS k, row_number() OVER (PARTITION BY notes ORDER BY count(*) DESC, zone) AS r FROM zoned GROUP BY notes, zone),
    drift AS (SELECT folder, model, median(s) AS m, count(*) AS k, count(*) FILTER (placed) AS fixes, min(path) AS seen FROM n WHERE s IS NOT NULL AND model IS NOT NULL GROUP BY folder, model HAVING count(*) >= 3),
    ref AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY fixes DESC, k DESC, seen) AS r, count(*) OVER (PARTITION BY folder) AS cameras FROM drift),
    f AS (
        SELECT 'gps-from-companion' AS rule, 0 AS ordinal, 'high' AS tier, path, {_four("gps_lat", "gps_lon").replace(", unnest([", " AS field, unnest([", 1)} AS value
            FROM n WHERE NOT placed AND id % 10 = 3 AND located AND NOT (gps_lat = 0 AND gps_lon = 0)
        UNION ALL SELECT 'date-from-companion', 1, 'high', path, 'DateTimeOriginal', taken_at FROM n WHERE NOT dated AND taken_src = 'json' AND taken_at IS NOT NULL
        UNION ALL SELECT 'date-from-name', 2, 'high', path, 'DateTimeOriginal', CASE WHEN id % 13 < 2 THEN '2020:01:01 00:00:00' ELSE strftime(make_timestamp((1500000000 + id) * 1000000), '%Y:%m:%d %H:%M:%S') END
            FROM n WHERE NOT dated AND (id % 13 = 0 OR (id % 13 > 1 AND id % 11 = 0))
        UNION ALL SELECT 'lens-pair', 3, 'high', a.path, 'Pair', b.path FROM n a JOIN n b ON a.id // 13 = b.id // 13 AND a.id <> b.id AND a.id % 13 < 2 AND b.id % 13 < 2
        UNION ALL SELECT 'gps-from-siblings', 5, tier, path, {_four("lat", "lon")} FROM found
        UNION ALL SELECT 'gps-anchor', 6, 'high', path, {_four("gps_lat", "gps_lon")} FROM n WHERE NOT placed AND id % 4 = 1 AND located
        UNION ALL SELECT 'tags-from-notes', 7, 'high', path, unnest(['HierarchicalSubject', 'Subject']),
            unnest(CASE WHEN cam IS NULL THEN ['Family', 'Family'] WHEN contains(cam, 'google') OR contains('google', cam) THEN ['Family|Gear/Camera/google', 'Family|google']
                ELSE ['Family|Gear/Camera/' || cam, array_to_string(list_sort(['Family', regexp_extract(cam, '[^/]*$')]), '|')] END) FROM n WHERE notes IS NOT NULL
        UNION ALL SELECT 'zone-guess', 8, 'high', a.notes, 'timezone', a.zone FROM votes a LEFT JOIN votes b ON b.notes = a.notes AND b.r = 2 WHERE a.r = 1 AND (b.k IS NULL OR a.k >= 2 * b.k)
        UNION ALL SELECT 'zone-suffix', 9, 'high', path, 'DateTimeOriginal', strftime(e, '%Y:%m:%d %H:%M:%S') || CASE WHEN s - epoch(timezone('Europe/Berlin', e))::BIGINT = 7200 THEN '+02:00' ELSE '+01:00' END
            FROM n WHERE e IS NOT NULL AND size % 6 = 0 AND NOT regexp_matches(trim(taken_at), '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$')
        UNION ALL SELECT 'clock-drift', 10, 'medium', path, 'DateTimeOriginal', strftime(make_timestamp(floor(m)::BIGINT * 1000000), '%Y:%m:%d %H:%M:%S') FROM (
            SELECT *, median(s) OVER (PARTITION BY folder) AS m, count(*) OVER (PARTITION BY folder) AS k, min(model) OVER (PARTITION BY folder) AS a, max(model) OVER (PARTITION BY folder) AS b FROM n WHERE e IS NOT NULL)
            WHERE k >= 3 AND a = b AND abs(s - m) >= 86400
        UNION ALL SELECT 'camera-drift', 11, 'medium', n.path, 'DateTimeOriginal', strftime(make_timestamp(floor(n.s + r.m - c.m)::BIGINT * 1000000), '%Y:%m:%d %H:%M:%S')
            FROM ref c JOIN ref r ON r.folder = c.folder AND r.r = 1 AND c.r > 1 JOIN n ON n.folder = c.folder AND n.model = c.model AND n.s IS NOT NULL WHERE abs(r.m - c.m) BETWEEN 300 AND 1209600
        UNION ALL SELECT 'tags-missing', 12, 'medium', notes, 'add_tags', array_to_string(list_concat(['Events/' || regexp_extract(folder, '[^/]*$')], coalesce(list_sort(list(DISTINCT 'Source/' || p) FILTER (p <> '')), [])), '|')
            FROM (SELECT notes, folder, upper(regexp_extract(f, '^([A-Za-z]{{1,6}})', 1)) AS p FROM n WHERE notes IS NOT NULL) GROUP BY notes, folder
        UNION ALL SELECT 'export-date-trap', 13, 'low', path, 'Note', 'only a modification date' FROM n WHERE NOT dated AND taken_src = 'mtime' AND taken_at IS NOT NULL
        UNION ALL SELECT 'bloat-candidate', 14, 'low', path, 'Bloat', CASE WHEN q >= 2 * lim THEN 'obscene' ELSE 'fat' END FROM (
            SELECT *, (bytes * 8 / 10.0::DOUBLE) / (width::DOUBLE * height * 30) AS q, CASE WHEN id % 2 = 0 THEN 0.08 ELSE 0.15 END AS lim FROM n WHERE media_type = 'video' AND width > 0 AND height > 0)
            WHERE q >= lim AND NOT regexp_matches(lower(folder), 'raw|source|edit|project|insta360') AND NOT regexp_matches(lower(path), '[.](insv|insp|lrv|lrf|mts|dng|braw)$')
            AND NOT regexp_matches(upper(f), '^(DJI_|GX|GH|GOPR|MAH|MVI_|C0|LRV_|PRO_|DSC_|(VID|IMG)_[0-9]{{8}})')
        UNION ALL SELECT 'makernote-present', 15, 'low', path, 'MakerNote', 'present' FROM n WHERE exif_fields > 40)"""


@query("rule_findings", f"WITH {_FINDINGS_SQL} SELECT rule, tier, path, field, value FROM f")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(_media(spark, sf_dir)).select("rule", "tier", "path", "field", "value")


@query(
    "rule_resolution",
    f"""WITH {_FINDINGS_SQL} SELECT rule, tier, path, field, value FROM (SELECT *, row_number() OVER (PARTITION BY path, field
        ORDER BY CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, ordinal, value) AS k FROM f) WHERE k = 1""",
)
def rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resolve(rules.evaluate(_media(spark, sf_dir))).select("rule", "tier", "path", "field", "value")


@query(
    "rule_counts",
    f"WITH {_FINDINGS_SQL} SELECT rule, tier, count(*) AS n FROM f GROUP BY ALL",
)
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(_media(spark, sf_dir)).groupBy("rule", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_pending",
    f"""WITH {_FINDINGS_SQL}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, field
        ORDER BY CASE tier WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, ordinal, value) AS k FROM f) WHERE k = 1)
        SELECT path, rule, field, value, tier FROM r WHERE tier IN ('high', 'medium') AND NOT (rule = 'gps-anchor' AND field LIKE '%Ref')""",
)
def ledger_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.resolve(rules.evaluate(_media(spark, sf_dir)))
    done = found.where("rule = 'gps-anchor' and field like '%Ref'").select("path", "rule", "field", "value")
    return rules.pending(found, done).select("path", "rule", "field", "value", "tier")


@query("rules_fixpoint")
def rules_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields written per rule when high findings are applied until none is left (a driver loop)."""
    _, written = rules.apply_to_fixpoint(_media(spark, sf_dir))
    return written.groupBy("rule", "field").agg(F.count(F.lit(1)).alias("n"))


@query(
    "inserted_rows",
    """WITH n AS (SELECT path, min(bytes) AS bytes FROM (SELECT DISTINCT path, bytes FROM asset_inbox) GROUP BY 1)
       SELECT path, bytes, false AS inserted FROM (SELECT DISTINCT path, bytes FROM asset) UNION ALL
       SELECT path, bytes, true FROM n WHERE path NOT IN (SELECT path FROM asset WHERE path IS NOT NULL)""",
)
def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "asset").select("path", "bytes").distinct()
    return merge.insert_absent(known, table(spark, sf_dir, "asset_inbox").select("path", "bytes"), ["path"])


@query(
    "upserted_clusters",
    """WITH c AS (SELECT cluster_id AS id, max(role) AS decision FROM membership WHERE cluster_id % 3 = 0 GROUP BY 1)
       SELECT id, decision FROM (SELECT DISTINCT id, decision FROM dedup_cluster) WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, decision FROM c""",
)
def upserted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "dedup_cluster").select("id", "decision").distinct()
    changes = table(spark, sf_dir, "membership").where("cluster_id % 3 = 0").select(
        F.col("cluster_id").alias("id"), F.col("role").alias("decision"), F.col("role").alias("at")
    )
    return merge.upsert(target, changes, ["id"], ["at"])


@query(
    "guarded_dates",
    """WITH c AS (SELECT asset_id AS id, min(trim(local_date_time)) AS new_value FROM date_candidate WHERE local_date_time IS NOT NULL GROUP BY 1)
       SELECT a.id, CASE WHEN a.taken_at IS NULL AND c.new_value IS NOT NULL THEN c.new_value ELSE a.taken_at END AS taken_at,
           (a.taken_at IS NULL AND c.new_value IS NOT NULL) AS written, CASE WHEN a.taken_at IS NULL AND c.new_value IS NOT NULL THEN 'taken_at' ELSE '' END AS locks
       FROM (SELECT DISTINCT id, taken_at FROM asset) a LEFT JOIN c ON c.id = a.id""",
)
def guarded_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "asset").select("id", "taken_at").distinct().withColumn("locks", F.array().cast("array<string>"))
    changes = table(spark, sf_dir, "date_candidate").where("local_date_time is not null").groupBy(F.col("asset_id").alias("id")).agg(
        F.min(F.trim("local_date_time")).alias("new_value")
    )
    out = merge.guarded_update(target, changes, "id", "taken_at", F.col("taken_at").isNull(), "locks")
    return out.select("id", "taken_at", "written", F.array_join("locks", ",").alias("locks"))


@query(
    "replaced_roles",
    """WITH n AS (SELECT DISTINCT winner_asset_id AS asset_id, id AS cluster_id, 'winner' AS role FROM dedup_cluster WHERE decision = 'auto' AND winner_asset_id IS NOT NULL)
       SELECT m.cluster_id, m.asset_id, m.role FROM (SELECT DISTINCT cluster_id, asset_id, role FROM membership) m
       WHERE NOT (m.role = 'winner' AND EXISTS (SELECT 1 FROM n WHERE n.cluster_id = m.cluster_id)) UNION ALL SELECT cluster_id, asset_id, role FROM n""",
)
def replaced_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "membership").select("cluster_id", "asset_id", "role").distinct()
    new = table(spark, sf_dir, "dedup_cluster").where("decision = 'auto' and winner_asset_id is not null").select(
        F.col("id").alias("cluster_id"), F.col("winner_asset_id").alias("asset_id"), F.lit("winner").alias("role")
    ).distinct()
    return merge.replace_where(target, new, ["cluster_id"], F.col("role") == "winner")


@query(
    "lock_arrays",
    """SELECT DISTINCT id, CASE WHEN id % 2 = 0 THEN 'gps_lat,gps_lon' ELSE 'taken_at,gps_lat,gps_lon' END AS locked, CASE WHEN id % 2 = 0 THEN '' ELSE 'taken_at' END AS unlocked FROM asset""",
)
def lock_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id").distinct()
    base = F.when(F.col("id") % 2 == 1, F.array(F.lit("taken_at"), F.lit("gps_lat")))
    locked = merge.add_locks(base, "gps_lat", "gps_lon")
    return rows.select(
        "id", F.array_join(locked, ",").alias("locked"), F.array_join(merge.drop_locks(locked, "gps_lat", "gps_lon"), ",").alias("unlocked")
    )


@query(
    "album_sync",
    """WITH w AS (SELECT cluster_id, count(DISTINCT asset_id) AS n FROM membership GROUP BY 1), p AS (SELECT DISTINCT id AS cluster_id, CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n FROM dedup_cluster WHERE id % 5 <> 0)
       SELECT coalesce(w.cluster_id, p.cluster_id) AS cluster_id, CASE WHEN p.cluster_id IS NULL THEN 'create' WHEN w.cluster_id IS NULL THEN 'delete' WHEN w.n IS DISTINCT FROM p.n THEN 'update' ELSE 'skip' END AS action
       FROM w FULL OUTER JOIN p ON p.cluster_id = w.cluster_id""",
)
def album_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "membership").groupBy("cluster_id").agg(F.count_distinct("asset_id").alias("n"))
    present = table(spark, sf_dir, "dedup_cluster").where("id % 5 <> 0").select(
        F.col("id").alias("cluster_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).cast("bigint").alias("n")
    ).distinct()
    return merge.sync_plan(wanted, present, "cluster_id", "n")


@query(
    "camera_locate_status",
    """SELECT l.id, CASE WHEN s.clip_id IS NULL THEN 'no-track' WHEN NOT s.ok THEN 'no-fix' WHEN l.fix THEN CASE WHEN km > 2 THEN 'skip-mismatch' ELSE 'would-relock' END ELSE 'would-tag' END AS status
       FROM ledger l LEFT JOIN (SELECT clip_id, ok, lat, lon FROM (SELECT DISTINCT clip_id, (latitude IS NOT NULL AND longitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)) AS ok, latitude AS lat, longitude AS lon,
           row_number() OVER (PARTITION BY clip_id ORDER BY datetime_original, latitude) AS k FROM srt_telemetry) WHERE k = 1) s ON s.clip_id = l.id,
       LATERAL (SELECT 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - l.gps_lat) / 2), 2) + cos(radians(l.gps_lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - l.gps_lon) / 2), 2)))) AS km) x
       WHERE l.media_type = 'video'""",
    "wall ledger",
)
def camera_locate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of locating each clip from its track: ordered reasons, distance checked."""
    from ..functions.geo import haversine_km

    clips = table(spark, sf_dir, "srt_telemetry").groupBy(F.col("clip_id").alias("id")).agg(
        F.min(F.struct("datetime_original", "latitude", "longitude")).alias("s")
    )
    rows = ledger(spark, sf_dir).where("media_type = 'video'").join(clips, "id", "left")
    lat, lon = F.col("s.latitude"), F.col("s.longitude")
    fix = lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
    km = haversine_km(F.col("gps_lat"), F.col("gps_lon"), lat, lon)
    status = (
        F.when(F.col("s").isNull(), "no-track")
        .when(~fix, "no-fix")
        .when(F.col("fix"), F.when(km > 2, "skip-mismatch").otherwise("would-relock"))
        .otherwise("would-tag")
    )
    return rows.select("id", status.alias("status"))


@query(
    "registered_files",
    """SELECT path, bytes, mtime, false AS inserted FROM (SELECT DISTINCT path, bytes, mtime FROM asset WHERE id % 2 = 0) UNION ALL
       SELECT path, min(bytes), min(mtime), true FROM asset WHERE id % 2 = 1 AND mtime <= 1600000000 - 3600 AND path NOT IN (SELECT path FROM asset WHERE id % 2 = 0 AND path IS NOT NULL) GROUP BY path""",
)
def registered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental registration: settled files that the ledger lacks."""
    rows = table(spark, sf_dir, "asset").select("id", "path", "bytes", "mtime").distinct()
    return jobs.register(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 1_600_000_000)


@query(
    "work_due",
    """SELECT DISTINCT id AS key FROM asset WHERE id NOT IN (SELECT asset_id FROM asset_embedding WHERE model LIKE 'clip-b32-%' AND model NOT LIKE '%-legacy')""",
)
def work_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "asset_embedding").select(
        F.col("asset_id").alias("key"), F.lit("embed").alias("worker"),
        F.when(F.col("model").startswith("clip-b32-") & ~F.col("model").endswith("-legacy"), "current").otherwise("old").alias("version"),
    )
    return jobs.work_due(table(spark, sf_dir, "asset").select(F.col("id").alias("key")).distinct(), state, "embed", "current")


@query(
    "replayed",
    """SELECT doc_id AS key, md5(text) AS digest FROM documents""",
)
def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay converges: after it the target holds the content of every entry."""
    entries = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).alias("synced_hash"),
    )
    target = entries.where("key % 2 = 0 or key % 3 = 0").select(
        "key", F.when(F.col("key") % 2 == 0, F.col("content")).otherwise("stale").alias("content")
    )
    after, written = jobs.replay(entries, target)
    _, again = jobs.replay(after, written)
    return again.select("key", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(
    "window_counts",
    """SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
)
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = jobs.window_counts(rows)
    return found.select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "telemetry_cues",
    """WITH d AS (SELECT doc_id, regexp_split_to_array(trim(replace(text, chr(13) || chr(10), chr(10)), chr(10) || ' '), '\\n\\s*\\n') AS b FROM documents WHERE contains(text, '-->'))
       SELECT doc_id, len(list_filter(b, lambda x: trim(x) <> ''))::BIGINT AS frames FROM d""",
)
def telemetry_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where(F.col("text").contains("-->"))
    frames = telemetry_frames(texts, "doc_id", "text")
    return frames.groupBy("doc_id").agg(F.max("frame").cast("bigint").alias("frames"))


@query("note_fields")
def note_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of the trip notes: one row per field (no SQL: nested line rules)."""
    return front_matter(table(spark, sf_dir, "documents"), "doc_id", "text")
