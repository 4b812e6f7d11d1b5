"""Queries of the remaining catalog operators: scans, gates, plans and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog, media, text
from ..operators.asof import bracket, nearest
from ..session import Scratch, table
from .registry import ledger, members, pings, query


@query("pending_fingerprints", "SELECT DISTINCT id, path FROM asset WHERE status = 'registered' AND source = 'icloud' ORDER BY id LIMIT 50")
def pending_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next work items of a source in order of id: the limit is the feature."""
    due = table(spark, sf_dir, "asset").where("status = 'registered' and source = 'icloud'")
    return due.select("id", "path").distinct().orderBy("id").limit(50)


@query("clusterable", "SELECT DISTINCT id, phash::VARCHAR AS phash FROM asset WHERE status IN ('fingerprinted', 'clustered', 'canonical')")
def clusterable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "asset").where("status in ('fingerprinted', 'clustered', 'canonical')").select("id", F.col("phash").cast("string")).distinct()


@query(
    "cluster_members",
    """SELECT m.cluster_id, array_to_string(list(a.id ORDER BY a.id), ',') AS ids, count(*) AS n FROM members m
       JOIN (SELECT DISTINCT id FROM asset) a ON a.id = m.asset_id JOIN (SELECT DISTINCT id FROM dedup_cluster WHERE decision = 'review') c ON c.id = m.cluster_id
       GROUP BY 1 HAVING count(*) >= 2""",
    "members",
)
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters under review with their members, in one query."""
    review = table(spark, sf_dir, "dedup_cluster").where("decision = 'review'").select(F.col("id").alias("cluster_id")).distinct()
    known = table(spark, sf_dir, "asset").select(F.col("id").alias("asset_id")).distinct()
    grouped = members(spark, sf_dir).join(review, "cluster_id").join(known, "asset_id").groupBy("cluster_id").agg(
        F.array_join(F.sort_array(F.collect_list("asset_id")), ",").alias("ids"), F.count(F.lit(1)).alias("n")
    )
    return grouped.where("n >= 2")


@query(
    "decided_files",
    """SELECT m.cluster_id, l.id, l.path FROM members m JOIN (SELECT DISTINCT id, path, status FROM asset) l ON l.id = m.asset_id
       JOIN (SELECT DISTINCT id, decision FROM dedup_cluster) c ON c.id = m.cluster_id WHERE l.status = 'decided' AND c.decision = 'auto'""",
    "members",
)
def decided_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = table(spark, sf_dir, "dedup_cluster").where("decision = 'auto'").select(F.col("id").alias("cluster_id")).distinct()
    files = table(spark, sf_dir, "asset").where("status = 'decided'").select(F.col("id").alias("asset_id"), "path").distinct()
    return members(spark, sf_dir).join(auto, "cluster_id").join(files, "asset_id").select("cluster_id", F.col("asset_id").alias("id"), "path")


@query(
    "path_prefixes",
    """SELECT regexp_extract(path, '^/[^/]*/[^/]*', 0) AS root, count(*) AS n, count(*) FILTER (status = 'quarantined') AS trashed,
           count(*) FILTER (starts_with(path, '/library/originals/2015')) AS of_2015 FROM (SELECT DISTINCT id, path, status FROM asset) GROUP BY 1""",
)
def path_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "path", "status").distinct()
    return rows.groupBy(F.regexp_extract("path", r"^/[^/]*/[^/]*", 0).alias("root")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "quarantined").alias("trashed"),
        F.count_if(F.col("path").startswith("/library/originals/2015")).alias("of_2015"),
    )


@query(
    "file_roles",
    """WITH e AS (SELECT id, lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS x FROM (SELECT DISTINCT id, path FROM asset))
       SELECT id, CASE WHEN x IN ('dng','cr2','cr3','arw','nef','raf','rw2','orf') THEN 'raw' WHEN x IN ('jpg','jpeg','heic','heif') THEN 'preview'
           WHEN x IN ('lrf','lrv') THEN 'proxy' WHEN x IN ('mp4','mov','m4v','insv') THEN 'master' ELSE 'other' END AS role FROM e""",
)
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "asset").select("id", "path").distinct().select("id", catalog.file_role(F.col("path")).alias("role"))


_LENS = """lens AS (SELECT e.event_id, e.user_id, 'VID_' || strftime(ts, '%Y%m%d') || '_' || lpad((user_id % 40)::VARCHAR, 6, '0') || CASE WHEN event_id % 2 = 0 THEN '_00_' ELSE '_10_' END || lpad((event_id // 2 % 50)::VARCHAR, 3, '0') AS stem,
    CASE WHEN event_id % 3 = 0 THEN 'lrv' ELSE 'insv' END AS ext FROM events e)"""


@query(
    "lens_pairs",
    f"""WITH {_LENS}, k AS (SELECT regexp_replace(stem, '_(00|10)_([0-9]+)$', '_\\2') AS key, ext, max(stem || '.' || ext) AS path FROM lens GROUP BY ALL)
       SELECT a.path AS master, b.path AS proxy FROM k a JOIN k b ON a.key = b.key AND a.ext = 'insv' AND b.ext = 'lrv'
       UNION ALL SELECT b.path, a.path FROM k a JOIN k b ON a.key = b.key AND a.ext = 'insv' AND b.ext = 'lrv'""",
)
def lens_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """360-degree masters and proxies paired by time and serial number, in both directions."""
    rows = _lens_files(spark, sf_dir)
    keyed = rows.groupBy(catalog.twin_key(F.col("path")).alias("key")).agg(
        F.max(F.when(F.col("path").endswith(".insv"), F.col("path"))).alias("master"),
        F.max(F.when(F.col("path").endswith(".lrv"), F.col("path"))).alias("proxy"),
    ).where("master is not null and proxy is not null")
    return keyed.select("master", "proxy").unionByName(keyed.select(F.col("proxy").alias("master"), F.col("master").alias("proxy")))


def _lens_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = F.when(F.col("event_id") % 2 == 0, "_00_").otherwise("_10_")
    name = F.concat(
        F.lit("VID_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"), F.lpad((F.col("user_id") % 40).cast("string"), 6, "0"), lens,
        F.lpad((F.floor(F.col("event_id") / 2) % 50).cast("string"), 3, "0"), F.when(F.col("event_id") % 3 == 0, ".lrv").otherwise(".insv"),
    )
    return table(spark, sf_dir, "events").select("event_id", name.alias("path"))


@query(
    "lens_twins",
    f"""WITH {_LENS} SELECT regexp_replace(stem, '_(00|10)_([0-9]+)$', '_\\2') AS key, min(stem) AS keep, count(DISTINCT stem) AS stems FROM lens GROUP BY 1 HAVING count(DISTINCT stem) > 1""",
)
def lens_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twin files of two lenses: the one of the first lens is kept."""
    stem = text.file_stem(F.col("path"))
    return _lens_files(spark, sf_dir).groupBy(catalog.twin_key(F.col("path")).alias("key")).agg(
        F.min(stem).alias("keep"), F.count_distinct(stem).alias("stems")
    ).where("stems > 1")


@query(
    "merge_targets",
    """WITH p AS (SELECT DISTINCT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey // 7 * 7 WHEN c_custkey % 49 <> 0 THEN c_custkey // 49 * 49 ELSE NULL END AS up FROM customer),
       r AS (SELECT id, id AS cur, 0 AS hops FROM p UNION ALL SELECT r.id, p.up, r.hops + 1 FROM r JOIN p ON p.id = r.cur WHERE p.up IS NOT NULL AND r.hops < 10)
       SELECT id, arg_max(cur, hops) AS target FROM r GROUP BY 1""",
    recursive=True,
)
def merge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that each merged record ends up in, at most ten hops away, by pointer doubling."""
    key = F.col("c_custkey")
    up = F.when(key % 7 != 0, F.floor(key / 7) * 7).when(key % 49 != 0, F.floor(key / 49) * 49)
    pointers = table(spark, sf_dir, "customer").select(key.alias("id"), up.alias("up")).distinct()
    pointers = pointers.withColumn("up", F.coalesce("up", "id"))
    return chase(pointers)


def chase(pointers: DataFrame, most_hops: int = 10) -> DataFrame:
    """id, target of pointers (id, up; up = id ends). A pointer to nowhere is followed one step.

    Cycles end at the hop limit, which is met by doubling: four joins for ten hops
    would reach sixteen, so the steps are composed bit by bit.
    """
    scratch = Scratch(pointers.sparkSession, "pointers")
    power = pointers.select("id", "up")
    out = pointers.select("id", F.col("id").alias("at"))
    left = most_hops
    while left:
        if left & 1:
            step = power.select(F.col("id").alias("at"), F.col("up").alias("__to"))
            out = out.join(step, "at", "left").select("id", F.coalesce("__to", "at").alias("at"))
        left >>= 1
        if left:
            following = power.select(F.col("id").alias("up"), F.col("up").alias("__far"))
            power = scratch.keep(power.join(following, "up", "left").select("id", F.coalesce("__far", "up").alias("up")), "power")
    return out.select("id", F.col("at").alias("target"))


@query(
    "clock_offsets",
    """WITH r AS (SELECT device_id, t FROM pings WHERE id % 2 = 0), x AS (SELECT device_id, t + 37 AS t FROM pings WHERE id % 2 = 1),
       b AS (SELECT x.device_id, x.t, p.t AS bt, q.t AS nt FROM x ASOF LEFT JOIN r p ON p.device_id = x.device_id AND p.t < x.t ASOF LEFT JOIN r q ON q.device_id = x.device_id AND q.t >= x.t),
       d AS (SELECT device_id, CASE WHEN bt IS NOT NULL AND (nt IS NULL OR t - bt <= nt - t) THEN bt ELSE nt END - t AS off FROM b),
       k AS (SELECT device_id, off, row_number() OVER (PARTITION BY device_id ORDER BY off) - 1 AS i, count(*) OVER (PARTITION BY device_id) AS n FROM d WHERE off IS NOT NULL AND abs(off) < 172800)
       SELECT device_id, max(CASE WHEN i = n // 2 THEN off END)::BIGINT AS offset_s FROM k GROUP BY 1""",
    "pings",
)
def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the offsets of a clock to the nearest reference shot within two days."""
    rows = pings(spark, sf_dir)
    fixes = rows.where("id % 2 = 0")
    targets = rows.where("id % 2 = 1").withColumn("t", F.col("t") + 37).select("device_id", "id", "t")
    off = nearest(bracket(targets, fixes, ["device_id"]), 172_799).select("device_id", (F.col("fix.t") - F.col("t")).alias("off"))
    inside = Window.partitionBy("device_id")
    placed = off.withColumns({"i": F.row_number().over(inside.orderBy("off")) - 1, "n": F.count(F.lit(1)).over(inside)})
    return placed.groupBy("device_id").agg(F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("off"))).alias("offset_s"))


@query(
    "gear_tag_lists",
    """WITH s AS (SELECT s_suppkey, n_name || CASE WHEN s_suppkey % 2 = 0 THEN ' Pro' ELSE '' END AS cam FROM supplier JOIN nation ON n_nationkey = s_nationkey)
       SELECT s_suppkey AS id, CASE WHEN contains('CHINA Pro', cam) OR contains(cam, 'CHINA Pro') THEN 'Family|Gear/Camera/CHINA Pro' ELSE 'Family|Gear/Camera/' || cam END AS tags FROM s""",
)
def gear_tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    camera = F.concat("n_name", F.when(F.col("s_suppkey") % 2 == 0, " Pro").otherwise(""))
    tags = F.array(F.lit("Family"), F.lit("Gear/Camera/CHINA Pro"), F.lit(" "), F.lit(None).cast("string"))
    return rows.select(F.col("s_suppkey").alias("id"), F.array_join(catalog.gear_tags(tags, camera), "|").alias("tags"))


@query(
    "camera_names",
    """SELECT id, CASE WHEN id % 3 = 0 THEN source || ' X' WHEN starts_with(f, 'DJI_') THEN 'DJI' WHEN starts_with(f, 'GOPR') OR starts_with(f, 'GX01') OR starts_with(f, 'GH01') THEN 'GoPro' END AS camera
       FROM (SELECT DISTINCT id, source, regexp_extract(path, '[^/]*$') AS f FROM asset)""",
)
def camera_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "source", "path").distinct()
    make = F.when(F.col("id") % 3 == 0, F.col("source"))
    model = F.when(F.col("id") % 3 == 0, "X")
    return rows.select("id", catalog.file_camera(make, model, F.col("path")).alias("camera"))


@query(
    "caption_gates",
    """WITH a AS (SELECT DISTINCT id, path, regexp_extract(path, '[^/]*$') AS f, lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS x,
           CASE id % 6 WHEN 0 THEN 'AI: a boat' WHEN 1 THEN 'our boat' WHEN 2 THEN 'default' WHEN 3 THEN regexp_extract(path, '[^/]*$') WHEN 4 THEN ' ' END AS d FROM asset),
       r AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'already done' WHEN trim(coalesce(d, '')) <> '' AND NOT starts_with(d, 'AI: ') AND d <> 'default' AND d <> f THEN 'user text'
           WHEN x IN ('mp4','mov','m4v','avi','mkv','mts','m2ts','insv','lrv') AND id % 2 = 1 THEN 'no preview' END AS reason FROM a)
       SELECT CASE WHEN reason IS NULL THEN 'caption' ELSE 'skip' END AS action, reason, count(*) AS n FROM r GROUP BY ALL""",
)
def caption_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "path").distinct()
    turn = F.col("id") % 6
    described = (
        F.when(turn == 0, "AI: a boat").when(turn == 1, "our boat").when(turn == 2, "default").when(turn == 3, text.file_name(F.col("path"))).when(turn == 4, " ")
    )
    gate = catalog.caption_gate(described, F.col("path"), F.col("id") % 2 == 0, F.col("id") % 10 == 0)
    return rows.select(gate.alias("g")).groupBy("g.action", "g.reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pixel_bands",
    """SELECT CASE WHEN s IS NULL THEN NULL WHEN s >= 0.9 THEN 'likely same frame' WHEN s >= 0.85 THEN 'ambiguous upper' WHEN s >= 0.8 THEN 'ambiguous lower' WHEN s >= 0.75 THEN 'lean distinct' ELSE 'likely distinct' END AS band,
           count(*) AS n FROM (SELECT DISTINCT id, clip_cos_sim AS s FROM dedup_cluster) GROUP BY 1""",
)
def pixel_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dedup_cluster").select("id", "clip_cos_sim").distinct()
    return rows.groupBy(catalog.pixel_band(F.col("clip_cos_sim")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "review_reasons",
    """WITH h AS (SELECT m.cluster_id, l.*, min(l.id) OVER (PARTITION BY m.cluster_id) AS head FROM members m JOIN ledger l ON l.id = m.asset_id),
       w AS (SELECT cluster_id, width AS ww, height AS wh, phash AS wp, epoch AS we FROM h WHERE id = head),
       r AS (SELECT h.cluster_id, h.id, CASE WHEN coalesce(ww, 0) > 0 AND coalesce(wh, 0) > 0 AND coalesce(width, 0) > 0 AND coalesce(height, 0) > 0
             AND abs(ww / wh::DOUBLE - width / height::DOUBLE) / greatest(ww / wh::DOUBLE, width / height::DOUBLE) > 0.05 THEN 'aspect'
           WHEN source = 'originals' THEN 'originals' WHEN media_type = 'image' AND (phash IS NULL OR wp IS NULL OR bit_count(xor(phash, wp)) > 6) THEN 'phash'
           WHEN NOT coalesce(abs(epoch - we) <= 3, false) THEN 'metadata' END AS reason FROM h JOIN w USING (cluster_id) WHERE h.id <> h.head)
       SELECT c.cluster_id, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ', '), 'borderline') AS reasons FROM (SELECT DISTINCT cluster_id FROM h) c LEFT JOIN r USING (cluster_id) GROUP BY 1""",
    "wall ledger members",
)
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sent a cluster to review, against its first member; each reason once."""
    rows = members(spark, sf_dir).withColumnRenamed("asset_id", "id").join(ledger(spark, sf_dir), "id")
    first = F.min(F.struct("id", "width", "height", "phash", "epoch")).over(Window.partitionBy("cluster_id"))
    met = rows.withColumn("w", first)
    crop = media.aspect_change(F.col("w.width"), F.col("w.height"), F.col("width"), F.col("height")) > 0.05
    weak = (F.col("media_type") == "image") & ~F.coalesce(media.hamming(F.col("phash"), F.col("w.phash")) <= 6, F.lit(False))
    apart = ~F.coalesce(F.abs(F.col("epoch") - F.col("w.epoch")) <= 3, F.lit(False))
    reason = F.when(
        F.col("id") != F.col("w.id"),
        F.when(crop, "aspect").when(F.col("source") == "originals", "originals").when(weak, "phash").when(apart, "metadata"),
    )
    grouped = met.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_set(reason)), ", ").alias("reasons"))
    return grouped.select("cluster_id", F.when(F.col("reasons") == "", "borderline").otherwise(F.col("reasons")).alias("reasons"))


@query(
    "shifted_segments",
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS chunk, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
       o AS (SELECT k, chunk * 100 + q AS start FROM s)
       SELECT k, array_to_string(list_transform(list_sort(list(start)), lambda x: x::BIGINT::VARCHAR), ',') AS starts FROM o GROUP BY k""",
)
def shifted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of chunks shifted by their chunk's offset, flattened and sorted by start."""
    chunks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.collect_list("l_quantity").alias("segments"))
    shifted = chunks.withColumn("segments", F.transform("segments", lambda s: s + F.col("l_linenumber") * 100))
    whole = shifted.groupBy("k").agg(F.array_sort(F.flatten(F.collect_list("segments"))).alias("starts"))
    return whole.select("k", F.array_join(F.transform("starts", lambda s: s.cast("bigint").cast("string")), ",").alias("starts"))


@query(
    "durations",
    "WITH m AS (SELECT event_id, round_even(value * 1000, 0)::BIGINT AS ms FROM events WHERE value >= 0) SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS shown FROM m",
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("value >= 0").select("event_id", catalog.format_duration(F.col("value")).alias("shown"))


@query(
    "tracks_as_gpx",
    """SELECT device_id, floor(t / 86400.0)::BIGINT AS day, sha1('<gpx version="1.1"><trk><trkseg>' || string_agg('<trkpt lat="' || printf('%.6f', lat) || '" lon="' || printf('%.6f', lon) || '"><time>' || strftime(make_timestamp((t * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%SZ') || '</time></trkpt>', '' ORDER BY t)
           || '</trkseg></trk></gpx>') AS digest, count(*) AS points FROM pings GROUP BY ALL""",
    "pings",
)
def tracks_as_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The GPX document of each device and day, as a digest."""
    point = F.struct(F.col("t"), F.col("lat"), F.col("lon"), F.timestamp_seconds("t").alias("at"))
    grouped = pings(spark, sf_dir).groupBy("device_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.array_sort(F.collect_list(point)).alias("points"))
    return grouped.select("device_id", "day", F.sha1(catalog.gpx_text(F.col("points")).cast("binary")).alias("digest"), F.size("points").cast("bigint").alias("points"))


@query(
    "report_rows",
    """SELECT verdict, to_json({'n': n, 'verdict': verdict}) AS body FROM (SELECT decision AS verdict, count(DISTINCT id) AS n FROM dedup_cluster GROUP BY 1)""",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "dedup_cluster").groupBy(F.col("decision").alias("verdict")).agg(F.count_distinct("id").alias("n"))
    return counts.select("verdict", F.to_json(F.struct("n", "verdict")).alias("body"))


@query(
    "locked_places",
    """SELECT id, source FROM (SELECT DISTINCT id, source, gps_lat, burst_uuid FROM asset) WHERE gps_lat IS NOT NULL AND burst_uuid IS NULL AND id % 3 = 0""",
)
def locked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose lock array holds the position while another field is still empty."""
    rows = table(spark, sf_dir, "asset").select("id", "source", "gps_lat", "burst_uuid").distinct()
    locks = F.when((F.col("id") % 3 == 0) & F.col("gps_lat").isNotNull(), F.array(F.lit("latitude"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("locks", locks).where(F.array_contains("locks", "latitude") & F.col("burst_uuid").isNull()).select("id", "source")


@query(
    "dateless_matches",
    """SELECT d.candidate_id, a.id FROM (SELECT DISTINCT candidate_id, original_path FROM date_candidate) d JOIN (SELECT DISTINCT id, path, source, taken_at FROM asset) a
       ON a.path = d.original_path WHERE a.taken_at IS NULL AND (a.source = 'icloud' OR a.source IS NULL)""",
)
def dateless_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "date_candidate").select("candidate_id", F.col("original_path").alias("path")).distinct()
    rows = table(spark, sf_dir, "asset").where("taken_at is null and (source = 'icloud' or source is null)").select("id", "path").distinct()
    return wanted.join(rows, "path").select("candidate_id", "id")


@query(
    "frame_groups",
    """WITH f AS (SELECT user_id, min(epoch_us(ts) // 1000000) AS s, count(*) AS frames FROM events WHERE event_type = 'view' GROUP BY 1),
       v AS (SELECT event_id, epoch_us(ts) // 1000000 AS t, event_id % 30 AS frames FROM events WHERE event_type = 'click'),
       m AS (SELECT f.user_id, v.event_id, abs(v.t - f.s) AS d FROM f JOIN v ON abs(v.t - f.s) <= 600 AND abs(v.frames - f.frames) <= 0.5 * f.frames)
       SELECT user_id, arg_min(event_id, (d, event_id)) AS video FROM m GROUP BY 1""",
)
def frame_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered video nearest to a group of frames: within ten minutes and half its frame count."""
    from ..operators.range_join import range_join

    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").withColumn("t", at)
    groups = events.where("event_type = 'view'").groupBy("user_id").agg(F.min("t").alias("s"), F.count(F.lit(1)).alias("frames"))
    videos = events.where("event_type = 'click'").select("event_id", "t", (F.col("event_id") % 30).alias("shots"))
    met = range_join(groups, videos, "s", "t", 600).where(F.abs(F.col("shots") - F.col("frames")) <= 0.5 * F.col("frames"))
    return met.groupBy("user_id").agg(F.min_by("event_id", F.struct(F.abs(F.col("t") - F.col("s")), F.col("event_id"))).alias("video"))


@query(
    "fully_cached",
    """SELECT regexp_extract(path, '(t[0-9]{6})', 1) AS trip, count(*) FILTER (status <> 'error') = count(*) AND max(mtime) <= 1700000000 AS cached FROM (SELECT DISTINCT id, path, status, mtime FROM asset) GROUP BY 1""",
)
def fully_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "path", "status", "mtime").distinct()
    return rows.groupBy(F.regexp_extract("path", r"(t[0-9]{6})", 1).alias("trip")).agg(
        ((F.count_if(F.col("status") != "error") == F.count(F.lit(1))) & (F.max("mtime") <= 1_700_000_000)).alias("cached")
    )


@query(
    "purged_state",
    """SELECT DISTINCT doc_id FROM documents WHERE (lang IS NULL OR lang NOT IN ('en', 'de')) AND source = 'transcript'""",
)
def purged_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts in a language outside the allowed ones; an unknown language counts as outside."""
    wrong = ~F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    return table(spark, sf_dir, "documents").where(wrong & (F.col("source") == "transcript")).select("doc_id").distinct()


@query(
    "vector_literals",
    "SELECT vec_id, sha1('[' || array_to_string(list_transform(embedding, lambda x: printf('%.4f', round(x::DOUBLE::DECIMAL(18, 12), 4)::DOUBLE)), ',') || ']') AS digest FROM embeddings",
)
def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.transform("embedding", lambda x: F.round(x.cast("double").cast("decimal(18,12)"), 4).cast("double") + F.lit(0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.sha1(catalog.vector_literal(wide, 4).cast("binary")).alias("digest"))
