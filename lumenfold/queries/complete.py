"""Queries of persons, trips, zones, notes, playability and other operators of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import catalog, dates, media, registration, text, video
from ..operators import library
from ..operators.components import components
from ..session import table
from ..sources.files import sibling_telemetry
from . import joins, ordered  # noqa: F401
from .problems import SQL as PROBLEM_SQL
from .registry import SQL, ledger, members, pings, query

_KM = """2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
    + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"""


@query(
    "cluster_radii",
    f"""WITH p AS (SELECT m.cluster_id, gps_lat AS lat, gps_lon AS lon FROM members m JOIN ledger l ON l.id = m.asset_id WHERE fix),
       c AS (SELECT cluster_id, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n FROM p GROUP BY 1)
       SELECT c.cluster_id, round(c.lat, 4) AS lat, round(c.lon, 4) AS lon, round(max({_KM.format(a="c", b="p")}), 3) AS radius_km, c.n
       FROM c JOIN p USING (cluster_id) GROUP BY c.cluster_id, c.lat, c.lon, c.n""",
    "wall ledger members",
)
def cluster_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre of each cluster and its members' greatest distance from it."""
    placed = ledger(spark, sf_dir).where("fix").select(F.col("id").alias("asset_id"), F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    found = library.centroid_radius(members(spark, sf_dir).join(placed, "asset_id"), ["cluster_id"])
    return found.select("cluster_id", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("radius_km", 3).alias("radius_km"), "n")


@query(
    "psnr_verdicts",
    """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 13 = 0 THEN 'unknown' WHEN p_size >= 30 THEN 'ok' WHEN p_size >= 25 THEN 'review' ELSE 'fail' END AS verdict
       FROM part) GROUP BY 1""",
)
def psnr_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    decibels = F.when(F.col("p_partkey") % 13 != 0, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").groupBy(video.psnr_verdict(decibels).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "named_persons",
    """SELECT c_custkey AS person_id, c_name AS name, count(DISTINCT o_orderkey) AS faces FROM customer JOIN orders ON o_custkey = c_custkey
       WHERE c_acctbal > 0 GROUP BY ALL HAVING count(DISTINCT o_orderkey) >= 12""",
)
def named_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named persons with at least twelve faces, the most seen first."""
    persons = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    faces = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(F.count_distinct("o_orderkey").alias("faces"))
    return persons.join(faces.where("faces >= 12"), "person_id").select("person_id", "name", "faces").orderBy(F.desc("faces"), "person_id")


@query(
    "face_assets",
    """SELECT f.l_orderkey, f.l_linenumber, o.o_orderstatus, c.c_name FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) f
       JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o.o_orderkey = f.l_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0
       WHERE c.c_name IS NOT NULL""",
)
def face_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces with their asset, unless that is in the trash, and its attributes; the filter makes the outer join an inner one."""
    faces = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    assets = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    extra = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    met = faces.join(assets, "l_orderkey").join(extra, "o_custkey", "left").where("c_name is not null")
    return met.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name")


@query(
    "person_votes",
    """WITH f AS (SELECT o_custkey % 50 AS person, o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'none' WHEN 1 THEN 'orphan' WHEN 2 THEN 'same' WHEN 3 THEN 'other' ELSE 'vote' END AS kind,
              CASE WHEN o_orderkey % 7 < 5 THEN o_custkey % 3 ELSE 9 END AS cluster FROM orders),
       v AS (SELECT person, cluster, count(*) AS n FROM f WHERE kind = 'vote' GROUP BY ALL),
       w AS (SELECT person, max(n) AS best, sum(n) AS total, arg_min(cluster, (-n, cluster)) AS cluster FROM v GROUP BY 1)
       SELECT f.person, max(CASE WHEN best >= 3 AND best >= 0.6 * total THEN w.cluster END) AS target, coalesce(max(total), 0)::BIGINT AS votes,
              CASE WHEN max(CASE WHEN best >= 3 AND best >= 0.6 * total THEN 1 ELSE 0 END) = 1 THEN count(*) FILTER (kind = 'orphan') ELSE 0 END AS orphans,
              count(*) FILTER (kind = 'other') AS conflicts, count(*) FILTER (kind = 'same') AS already_named, count(*) FILTER (kind = 'none') AS no_detection
       FROM f LEFT JOIN w USING (person) GROUP BY 1""",
)
def person_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster that a person's faces vote for, with the faces that took no part; orphans count only with a winner."""
    key = F.col("o_orderkey")
    kind = F.when(key % 10 == 0, "none").when(key % 10 == 1, "orphan").when(key % 10 == 2, "same").when(key % 10 == 3, "other").otherwise("vote")
    faces = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("person"), kind.alias("kind"), F.when(key % 7 < 5, F.col("o_custkey") % 3).otherwise(9).alias("cluster")
    )
    return vote_with_counts(faces)


def vote_with_counts(faces: DataFrame, least_votes: int = 3, least_share: float = 0.6) -> DataFrame:
    """person, target, votes, orphans, conflicts, already_named, no_detection of faces (person, kind, cluster).

    kind: vote (an unnamed cluster), orphan (no cluster), same or other (a cluster named
    so, or otherwise), none (no face found there).
    """
    counted = faces.groupBy("person", "kind", F.when(F.col("kind") == "vote", F.col("cluster")).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    vote = F.col("kind") == "vote"
    best = F.min(F.when(vote, F.struct((-F.col("n")).alias("n"), "cluster")))

    def of(kind: str):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    summed = counted.groupBy("person").agg(
        best.alias("best"), of("vote").alias("votes"), of("orphan").alias("orphan"), of("other").alias("conflicts"),
        of("same").alias("already_named"), of("none").alias("no_detection"),
    )
    wins = F.coalesce((-F.col("best.n") >= least_votes) & (-F.col("best.n") >= least_share * F.col("votes")), F.lit(False))
    return summed.select(
        "person", F.when(wins, F.col("best.cluster")).alias("target"), "votes", F.when(wins, F.col("orphan")).otherwise(0).alias("orphans"),
        "conflicts", "already_named", "no_detection",
    )


@query("trip_library")
def trip_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums (clusters of the catalog) and events of all other dated, placed assets, as one table of trips."""
    rows = ledger(spark, sf_dir)
    fix = F.col("fix")
    assets = rows.select("id", F.col("epoch").alias("t"), F.when(fix, F.col("gps_lat")).alias("lat"), F.when(fix, F.col("gps_lon")).alias("lon"), "source")
    albums = members(spark, sf_dir).select(F.col("cluster_id").alias("name"), F.col("asset_id").alias("id"))
    found = library.trip_library(albums, assets.withColumnRenamed("source", "owner"), ["owner"])
    return found.select("source", "name", "start", "end", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("radius_km", 3).alias("radius_km"), "assets")


@query(
    "notes_bodies",
    r"""WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^---[ \t]*\n(?:.|\n)*?\n---[ \t]*(?:\n|$)', ''), '^\s*\n', ''), '^# [^\n]*(\n|$)', '') AS t FROM documents WHERE text IS NOT NULL),
       p AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '\n[ \t]*(?:\n[ \t]*)+'), lambda x: trim(x, ' ' || chr(9) || chr(10)) <> '') AS ps FROM b)
       SELECT doc_id, md5(trim(array_to_string(list_filter(list_transform(ps, lambda x: trim(x, chr(10))), lambda x: NOT (starts_with(trim(x), '_') AND ends_with(trim(x), '_') AND contains(x, 'scan'))), chr(10) || chr(10)), ' ' || chr(9) || chr(10))) AS body FROM p""",
)
def notes_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of a note as a description, by its digest."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(text.notes_body(F.col("text"), "scan")).alias("body"))


@query(
    "clamped_languages",
    """SELECT CASE WHEN lang IN ('en', 'de') THEN lang WHEN lang IS NOT NULL THEN 'en' END AS lang, count(*) AS n FROM documents GROUP BY 1""",
)
def clamped_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(catalog.clamp_language(F.col("lang"), ("en", "de")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "silent_makes",
    """SELECT id, starts_with(lower(trim(CASE WHEN id % 3 = 0 THEN ' DJI' WHEN id % 3 = 1 THEN 'GoPro' END)), 'dji') IS TRUE AS silent FROM (SELECT DISTINCT id FROM asset WHERE media_type = 'video')""",
)
def silent_makes(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "asset").where("media_type = 'video'").select("id").distinct()
    make = F.when(F.col("id") % 3 == 0, " DJI").when(F.col("id") % 3 == 1, "GoPro")
    return videos.select("id", catalog.is_silent_make(make).alias("silent"))


@query(
    "renamed_paths",
    """SELECT id, regexp_replace(regexp_replace('{"path":"' || path || '"}', '/google(/|"|$)', '/takeout\\1', 'g'), '/2016(/|"|$)', '/year-2016\\1', 'g') AS body
       FROM (SELECT DISTINCT id, path FROM asset)""",
)
def renamed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records with whole path parts renamed."""
    rows = table(spark, sf_dir, "asset").select("id", "path").distinct()
    body = F.concat(F.lit('{"path":"'), F.col("path"), F.lit('"}'))
    return rows.select("id", text.rewrite_paths(body, {"google": "takeout", "2016": "year-2016"}).alias("body"))


_TAG_TIME = """CASE WHEN regexp_full_match(regexp_replace(trim({c}), '[ ]*[+-][0-9]{{2}}:[0-9]{{2}}$', ''), '[0-9]{{4}}:[0-9]{{2}}:[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')
    THEN try_strptime(regexp_replace(trim({c}), '[ ]*[+-][0-9]{{2}}:[0-9]{{2}}$', ''), '%Y:%m:%d %H:%M:%S') END"""
_OFFSET = """regexp_extract(trim({c}), '^.{{19}}.*([+-][0-9]{{2}}:[0-9]{{2}})$', 1)"""


@query(
    "capture_times",
    f"""WITH r AS (SELECT DISTINCT candidate_id, original_path, date_time_original AS a, local_date_time AS b FROM date_candidate),
       t AS (SELECT *, {_TAG_TIME.format(c="a")} AS ta, {_OFFSET.format(c="a")} AS oa, {_TAG_TIME.format(c="b")} AS tb, {_OFFSET.format(c="b")} AS ob FROM r),
       e AS (SELECT candidate_id, CASE WHEN year(ta) BETWEEN 1970 AND 2100 THEN ta WHEN year(tb) BETWEEN 1970 AND 2100 THEN tb END AS w,
              CASE WHEN year(ta) BETWEEN 1970 AND 2100 THEN oa WHEN year(tb) BETWEEN 1970 AND 2100 THEN ob END AS o FROM t),
       s AS (SELECT candidate_id, CASE WHEN candidate_id % 5 = 0 THEN candidate_id * 100000 END AS tele, w, o, CASE WHEN candidate_id % 3 = 0 THEN candidate_id * 1000 END AS name,
              CASE WHEN candidate_id % 2 = 0 THEN candidate_id END AS box FROM e)
       SELECT candidate_id, CASE WHEN tele IS NOT NULL THEN tele WHEN w IS NOT NULL THEN epoch(w)::BIGINT - CASE WHEN o <> '' THEN (CASE WHEN o[1] = '-' THEN -1 ELSE 1 END) * (o[2:3]::INT * 3600 + o[5:6]::INT * 60) ELSE 0 END
                WHEN name IS NOT NULL THEN name ELSE box END AS secs,
              CASE WHEN tele IS NOT NULL THEN 'telemetry' WHEN w IS NOT NULL THEN 'embedded' WHEN name IS NOT NULL THEN 'name' WHEN box IS NOT NULL THEN 'container' END AS source,
              CASE WHEN tele IS NOT NULL THEN 'utc' WHEN w IS NOT NULL THEN CASE WHEN o <> '' THEN 'utc' ELSE 'local' END WHEN name IS NOT NULL THEN 'local' WHEN box IS NOT NULL THEN 'utc' END AS kind FROM s""",
)
def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a capture time comes from, and whether it is an instant or a wall clock."""
    rows = table(spark, sf_dir, "date_candidate").select("candidate_id", "date_time_original", "local_date_time").distinct()
    tags = F.create_map(F.lit("EXIF:DateTimeOriginal"), F.col("date_time_original"), F.lit("XMP:DateTimeOriginal"), F.col("local_date_time"))
    key = F.col("candidate_id")
    got = dates.capture_time(
        F.when(key % 5 == 0, key * 100_000), dates.first_tag_time(tags), F.when(key % 3 == 0, key * 1_000), F.when(key % 2 == 0, key)
    )
    return rows.withColumn("c", got).select(key, F.col("c.secs").alias("secs"), F.col("c.source").alias("source"), F.col("c.kind").alias("kind"))


@query(
    "authority_order",
    f"""WITH r AS (SELECT DISTINCT id, path, taken_at, taken_src, mtime FROM asset),
       s AS (SELECT *, {_TAG_TIME.format(c="CASE WHEN taken_src = 'exif' THEN taken_at END")} AS e, {_TAG_TIME.format(c="CASE WHEN taken_src = 'json' THEN taken_at END")} AS j,
              CASE WHEN id % 4 = 0 THEN make_timestamp((1500000000 + id) * 1000000) END AS f FROM r)
       SELECT id, CASE WHEN year(e) BETWEEN 1990 AND 2027 THEN 'exif' WHEN year(j) BETWEEN 1990 AND 2027 THEN 'companion' WHEN year(f) BETWEEN 1990 AND 2027 THEN 'filename' WHEN mtime IS NOT NULL THEN 'mtime' END AS source,
              CASE WHEN year(e) BETWEEN 1990 AND 2027 THEN epoch(e)::BIGINT WHEN year(j) BETWEEN 1990 AND 2027 THEN epoch(j)::BIGINT WHEN year(f) BETWEEN 1990 AND 2027 THEN epoch(f)::BIGINT ELSE floor(mtime)::BIGINT END AS secs FROM s""",
)
def authority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole order of authority: tags in their order, companion, file name, then the file's own time."""
    rows = table(spark, sf_dir, "asset").select("id", "path", "taken_at", "taken_src", "mtime").distinct()
    in_tag = F.when(F.col("taken_src") == "exif", F.col("taken_at"))
    which = F.col("id") % 5
    tags = F.create_map(*(x for n, tag in enumerate(dates.AUTHORITY_TAGS) for x in (F.lit(tag), F.when(which == n, in_tag))))

    def stamp(tag):
        return F.timestamp_seconds(dates.tag_time(tag)["secs"])

    picked = dates.capture_authority(
        [("exif", stamp(tags[tag])) for tag in dates.AUTHORITY_TAGS]
        + [
            ("companion", stamp(F.when(F.col("taken_src") == "json", F.col("taken_at")))),
            ("filename", dates.name_timestamp(F.when(F.col("id") % 4 == 0, F.concat(F.lit("/a/IMG_"), F.date_format(F.timestamp_seconds(1_500_000_000 + F.col("id")), "yyyyMMdd_HHmmss"), F.lit(".jpg"))))),
        ],
        ("mtime", F.timestamp_seconds(F.floor("mtime"))),
        2027,
    )
    return rows.withColumn("a", picked).select("id", F.col("a.source").alias("source"), F.unix_seconds("a.dt").alias("secs"))


@query(
    "name_dates",
    """WITH n AS (SELECT event_id, '/in/' || CASE event_id % 3 WHEN 0 THEN 'VID_' WHEN 1 THEN 'dji_' ELSE 'scan ' END || strftime(ts, '%Y%m%d_%H%M%S') || '_01.mp4' AS path, strftime(ts, '%Y%m%d') AS d FROM events)
       SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE d END AS day_key, CASE WHEN event_id % 3 = 2 THEN NULL ELSE d[1:6] END AS month_key FROM n""",
)
def name_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and month written in a file name."""
    prefix = F.when(F.col("event_id") % 3 == 0, "VID_").when(F.col("event_id") % 3 == 1, "dji_").otherwise("scan ")
    path = F.concat(F.lit("/in/"), prefix, F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_01.mp4"))
    return table(spark, sf_dir, "events").select("event_id", dates.date_key(path).alias("day_key"), dates.date_key(path, months=True).alias("month_key"))


@query(
    "times_since_2001",
    """SELECT id, epoch(make_timestamp(floor(mtime)::BIGINT * 1000000))::BIGINT AS secs FROM (SELECT DISTINCT id, mtime FROM asset) WHERE mtime IS NOT NULL""",
)
def times_since_2001(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants stored as seconds since 2001."""
    rows = table(spark, sf_dir, "asset").where("mtime is not null").select("id", "mtime").distinct()
    stored = F.floor("mtime") - dates.EPOCH_2001
    return rows.select("id", F.unix_seconds(dates.timestamp_2001(stored)).alias("secs"))


def _zones_sql() -> str:
    towns = ", ".join(f"('{zone}', {lat}, {lon})" for zone, lat, lon in library.ZONE_TOWNS)
    return f"""WITH town AS (SELECT * FROM (VALUES {towns}) v(zone, lat, lon)),
       d AS (SELECT p.id, t.zone, {_KM.format(a="p", b="t")} AS km FROM pings p CROSS JOIN town t)
       SELECT id, arg_min(zone, (km, zone)) AS zone FROM d GROUP BY 1"""


@query("zones_at", _zones_sql(), "pings")
def zones_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone of the town nearest to each ping."""
    return library.zone_of_points(pings(spark, sf_dir), "id", "lat", "lon")


@query(
    "savings",
    """WITH v AS (SELECT DISTINCT id, bytes, 1 + exif_fields % 40 AS dur, bytes * 8.0::DOUBLE / (1 + exif_fields % 40) AS rate FROM asset WHERE bytes IS NOT NULL AND exif_fields IS NOT NULL),
       e AS (SELECT *, trunc(4000000 * (bytes / greatest(rate, 1)))::BIGINT AS est FROM v)
       SELECT id, est AS estimated, round(CASE WHEN bytes > 0 THEN greatest(bytes - est, 0) / bytes::DOUBLE ELSE 0 END, 6) AS share, CASE WHEN rate >= 1000000 THEN printf('%.1f Mbps', rate / 1000000) ELSE printf('%.0f kbps', rate / 1000) END AS shown
       FROM e WHERE bytes > 0 AND greatest(bytes - est, 0) / bytes::DOUBLE >= 0.2""",
)
def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a copy at 4 Mbps makes smaller by a fifth or more."""
    rows = table(spark, sf_dir, "asset").where("bytes is not null and exif_fields is not null").select("id", "bytes", "exif_fields").distinct()
    rate = F.col("bytes") * F.lit(8.0) / (1 + F.col("exif_fields") % 40)
    sized = rows.withColumns({"rate": rate, "estimated": video.estimated_size(F.col("bytes"), rate, F.lit(4_000_000))})
    share = video.saved_share(F.col("bytes"), F.col("estimated"))
    return sized.where(share >= video.LEAST_SAVING).select("id", "estimated", F.round(share, 6).alias("share"), video.format_bitrate(F.col("rate")).alias("shown"))


@query(
    "corner_boxes",
    """WITH b AS (SELECT DISTINCT l_orderkey, l_linenumber, (l_partkey % 97) / 97.0::DOUBLE AS x, (l_suppkey % 89) / 89.0::DOUBLE AS y, (l_linenumber - 1) / 10.0::DOUBLE AS s FROM lineitem)
       SELECT l_orderkey, l_linenumber, round(x - s / 2, 6) AS x1, round(1 - (y + s / 2), 6) AS y1, round(x + s / 2, 6) AS x2, round(1 - (y - s / 2), 6) AS y2 FROM b WHERE s > 0""",
)
def corner_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by centre and size, from the bottom left, as corners from the top left."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    box = video.corner_box(F.col("l_partkey") % 97 / 97.0, F.col("l_suppkey") % 89 / 89.0, (F.col("l_linenumber") - 1) / 10.0)
    cut = rows.select("l_orderkey", "l_linenumber", box.alias("b")).where("b is not null")
    return cut.select("l_orderkey", "l_linenumber", *(F.round(f"b.{c}", 6).alias(c) for c in ("x1", "y1", "x2", "y2"))).distinct()


@query(
    "transcodes",
    """SELECT id, NOT (id % 3 <> 0 AND id % 4 <> 1 AND lower(regexp_extract(path, '[.]([^./]+)$', 1)) IN ('mp4', 'mov', 'm4v') AND coalesce(height <= 720, false)) AS needed
       FROM (SELECT DISTINCT id, path, height FROM asset)""",
)
def transcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a browser does not play as they are."""
    rows = table(spark, sf_dir, "asset").select("id", "path", "height").distinct()
    codec = F.when(F.col("id") % 3 != 0, "h264").otherwise("hevc")
    sound = F.when(F.col("id") % 4 == 1, "pcm").when(F.col("id") % 4 == 2, "aac")
    return rows.select("id", video.needs_transcode(codec, sound, text.extension(F.col("path")), F.col("height")).alias("needed"))


@query(
    "face_rows",
    """SELECT DISTINCT l_orderkey AS asset_id, l_linenumber AS face, l_quantity::INT AS x1, (l_quantity + 10)::INT AS x2, '[' || printf('%.8f', l_discount) || ',' || printf('%.8f', l_tax) || ']' AS embedding
       FROM lineitem WHERE l_quantity > 0""",
)
def face_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per detected face of an asset, from its array of faces; assets without faces give none."""
    face = F.struct(F.col("l_linenumber").alias("face"), F.col("l_quantity").cast("int").alias("x1"), F.array("l_discount", "l_tax").alias("vec"))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("asset_id")).agg(F.collect_list(face).alias("faces"))
    rows = held.select("asset_id", F.explode("faces").alias("f")).where("f.x1 > 0")
    return rows.select("asset_id", "f.face", "f.x1", (F.col("f.x1") + 10).alias("x2"), catalog.vector_literal(F.col("f.vec")).alias("embedding")).distinct()


@query(
    "decoded_checksums",
    """SELECT id, lower(hex(from_base64(to_base64(sha1(path)::BLOB)))) AS checksum FROM (SELECT DISTINCT id, path FROM asset) WHERE path IS NOT NULL""",
)
def decoded_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums that arrive as bytes or as base64 text, as hexadecimal."""
    rows = table(spark, sf_dir, "asset").where("path is not null").select("id", "path").distinct()
    raw = F.encode(F.sha1(F.col("path").cast("binary")), "UTF-8")
    sent = rows.select("id", F.when(F.col("id") % 2 == 0, raw).alias("as_bytes"), F.when(F.col("id") % 2 == 1, F.base64(raw)).alias("as_text"))
    return sent.select("id", F.lower(F.hex(F.coalesce("as_bytes", F.unbase64("as_text")))).alias("checksum"))


@query(
    "telemetry_siblings",
    """WITH m AS (SELECT DISTINCT regexp_replace(clip_path, '[.][^./]*$', '') AS stem, clip_id FROM srt_telemetry WHERE clip_path IS NOT NULL),
       s AS (SELECT stem, bool_or(clip_id % 3 <> 0) AS upper, bool_or(clip_id % 2 = 0) AS low FROM m GROUP BY 1)
       SELECT stem || '.MP4' AS path, stem || CASE WHEN upper THEN '.SRT' ELSE '.srt' END AS telemetry_path FROM s WHERE upper OR low""",
)
def telemetry_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry beside each clip, in capitals before small letters."""
    clips = table(spark, sf_dir, "srt_telemetry").where("clip_path is not null").select("clip_id", F.regexp_replace("clip_path", r"\.[^./]*$", "").alias("stem")).distinct()
    media_files = clips.select(F.concat("stem", F.lit(".MP4")).alias("path")).distinct()
    upper = clips.where("clip_id % 3 <> 0").select(F.concat("stem", F.lit(".SRT")).alias("path"))
    low = clips.where("clip_id % 2 = 0").select(F.concat("stem", F.lit(".srt")).alias("path"))
    other = clips.select(F.concat("stem", F.lit(".Srt")).alias("path"))
    return sibling_telemetry(media_files, upper.unionByName(low).unionByName(other))


@query(
    "review_chips",
    """WITH s AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1)
       SELECT c.id AS cluster_id, CASE WHEN clip_cos_sim IS NULL THEN 'no score' WHEN clip_cos_sim >= 0.9 THEN 'same' ELSE 'differs' END || '/' || coalesce(n, 0) AS chip
       FROM (SELECT DISTINCT id, clip_cos_sim FROM dedup_cluster) c LEFT JOIN s ON s.cluster_id = c.id""",
    "members",
)
def review_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the review shows of each cluster, also where no score was stored."""
    clusters = table(spark, sf_dir, "dedup_cluster").select(F.col("id").alias("cluster_id"), "clip_cos_sim").distinct()
    sizes = members(spark, sf_dir).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    score = F.when(F.col("clip_cos_sim").isNull(), "no score").when(F.col("clip_cos_sim") >= 0.9, "same").otherwise("differs")
    return clusters.join(sizes, "cluster_id", "left").select("cluster_id", F.concat_ws("/", score, F.coalesce("n", F.lit(0)).cast("string")).alias("chip"))


@query(
    "caption_paths",
    """WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'AI: a lake' WHEN 2 THEN 'default' WHEN 3 THEN 'IMG_1' ELSE text END AS t FROM documents)
       SELECT doc_id, coalesce(trim(t), '') = '' OR starts_with(t, 'AI: ') AS queued, coalesce(trim(t), '') = '' OR starts_with(t, 'AI: ') OR lower(trim(t)) = 'default' OR trim(t) = 'IMG_1' AS written FROM d""",
)
def caption_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts each of the two captioners replaces; they differ on what cameras write."""
    turn = F.col("doc_id") % 5
    said = F.when(turn == 1, "AI: a lake").when(turn == 2, "default").when(turn == 3, "IMG_1").when(turn == 4, F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("t"))
    path = F.lit("/a/IMG_1.jpg")
    return rows.select("doc_id", catalog.open_for_caption(F.col("t")).alias("queued"), catalog.replaceable_caption(F.col("t"), path).alias("written"))


@query(
    "device_names",
    """WITH d AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'fc3582' WHEN 1 THEN 'FC9999' WHEN 2 THEN 'iPhone 12' END AS model,
              CASE event_id % 6 WHEN 3 THEN 'DJI Mini4 Pro' WHEN 4 THEN 'Lavf58.1' END AS encoder, CASE WHEN event_id % 4 = 0 THEN 'Maker' END AS make FROM events)
       SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Maker' WHEN event_id % 6 IN (0, 1, 3) THEN 'DJI' END AS make,
              CASE event_id % 6 WHEN 0 THEN 'Mini 3 Pro' WHEN 1 THEN 'FC9999' WHEN 2 THEN 'iPhone 12' WHEN 3 THEN 'Mini 4 Pro' END AS model FROM d""",
)
def device_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makes and models by the list of devices, with encoders standing in for models."""
    turn = F.col("event_id") % 6
    model = F.when(turn == 0, "fc3582").when(turn == 1, "FC9999").when(turn == 2, "iPhone 12")
    encoder = F.when(turn == 3, "DJI Mini4 Pro").when(turn == 4, "Lavf58.1")
    named = catalog.device(F.when(F.col("event_id") % 4 == 0, "Maker"), model, encoder)
    return table(spark, sf_dir, "events").select("event_id", named.alias("d")).select("event_id", "d.make", "d.model")


@query(
    "camera_keys",
    """WITH a AS (SELECT DISTINCT id, source, format, regexp_extract(path, '[^/]*$') AS f FROM asset)
       SELECT source || ' ' || coalesce(format, '') AS camera, nullif(upper(regexp_extract(f, '^[A-Za-z]+')), '') AS prefix, count(*) AS n FROM
         (SELECT trim(source) AS source, trim(format) AS format, f FROM a WHERE format IS NOT NULL AND source IS NOT NULL) GROUP BY ALL""",
)
def camera_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").where("format is not null and source is not null").select("id", "path", "source", "format").distinct()
    return rows.groupBy(catalog.camera_key(F.col("source"), F.col("format")).alias("camera"), catalog.name_prefix(F.col("path")).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "sql_functions",
    """WITH a AS (SELECT DISTINCT id, status, bytes FROM asset WHERE bytes IS NOT NULL),
       r AS (SELECT status, bytes, row_number() OVER (PARTITION BY status ORDER BY bytes) - 1 AS i, count(*) OVER (PARTITION BY status) AS n FROM a)
       SELECT status, max(CASE WHEN i = least(n - 1, floor(n * 0.9)::BIGINT) THEN bytes END) AS p90 FROM r GROUP BY 1""",
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index percentile in SQL text, with a registered function for the place."""
    registration.register(spark)
    table(spark, sf_dir, "asset").where("bytes is not null").select("id", "status", "bytes").distinct().createOrReplaceTempView("lf_assets")
    return spark.sql(
        """SELECT status, max(CASE WHEN i = lf_place(0.9D, n) THEN bytes END) AS p90 FROM (
             SELECT status, bytes, row_number() OVER (PARTITION BY status ORDER BY bytes) - 1 AS i, count(*) OVER (PARTITION BY status) AS n FROM lf_assets)
           GROUP BY status"""
    )


@query(
    "sql_cues",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3} --> [0-9]{2}:[0-9]{2}:[0-9]{2}[,.][0-9]{3}')) AS cues
       FROM documents WHERE contains(text, ' --> ')""",
)
def sql_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues per document by the registered table function."""
    registration.register(spark)
    table(spark, sf_dir, "documents").where("text like '% --> %'").select("doc_id", "text").createOrReplaceTempView("lf_documents")
    return spark.sql("SELECT doc_id, count(*) AS cues FROM lf_documents, LATERAL lf_cues(text) GROUP BY doc_id")


def _repointed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = members(spark, sf_dir)
    heads = Window.partitionBy("cluster_id")
    stars = old.withColumn("head", F.min("asset_id").over(heads)).where("asset_id <> head").select(F.col("asset_id").alias("id_a"), F.col("head").alias("id_b"))
    found = components(joins.pair_evidence(spark, sf_dir).select("id_a", "id_b").unionByName(stars), "id_a", "id_b")
    return library.merge_into_clusters(found, old, 1_000_000_000)


@query("repointed_membership")
def repointed_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The membership after new evidence: touched clusters merge into the smallest of them."""
    return _repointed(spark, sf_dir)[0]


@query("deleted_clusters")
def deleted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that the merge leaves without members."""
    return _repointed(spark, sf_dir)[1]


def _merge_sql(last: str) -> str:
    evidence = SQL["evidence_components"].partition("evidence AS (")[0]
    return f"""{evidence}old AS (SELECT DISTINCT cluster_id, asset_id FROM membership),
       evidence AS (SELECT id_a, id_b FROM pairs WHERE evidence IS NOT NULL UNION
           SELECT o.asset_id, h.head FROM old o JOIN (SELECT cluster_id, min(asset_id) AS head FROM old GROUP BY 1) h USING (cluster_id) WHERE o.asset_id <> h.head),
       both_ways AS (SELECT id_a AS a, id_b AS b FROM evidence UNION SELECT id_b, id_a FROM evidence),
       reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
       comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
       met AS (SELECT DISTINCT component, cluster_id FROM comp JOIN old ON old.asset_id = comp.node),
       least_of AS (SELECT component, min(cluster_id) AS kept FROM met GROUP BY 1)
       {last}"""


SQL["repointed_membership"] = _merge_sql(
    """SELECT coalesce(l.kept, 1000000000 + c.component) AS cluster_id, c.node AS asset_id FROM comp c LEFT JOIN least_of l USING (component)
       UNION SELECT cluster_id, asset_id FROM old WHERE cluster_id NOT IN (SELECT cluster_id FROM met)"""
)
SQL["deleted_clusters"] = _merge_sql("SELECT DISTINCT m.cluster_id FROM met m JOIN least_of l USING (component) WHERE m.cluster_id <> l.kept")


_WINNER_SQL = """s AS (SELECT m.cluster_id, l.*, round(CASE l.source WHEN 'originals' THEN 120 WHEN 'icloud' THEN 100 WHEN 'google' THEN 30 ELSE 50 END
               + log10(coalesce(nullif(width, 0), 1)::DOUBLE * coalesce(nullif(height, 0), 1)) * 10 + log10(greatest(coalesce(bytes, 1), 1)::DOUBLE) * 5
               + coalesce(exif_fields, 0) * 2 + CASE WHEN format IN ('heic','heif','dng','cr2','cr3','arw','nef','raf','rw2','orf') THEN 20 ELSE 0 END, 9) AS score
             FROM members m JOIN ledger l ON l.id = m.asset_id),
       won AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id) = 1 AS wins FROM s)"""


def _with_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each cluster with w, the record of the member that scores best; a tie goes to the smaller id."""
    rows = members(spark, sf_dir).withColumnRenamed("asset_id", "id").join(ledger(spark, sf_dir), "id")
    score = F.round(media.winner_score(*(F.col(c) for c in ("source", "width", "height", "bytes", "exif_fields", "format"))), 9)
    best = rows.groupBy("cluster_id").agg(F.min(F.struct((-score).alias("__score"), "id", "width", "height", "phash", "epoch")).alias("w"))
    return rows.join(best, "cluster_id")


@query(
    "winner_reasons",
    f"""WITH {_WINNER_SQL},
       w AS (SELECT cluster_id, id AS wid, width AS ww, height AS wh, phash AS wp, epoch AS we FROM won WHERE wins),
       r AS (SELECT h.cluster_id, h.id, CASE WHEN coalesce(ww, 0) > 0 AND coalesce(wh, 0) > 0 AND coalesce(width, 0) > 0 AND coalesce(height, 0) > 0
             AND abs(ww / wh::DOUBLE - width / height::DOUBLE) / greatest(ww / wh::DOUBLE, width / height::DOUBLE) > 0.05 THEN 'aspect'
           WHEN source = 'originals' THEN 'originals' WHEN media_type = 'image' AND (phash IS NULL OR wp IS NULL OR bit_count(xor(phash, wp)) > 6) THEN 'phash'
           WHEN NOT coalesce(abs(epoch - we) <= 3, false) THEN 'metadata' END AS reason FROM won h JOIN w USING (cluster_id) WHERE h.id <> w.wid)
       SELECT c.cluster_id, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ', '), 'borderline') AS reasons FROM (SELECT DISTINCT cluster_id FROM won) c LEFT JOIN r USING (cluster_id) GROUP BY 1""",
    "wall ledger members",
)
def winner_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sent a cluster to review, each loser against the winner; each reason once."""
    met = _with_winner(spark, sf_dir)
    crop = media.aspect_change(F.col("w.width"), F.col("w.height"), F.col("width"), F.col("height")) > 0.05
    weak = (F.col("media_type") == "image") & ~F.coalesce(media.hamming(F.col("phash"), F.col("w.phash")) <= 6, F.lit(False))
    apart = ~F.coalesce(F.abs(F.col("epoch") - F.col("w.epoch")) <= 3, F.lit(False))
    reason = F.when(
        F.col("id") != F.col("w.id"),
        F.when(crop, "aspect").when(F.col("source") == "originals", "originals").when(weak, "phash").when(apart, "metadata"),
    )
    grouped = met.groupBy("cluster_id").agg(F.array_join(F.sort_array(F.collect_set(reason)), ", ").alias("reasons"))
    return grouped.select("cluster_id", F.when(F.col("reasons") == "", "borderline").otherwise(F.col("reasons")).alias("reasons"))


_CLIP = "model LIKE 'clip-b32-%' AND model NOT LIKE '%-legacy' AND vec IS NOT NULL"


@query(
    "winner_min_scores",
    f"""WITH {_WINNER_SQL},
       e AS (SELECT asset_id, vec::DOUBLE[] AS vec FROM (SELECT DISTINCT asset_id, model, vec FROM asset_embedding WHERE {_CLIP})),
       m AS (SELECT won.cluster_id, won.id, won.wins, e.vec FROM won LEFT JOIN e ON e.asset_id = won.id),
       k AS (SELECT cluster_id FROM m GROUP BY 1 HAVING count(*) = count(vec) AND count(DISTINCT id) >= 2)
       SELECT a.cluster_id, round(min(list_cosine_similarity(a.vec, b.vec)), 6) AS cosine FROM m a JOIN k USING (cluster_id) JOIN m b ON b.cluster_id = a.cluster_id AND b.wins
       WHERE NOT a.wins AND list_sum(list_transform(a.vec, lambda x: x * x)) > 0 AND list_sum(list_transform(b.vec, lambda x: x * x)) > 0 AND NOT isnan(list_cosine_similarity(a.vec, b.vec)) GROUP BY 1""",
    "wall ledger members",
)
def winner_min_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cosine of any loser to the winner; void for the whole cluster if any vector is missing."""
    vectors = table(spark, sf_dir, "asset_embedding").where(_CLIP).select("asset_id", "model", "vec").distinct()
    rows = _with_winner(spark, sf_dir).select("cluster_id", "id", F.col("w.id").alias("winner"))
    held = rows.join(vectors.select(F.col("asset_id").alias("id"), "vec"), "id", "left")
    whole = held.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.count("vec").alias("k"), F.count_distinct("id").alias("ids")).where("n = k and ids >= 2")
    best = held.where("id = winner").select("cluster_id", F.col("vec").alias("won"))
    met = held.where("id <> winner").join(whole.select("cluster_id"), "cluster_id").join(best, "cluster_id")
    scored = met.withColumn("cosine", media.cosine(F.col("vec"), F.col("won"))).where("cosine is not null and not isnan(cosine)")
    return scored.groupBy("cluster_id").agg(F.round(F.min("cosine"), 6).alias("cosine"))


@query(
    "moved_without_collision",
    """WITH p AS (SELECT id, '/originals/' || coalesce(strftime(make_timestamp(epoch * 1000000), '%Y/%m'), 'unknown-date') AS dir, regexp_extract(path, '[^/]*$') AS f FROM ledger WHERE status = 'decided'),
       n AS (SELECT *, row_number() OVER (PARTITION BY dir, lower(f) ORDER BY id) AS k FROM p)
       SELECT id, dir || '/' || CASE WHEN k = 1 THEN f ELSE regexp_replace(f, '[.][^.]*$', '') || '_' || k || regexp_extract(f, '[.][^.]*$') END AS dest FROM n""",
    "wall ledger",
)
def moved_without_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Destinations of decided files; names that meet in a folder get a number, in order of id."""
    rows = ledger(spark, sf_dir).where("status = 'decided'")
    month = F.coalesce(F.date_format(F.timestamp_seconds("epoch"), "yyyy/MM"), F.lit("unknown-date"))
    placed = rows.select("id", F.concat_ws("/", F.lit("/originals"), month).alias("dir"), text.file_name(F.col("path")).alias("f"))
    k = F.row_number().over(Window.partitionBy("dir", F.lower("f")).orderBy("id"))
    numbered = F.concat(F.regexp_replace("f", r"\.[^.]*$", ""), F.lit("_"), F.col("k").cast("string"), F.regexp_extract("f", r"(\.[^.]*)$", 1))
    return placed.withColumn("k", k).select("id", F.concat_ws("/", "dir", F.when(F.col("k") == 1, F.col("f")).otherwise(numbered)).alias("dest"))


@query(
    "verdict_maps",
    """WITH v AS (SELECT parent, verdict, count(*) AS n FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS parent, status AS verdict FROM (SELECT DISTINCT id, path, status FROM asset)) GROUP BY ALL)
       SELECT parent AS folder, sum(n)::BIGINT AS total, array_to_string(list(verdict || '=' || n ORDER BY verdict), ',') AS verdicts FROM v GROUP BY 1""",
)
def verdict_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each folder with the number of each verdict, as one map."""
    rows = table(spark, sf_dir, "asset").select("id", "path", "status").distinct()
    counts = rows.groupBy(text.parent_dir(F.col("path")).alias("folder"), F.col("status").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat_ws("=", "verdict", F.col("n").cast("string"))
    return counts.groupBy("folder").agg(F.sum("n").alias("total"), F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("verdicts"))


@query(
    "twin_digests",
    """WITH s AS (SELECT lang, md5(text) AS d, doc_id % 3 * 10 AS lens, doc_id FROM documents WHERE text IS NOT NULL)
       SELECT lang, d AS digest, arg_min(doc_id, (lens, doc_id)) AS keep, count(*) AS files FROM s GROUP BY ALL HAVING count(*) > 1""",
)
def twin_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files with one digest, the one of the first lens is kept; files that differ are left alone."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("lang", F.md5("text").alias("digest"), (F.col("doc_id") % 3 * 10).alias("lens"), "doc_id")
    grouped = rows.groupBy("lang", "digest").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("lens", "doc_id")).alias("k"))
    return grouped.where("files > 1").select("lang", "digest", F.col("k.doc_id").alias("keep"), "files")


@query(
    "band_page",
    """WITH m AS (SELECT m.cluster_id, min(l.taken_at) AS first_taken FROM members m JOIN ledger l ON l.id = m.asset_id GROUP BY 1)
       SELECT c.id AS cluster_id, coalesce(first_taken, '9999') AS first_taken FROM (SELECT DISTINCT id, clip_cos_sim, decision FROM dedup_cluster) c LEFT JOIN m ON m.cluster_id = c.id
       WHERE decision = 'review' AND clip_cos_sim >= 0.8 AND clip_cos_sim < 0.9 ORDER BY 2, 1 LIMIT 24""",
    "wall ledger members",
)
def band_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a band of scores under review, by earliest capture: the page size is the feature."""
    clusters = table(spark, sf_dir, "dedup_cluster").where("decision = 'review' and clip_cos_sim >= 0.8 and clip_cos_sim < 0.9")
    taken = members(spark, sf_dir).join(ledger(spark, sf_dir).select(F.col("id").alias("asset_id"), "taken_at"), "asset_id").groupBy("cluster_id").agg(F.min("taken_at").alias("first_taken"))
    rows = clusters.select(F.col("id").alias("cluster_id")).distinct().join(taken, "cluster_id", "left")
    return rows.select("cluster_id", F.coalesce("first_taken", F.lit("9999")).alias("first_taken")).orderBy("first_taken", "cluster_id").limit(24)


@query(
    "positive_faces",
    """SELECT l_orderkey, l_linenumber, round(l_quantity / 100, 6) AS x1, round((l_quantity + 10) / 100, 6) AS x2 FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity, l_suppkey, l_partkey FROM lineitem)
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') AND l_quantity > 0 AND l_partkey % 5 > 0""",
)
def positive_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of a set of assets as parts of the picture; pictures without a size give none."""
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_partkey").distinct()
    faces = rows.where("l_quantity > 0").join(wanted, "l_orderkey", "left_semi")
    side = F.when(F.col("l_partkey") % 5 > 0, 100).otherwise(0)
    box = video.unit_box(F.col("l_quantity"), F.lit(0), F.col("l_quantity") + 10, F.lit(10), side, side)
    return faces.select("l_orderkey", "l_linenumber", box.alias("b")).where("b is not null").select(
        "l_orderkey", "l_linenumber", F.round("b.x1", 6).alias("x1"), F.round("b.x2", 6).alias("x2")
    )


def _kinds_sql() -> str:
    """The SQL of instants, for the first text of each candidate only, with its kind."""
    whole = PROBLEM_SQL["p4_found"]
    before, rest = whole.split(" own AS (", 1)
    after = "names AS (" + rest.split("names AS (", 1)[1]
    steps, last = after.rsplit("SELECT DISTINCT candidate_id, utc_second FROM (", 1)
    own = " own AS (SELECT c.candidate_id, c.tz_name, a.secs, a.fixed FROM c JOIN q a ON a.t = c.date_time_original),\n        "
    last = last.replace("SELECT candidate_id, CASE WHEN fixed", "SELECT candidate_id, CASE WHEN fixed THEN 'utc' ELSE 'local' END AS kind, CASE WHEN fixed", 1)
    return before + own + steps + "SELECT DISTINCT candidate_id, kind, utc_second AS instant FROM (" + last


SQL["capture_kinds"] = _kinds_sql()
