"""Queries of the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, geo, hashing, maps, media, text
from ..session import Scratch, table
from .registry import ledger, query


@query(
    "stems",
    """SELECT id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')), '-(edited|effects)$', ''),
           '[(][0-9]+[)]$', ''), ' ._-') AS stem, regexp_replace(path, '/[^/]*$', '') AS folder, lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS ext
       FROM ledger""",
    "wall ledger",
)
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return table(spark, sf_dir, "asset").distinct().select(
        "id", text.normalized_stem(path).alias("stem"), text.parent_dir(path).alias("folder"), text.extension(path).alias("ext")
    )


@query(
    "invented_cues",
    """WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Thanks for  watching!' WHEN 1 THEN '«Music»' WHEN 2 THEN event_type
           WHEN 3 THEN 'Subtitles by the team' ELSE ' ... ' END AS cue FROM events),
       n AS (SELECT event_id, lower(trim(regexp_replace(cue, '\\s+', ' ', 'g'), ' .,!?…"''«»“”‘’()[]')) AS k FROM c)
       SELECT event_id, (k = '' OR regexp_matches(k, '^thanks? for watching$|^subtitles by\\b.*|^music$')) AS invented FROM n""",
)
def invented_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 5
    cue = (
        F.when(turn == 0, "Thanks for  watching!").when(turn == 1, "«Music»").when(turn == 2, F.col("event_type"))
        .when(turn == 3, "Subtitles by the team").otherwise(" ... ")
    )
    return table(spark, sf_dir, "events").select("event_id", text.is_invented_cue(cue).alias("invented"))


@query(
    "excerpts",
    """SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(regexp_replace(left(t, 120), ' [^ ]*$', ''), ' .,;:!?') || '…' END AS excerpt
       FROM (SELECT doc_id, trim(text) AS t FROM documents)""",
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), 120).alias("excerpt"))


@query(
    "plain_cues",
    """SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x)),
           lambda x: x <> '' AND NOT contains(x, '-->') AND NOT regexp_full_match(x, '[0-9]+')), ' ') AS spoken FROM documents WHERE contains(text, '-->')""",
)
def plain_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "documents").where(F.col("text").contains("-->"))
    return cues.select("doc_id", text.cue_plaintext(F.col("text")).alias("spoken"))


@query(
    "cue_times",
    """WITH m AS (SELECT event_id, round_even(greatest(value, 0) * 1000, 0)::BIGINT AS ms FROM events)
       SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS shown FROM m""",
)
def cue_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.format_cue_time(F.col("value")).alias("shown"))


@query("collapsed_words")
def collapsed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word runs inside each document, collapsed (no SQL: a fold over words; tested against plain Python)."""
    looped = F.concat_ws(" ", F.col("text"), F.array_join(F.array_repeat(F.lit("again,"), F.col("doc_id").cast("int") % 9), " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapse_word_runs(looped).cast("binary")).alias("digest"))


@query("word_ratios")
def word_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word similarity of each caption and the next one (no SQL: Ratcliff-Obershelp)."""
    docs = table(spark, sf_dir, "documents").where("lower(trim(source)) = 'caption' and doc_id is not null")
    pairs = _with_next(docs.select("doc_id", "text").distinct())
    return pairs.select("doc_id", media.word_ratio(F.lower("text"), F.lower("next.text")).alias("ratio"))


def _with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next of every row but the last, in order of doc_id; no window runs over the table.

    The rows are cut into ranges of doc_id; the last row of a range gets the first row of the following range.
    """
    blocks = docs.repartitionByRange("doc_id").withColumn("block", F.spark_partition_id())
    rows = Scratch(docs.sparkSession, "ordered").keep(blocks, "blocks")
    one = F.struct("doc_id", "text")
    inside = rows.withColumn("next", F.lead(one).over(Window.partitionBy("block").orderBy("doc_id", "text")))
    firsts = rows.groupBy("block").agg(F.min(one).alias("first"))
    carried = firsts.select("block", F.lead("first").over(Window.partitionBy().orderBy("block")).alias("carried"))
    joined = inside.join(F.broadcast(carried), "block").withColumn("next", F.coalesce("next", "carried"))
    return joined.where("next is not null").select("doc_id", "text", "next")


@query(
    "human_sizes",
    """SELECT id, CASE WHEN bytes >= 1073741824 THEN printf('%.1f GB', round(bytes / 1073741824.0::DOUBLE, 1)) WHEN bytes >= 1048576 THEN printf('%.1f MB', round(bytes / 1048576.0::DOUBLE, 1))
           WHEN bytes >= 1024 THEN printf('%.1f KB', round(bytes / 1024.0::DOUBLE, 1)) ELSE bytes || ' B' END AS size FROM ledger WHERE bytes IS NOT NULL""",
    "wall ledger",
)
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").where("bytes is not null").select("id", "bytes").distinct()
    return rows.select("id", text.human_bytes(F.col("bytes")).alias("size"))


@query(
    "make_models",
    """SELECT s_suppkey AS id, CASE WHEN starts_with(lower(md), lower(mk)) THEN md ELSE mk || ' ' || md END AS camera FROM (
           SELECT s_suppkey, n_name AS mk, CASE WHEN s_suppkey % 2 = 0 THEN n_name || ' Pro' ELSE s_name END AS md FROM supplier JOIN nation ON n_nationkey = s_nationkey)""",
)
def make_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey"
    )
    model = F.when(F.col("s_suppkey") % 2 == 0, F.concat("n_name", F.lit(" Pro"))).otherwise(F.col("s_name"))
    return rows.select(F.col("s_suppkey").alias("id"), text.join_make_model(F.col("n_name"), model).alias("camera"))


@query(
    "exif_dates",
    """WITH h AS (SELECT id, left(replace(trim(taken_at), '/', ':'), 19) AS t FROM (SELECT DISTINCT id, taken_at FROM asset) WHERE taken_at IS NOT NULL)
       SELECT id, epoch(coalesce(CASE WHEN regexp_matches(t, '^[0-9]{4}:[0-9]{2}:[0-9]{2} ') THEN try_strptime(t, '%Y:%m:%d %H:%M:%S') END,
           CASE WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') THEN try_strptime(t, '%Y-%m-%dT%H:%M:%S') END))::BIGINT AS secs FROM h""",
)
def exif_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").where("taken_at is not null").select("id", "taken_at").distinct()
    return rows.select("id", F.unix_seconds(dates.exif_timestamp(F.col("taken_at"))).alias("secs"))


@query(
    "date_authority",
    """WITH a AS (SELECT DISTINCT id, path, taken_at, taken_src, mtime FROM asset),
       h AS (SELECT *, left(replace(trim(taken_at), '/', ':'), 19) AS t FROM a),
       d AS (SELECT *, coalesce(CASE WHEN regexp_matches(t, '^[0-9]{4}:[0-9]{2}:[0-9]{2} ') THEN try_strptime(t, '%Y:%m:%d %H:%M:%S') END,
           CASE WHEN regexp_matches(t, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T') THEN try_strptime(t, '%Y-%m-%dT%H:%M:%S') END) AS e FROM h),
       c AS (SELECT *, CASE WHEN taken_src = 'exif' AND year(e) BETWEEN 1990 AND 2027 THEN 'exif' WHEN taken_src = 'json' AND year(e) BETWEEN 1990 AND 2027 THEN 'companion'
           WHEN mtime IS NOT NULL THEN 'mtime' END AS src FROM d)
       SELECT id, src AS source, CASE WHEN src = 'mtime' THEN floor(mtime)::BIGINT ELSE epoch(e)::BIGINT END AS secs FROM c""",
)
def date_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "path", "taken_at", "taken_src", "mtime").distinct()
    stamp = dates.exif_timestamp(F.col("taken_at"))
    picked = dates.capture_authority(
        [
            ("exif", F.when(F.col("taken_src") == "exif", stamp)),
            ("companion", F.when(F.col("taken_src") == "json", stamp)),
        ],
        ("mtime", F.timestamp_seconds(F.floor("mtime"))),
        2027,
    )
    return rows.withColumn("a", picked).select("id", F.col("a.source").alias("source"), F.unix_seconds("a.dt").alias("secs"))


@query(
    "date_ranges",
    """WITH c AS (SELECT o_custkey AS k, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1)
       SELECT k AS cust_key, CASE WHEN a::DATE = b::DATE THEN strftime(a, '%-d %b %Y') WHEN year(a) = year(b) AND month(a) = month(b) THEN strftime(a, '%-d') || '–' || strftime(b, '%-d %b %Y')
           WHEN year(a) = year(b) THEN strftime(a, '%-d %b') || ' – ' || strftime(b, '%-d %b %Y') ELSE strftime(a, '%-d %b %Y') || ' – ' || strftime(b, '%-d %b %Y') END AS shown FROM c""",
)
def date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust_key")).agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")
    )
    return spans.select("cust_key", dates.date_range_name(F.col("a"), F.col("b")).alias("shown"))


@query(
    "offsets_shown",
    """SELECT event_id, CASE WHEN s < 0 THEN '-' ELSE '+' END || printf('%02d:%02d', abs(s) // 3600, abs(s) // 60 % 60) AS zone,
           CASE WHEN s < 0 THEN '-' ELSE '+' END || printf('%02dh%02dm', abs(s) // 3600, abs(s) // 60 % 60) AS delta FROM (
           SELECT event_id, (event_id % 53 - 26) * 900 AS s FROM events)""",
)
def offsets_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.col("event_id") % 53 - 26) * 900
    return table(spark, sf_dir, "events").select(
        "event_id", dates.format_offset(size).alias("zone"), dates.format_delta(size).alias("delta")
    )


@query(
    "geo_scalars",
    """SELECT id, floor(gps_lat / 0.001::DOUBLE)::BIGINT AS cell_lat, floor(gps_lon / 0.001::DOUBLE)::BIGINT AS cell_lon,
           round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(48.0 - gps_lat) / 2), 2) + cos(radians(gps_lat)) * cos(radians(48.0)) * pow(sin(radians(2.0 - gps_lon) / 2), 2)))), 5) AS km,
           abs(gps_lat) < 0.001 AND abs(gps_lon) < 0.001 AS near_null, gps_lat = 0 AND gps_lon = 0 AS at_null
       FROM ledger WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL AND abs(gps_lat) <= 90 AND abs(gps_lon) <= 180""",
    "wall ledger",
)
def geo_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("gps_lat"), F.col("gps_lon")
    rows = table(spark, sf_dir, "asset").select("id", "gps_lat", "gps_lon").distinct().where((F.abs(lat) <= 90) & (F.abs(lon) <= 180))
    return rows.select(
        "id",
        geo.geo_cell(lat).alias("cell_lat"),
        geo.geo_cell(lon).alias("cell_lon"),
        F.round(geo.haversine_km(lat, lon, F.lit(48.0), F.lit(2.0)), 5).alias("km"),
        geo.near_null_island(lat, lon).alias("near_null"),
        geo.at_null_island(lat, lon).alias("at_null"),
    )


@query(
    "hash_scalars",
    """SELECT id, sha1('path:' || path) AS path_sum, lower(printf('%016x', phash)) AS hex, phash AS back FROM ledger WHERE phash IS NOT NULL AND phash >= 0""",
    "wall ledger",
)
def hash_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").where("phash >= 0").select("id", "path", "phash").distinct()
    shown = media.hash_to_hex(F.col("phash"))
    return rows.select(
        "id", hashing.path_checksum(F.col("path").cast("binary")).alias("path_sum"), shown.alias("hex"), media.hash_from_hex(shown).alias("back")
    )


@query(
    "shape_scalars",
    """WITH s AS (SELECT a.id, a.width AS w1, a.height AS h1, b.width AS w2, b.height AS h2 FROM ledger a JOIN members m ON m.asset_id = a.id
           JOIN (SELECT cluster_id, min(asset_id) AS head FROM members x JOIN ledger y ON y.id = x.asset_id GROUP BY 1) h USING (cluster_id) JOIN ledger b ON b.id = h.head)
       SELECT DISTINCT id, w1, h1, w2, h2, CASE WHEN w1 > 0 AND h1 > 0 AND w2 > 0 AND h2 > 0
           THEN round(abs(w1 / h1::DOUBLE - w2 / h2::DOUBLE) / greatest(w1 / h1::DOUBLE, w2 / h2::DOUBLE), 6) ELSE 0 END AS change,
           coalesce(w1 > 0 AND h1 > 0 AND w2 > 0 AND h2 > 0 AND abs(w1 - h2) / greatest(w1, h2)::DOUBLE < 0.03 AND abs(h1 - w2) / greatest(h1, w2)::DOUBLE < 0.03, false) AS swapped FROM s""",
    "wall ledger members",
)
def shape_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import members

    known = table(spark, sf_dir, "asset").select("id", "width", "height").distinct()
    linked = members(spark, sf_dir).withColumnRenamed("asset_id", "id").join(known, "id")
    heads = linked.groupBy("cluster_id").agg(F.min_by("width", "id").alias("w2"), F.min_by("height", "id").alias("h2"))
    both = linked.join(heads, "cluster_id").withColumnsRenamed({"width": "w1", "height": "h1"})
    dims = [F.col(c) for c in ("w1", "h1", "w2", "h2")]
    return both.select(
        "id", "w1", "h1", "w2", "h2",
        F.round(media.aspect_change(*dims), 6).alias("change"), media.is_rotation_swap(*dims).alias("swapped"),
    ).distinct()


@query(
    "bitrate_targets",
    """SELECT p_partkey AS id, round((p_retailprice * 60000) / (p_size * 100.0::DOUBLE * 1080 * 30), 6) AS bpp,
           greatest(round_even(p_size * 100.0::DOUBLE * 1080 * 30 * 0.06 / 500000, 0), 1)::BIGINT * 500000 AS target,
           CASE WHEN (p_retailprice * 60000) / (p_size * 100.0::DOUBLE * 1080 * 30) < 0.15 THEN 'fine'
                WHEN (p_retailprice * 60000) / (p_size * 100.0::DOUBLE * 1080 * 30) < 0.3 THEN 'fat' ELSE 'obscene' END AS tier FROM part""",
)
def bitrate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, high, fps = F.col("p_size") * 100.0, F.lit(1080), F.lit(30)
    bpp = media.bits_per_pixel(F.col("p_retailprice") * 60000, wide, high, fps)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.round(bpp, 6).alias("bpp"),
        media.target_bitrate(wide, high, fps).alias("target"),
        F.when(bpp < 0.15, "fine").when(bpp < 0.3, "fat").otherwise("obscene").alias("tier"),
    )


@query(
    "tag_maps",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_type END ELSE user_id::VARCHAR END AS first_tag,
           CASE WHEN event_id % 3 = 0 THEN 3 ELSE 2 END AS merged FROM events""",
)
def tag_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First present tag, where a present null wins, and a merge that keeps existing tags."""
    always = F.create_map(F.lit("XMP:B"), F.col("user_id").cast("string"))
    extra = F.create_map(F.lit("XMP:A"), F.when(F.col("event_id") % 2 == 1, F.col("event_type")))
    tags = F.when(F.col("event_id") % 3 == 0, F.map_concat(always, extra)).otherwise(always)
    sidecar = F.create_map(F.lit("XMP:B"), F.lit("other"), F.lit("XMP:C"), F.lit("new"), F.lit("EXIF:D"), F.lit("not merged"))
    rows = table(spark, sf_dir, "events").select("event_id", tags.alias("tags"), sidecar.alias("sidecar"))
    return rows.select(
        "event_id",
        maps.first_present(F.col("tags"), "XMP:A", "XMP:B").alias("first_tag"),
        F.size(maps.merge_missing(F.col("tags"), F.col("sidecar"), "XMP:")).alias("merged"),
    )


@query(
    "json_props",
    """SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, try_cast(event_type AS BIGINT) AS bad, floor(value)::BIGINT AS whole FROM events""",
)
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.from_json("props", "k bigint")["k"].alias("k"),
        F.col("event_type").try_cast("bigint").alias("bad"),
        F.floor("value").alias("whole"),
    )


@query(
    "missing_tags",
    """WITH t AS (SELECT l.cluster_id, list_sort(list(DISTINCT CASE WHEN asset_id % 2 = 0 THEN 'Gear/Drone' ELSE 'Gear/Phone' END)) AS have FROM members l GROUP BY 1)
       SELECT cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 'Place/Home' ELSE 'Place/Home,Family' END AS missing FROM t""",
    "members",
)
def missing_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .registry import members

    tag = F.when(F.col("asset_id") % 2 == 0, "Gear/Drone").otherwise("Gear/Phone")
    have = members(spark, sf_dir).groupBy("cluster_id").agg(F.sort_array(F.collect_set(tag)).alias("have"))
    base = F.array(F.lit("Gear/Drone"), F.lit("Place/Home"))
    wanted = F.when(F.col("cluster_id") % 2 == 0, base).otherwise(F.concat(base, F.array(F.lit("Family"))))
    return have.select("cluster_id", F.array_join(maps.missing_tags(wanted, F.col("have")), ",").alias("missing"))


@query("capture_kinds")
def capture_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local wall clock and instant of each candidate by kind (no SQL: zone rules of the JVM)."""
    from ..operators.timestamps import parsed, resolve_instants

    rows = table(spark, sf_dir, "date_candidate").select("candidate_id", "tz_name", parsed(F.col("date_time_original")).alias("p")).distinct()
    known = resolve_instants(rows.where("p is not null"), "p", "tz_name", "instant")
    return known.select("candidate_id", F.when(F.col("p.fixed"), "utc").otherwise("local").alias("kind"), "instant")


@query(
    "promote_paths",
    """SELECT id, '/originals/' || coalesce(strftime(make_timestamp(epoch * 1000000), '%Y/%m'), 'unknown-date') || '/' || regexp_extract(path, '[^/]*$') AS dest FROM ledger WHERE status = 'decided'""",
    "wall ledger",
)
def promote_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a decided file goes: the plan of the move, by year and month of capture."""
    rows = ledger(spark, sf_dir).where("status = 'decided'")
    month = F.coalesce(F.date_format(F.timestamp_seconds("epoch"), "yyyy/MM"), F.lit("unknown-date"))
    return rows.select("id", F.concat_ws("/", F.lit("/originals"), month, text.file_name(F.col("path"))).alias("dest"))
