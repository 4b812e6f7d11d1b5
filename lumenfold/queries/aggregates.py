"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media
from ..functions.text import extension, file_name, file_stem, parent_dir
from ..operators.robust import dominant, fenced_bounds, first_seen_mode, index_percentile, trip_summary, vote
from ..session import table
from .registry import ledger, members, pings, query


@query("status_counts", "SELECT source, status, count(*) AS n FROM ledger GROUP BY ALL", "wall ledger")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "source", "status").distinct()
    return rows.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


@query("decision_counts", "SELECT decision, count(DISTINCT id) AS n FROM dedup_cluster GROUP BY ALL")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dedup_cluster").groupBy("decision").agg(F.count_distinct("id").alias("n"))


@query(
    "having_images",
    """SELECT m.cluster_id, count(*) AS images FROM members m JOIN ledger l ON l.id = m.asset_id
       JOIN (SELECT DISTINCT id, decision FROM dedup_cluster) c ON c.id = m.cluster_id
       WHERE l.media_type = 'image' AND c.decision IN ('pending', 'review') GROUP BY 1 HAVING count(*) >= 2""",
    "wall ledger members",
)
def having_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "asset").where("media_type = 'image'").select(F.col("id").alias("asset_id")).distinct()
    open_clusters = table(spark, sf_dir, "dedup_cluster").where("decision in ('pending', 'review')").select(
        F.col("id").alias("cluster_id")
    ).distinct()
    met = members(spark, sf_dir).join(open_clusters, "cluster_id").join(images, "asset_id")
    return met.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("images")).where("images >= 2")


@query("cluster_ids", "SELECT DISTINCT cluster_id FROM membership")
def cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "membership").select("cluster_id").distinct()


@query(
    "mode_first_seen",
    """WITH c AS (SELECT device_id, city, count(*) AS n, min(shot_when) AS seen, arg_min(point_id, (shot_when, point_id)) AS p
           FROM (SELECT DISTINCT * FROM asset_point) WHERE city IS NOT NULL GROUP BY ALL)
       SELECT device_id, city AS mode, n FROM (SELECT *, row_number() OVER (
           PARTITION BY device_id ORDER BY n DESC, seen, p, city) AS r FROM c) WHERE r = 1""",
)
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "asset_point").select("device_id", "point_id", "shot_when", "city", "lat", "lon", "country", "received_at").distinct()
    return first_seen_mode(points, ["device_id"], "city", ["shot_when", "point_id"])


@query(
    "centroids",
    "SELECT device_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM pings GROUP BY 1",
    "pings",
)
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pings(spark, sf_dir).groupBy("device_id").agg(
        F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon")
    )


@query(
    "order_medians",
    """SELECT c_nationkey AS nation_key, round(median(o_totalprice), 4) AS median_price FROM orders
       JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def order_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey"
    )
    return joined.groupBy(F.col("c_nationkey").alias("nation_key")).agg(
        F.round(F.median("o_totalprice"), 4).alias("median_price")
    )


@query(
    "index_percentiles",
    """WITH r AS (SELECT l_suppkey, l_extendedprice AS x, count(*) OVER w AS n,
           row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))
       SELECT l_suppkey, max(CASE WHEN i = least(n - 1, floor(n * 0.9)::BIGINT) THEN x END) AS percentile FROM r GROUP BY 1""",
)
def index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_percentile(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.9)


@query(
    "iqr_bounds",
    """WITH r AS (SELECT cluster_id, epoch AS x, count(*) OVER (PARTITION BY cluster_id) AS n,
           row_number() OVER (PARTITION BY cluster_id ORDER BY epoch) - 1 AS i
           FROM members m JOIN ledger l ON l.id = m.asset_id WHERE epoch IS NOT NULL),
       q AS (SELECT cluster_id, max(n) AS n, max(CASE WHEN i = n // 4 THEN x END) AS q1,
           max(CASE WHEN i = 3 * n // 4 THEN x END) AS q3 FROM r GROUP BY 1),
       k AS (SELECT r.*, (r.n < 4 OR x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS kept FROM r JOIN q USING (cluster_id))
       SELECT cluster_id, coalesce(min(x) FILTER (kept), min(x)) AS low, coalesce(max(x) FILTER (kept), max(x)) AS high FROM k GROUP BY 1""",
    "wall ledger members",
)
def iqr_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = members(spark, sf_dir).join(ledger(spark, sf_dir).select(F.col("id").alias("asset_id"), "epoch"), "asset_id")
    return fenced_bounds(dated, ["cluster_id"], "epoch")


_TRIP = "regexp_extract({path}, '(t[0-9]{{6}})', 1)"


@query(
    "trip_summaries",
    """WITH m AS (SELECT regexp_extract(path, '(t[0-9]{6})', 1) AS trip, epoch AS t,
           CASE WHEN fix THEN gps_lat END AS lat, CASE WHEN fix THEN gps_lon END AS lon FROM ledger),
       r AS (SELECT trip, t AS x, count(*) OVER (PARTITION BY trip) AS n, row_number() OVER (PARTITION BY trip ORDER BY t) - 1 AS i
           FROM m WHERE t IS NOT NULL),
       q AS (SELECT trip, max(CASE WHEN i = n // 4 THEN x END) AS q1, max(CASE WHEN i = 3 * n // 4 THEN x END) AS q3 FROM r GROUP BY 1),
       k AS (SELECT r.*, (r.n < 4 OR x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS kept FROM r JOIN q USING (trip)),
       b AS (SELECT trip, coalesce(min(x) FILTER (kept), min(x)) AS s, coalesce(max(x) FILTER (kept), max(x)) AS e FROM k GROUP BY 1),
       c AS (SELECT trip, median(lat) AS lat, median(lon) AS lon FROM m WHERE lat IS NOT NULL GROUP BY 1),
       a AS (SELECT trip, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(m.lat - c.lat) / 2), 2)
           + cos(radians(c.lat)) * cos(radians(m.lat)) * pow(sin(radians(m.lon - c.lon) / 2), 2)))) AS km
           FROM m JOIN c USING (trip) WHERE m.lat IS NOT NULL),
       p AS (SELECT trip, km, count(*) OVER (PARTITION BY trip) AS n, row_number() OVER (PARTITION BY trip ORDER BY km) - 1 AS i FROM a),
       z AS (SELECT trip, max(CASE WHEN i = least(n - 1, floor(n * 0.9)::BIGINT) THEN km END) AS km FROM p GROUP BY 1)
       SELECT t.trip, b.s AS "start", b.e AS "end", round(c.lat, 8) AS lat, round(c.lon, 8) AS lon,
           round(coalesce(z.km, 0), 5) AS radius_km, t.n AS assets
       FROM (SELECT trip, count(*) AS n FROM m GROUP BY 1) t LEFT JOIN b USING (trip) LEFT JOIN c USING (trip) LEFT JOIN z USING (trip)""",
    "wall ledger",
)
def trip_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select(
        F.regexp_extract("path", r"(t[0-9]{6})", 1).alias("trip"),
        F.col("epoch").alias("t"),
        F.when(F.col("fix"), F.col("gps_lat")).alias("lat"),
        F.when(F.col("fix"), F.col("gps_lon")).alias("lon"),
    )
    found = trip_summary(rows, ["trip"])
    return found.select(
        "trip", "start", "end", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"),
        F.round("radius_km", 5).alias("radius_km"), "assets",
    )


@query(
    "vote_person",
    """WITH c AS (SELECT l_suppkey AS person, l_partkey % 7 AS choice, count(*) AS n FROM lineitem GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, choice) AS k, sum(n) OVER (PARTITION BY person)::BIGINT AS total FROM c)
       SELECT person, CASE WHEN n >= 3 AND n >= 0.16 * total THEN choice END AS winner, n AS votes, total FROM r WHERE k = 1""",
)
def vote_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), (F.col("l_partkey") % 7).alias("choice"))
    return vote(rows, ["person"], "choice", 3, 0.16)


@query(
    "vote_zone",
    """WITH z AS (SELECT a.source, d.tz_name, count(*) AS n FROM (SELECT DISTINCT candidate_id, asset_id, trim(tz_name) AS tz_name FROM date_candidate) d
           JOIN ledger a ON a.id = d.asset_id WHERE d.tz_name IS NOT NULL GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, tz_name) AS k FROM z),
       p AS (SELECT source, max(CASE WHEN k = 1 THEN tz_name END) AS a, max(CASE WHEN k = 1 THEN n END) AS m, max(CASE WHEN k = 2 THEN n END) AS q FROM r GROUP BY 1)
       SELECT source, CASE WHEN q IS NULL OR m >= 2 * q THEN a END AS winner FROM p""",
    "wall ledger",
)
def vote_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "date_candidate").select("candidate_id", F.col("asset_id").alias("id"), F.trim("tz_name").alias("tz_name")).distinct()
    known = table(spark, sf_dir, "asset").select("id", "source").distinct()
    return dominant(zones.join(known, "id"), ["source"], "tz_name", 2.0)


@query(
    "plurality_zone",
    """WITH z AS (SELECT source, trim(tz_name) AS zone, count(*) AS n FROM (SELECT DISTINCT * FROM date_candidate) WHERE tz_name IS NOT NULL GROUP BY ALL)
       SELECT source, zone, n || '/' || total AS reason FROM (SELECT *, sum(n) OVER (PARTITION BY source)::BIGINT AS total,
           row_number() OVER (PARTITION BY source ORDER BY n DESC, zone) AS k FROM z) WHERE k = 1""",
)
def plurality_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "date_candidate").distinct().select("source", F.trim("tz_name").alias("zone"))
    best = vote(rows, ["source"], "zone", 1, 0.0)
    return best.select("source", F.col("winner").alias("zone"), F.concat_ws("/", "votes", "total").alias("reason"))


@query(
    "cluster_min_scores",
    """WITH m AS (SELECT DISTINCT m.cluster_id, m.asset_id, e.vec::DOUBLE[] AS vec FROM members m JOIN ledger l ON l.id = m.asset_id
           LEFT JOIN (SELECT DISTINCT asset_id, model, vec FROM asset_embedding WHERE model LIKE 'clip-b32-%' AND model NOT LIKE '%-legacy' AND vec IS NOT NULL) e ON e.asset_id = m.asset_id),
       w AS (SELECT cluster_id, min(asset_id) AS head, count(*) AS n, count(vec) AS k FROM m GROUP BY 1),
       s AS (SELECT a.cluster_id, min(list_cosine_similarity(a.vec, b.vec)) AS cosine FROM m a JOIN w ON w.cluster_id = a.cluster_id AND w.n = w.k AND w.n >= 2
           JOIN m b ON b.cluster_id = a.cluster_id AND b.asset_id = w.head WHERE a.asset_id <> w.head
           AND list_sum(list_transform(a.vec, lambda x: x * x)) > 0 AND list_sum(list_transform(b.vec, lambda x: x * x)) > 0 GROUP BY 1)
       SELECT cluster_id, round(cosine, 6) AS cosine FROM s WHERE NOT isnan(cosine)""",
    "wall ledger members",
)
def cluster_min_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cosine to the first member; void for the whole cluster if any vector is missing."""
    vectors = table(spark, sf_dir, "asset_embedding").where("model like 'clip-b32-%' and model not like '%-legacy' and vec is not null").select("asset_id", "vec").distinct()
    known = table(spark, sf_dir, "asset").select(F.col("id").alias("asset_id")).distinct()
    rows = members(spark, sf_dir).join(known, "asset_id").join(vectors, "asset_id", "left").distinct()
    heads = rows.groupBy("cluster_id").agg(
        F.min("asset_id").alias("head"), F.min_by("vec", "asset_id").alias("head_vec"),
        F.count(F.lit(1)).alias("n"), F.count("vec").alias("k"),
    )
    met = rows.join(heads.where("n = k and n >= 2"), "cluster_id").where("asset_id <> head")
    scored = met.withColumn("cosine", media.cosine(F.col("vec"), F.col("head_vec")))
    return scored.groupBy("cluster_id").agg(F.round(F.min("cosine"), 6).alias("cosine")).where("cosine is not null and not isnan(cosine)")


@query(
    "camera_pivot",
    """SELECT source, format, count(*) AS n, min(epoch) AS first_at, max(epoch) AS last_at, count(*) FILTER (epoch IS NULL) AS undated,
           count(*) FILTER (NOT fix) AS unplaced, count(*) FILTER (abs(mtime - epoch) > 2592000) AS trapped, sum(bytes)::BIGINT AS bytes
       FROM ledger GROUP BY ALL""",
    "wall ledger",
)
def camera_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).groupBy("source", "format").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("epoch").alias("first_at"),
        F.max("epoch").alias("last_at"),
        F.count_if(F.col("epoch").isNull()).alias("undated"),
        F.count_if(~F.col("fix")).alias("unplaced"),
        F.count_if(F.abs(F.col("mtime") - F.col("epoch")) > 30 * 86400).alias("trapped"),
        F.sum("bytes").alias("bytes"),
    )


@query(
    "stem_pairs",
    """WITH s AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')) AS stem,
           list_sort(list(DISTINCT lower(regexp_extract(path, '[.]([^./]+)$', 1)))) AS exts FROM ledger GROUP BY ALL)
       SELECT array_to_string(exts, '+') AS exts, count(*) AS n FROM s WHERE len(exts) > 1 GROUP BY 1""",
    "wall ledger",
)
def stem_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "asset").select("id", "path").distinct()
    sets = files.groupBy(parent_dir(F.col("path")), F.lower(file_stem(F.col("path")))).agg(
        F.sort_array(F.collect_set(extension(F.col("path")))).alias("exts")
    )
    return sets.where(F.size("exts") > 1).groupBy(F.array_join("exts", "+").alias("exts")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "folder_report",
    """WITH f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, status, regexp_extract(path, '(t[0-9]{6})', 1) AS trip FROM ledger)
       SELECT folder, count(*) AS total, count(*) FILTER (status = 'quarantined') AS duplicates, count(DISTINCT trip) AS trips,
           count(DISTINCT trip) > 1 AS spans_multiple, array_to_string(list_sort(list(DISTINCT status)), ',') AS states FROM f GROUP BY 1""",
    "wall ledger",
)
def folder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "path", "status").distinct()
    trip = F.regexp_extract("path", r"(t[0-9]{6})", 1)
    return rows.groupBy(parent_dir(F.col("path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "quarantined").alias("duplicates"),
        F.count_distinct(trip).alias("trips"),
        (F.count_distinct(trip) > 1).alias("spans_multiple"),
        F.array_join(F.sort_array(F.collect_set("status")), ",").alias("states"),
    )


@query(
    "track_summary",
    """WITH s AS (SELECT DISTINCT * FROM srt_telemetry), o AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY clip_id, datetime_original) AS i FROM s)
       SELECT device_id, count(*) AS frames, count(*) FILTER (latitude IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)) AS fixes,
           arg_min(epoch_us(datetime_original) // 1000000, i) AS start_s, arg_max(epoch_us(datetime_original) // 1000000, i) AS end_s,
           min(altitude) AS alt_min, max(altitude) AS alt_max FROM o GROUP BY 1""",
)
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end are those of the first and last row in clip order, not the extremes."""
    rows = table(spark, sf_dir, "srt_telemetry").distinct()
    at = F.unix_seconds(F.col("datetime_original").cast("timestamp"))
    order = F.struct("clip_id", "datetime_original")
    valid = F.col("latitude").isNotNull() & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))
    return rows.groupBy("device_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(valid).alias("fixes"),
        F.min_by(at, order).alias("start_s"),
        F.max_by(at, order).alias("end_s"),
        F.min("altitude").alias("alt_min"),
        F.max("altitude").alias("alt_max"),
    )


@query(
    "trip_identity",
    """SELECT regexp_extract(path, '(t[0-9]{6})', 1) AS trip,
           coalesce(array_to_string(list_sort(list(DISTINCT strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d')) FILTER (epoch IS NOT NULL)), ','), '') AS dates,
           array_to_string(list_sort(list(DISTINCT upper(regexp_extract(regexp_extract(path, '[^/]*$'), '^([^0-9]{0,6})', 1)))), ',') AS prefixes
       FROM ledger GROUP BY 1""",
    "wall ledger",
)
def trip_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.upper(F.regexp_extract(file_name(F.col("path")), r"^([^0-9]{0,6})", 1))
    day = F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd")
    return ledger(spark, sf_dir).groupBy(F.regexp_extract("path", r"(t[0-9]{6})", 1).alias("trip")).agg(
        F.array_join(F.sort_array(F.collect_set(day)), ",").alias("dates"),
        F.array_join(F.sort_array(F.collect_set(head)), ",").alias("prefixes"),
    )


@query(
    "decision_band_cube",
    """WITH c AS (SELECT DISTINCT id, decision, CASE WHEN clip_cos_sim IS NULL THEN 'none' WHEN clip_cos_sim < 0.9 THEN 'low'
           WHEN clip_cos_sim < 0.98 THEN 'middle' ELSE 'high' END AS band FROM dedup_cluster)
       SELECT coalesce(decision, 'all') AS decision, coalesce(band, 'all') AS band, count(*) AS n FROM c GROUP BY CUBE (decision, band)""",
)
def decision_band_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("clip_cos_sim")
    band = F.when(score.isNull(), "none").when(score < 0.9, "low").when(score < 0.98, "middle").otherwise("high")
    rows = table(spark, sf_dir, "dedup_cluster").select("id", "decision", band.alias("band")).distinct()
    return rows.cube("decision", "band").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("decision", F.lit("all")).alias("decision"), F.coalesce("band", F.lit("all")).alias("band"), "n"
    )


@query(
    "twin_text_groups",
    """SELECT md5(text) AS digest, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def twin_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")


@query(
    "merge_counters",
    """SELECT source, sum(n_chars)::BIGINT AS chars, max(epoch_us(written_at) // 1000000) AS last_at, count(*) AS n,
           array_to_string(list_sort(list(DISTINCT lang) FILTER (lang IS NOT NULL)), ',') AS langs FROM documents GROUP BY 1""",
)
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.sum("n_chars").alias("chars"),
        F.max(F.unix_seconds(F.col("written_at").cast("timestamp"))).alias("last_at"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"),
    )


@query(
    "first_wins",
    """SELECT id, arg_min(path, (CASE source WHEN 'originals' THEN 0 WHEN 'icloud' THEN 1 ELSE 2 END, path)) AS path FROM (
           SELECT id, source, path FROM asset UNION ALL SELECT id, source, path FROM asset_inbox) GROUP BY 1""",
)
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First value per key across sources in order of precedence."""
    rows = table(spark, sf_dir, "asset").select("id", "source", "path").unionByName(
        table(spark, sf_dir, "asset_inbox").select("id", "source", "path")
    )
    place = F.when(F.col("source") == "originals", 0).when(F.col("source") == "icloud", 1).otherwise(2)
    return rows.groupBy("id").agg(F.min_by("path", F.struct(place, F.col("path"))).alias("path"))


@query(
    "review_queue",
    """SELECT DISTINCT id, clip_cos_sim FROM dedup_cluster WHERE decision = 'review' ORDER BY clip_cos_sim DESC NULLS LAST, id""",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "dedup_cluster").where("decision = 'review'").select("id", "clip_cos_sim").distinct()
        .orderBy(F.desc_nulls_last("clip_cos_sim"), "id")
    )


@query(
    "batch_page",
    """SELECT c.id, coalesce(min(l.epoch)::VARCHAR, '9999999999') AS earliest FROM (SELECT DISTINCT id FROM dedup_cluster WHERE decision = 'review') c
       JOIN members m ON m.cluster_id = c.id JOIN ledger l ON l.id = m.asset_id GROUP BY 1 ORDER BY 2, 1 LIMIT 24""",
    "wall ledger members",
)
def batch_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the review queue by earliest capture: the limit is the feature."""
    review = table(spark, sf_dir, "dedup_cluster").where("decision = 'review'").select(F.col("id").alias("cluster_id")).distinct()
    dated = ledger(spark, sf_dir).select(F.col("id").alias("asset_id"), "epoch")
    pages = members(spark, sf_dir).join(review, "cluster_id").join(dated, "asset_id").groupBy(F.col("cluster_id").alias("id")).agg(
        F.coalesce(F.min("epoch").cast("string"), F.lit("9999999999")).alias("earliest")
    )
    return pages.orderBy("earliest", "id").limit(24)


@query(
    "top2_zones",
    """WITH z AS (SELECT source, trim(tz_name) AS zone, count(*) AS n FROM (SELECT DISTINCT * FROM date_candidate) WHERE tz_name IS NOT NULL GROUP BY ALL)
       SELECT source, zone, n, r::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, zone) AS r FROM z) WHERE r <= 2""",
)
def top2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "date_candidate").distinct().where("tz_name is not null")
    counts = rows.groupBy("source", F.trim("tz_name").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "zone")
    return counts.withColumn("place", F.row_number().over(order)).where("place <= 2")


@query(
    "largest_first",
    """SELECT regexp_extract(path, '(t[0-9]{6})', 1) AS trip, sum(bytes)::BIGINT AS bytes FROM ledger GROUP BY 1 ORDER BY bytes DESC, trip""",
    "wall ledger",
)
def largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "asset").select("id", "path", "bytes").distinct()
    return rows.groupBy(F.regexp_extract("path", r"(t[0-9]{6})", 1).alias("trip")).agg(F.sum("bytes").alias("bytes")).orderBy(
        F.desc("bytes"), "trip"
    )


@query(
    "winner_scores",
    """WITH s AS (SELECT m.cluster_id, l.id, CASE l.source WHEN 'originals' THEN 120 WHEN 'icloud' THEN 100 WHEN 'google' THEN 30 ELSE 50 END
           + log10(coalesce(nullif(width, 0), 1)::DOUBLE * coalesce(nullif(height, 0), 1)) * 10 + log10(greatest(coalesce(bytes, 1), 1)::DOUBLE) * 5
           + coalesce(exif_fields, 0) * 2 + CASE WHEN format IN ('heic','heif','dng','cr2','cr3','arw','nef','raf','rw2','orf') THEN 20 ELSE 0 END AS score
           FROM members m JOIN ledger l ON l.id = m.asset_id)
       SELECT cluster_id, id AS winner_id, round(score, 3) AS score FROM (
           SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, id) AS r FROM s) WHERE r = 1""",
    "wall ledger members",
)
def winner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).join(table(spark, sf_dir, "asset").distinct().withColumnRenamed("id", "asset_id"), "asset_id")
    score = media.winner_score(*(F.col(c) for c in ("source", "width", "height", "bytes", "exif_fields", "format")))
    best = rows.withColumn("score", F.round(score, 9)).groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("score")).alias("low"), F.col("asset_id").alias("id"))).alias("best")
    )
    return best.select("cluster_id", F.col("best.id").alias("winner_id"), F.round(-F.col("best.low"), 3).alias("score"))
