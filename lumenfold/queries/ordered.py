"""Queries of the ordered, graph and decision operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, media
from ..functions.text import normalized_stem
from ..operators.components import components
from ..operators.decide import decide_clusters
from ..operators.place import place_items
from ..operators.range_join import range_join
from ..operators.robust import first_seen_mode, trip_summary
from ..operators.sessionize import event_sweep, gap_sessions, gaps_between, merge_intervals, repeated_runs
from ..session import table
from . import aggregates  # noqa: F401
from .joins import pair_evidence
from .registry import QUERIES, SQL, ledger, members, pings, query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")
    )


@query(
    "gap_sessions",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t FROM events),
       g AS (SELECT *, coalesce(t - lag(t) OVER w > 14400, true)::INT AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
       s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
       SELECT user_id, k::BIGINT AS session, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM s GROUP BY ALL""",
)
def gap_session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gap_sessions(_events(spark, sf_dir), ["user_id"], "t", 14400)
    return found.groupBy("user_id", "session").agg(
        F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n")
    )


@query(
    "session_windows",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t FROM events),
       g AS (SELECT *, coalesce(t - lag(t) OVER w > 14400, true)::INT AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
       s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
       SELECT user_id, min(t) AS first_t, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions by the built-in session window, whose merge is partial before the shuffle."""
    stamped = _events(spark, sf_dir).withColumn("at", F.timestamp_seconds("t"))
    grouped = stamped.groupBy("user_id", F.session_window("at", "14401 seconds")).agg(
        F.min("t").alias("first_t"), F.count(F.lit(1)).alias("n")
    )
    return grouped.select("user_id", "first_t", "n")


@query(
    "event_sweep",
    """WITH p AS (SELECT device_id, id, t, lat, lon, row_number() OVER (PARTITION BY device_id ORDER BY t, id) AS i FROM pings),
       s AS (SELECT device_id, i, id, id AS event, t, lat AS slat, lon AS slon, 1 AS n FROM p WHERE i = 1
             UNION ALL
             SELECT p.device_id, p.i, p.id, CASE WHEN x.cut THEN p.id ELSE s.event END, p.t,
                 CASE WHEN x.cut THEN p.lat ELSE s.slat + p.lat END, CASE WHEN x.cut THEN p.lon ELSE s.slon + p.lon END,
                 CASE WHEN x.cut THEN 1 ELSE s.n + 1 END
             FROM s JOIN p ON p.device_id = s.device_id AND p.i = s.i + 1,
             LATERAL (SELECT (p.t - s.t > 14400 OR 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - s.slat / s.n) / 2), 2)
                 + cos(radians(s.slat / s.n)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - s.slon / s.n) / 2), 2)))) > 5) AS cut) x)
       SELECT device_id, event, count(*) AS size FROM s GROUP BY ALL HAVING count(*) >= 3""",
    "pings",
    recursive=True,
)
def event_sweep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pings(spark, sf_dir).select("device_id", "id", "t", "lat", "lon")
    found = event_sweep(points, ["device_id"])
    return found.groupBy("device_id", "event").agg(F.count(F.lit(1)).alias("size"))


def _named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pings(spark, sf_dir).select("device_id", "id", "t", "lat", "lon")
    events = event_sweep(points, ["device_id"]).select("device_id", "id", "event")
    places = table(spark, sf_dir, "asset_point").select(F.col("point_id").alias("id"), "city", "country").distinct()
    return events.join(points.select("id", "t", "lat", "lon"), "id").join(places, "id")


@query("event_names")
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and stable key of each event: dominant place, date range, centre."""
    rows = _named_events(spark, sf_dir)
    city = first_seen_mode(rows, ["event"], "city", ["t", "id"]).select("event", F.col("mode").alias("city"))
    country = first_seen_mode(rows, ["event"], "country", ["t", "id"]).select("event", F.col("mode").alias("country"))
    spans = rows.groupBy("event").agg(
        F.timestamp_seconds(F.min("t")).alias("first"), F.timestamp_seconds(F.max("t")).alias("last"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
    )
    from ..functions.hashing import stable_key

    joined = spans.join(city, "event", "left").join(country, "event", "left")
    return joined.select(
        "event",
        dates.event_name(F.col("city"), F.col("country"), F.col("first"), F.col("last")).alias("name"),
        stable_key(F.col("lat"), F.col("lon"), F.col("first")).alias("key"),
    )


@query(
    "cue_loops",
    """WITH c AS (SELECT user_id, event_id, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 7 < 5 THEN 'same words' ELSE event_type END AS cue FROM events),
       m AS (SELECT *, CASE WHEN cue = '' OR cue IS DISTINCT FROM lag(cue) OVER w THEN 1 ELSE 0 END AS ch FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
       SELECT event_id, n AS run_length FROM (SELECT event_id, cue, count(*) OVER (PARTITION BY user_id, run) AS n,
           row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS i FROM r) WHERE cue <> '' AND n >= 3 AND i > 1""",
)
def cue_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of three or more equal cues but the first; the cues of a user stand in one file."""
    cue = (
        F.when(F.col("event_id") % 11 == 0, "")
        .when(F.col("event_id") % 7 < 5, "same words")
        .otherwise(F.col("event_type"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", cue.alias("cue"), F.col("user_id").alias("file"))
    return repeated_runs(rows, ["file"], "event_id", "cue", 3).where("in_loop").select("event_id", "run_length")


@query(
    "first_fixes",
    """SELECT device_id, arg_min(latitude, (datetime_original, clip_id)) AS latitude, arg_min(longitude, (datetime_original, clip_id)) AS longitude
       FROM (SELECT DISTINCT * FROM srt_telemetry) WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND datetime_original IS NOT NULL
       AND NOT (latitude = 0 AND longitude = 0) GROUP BY 1""",
)
def first_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "srt_telemetry").where(
        "latitude is not null and longitude is not null and datetime_original is not null and not (latitude = 0 and longitude = 0)"
    )
    order = F.struct("datetime_original", "clip_id")
    return rows.groupBy("device_id").agg(
        F.min_by("latitude", order).alias("latitude"), F.min_by("longitude", order).alias("longitude")
    )


@query(
    "speech_intervals",
    """WITH e AS (SELECT user_id AS track, (epoch_us(ts) // 1000000 - 1704067200)::DOUBLE AS s, (epoch_us(ts) // 1000000 - 1704067200 + 3600 + event_id % 7200)::DOUBLE AS e FROM events),
       w AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY track ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS o FROM e),
       i AS (SELECT *, sum(o) OVER (PARTITION BY track ORDER BY s, e) AS k FROM w),
       m AS (SELECT track, min(s) AS s, max(e) AS e FROM i GROUP BY track, k),
       t AS (SELECT track, max(e) + 1000 AS total FROM m GROUP BY 1),
       g AS (SELECT track, coalesce(lag(e) OVER (PARTITION BY track ORDER BY s), 0) AS s, s AS e FROM m
             UNION ALL SELECT track, total - 1000, total FROM t),
       p AS (SELECT g.track, greatest(g.s - 0.3, 0) AS s, least(g.e + 0.3, t.total) AS e FROM g JOIN t USING (track) WHERE g.e > g.s)
       SELECT track, count(*) AS regions, round(sum(e - s), 3) AS speech_s FROM p GROUP BY 1""",
)
def speech_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What silences leave of a track, padded and merged, and its total length."""
    start = (F.col("t") - 1704067200).cast("double")
    rows = _events(spark, sf_dir).select(
        F.col("user_id").alias("track"), start.alias("s"), (start + 3600 + F.col("event_id") % 7200).alias("e")
    )
    total = rows.groupBy("track").agg((F.max("e") + 1000).alias("total"))
    speech = gaps_between(rows.join(total, "track"), ["track"], "s", "e", "total", 0.3)
    return speech.groupBy("track").agg(
        F.count(F.lit(1)).alias("regions"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("speech_s")
    )


@query(
    "rapid_series",
    """SELECT m.cluster_id FROM members m JOIN ledger l ON l.id = m.asset_id GROUP BY 1
       HAVING count(epoch) >= 3 AND max(epoch) - min(epoch) <= 1
       AND count(DISTINCT coalesce(width::VARCHAR, '?') || 'x' || coalesce(height::VARCHAR, '?')) = 1""",
    "wall ledger members",
)
def rapid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).join(ledger(spark, sf_dir).withColumnRenamed("id", "asset_id"), "asset_id")
    return rows.groupBy("cluster_id").agg(
        F.count("epoch").alias("dated"), (F.max("epoch") - F.min("epoch")).alias("spread"),
        F.count_distinct(F.struct("width", "height")).alias("shapes"),
    ).where("dated >= 3 and spread <= 1 and shapes = 1").select("cluster_id")


@query(
    "renumbered_cues",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS cue FROM events WHERE event_type <> 'error'""",
)
def renumbered_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "events").where("event_type <> 'error'")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return kept.select("user_id", "event_id", F.row_number().over(order).alias("cue"))


_COMPONENT_SQL = """both_ways AS (SELECT id_a AS a, id_b AS b FROM evidence UNION SELECT id_b, id_a FROM evidence),
    reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)"""


def _evidence_sql() -> str:
    return SQL["pair_evidence"][len("WITH ") :].rpartition("SELECT * FROM pairs")[0].rstrip()


@query("evidence_components")
def evidence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of assets linked by pair evidence; assets without evidence are in none."""
    return components(pair_evidence(spark, sf_dir), "id_a", "id_b")


SQL["evidence_components"] = (
    f"WITH RECURSIVE {_evidence_sql()},\nevidence AS (SELECT id_a, id_b FROM pairs WHERE evidence IS NOT NULL),\n"
    f"{_COMPONENT_SQL}\nSELECT node, min(seen) AS component FROM reach GROUP BY node"
)


@query("merged_clusters")
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New evidence merged into existing clusters: the smallest touched cluster id stays."""
    grouped = components(pair_evidence(spark, sf_dir), "id_a", "id_b")
    old = members(spark, sf_dir).select(F.col("asset_id").alias("node"), "cluster_id")
    touched = grouped.join(old, "node", "left").groupBy("component").agg(
        F.min("cluster_id").alias("cluster_id"), F.count_distinct("cluster_id").alias("merged"), F.count_distinct("node").alias("nodes")
    )
    return touched


SQL["merged_clusters"] = (
    f"WITH RECURSIVE {_evidence_sql()},\nevidence AS (SELECT id_a, id_b FROM pairs WHERE evidence IS NOT NULL),\n"
    f"{_COMPONENT_SQL},\ncomp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)\n"
    "SELECT component, min(m.cluster_id) AS cluster_id, count(DISTINCT m.cluster_id) AS merged, count(DISTINCT node) AS nodes\n"
    "FROM comp LEFT JOIN (SELECT DISTINCT cluster_id, asset_id FROM membership) m ON m.asset_id = comp.node GROUP BY 1"
)


@query(
    "twin_groups",
    """WITH m AS (SELECT DISTINCT m.cluster_id AS c, l.epoch, l.phash FROM members m JOIN ledger l ON l.id = m.asset_id WHERE epoch IS NOT NULL AND phash IS NOT NULL),
       e AS (SELECT DISTINCT a.c AS a, b.c AS b FROM m a JOIN m b ON a.c <> b.c AND abs(a.epoch - b.epoch) <= 5 AND bit_count(xor(a.phash, b.phash)) <= 6),
       reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.seen)
       SELECT node AS cluster_id, min(seen) AS twin_group FROM reach GROUP BY 1""",
    "wall ledger members",
    recursive=True,
)
def twin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(QUERIES["twin_probe"](spark, sf_dir), "cluster_a", "cluster_b")
    return found.select(F.col("node").alias("cluster_id"), F.col("component").alias("twin_group"))


@query(
    "decided_clusters",
    """WITH c AS (SELECT DISTINCT id, clip_cos_sim FROM dedup_cluster WHERE decision IN ('pending', 'review')),
       r AS (SELECT m.cluster_id, c.clip_cos_sim, l.*, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]+$', '')),
               '-(edited|effects)$', ''), '[(][0-9]+[)]$', ''), ' ._-') AS stem,
               round(CASE l.source WHEN 'originals' THEN 120 WHEN 'icloud' THEN 100 WHEN 'google' THEN 30 ELSE 50 END
               + log10(coalesce(nullif(width, 0), 1)::DOUBLE * coalesce(nullif(height, 0), 1)) * 10 + log10(greatest(coalesce(bytes, 1), 1)::DOUBLE) * 5
               + coalesce(exif_fields, 0) * 2 + CASE WHEN format IN ('heic','heif','dng','cr2','cr3','arw','nef','raf','rw2','orf') THEN 20 ELSE 0 END, 9) AS score
             FROM members m JOIN c ON c.id = m.cluster_id JOIN ledger l ON l.id = m.asset_id),
       w AS (SELECT cluster_id, id AS wid, width AS ww, height AS wh, phash AS wp, bytes AS wb, epoch AS we, gps_lat AS wlat, gps_lon AS wlon, stem AS wstem
             FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, id) AS k FROM r) WHERE k = 1),
       d AS (SELECT r.*, w.wid, (r.id <> w.wid) AS loses, bit_count(xor(phash, wp)) AS apart,
             (r.id <> w.wid) AND (
               (CASE WHEN coalesce(ww, 0) > 0 AND coalesce(wh, 0) > 0 AND coalesce(width, 0) > 0 AND coalesce(height, 0) > 0
                 THEN abs(ww / wh::DOUBLE - width / height::DOUBLE) / greatest(ww / wh::DOUBLE, width / height::DOUBLE) ELSE 0 END) > 0.05
               OR source = 'originals'
               OR NOT (CASE WHEN media_type = 'image' THEN coalesce(bit_count(xor(phash, wp)) <= 6, false) OR coalesce(clip_cos_sim >= 0.98, false)
                       ELSE coalesce(bytes = wb, false) END)
               OR NOT (coalesce(abs(epoch - we) <= 3, false) OR coalesce(abs(gps_lat - wlat) < 0.001 AND abs(gps_lon - wlon) < 0.001, false) OR stem = wstem)) AS doubt
             FROM r JOIN w USING (cluster_id))
       SELECT cluster_id, CASE WHEN bool_or(coalesce(burst_uuid <> '', false)) THEN 'kept_all'
           WHEN count(epoch) >= 3 AND max(epoch) - min(epoch) <= 1 AND count(DISTINCT coalesce(width::VARCHAR, '?') || 'x' || coalesce(height::VARCHAR, '?')) = 1 THEN 'kept_all'
           WHEN bool_or(coalesce(edited, false)) AND NOT bool_and(coalesce(edited, false)) THEN 'review'
           WHEN bool_or(doubt) THEN 'review' ELSE 'auto' END AS decision,
           min(wid) AS winner_id, coalesce(1 - max(CASE WHEN loses THEN apart END) / 64.0::DOUBLE, 0.5) AS confidence
       FROM d GROUP BY 1 HAVING count(*) >= 2""",
    "wall ledger members",
)
def decided_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide_clusters(_decision_rows(spark, sf_dir))


def _decision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = table(spark, sf_dir, "dedup_cluster").where("decision in ('pending', 'review')").select(
        F.col("id").alias("cluster_id"), "clip_cos_sim"
    ).distinct()
    rows = ledger(spark, sf_dir).withColumn("stem", normalized_stem(F.col("path")))
    linked = members(spark, sf_dir).withColumnRenamed("asset_id", "id")
    return linked.join(pending, "cluster_id").join(rows, "id")


@query("decision_roles")
def decision_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of every member and its status after the decision is committed."""
    decided = decide_clusters(_decision_rows(spark, sf_dir))
    known = table(spark, sf_dir, "asset").select("id", "status").distinct()
    rows = members(spark, sf_dir).join(decided, "cluster_id").join(known.withColumnRenamed("id", "asset_id"), "asset_id")
    role = F.when(F.col("asset_id") == F.col("winner_id"), "winner").when(F.col("decision") == "kept_all", "member").otherwise("loser")
    after = F.when((F.col("decision") == "auto") & (F.col("status") == "clustered"), "decided").otherwise(F.col("status"))
    return rows.select("cluster_id", "asset_id", role.alias("role"), after.alias("status"))


SQL["decision_roles"] = (
    "WITH decided AS ("
    + SQL["decided_clusters"]
    + """)
    SELECT m.cluster_id, m.asset_id, CASE WHEN m.asset_id = d.winner_id THEN 'winner' WHEN d.decision = 'kept_all' THEN 'member' ELSE 'loser' END AS role,
        CASE WHEN d.decision = 'auto' AND l.status = 'clustered' THEN 'decided' ELSE l.status END AS status
    FROM (SELECT DISTINCT cluster_id, asset_id FROM membership) m JOIN decided d USING (cluster_id)
    JOIN (SELECT DISTINCT id, status FROM asset) l ON l.id = m.asset_id"""
)


@query("placed_items")
def placed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided records against the trips of the accepted ones: date window, distance, rank."""
    rows = ledger(spark, sf_dir).select(
        "id", "status", F.regexp_extract("path", r"(t[0-9]{6})", 1).alias("trip"), F.col("epoch").alias("t"),
        F.when(F.col("fix"), F.col("gps_lat")).alias("lat"), F.when(F.col("fix"), F.col("gps_lon")).alias("lon"),
    )
    accepted = F.col("status").isin("canonical", "promoted")
    trips = trip_summary(rows.where(accepted), ["trip"]).select(
        "trip", "start", "end", F.col("lat").alias("trip_lat"), F.col("lon").alias("trip_lon"), "radius_km"
    )
    found = place_items(rows.where(~accepted).select("id", "t", "lat", "lon"), trips)
    return found.withColumn("km", F.round("km", 5))


SQL["placed_items"] = (
    "WITH summary AS ("
    + SQL["trip_summaries"].replace("FROM ledger)", "FROM ledger WHERE status IN ('canonical', 'promoted'))", 1).replace(
        "round(c.lat, 8) AS lat, round(c.lon, 8) AS lon,\n           round(coalesce(z.km, 0), 5) AS radius_km",
        "c.lat AS lat, c.lon AS lon, coalesce(z.km, 0) AS radius_km",
    )
    + """),
    w2 AS (SELECT DISTINCT taken_at, epoch(try_strptime(regexp_replace(regexp_replace(trim(taken_at), '([+-][0-9]{2}:[0-9]{2}|Z)$', ''), '[.][0-9]+$', ''),
        ['%Y-%m-%dT%H:%M:%S', '%Y:%m:%d %H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y%m%d_%H%M%S', '%Y/%m/%d %H:%M:%S']))::BIGINT AS epoch FROM asset),
    i AS (SELECT a.id, w2.epoch AS t, CASE WHEN f THEN gps_lat END AS lat, CASE WHEN f THEN gps_lon END AS lon FROM (
        SELECT DISTINCT *, (gps_lat IS NOT NULL AND gps_lon IS NOT NULL AND abs(gps_lat) <= 90 AND abs(gps_lon) <= 180
            AND NOT (abs(gps_lat) <= 0.001 AND abs(gps_lon) <= 0.001)) AS f FROM asset WHERE status NOT IN ('canonical', 'promoted')) a
        LEFT JOIN w2 ON w2.taken_at IS NOT DISTINCT FROM a.taken_at),
    o AS (SELECT i.id, s.trip, (i.t BETWEEN s."start" AND s."end") AS core, (i.lat IS NOT NULL AND s.lat IS NOT NULL) AS geo, s.radius_km,
        2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - i.lat) / 2), 2) + cos(radians(i.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - i.lon) / 2), 2)))) AS km
        FROM i JOIN summary s ON i.t BETWEEN s."start" - 14400 AND s."end" + 14400),
    q AS (SELECT id, trip, CASE WHEN geo THEN km END AS km, CASE WHEN NOT geo THEN CASE WHEN core THEN 1 ELSE 3 END
        WHEN km <= radius_km + 5 THEN CASE WHEN core THEN 0 ELSE 2 END WHEN km <= 50 THEN 2 END AS rank FROM o),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, coalesce(km, 0), trip) AS k FROM q WHERE rank IS NOT NULL) WHERE k = 1)
    SELECT i.id, CASE WHEN b.id IS NULL THEN 'new' WHEN b.rank <= 1 THEN 'matched' ELSE 'extends' END AS verdict,
        CASE WHEN i.t IS NULL THEN 'none' WHEN b.id IS NULL THEN CASE WHEN i.lat IS NOT NULL THEN 'geo' ELSE 'date-only' END
             WHEN b.km IS NULL THEN 'date-only' ELSE 'geo' END AS basis, b.trip, round(b.km, 5) AS km
    FROM i LEFT JOIN b ON b.id = i.id"""
)


@query(
    "merged_intervals",
    """WITH o AS (SELECT o_custkey AS k, epoch_us(o_orderdate) // 86400000000 AS s, epoch_us(o_orderdate) // 86400000000 + o_orderkey % 90 AS e FROM orders),
       w AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS opens FROM o),
       i AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM w)
       SELECT k AS cust_key, min(s) AS "start", max(e) AS "end" FROM i GROUP BY k, g""",
)
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cust_key"), day.alias("s"), (day + F.col("o_orderkey") % 90).alias("e")
    )
    return merge_intervals(rows, ["cust_key"], "s", "e")


@query(
    "range_pairs",
    """SELECT a.event_id AS one, b.event_id AS other FROM events a JOIN events b ON a.event_type = 'view' AND b.event_type = 'click'
       AND a.user_id = b.user_id AND abs(epoch_us(a.ts) // 1000000 - epoch_us(b.ts) // 1000000) <= 600""",
)
def range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    one = rows.where("event_type = 'view'").select(F.col("event_id").alias("one"), "user_id", F.col("t").alias("t1"))
    two = rows.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", F.col("t").alias("t2"))
    return range_join(one, two, "t1", "t2", 600, ["user_id"]).select("one", "other")


@query(
    "array_sets",
    """WITH s AS (SELECT cluster_id, list_sort(list(DISTINCT asset_id)) AS ids FROM members GROUP BY 1)
       SELECT cluster_id, array_to_string(list_filter(ids, lambda x: x % 2 = 0), ',') AS even_ids, len(ids) AS n FROM s""",
    "members",
)
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference on arrays, after an ordered de-duplication."""
    ids = F.sort_array(F.collect_set("asset_id"))
    grouped = members(spark, sf_dir).groupBy("cluster_id").agg(ids.alias("ids"))
    odd = F.filter("ids", lambda x: x % 2 == 1)
    return grouped.select("cluster_id", F.array_join(F.array_except("ids", odd), ",").alias("even_ids"), F.size("ids").alias("n"))


@query("pixel_hashes")
def pixel_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hash of 32 x 32 grey values made from each embedding (no SQL: a DCT in Python)."""
    vectors = table(spark, sf_dir, "embeddings")
    row = F.col("embedding").cast("array<double>")
    pixels = F.flatten(F.array(*(row if n % 2 else F.reverse(row) for n in range(16))))
    return vectors.select("vec_id", media.perceptual_hash(pixels).alias("phash"))


@query(
    "vector_cosines",
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
       FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vector_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(media.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("pixel_correlations")
def pixel_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised cross-correlation of neighbouring vectors, taken as pixels."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("u"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v"))
    return vectors.join(following, "vec_id").select("vec_id", F.round(media.correlation(F.col("u"), F.col("v")), 6).alias("ncc"))


SQL["pixel_correlations"] = """
    SELECT a.vec_id, round(list_cosine_similarity(list_transform(a.e, lambda x: x - list_avg(a.e)), list_transform(b.e, lambda x: x - list_avg(b.e))), 6) AS ncc
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1"""
