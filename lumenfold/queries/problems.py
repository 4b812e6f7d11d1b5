"""Queries of the general data-pipeline problems over the catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.geo_index import near_pairs, points_in_regions
from ..operators.timestamps import normalise_candidates
from ..operators.trips import stops_and_trips
from ..session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = table(spark, sf_dir, "asset")
    regions = table(spark, sf_dir, "geo_region")
    near = near_pairs(assets, "id", "gps_lat", "gps_lon", 20.0)
    held = points_in_regions(assets, "id", "gps_lat", "gps_lon", regions, "region_id", "ring")
    return near.select(F.lit("near").alias("kind"), "key_a", "key_b").unionByName(
        held.select(F.lit("region").alias("kind"), F.col("key").alias("key_a"), F.col("region").alias("key_b"))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise_candidates(table(spark, sf_dir, "date_candidate"), table(spark, sf_dir, "asset"))


def _pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "asset_point").select("device_id", F.col("shot_when").alias("at"), "lat", "lon")
    clips = table(spark, sf_dir, "srt_telemetry").select(
        "device_id", F.col("datetime_original").alias("at"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )
    return points.unionByName(clips)


def p7_stops_and_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stops_and_trips(_pings(spark, sf_dir))
    return found.select(
        "device_id",
        "kind",
        F.floor("start_s").alias("start_s"),
        F.floor("end_s").alias("end_s"),
        F.round("distance_m", 1).alias("distance_m"),
        "pings",
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stops_and_trips(_pings(spark, sf_dir))
    return found.select("device_id", "kind", F.floor("start_s").alias("start_s"), F.floor("end_s").alias("end_s"))


QUERIES = {
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p7_found": p7_found,
    "p7_stops_and_trips": p7_stops_and_trips,
}

SQL: dict[str, str] = {
    "p2_found": """
        WITH f AS (SELECT DISTINCT id, gps_lat AS lat, gps_lon AS lon FROM asset WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL
            AND abs(gps_lat) <= 90 AND abs(gps_lon) <= 180 AND NOT (abs(gps_lat) <= 0.001 AND abs(gps_lon) <= 0.001)),
        near AS (SELECT DISTINCT a.id AS key_a, b.id AS key_b FROM f a JOIN f b ON a.id < b.id AND a.lat BETWEEN b.lat - 0.0002 AND b.lat + 0.0002
            WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
                + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 20),
        corner AS (SELECT region_id, unnest(ring) AS c, generate_subscripts(ring, 1) AS n, len(ring) AS m FROM (SELECT DISTINCT region_id, ring FROM geo_region)),
        edge AS (SELECT a.region_id, a.c.lon AS x2, a.c.lat AS y2, b.c.lon AS x1, b.c.lat AS y1 FROM corner a JOIN corner b
            ON b.region_id = a.region_id AND b.n = CASE WHEN a.n = 1 THEN a.m ELSE a.n - 1 END),
        turned AS (SELECT id, lat, lon + turn AS lon, turn FROM f, (VALUES (0), (360), (-360)) v(turn)),
        held AS (SELECT t.id, e.region_id FROM turned t JOIN edge e ON t.lat >= least(e.y1, e.y2) AND t.lat <= greatest(e.y1, e.y2)
            WHERE (e.y1 > t.lat) <> (e.y2 > t.lat) AND t.lon < (e.x2 - e.x1) * (t.lat - e.y1) / (e.y2 - e.y1) + e.x1
            GROUP BY t.id, t.lat, t.lon, t.turn, e.region_id HAVING count(*) % 2 = 1)
        SELECT 'near' AS kind, key_a, key_b FROM near UNION ALL SELECT DISTINCT 'region', id, region_id FROM held
    """,
    "p4_found": """
        WITH c AS (SELECT DISTINCT candidate_id, asset_id, tz_name, local_date_time, date_time_original FROM date_candidate),
        texts AS (SELECT DISTINCT t, trim(t) AS s FROM (SELECT date_time_original AS t FROM c UNION SELECT local_date_time FROM c UNION SELECT taken_at FROM asset) WHERE t IS NOT NULL),
        cut AS (SELECT t, s, regexp_extract(s, '^(.*?) ?(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2})$', 1) AS body,
            regexp_extract(s, '^(.*?) ?(Z|UTC|GMT|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2})$', 2) AS zone FROM texts),
        shown AS (SELECT *, epoch(try_strptime(regexp_replace(CASE WHEN zone <> '' THEN body ELSE s END, '[.,][0-9]+$', ''),
            ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y:%m:%d %H:%M:%S', '%Y/%m/%d %H:%M:%S', '%Y%m%dT%H%M%S', '%Y%m%d_%H%M%S', '%Y%m%d-%H%M%S', '%Y%m%d%H%M%S',
             '%d-%b-%Y %H:%M:%S', '%d %b %Y, %I:%M:%S %p', '%a, %d %b %Y %H:%M:%S']))::BIGINT AS wall FROM cut),
        off AS (SELECT *, CASE WHEN zone IN ('Z', 'UTC', 'GMT') THEN 0 WHEN zone <> '' THEN (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END)
            * (zone[2:3]::BIGINT * 3600 + coalesce(nullif(replace(zone[4:], ':', ''), '')::BIGINT, 0) * 60) END AS o FROM shown),
        p AS (SELECT t, CASE WHEN regexp_full_match(s, '[0-9]{10}') THEN s::BIGINT WHEN regexp_full_match(s, '[0-9]{13}') THEN s::BIGINT // 1000
            WHEN zone <> '' THEN wall - o ELSE wall END AS secs, (regexp_full_match(s, '[0-9]{10}|[0-9]{13}') OR zone <> '') AS fixed FROM off),
        q AS (SELECT * FROM p WHERE secs IS NOT NULL),
        own AS (SELECT c.candidate_id, c.tz_name, CASE WHEN a.t IS NOT NULL THEN a.secs WHEN b.t IS NOT NULL THEN b.secs ELSE d.secs END AS secs,
            CASE WHEN a.t IS NOT NULL THEN a.fixed WHEN b.t IS NOT NULL THEN b.fixed ELSE d.fixed END AS fixed
            FROM c LEFT JOIN q a ON a.t = c.date_time_original LEFT JOIN q b ON b.t = c.local_date_time
            LEFT JOIN (SELECT DISTINCT id, taken_at FROM asset) x ON x.id = c.asset_id LEFT JOIN q d ON d.t = x.taken_at),
        names AS (SELECT lower(name) AS k, min(name) AS zone FROM pg_timezone_names() GROUP BY 1),
        z AS (SELECT own.*, names.zone, regexp_extract(lower(trim(tz_name)), '^(?:utc|gmt)?([+-][0-9]{2}):?[0-9]{2}$', 1) AS hh,
            regexp_extract(lower(trim(tz_name)), '^(?:utc|gmt)?[+-][0-9]{2}:?([0-9]{2})$', 1) AS mm
            FROM own LEFT JOIN names ON names.k = lower(replace(trim(tz_name), ' ', '_')) WHERE secs IS NOT NULL),
        e AS (SELECT *, secs - (epoch(timezone(zone, to_timestamp(secs - 54000)))::BIGINT - (secs - 54000)) AS u1,
            secs - (epoch(timezone(zone, to_timestamp(secs + 54000)))::BIGINT - (secs + 54000)) AS u2 FROM z),
        g AS (SELECT *, epoch(timezone(zone, to_timestamp(u1)))::BIGINT = secs AS ok1, epoch(timezone(zone, to_timestamp(u2)))::BIGINT = secs AS ok2 FROM e)
        SELECT DISTINCT candidate_id, utc_second FROM (
            SELECT candidate_id, CASE WHEN fixed THEN secs
                WHEN zone IS NOT NULL THEN CASE WHEN ok1 AND ok2 AND u1 <> u2 THEN NULL WHEN ok1 THEN u1 WHEN ok2 THEN u2 END
                WHEN hh <> '' THEN secs - (CASE WHEN hh[1] = '-' THEN -1 ELSE 1 END) * (hh[2:3]::BIGINT * 3600 + mm::BIGINT * 60) END AS utc_second FROM g)
        WHERE utc_second IS NOT NULL
    """,
    "p7_found": """
        WITH fix AS (
            SELECT DISTINCT device_id, epoch_us(seen) / 1e6 AS t, lat, lon FROM (
                SELECT device_id, shot_when AS seen, lat, lon FROM asset_point
                UNION ALL SELECT device_id, datetime_original, latitude, longitude FROM srt_telemetry)
            WHERE device_id IS NOT NULL AND seen IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)
        ),
        beside AS (
            SELECT *, lag(t) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon,
                   lead(t) OVER w AS nt, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon
            FROM fix WINDOW w AS (PARTITION BY device_id ORDER BY t, lat, lon)
        ),
        paced AS (
            SELECT *, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2)
                       + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(lon - plon) / 2), 2)))) * 3.6 > 300 * greatest(t - pt, 0) AS fast_in,
                   2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(nlat - lat) / 2), 2)
                       + cos(radians(lat)) * cos(radians(nlat)) * pow(sin(radians(nlon - lon) / 2), 2)))) * 3.6 > 300 * greatest(nt - t, 0) AS fast_out
            FROM beside
        ),
        clean AS (
            SELECT device_id, t, lat, lon, lag(t) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
            FROM paced WHERE NOT (coalesce(fast_in, false) AND coalesce(fast_out, false))
            WINDOW w AS (PARTITION BY device_id ORDER BY t, lat, lon)
        ),
        broken AS (
            SELECT *, coalesce(t - pt > 14400, true) AS silent,
                   2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - plat) / 2), 2)
                       + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(lon - plon) / 2), 2)))) > 150 AS stepped
            FROM clean
        ),
        runs AS (
            SELECT *, sum(silent::INT) OVER w AS session, sum((silent OR stepped)::INT) OVER w AS run
            FROM broken WINDOW w AS (PARTITION BY device_id ORDER BY t, lat, lon ROWS UNBOUNDED PRECEDING)
        ),
        stops AS (
            SELECT device_id, session, run, min(t) AS start_t, max(t) AS end_t FROM runs
            GROUP BY device_id, session, run HAVING max(t) - min(t) >= 1200
        ),
        trips AS (
            SELECT device_id, end_t AS start_t, lead(start_t) OVER (PARTITION BY device_id, session ORDER BY start_t) AS end_t FROM stops
        )
        SELECT device_id, 'stop' AS kind, floor(start_t)::BIGINT AS start_s, floor(end_t)::BIGINT AS end_s FROM stops
        UNION ALL SELECT device_id, 'trip', floor(start_t)::BIGINT, floor(end_t)::BIGINT FROM trips WHERE end_t IS NOT NULL
    """,
}
