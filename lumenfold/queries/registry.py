"""Registration of queries with their SQL, and the entities the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..operators.geo_index import is_fix
from ..operators.timestamps import parsed
from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL of the shared entities, put in front of a query's own SQL by name.
ENTITIES = {
    "wall": """wall AS (
        SELECT DISTINCT taken_at, epoch(try_strptime(regexp_replace(regexp_replace(trim(taken_at),
            '([+-][0-9]{2}:[0-9]{2}|Z)$', ''), '[.][0-9]+$', ''),
            ['%Y-%m-%dT%H:%M:%S', '%Y:%m:%d %H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y%m%d_%H%M%S', '%Y/%m/%d %H:%M:%S'])
            )::BIGINT AS epoch
        FROM (SELECT taken_at FROM asset UNION SELECT taken_at FROM asset_inbox))""",
    "ledger": """ledger AS (
        SELECT a.*, w.epoch,
            (gps_lat IS NOT NULL AND gps_lon IS NOT NULL AND abs(gps_lat) <= 90 AND abs(gps_lon) <= 180
             AND NOT (abs(gps_lat) <= 0.001 AND abs(gps_lon) <= 0.001)) AS fix
        FROM (SELECT DISTINCT * FROM asset) a LEFT JOIN wall w ON w.taken_at IS NOT DISTINCT FROM a.taken_at)""",
    "members": """members AS (SELECT DISTINCT cluster_id, asset_id FROM membership)""",
    "library": """library AS (
        SELECT id AS asset_id, regexp_extract(path, '[^/]*$') AS filename, bytes AS size_bytes,
            CASE WHEN phash IS NOT NULL THEN sha1(phash::VARCHAR) END AS checksum
        FROM ledger WHERE status IN ('canonical', 'promoted'))""",
    "inbound": """inbound AS (
        SELECT DISTINCT id, path, regexp_extract(path, '[^/]*$') AS filename, bytes AS size_bytes,
            CASE WHEN phash IS NOT NULL THEN sha1(phash::VARCHAR) END AS checksum, taken_at
        FROM (SELECT id, path, bytes, phash, taken_at FROM asset_inbox UNION ALL
              SELECT id, path, bytes, phash, taken_at FROM asset WHERE status NOT IN ('canonical', 'promoted')))""",
    "pings": """pings AS (
        SELECT device_id, t, min(lat) AS lat, min(lon) AS lon, min(id) AS id FROM (
            SELECT device_id, point_id AS id, epoch_us(shot_when) / 1000000 AS t, lat, lon FROM (
                SELECT DISTINCT * FROM asset_point)
            WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lat = 0 AND lon = 0))
        GROUP BY device_id, t)""",
}


def query(name: str, sql: str | None = None, needs: str = "", recursive: bool = False):
    """Registers a query; ``needs`` names the entities that its SQL starts with."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            parts = [ENTITIES[need] for need in needs.split()]
            body = sql.strip()
            if body.startswith("WITH "):
                parts.append(body[len("WITH ") :])
                SQL[name] = "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts)
            else:
                SQL[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
        return function

    return add


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset ledger, one row per record, with epoch (wall clock seconds) and fix."""
    rows = table(spark, sf_dir, "asset").distinct()
    return rows.withColumn("epoch", parsed(F.col("taken_at"), wall_only=True)["secs"]).withColumn(
        "fix", is_fix(F.col("gps_lat"), F.col("gps_lon"))
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "membership").select("cluster_id", "asset_id").distinct()


def content_key() -> Column:
    return F.sha1(F.col("phash").cast("string").cast("binary"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted records as a library snapshot: asset_id, filename, size_bytes, checksum."""
    rows = table(spark, sf_dir, "asset").where(F.col("status").isin("canonical", "promoted")).distinct()
    return rows.select(
        F.col("id").alias("asset_id"), file_name(F.col("path")).alias("filename"), F.col("bytes").alias("size_bytes"),
        content_key().alias("checksum"),
    )


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals, and ledger records that are not accepted yet, as inbound files: id, path, filename, size_bytes, checksum, taken_at."""
    columns = ["id", "path", "bytes", "phash", "taken_at"]
    waiting = table(spark, sf_dir, "asset").where(~F.col("status").isin("canonical", "promoted")).select(*columns)
    return (
        table(spark, sf_dir, "asset_inbox").select(*columns).unionByName(waiting)
        .select(
            "id", "path", file_name(F.col("path")).alias("filename"), F.col("bytes").alias("size_bytes"),
            content_key().alias("checksum"), "taken_at",
        )
        .distinct()
    )


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pings of asset_point, one per device and time: device_id, id, t, lat, lon."""
    rows = table(spark, sf_dir, "asset_point").where(
        "lat is not null and lon is not null and not (lat = 0 and lon = 0)"
    )
    return (
        rows.select("device_id", "point_id", F.unix_seconds(F.col("shot_when").cast("timestamp")).alias("t"), "lat", "lon")
        .groupBy("device_id", "t")
        .agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.min("point_id").alias("id"))
    )
