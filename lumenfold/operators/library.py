"""Trips of a library, zones of points, and evidence merged into existing clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .robust import trip_summary
from .sessionize import event_sweep
from .skew import blocked_join
from .timestamps import let


def centroid_radius(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lat, lon, radius_km, n: centre of the positions and the greatest distance from it.

    Positions are counted per place first, so a key with many rows at few places is
    small; the second pass reads the places only.
    """
    places = df.where("lat is not null and lon is not null").groupBy(*keys, "lat", "lon").agg(F.count(F.lit(1)).alias("n"))
    centre = places.groupBy(*keys).agg(
        (F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("mid_lat"), (F.sum(F.col("lon") * F.col("n")) / F.sum("n")).alias("mid_lon"), F.sum("n").alias("total")
    )
    away = haversine_km(F.col("mid_lat"), F.col("mid_lon"), F.col("lat"), F.col("lon"))
    met = places.join(centre, keys)
    return met.groupBy(*keys).agg(
        F.first("mid_lat").alias("lat"), F.first("mid_lon").alias("lon"), F.max(away).alias("radius_km"), F.first("total").alias("n")
    )


def trip_library(albums: DataFrame, assets: DataFrame, keys: list[str], gap: float = 4 * 3600, most_km: float = 5.0, least: int = 3) -> DataFrame:
    """source, name, start, end, lat, lon, radius_km, assets: albums with dates, and events of what no such album holds.

    ``albums``: name, id; ``assets``: id, t, lat, lon and ``keys`` (such as the device), in
    which events are looked for. An album without a dated member claims nothing. Album
    bounds are fenced and its radius is the 90th percentile; those of an event are plain.
    """
    held = albums.select("name", "id").distinct().join(assets.select("id", "t", "lat", "lon"), "id")
    named = trip_summary(held, ["name"]).where("start is not null and end is not null").select(
        F.lit("album").alias("source"), F.col("name").cast("string").alias("name"), "start", "end", "lat", "lon", "radius_km", "assets"
    )
    claimed = held.join(named.select(F.col("name").alias("__name")), F.col("name").cast("string") == F.col("__name"), "left_semi").select("id")
    free = assets.join(claimed.distinct(), "id", "left_anti").where("t is not null and lat is not null and lon is not null")
    events = event_sweep(free.select(*keys, "id", "t", "lat", "lon"), keys, gap, most_km, least).select("id", "event")
    placed = events.join(free.select("id", "t", "lat", "lon"), "id")
    bounds = placed.groupBy("event").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    found = bounds.join(centroid_radius(placed, ["event"]), "event").select(
        F.lit("cluster").alias("source"), F.col("event").cast("string").alias("name"), "start", "end", "lat", "lon", "radius_km", F.col("n").alias("assets")
    )
    return named.unionByName(found)


#: A town of each zone, with its position, for the zone nearest to a point.
ZONE_TOWNS = (
    ("Pacific/Honolulu", 21.31, -157.86), ("America/Anchorage", 61.22, -149.90), ("America/Los_Angeles", 34.05, -118.24),
    ("America/Denver", 39.74, -104.99), ("America/Chicago", 41.88, -87.63), ("America/New_York", 40.71, -74.01),
    ("America/Mexico_City", 19.43, -99.13), ("America/Bogota", 4.71, -74.07), ("America/Lima", -12.05, -77.04),
    ("America/Santiago", -33.45, -70.67), ("America/Argentina/Buenos_Aires", -34.60, -58.38), ("America/Sao_Paulo", -23.55, -46.63),
    ("America/Halifax", 44.65, -63.58), ("America/St_Johns", 47.56, -52.71), ("Atlantic/Reykjavik", 64.15, -21.94),
    ("Europe/London", 51.51, -0.13), ("Europe/Lisbon", 38.72, -9.14), ("Europe/Madrid", 40.42, -3.70), ("Europe/Paris", 48.86, 2.35),
    ("Europe/Berlin", 52.52, 13.41), ("Europe/Rome", 41.90, 12.50), ("Europe/Stockholm", 59.33, 18.07), ("Europe/Warsaw", 52.23, 21.01),
    ("Europe/Athens", 37.98, 23.73), ("Europe/Helsinki", 60.17, 24.94), ("Europe/Istanbul", 41.01, 28.98), ("Europe/Moscow", 55.76, 37.62),
    ("Africa/Cairo", 30.04, 31.24), ("Africa/Lagos", 6.52, 3.38), ("Africa/Nairobi", -1.29, 36.82), ("Africa/Johannesburg", -26.20, 28.05),
    ("Asia/Dubai", 25.20, 55.27), ("Asia/Tehran", 35.69, 51.39), ("Asia/Karachi", 24.86, 67.01), ("Asia/Kolkata", 22.57, 88.36),
    ("Asia/Kathmandu", 27.72, 85.32), ("Asia/Dhaka", 23.81, 90.41), ("Asia/Bangkok", 13.76, 100.50), ("Asia/Singapore", 1.35, 103.82),
    ("Asia/Shanghai", 31.23, 121.47), ("Asia/Tokyo", 35.68, 139.69), ("Asia/Seoul", 37.57, 126.98), ("Asia/Yakutsk", 62.03, 129.73),
    ("Australia/Perth", -31.95, 115.86), ("Australia/Adelaide", -34.93, 138.60), ("Australia/Sydney", -33.87, 151.21),
    ("Pacific/Auckland", -36.85, 174.76), ("Pacific/Fiji", -18.12, 178.45),
)


def zone_of_points(points: DataFrame, key: str, lat: str, lon: str, towns: tuple = ZONE_TOWNS) -> DataFrame:
    """key, zone: the zone of the town nearest to each position; a tie goes to the first name.

    The towns are a fixed list within the plan, so nothing is joined. Rows without a
    position have no zone.
    """

    def nearest_town(point: Column) -> Column:
        here = (point["lat"], point["lon"])
        return F.array_min(F.array(*(F.struct(haversine_km(*here, F.lit(y), F.lit(x)).alias("km"), F.lit(zone).alias("zone")) for zone, y, x in towns)))

    placed = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    point = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    return placed.select(key, let(point, nearest_town)["zone"].alias("zone"))


def merge_into_clusters(groups: DataFrame, membership: DataFrame, first_new: int) -> tuple[DataFrame, DataFrame]:
    """(cluster_id, asset_id after the merge; cluster ids that are gone).

    ``groups``: node, component of new evidence that has the old membership among its
    edges, so a group holds whole clusters. A group takes the smallest of its clusters,
    all its members are re-pointed to it and its other clusters are deleted; a group
    without one gets ``first_new`` plus its component. Clusters that no group touches stay.
    """
    old = membership.select("cluster_id", F.col("asset_id").alias("node")).distinct()
    met = groups.join(old, "node").select("component", "cluster_id").distinct()
    least = met.groupBy("component").agg(F.min("cluster_id").alias("kept"))
    target = groups.select("component").distinct().join(least, "component", "left").select(
        "component", F.coalesce("kept", F.lit(first_new) + F.col("component")).alias("kept")
    )
    moved = blocked_join(target, groups.select("node", "component"), ["component"]).select(
        F.col("kept").alias("cluster_id"), F.col("node").alias("asset_id")
    )
    gone = met.join(least, "component").where("cluster_id <> kept").select("cluster_id").distinct()
    stay = old.join(met.select("cluster_id").distinct(), "cluster_id", "left_anti").select("cluster_id", F.col("node").alias("asset_id"))
    return stay.unionByName(moved).distinct(), gone
