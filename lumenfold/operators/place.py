"""Placing items against known trips by date window and distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .skew import blocked_join


def place_items(
    items: DataFrame,
    trips: DataFrame,
    gap: float = 4 * 3600,
    near_km: float = 5.0,
    extend_km: float = 50.0,
    slot: float = 30 * 86400,
) -> DataFrame:
    """id, verdict, basis, trip, km of each item (id, t, lat, lon) against trips.

    ``trips``: trip, start, end, trip_lat, trip_lon, radius_km. Best first: by place and
    inside the dates, by date only and inside, by place and close to the dates or the
    radius, by date only and close; then the nearest, then the smallest trip name.
    An item without a time is new, as is one that no trip takes. Trips meet items in
    time slots; a trip covers as many as it lasts, so no nested loop is planned.
    """
    spans = trips.where("start is not null and end is not null").withColumn(
        "slot", F.explode(F.sequence(F.floor((F.col("start") - gap) / slot), F.floor((F.col("end") + gap) / slot)))
    )
    dated = items.where("t is not null").withColumn("slot", F.floor(F.col("t") / slot))
    met = blocked_join(dated, spans, ["slot"]).where(F.col("t").between(F.col("start") - gap, F.col("end") + gap))
    inside = F.col("t").between(F.col("start"), F.col("end"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("trip_lat"), F.col("trip_lon"))
    by_place = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("trip_lat").isNotNull() & F.col("trip_lon").isNotNull()
    rank = (
        F.when(~by_place, F.when(inside, 1).otherwise(3))
        .when(km <= F.col("radius_km") + near_km, F.when(inside, 0).otherwise(2))
        .when(km <= extend_km, 2)
    )
    offers = met.withColumns({"rank": rank, "km": F.when(by_place, km)}).where("rank is not null")
    best = offers.groupBy("id").agg(F.min(F.struct("rank", F.coalesce("km", F.lit(0.0)).alias("by"), "trip", "km")).alias("best"))
    verdict = F.when(F.col("best").isNull(), "new").when(F.col("best.rank") <= 1, "matched").otherwise("extends")
    has_place = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    basis = (
        F.when(F.col("t").isNull(), "none")
        .when(F.col("best").isNull(), F.when(has_place, "geo").otherwise("date-only"))
        .when(F.col("best.km").isNull(), "date-only")
        .otherwise("geo")
    )
    return items.join(best, "id", "left").select(
        "id", verdict.alias("verdict"), basis.alias("basis"), F.col("best.trip").alias("trip"), F.col("best.km").alias("km")
    )
