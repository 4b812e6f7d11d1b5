"""Robust aggregates: first-seen mode, index percentile, fenced bounds, trip summaries, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..session import Scratch


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys, mode, n: the most frequent non-null value; a tie goes to the one seen first."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")
    )
    best = seen.groupBy(*keys).agg(F.min(F.struct(-F.col("n"), "first", value)).alias("best"))
    return best.select(*keys, F.col(f"best.{value}").alias("mode"), (-F.col("best.col1")).alias("n"))


#: Rows of a key up to which it is put in order whole, and value ranges into which the rows are counted beyond that.
HOT_ROWS = 500_000
RANGES = 256


def values_at(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """keys, n and, by name, the value at each place (from 0, a column over n) of the sorted values.

    Where a key has more than HOT_ROWS rows, rows are counted per key and range of values,
    ranges of equal width between least and greatest. Only the range that holds a place is
    then put in order, a key and range at a time, so a hot key is never sorted in one
    task; equal values are counted, not sorted. Nulls and NaN take no part; keys without
    a value have no row.
    """
    plain = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).isEmpty():
        whole = Window.partitionBy(*keys)
        numbered = plain.select(
            *keys, value, F.count(F.lit(1)).over(whole).alias("n"), (F.row_number().over(whole.orderBy(value)) - 1).alias("__place")
        )
        picked = (F.max(F.when(F.col("__place") == F.greatest(place, F.lit(0)), F.col(value))).alias(name) for name, place in places.items())
        return numbered.groupBy(*keys).agg(F.first("n").alias("n"), *picked)
    rows = plain.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    whole = rows.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.sum("__c").alias("n"))
    width = (F.col("__high") - F.col("__low")).cast("double") / RANGES
    part = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("__low")).cast("double") / width), F.lit(RANGES - 1))).otherwise(F.lit(0))
    placed = rows.join(whole, keys).withColumn("__range", part.cast("int"))
    sums = placed.groupBy(*keys, "__range").agg(F.sum("__c").alias("__c"), F.first("n").alias("n"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sums.withColumn("__before", before)
    asked = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(place, F.lit(0)).cast("bigint").alias("place")) for name, place in places.items()))
    inside = F.filter(asked, lambda p: (p["place"] >= F.col("__before")) & (p["place"] < F.col("__before") + F.col("__c")))
    wanted = ranges.withColumn("__asked", inside).where(F.size("__asked") > 0).select(*keys, "__range", "__before", "__asked")
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__range").orderBy(value))
    held = placed.drop("__low", "__high").join(wanted, [*keys, "__range"]).withColumn("__upto", upto + F.col("__before"))
    hit = F.explode(F.filter("__asked", lambda p: (p["place"] < F.col("__upto")) & (p["place"] >= F.col("__upto") - F.col("__c"))))
    found = held.select(*keys, "n", value, hit.alias("p"))
    return found.groupBy(*keys).agg(F.first("n").alias("n"), *(F.max(F.when(F.col("p.name") == name, F.col(value))).alias(name) for name in places))


def index_percentile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """keys, percentile: the value at index min(n - 1, int(q * n)) of the sorted values."""
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * q))
    return values_at(df, keys, value, {"percentile": place}).drop("n")


def fenced_bounds(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, low, high: least and greatest value within 1.5 quartile ranges.

    Quartiles are the values at n // 4 and 3 n // 4; fewer than four values, or none
    inside the fence, give the plain bounds.
    """
    quartiles = values_at(df, keys, value, {"q1": F.floor(F.col("n") / 4), "q3": F.floor(F.col("n") * 3 / 4)})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    kept = (F.col("n") < 4) | F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    rows = df.where(F.col(value).isNotNull()).select(*keys, value).distinct().join(quartiles, keys)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(kept, F.col(value))), F.min(value)).alias("low"),
        F.coalesce(F.max(F.when(kept, F.col(value))), F.max(value)).alias("high"),
    )


def trip_summary(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end (fenced), lat, lon (medians), radius_km (90th percentile), assets.

    ``members``: keys, t (seconds), lat, lon; any of them may be null.
    """
    # Read five times below, so it is worked out once.
    members = Scratch(members.sparkSession, "trips").keep(members.select(*keys, "t", "lat", "lon"), "members")
    centre = members.where("lat is not null and lon is not null").groupBy(*keys).agg(
        F.median("lat").alias("mid_lat"), F.median("lon").alias("mid_lon")
    )
    away = members.where("lat is not null and lon is not null").join(centre, keys)
    away = away.withColumn("km", haversine_km(F.col("mid_lat"), F.col("mid_lon"), F.col("lat"), F.col("lon")))
    radius = index_percentile(away, keys, "km", 0.9)
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("assets"))
    return (
        counts.join(fenced_bounds(members, keys, "t"), keys, "left")
        .join(centre, keys, "left")
        .join(radius, keys, "left")
        .select(
            *keys,
            F.col("low").alias("start"),
            F.col("high").alias("end"),
            F.col("mid_lat").alias("lat"),
            F.col("mid_lon").alias("lon"),
            F.coalesce("percentile", F.lit(0.0)).alias("radius_km"),
            "assets",
        )
    )


def vote(df: DataFrame, keys: list[str], choice: str, least_votes: int = 3, least_share: float = 0.6) -> DataFrame:
    """keys, winner, votes, total: winner null if it has too few votes or too small a share."""
    counts = df.where(F.col(choice).isNotNull()).groupBy(*keys, choice).count()
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), choice)
    total = F.sum("count").over(Window.partitionBy(*keys))
    best = counts.withColumns({"n": F.row_number().over(order), "total": total}).where("n = 1")
    wins = (F.col("count") >= least_votes) & (F.col("count") >= least_share * F.col("total"))
    return best.select(*keys, F.when(wins, F.col(choice)).alias("winner"), F.col("count").alias("votes"), "total")


def dominant(df: DataFrame, keys: list[str], choice: str, factor: float = 2.0) -> DataFrame:
    """keys, winner: the most frequent choice unless the runner-up has more than 1/factor of it."""
    counts = df.where(F.col(choice).isNotNull()).groupBy(*keys, choice).count()
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), choice)
    top = counts.withColumn("n", F.row_number().over(order)).where("n <= 2")
    pair = top.groupBy(*keys).agg(
        F.max(F.when(F.col("n") == 1, F.col(choice))).alias("first"),
        F.max(F.when(F.col("n") == 1, F.col("count"))).alias("most"),
        F.max(F.when(F.col("n") == 2, F.col("count"))).alias("next"),
    )
    clear = F.col("next").isNull() | (F.col("most") >= factor * F.col("next"))
    return pair.select(*keys, F.when(clear, F.col("first")).alias("winner"))
