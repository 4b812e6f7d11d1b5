"""Nearest and bracketing fixes in time, by one union and two running windows per slot of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, interpolate


#: Seconds of a time slot: the rows of a key are sorted slot by slot, not in one task.
SLOT = 86_400


def bracket(targets: DataFrame, fixes: DataFrame, keys: list[str], slot: float = SLOT) -> DataFrame:
    """targets (keys, id, t) with before and after: struct(t, lat, lon) of the fixes around t.

    A fix exactly at t is the one after; of fixes at one time the least position counts.
    Rows meet in slots of time, and the last and first fix of every slot are carried to
    the slots after and before it, so a bracket may span any number of slots. Both
    windows run from one end, so their time grows with the rows. Targets without a key
    or time find no fix.
    """
    point, kind = F.struct("t", "lat", "lon"), _point_type(fixes)
    fixes = fixes.where(F.col("t").isNotNull())
    rows = targets.select(*keys, "t", F.lit(0).alias("is_fix"), "id", F.lit(None).cast(kind).alias("fix")).unionByName(
        fixes.select(*keys, "t", F.lit(1).alias("is_fix"), F.lit(None).cast(targets.schema["id"].dataType).alias("id"), point.alias("fix"))
    )
    rows = rows.withColumn("__slot", F.floor(F.col("t") / F.lit(slot)))
    latest = F.max(F.when(F.col("fix").isNotNull(), F.struct(F.col("fix.t").alias("t"), (-F.col("fix.lat")).alias("lat"), (-F.col("fix.lon")).alias("lon"))))
    ends = rows.groupBy(*keys, "__slot").agg(F.min("fix").alias("__first"), latest.alias("l")).withColumn(
        "__last", F.when(F.col("l").isNotNull(), F.struct(F.col("l.t").alias("t"), (-F.col("l.lat")).alias("lat"), (-F.col("l.lon")).alias("lon")))
    )
    in_order, backwards = Window.partitionBy(*keys).orderBy("__slot"), Window.partitionBy(*keys).orderBy(F.desc("__slot"))
    carried = ends.select(
        *keys,
        "__slot",
        F.last("__last", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("__prior"),
        F.last("__first", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1)).alias("__next"),
    )
    inside = Window.partitionBy(*keys, "__slot")
    earlier = inside.orderBy("t", "is_fix", F.desc("fix")).rowsBetween(Window.unboundedPreceding, 0)
    later = inside.orderBy(F.desc("t"), F.desc("is_fix"), F.desc("fix")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(carried, [*keys, "__slot"], "left")
        .withColumn("before", F.coalesce(F.last("fix", ignorenulls=True).over(earlier), "__prior"))
        .withColumn("after", F.coalesce(F.last("fix", ignorenulls=True).over(later), "__next"))
        .where("is_fix = 0")
        .select(*keys, "id", "t", "before", "after")
    )


def _point_type(fixes: DataFrame) -> str:
    kinds = dict(fixes.dtypes)
    return f"struct<t:{kinds['t']},lat:{kinds['lat']},lon:{kinds['lon']}>"


def nearest(bracketed: DataFrame, tolerance: float) -> DataFrame:
    """The nearer of before and after within ``tolerance``; a tie goes to the earlier one."""
    gap_before = F.col("t") - F.col("before.t")
    gap_after = F.col("after.t") - F.col("t")
    take_before = gap_after.isNull() | (gap_before <= gap_after)
    chosen = F.when(gap_before.isNotNull() & take_before, F.col("before")).otherwise(F.col("after"))
    return bracketed.withColumn("fix", chosen).where(F.abs(F.col("fix.t") - F.col("t")) <= tolerance)


def locate(
    bracketed: DataFrame,
    high: float = 300,
    medium: float = 5400,
    widest: float = 6 * 3600,
    local_km: float = 2.0,
) -> DataFrame:
    """Adds lat, lon and confidence of each target, null where no fix can be trusted.

    Inside a bracket of at most ``widest`` seconds: the nearer fix if within ``high``,
    else the point between if the ends lie within ``local_km`` or the nearer one within
    ``medium``. Without such a bracket: the nearest fix within ``high`` or ``medium``.
    """
    t, before, after = F.col("t"), F.col("before"), F.col("after")
    gap_before, gap_after = t - before["t"], after["t"] - t
    span = after["t"] - before["t"]
    both = before.isNotNull() & after.isNotNull()
    closed = both & (span <= widest)
    nearer = F.when(both & (gap_before <= gap_after), before).when(both, after).otherwise(F.coalesce(before, after))
    gap = F.least(gap_before, gap_after)
    share = F.when(span > 0, gap_before / span).otherwise(0.0)
    apart = haversine_km(before["lat"], before["lon"], after["lat"], after["lon"])

    def pick(name: str) -> Column:
        return (
            F.when(gap <= high, nearer[name])
            .when(closed & ((apart <= local_km) | (gap <= medium)), interpolate(before[name], after[name], share))
            .when(~F.coalesce(closed, F.lit(False)) & (gap <= medium), nearer[name])
        )

    confidence = F.when(gap <= high, "high").when(
        (closed & ((apart <= local_km) | (gap <= medium))) | (~F.coalesce(closed, F.lit(False)) & (gap <= medium)), "medium"
    )
    return bracketed.withColumn("lat", pick("lat")).withColumn("lon", pick("lon")).withColumn("confidence", confidence)
