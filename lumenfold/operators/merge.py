"""After-images of table changes: upserts, guarded updates, lock arrays, replacements.

Parquet tables are never changed in place; each operator gives the table as it
stands after the change, to be written as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows of ``new`` whose keys it lacks; a null key never conflicts.

    Adds inserted, true for the new rows. Of new rows with equal keys the smallest
    whole row is taken.
    """
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    rest = [c for c in new.columns if c not in keys]
    keyed = new.where(complete).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("row"))
    keyed = keyed.select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest)).select(*new.columns)
    fresh = keyed.join(target.select(*keys), keys, "left_anti").unionByName(new.where(~complete))
    return target.withColumn("inserted", F.lit(False)).unionByName(fresh.withColumn("inserted", F.lit(True)))


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """target with the last change per key, by ``order``, written over it or added."""
    rest = [c for c in target.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("row"))
    last = last.select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))
    kept = target.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.select(*target.columns))


def guarded_update(target: DataFrame, changes: DataFrame, key: str, column: str, guard: Column, locks: str | None = None) -> DataFrame:
    """target with ``column`` replaced where ``guard`` holds and a change exists.

    ``changes``: key, new_value, one row per key. Adds written. With ``locks`` the
    column's name joins that array wherever it was written.
    """
    met = target.join(changes.select(key, "new_value"), key, "left")
    writes = F.col("new_value").isNotNull() & F.coalesce(guard, F.lit(False))
    out = met.withColumn("written", writes).withColumn(column, F.when(F.col("written"), F.col("new_value")).otherwise(F.col(column)))
    if locks:
        grown = F.array_union(F.coalesce(F.col(locks), F.array().cast("array<string>")), F.array(F.lit(column)))
        out = out.withColumn(locks, F.when(F.col("written"), grown).otherwise(F.col(locks)))
    return out.drop("new_value")


def replace_where(target: DataFrame, new: DataFrame, keys: list[str], doomed: Column) -> DataFrame:
    """target without the rows for which ``doomed`` holds and whose keys ``new`` has, plus ``new``."""
    renewed = new.select(*keys).distinct().withColumn("__renewed", F.lit(True))
    kept = target.join(renewed, keys, "left").where(~(F.coalesce(F.col("__renewed"), F.lit(False)) & doomed)).drop("__renewed")
    return kept.unionByName(new)


def add_locks(locked: Column, *names: str) -> Column:
    return F.array_union(F.coalesce(locked, F.array().cast("array<string>")), F.array(*(F.lit(n) for n in names)))


def drop_locks(locked: Column, *names: str) -> Column:
    return F.array_except(F.coalesce(locked, F.array().cast("array<string>")), F.array(*(F.lit(n) for n in names)))


def sync_plan(wanted: DataFrame, present: DataFrame, key: str, value: str) -> DataFrame:
    """key, action: create, update, delete or skip, from a full outer join."""
    one = wanted.select(key, F.col(value).alias("__want"), F.lit(1).alias("__w"))
    two = present.select(key, F.col(value).alias("__have"), F.lit(1).alias("__p"))
    action = (
        F.when(F.col("__p").isNull(), "create")
        .when(F.col("__w").isNull(), "delete")
        .when(~F.col("__want").eqNullSafe(F.col("__have")), "update")
        .otherwise("skip")
    )
    return one.join(two, key, "full").select(key, action.alias("action"))
