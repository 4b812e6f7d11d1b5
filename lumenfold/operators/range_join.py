"""Pairs and joins by distance on a number line, as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import blocked_join


def range_join(
    left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, equal: list[str] = []
) -> DataFrame:
    """Inner join of rows whose values differ by at most ``width`` (and agree on ``equal``).

    Each right row goes to the bucket of its value, each left row to the two or three
    buckets it can reach; nulls join nothing. Other column names must differ.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    step = float(width)
    home = right.where(F.col(right_value).isNotNull()).withColumn("__bucket", F.floor(F.col(right_value) / step))
    reach = F.sequence(F.floor((F.col(left_value) - step) / step), F.floor((F.col(left_value) + step) / step))
    probe = left.where(F.col(left_value).isNotNull()).withColumn("__bucket", F.explode(reach))
    met = blocked_join(probe, home, [*equal, "__bucket"])
    return met.where(F.abs(F.col(left_value) - F.col(right_value)) <= width).drop("__bucket")


def near_pairs_in_time(df: DataFrame, key: str, seconds: str, width: float) -> DataFrame:
    """id_a < id_b of rows at most ``width`` seconds apart."""
    one = df.select(F.col(key).alias("id_a"), F.col(seconds).alias("__a"))
    two = df.select(F.col(key).alias("id_b"), F.col(seconds).alias("__b"))
    return range_join(one, two, "__a", "__b", width).where("id_a < id_b").select("id_a", "id_b").distinct()


def block_pairs(df: DataFrame, key: str, blocks: Column, most_members: int = 200) -> DataFrame:
    """id_a < id_b of rows that share a block key of 2 to ``most_members`` members.

    The cap is part of the operator's meaning: a larger block proves nothing and is
    left out whole, counted before pairing.
    """
    rows = df.select(F.col(key).alias("id"), F.explode(F.array_compact(blocks)).alias("block")).distinct()
    sizes = rows.groupBy("block").count().where(F.col("count").between(2, most_members)).select("block")
    kept = rows.join(sizes, "block")
    one, two = kept.withColumnRenamed("id", "id_a"), kept.withColumnRenamed("id", "id_b")
    return one.join(two, "block").where("id_a < id_b").select("id_a", "id_b").distinct()
