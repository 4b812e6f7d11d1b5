"""Equi-join that splits hot keys into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most hot keys that are sent to every executor; more are joined by shuffle.
HOT_KEYS_BROADCAST = 20_000


def blocked_join(probe: DataFrame, build: DataFrame, keys: list[str], per_block: int = 20_000) -> DataFrame:
    """Inner equi-join of ``probe`` and ``build`` on ``keys``.

    A key with more than ``per_block`` build rows is cut into blocks of about that
    many rows: each build row goes to one block, each probe row to all blocks of its
    key, so no task has to take a whole hot key. Rows with a null key join nothing.
    Column names other than ``keys`` must be distinct between the sides.
    """
    counts = build.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > per_block)
    hot = counts.select(*keys, F.ceil(F.col("__n") / F.lit(per_block)).cast("int").alias("__blocks"))
    found = hot.take(HOT_KEYS_BROADCAST + 1)
    if not found:
        return probe.join(build, keys)
    if len(found) <= HOT_KEYS_BROADCAST:
        hot = F.broadcast(build.sparkSession.createDataFrame(found, hot.schema))
    values = [c for c in build.columns if c not in keys]
    salted = build.join(hot, keys, "left").withColumn(
        "__block", F.pmod(F.xxhash64(*values), F.coalesce("__blocks", F.lit(1))).cast("int")
    )
    spread = probe.join(hot, keys, "left").withColumn(
        "__block", F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1))
    )
    return spread.drop("__blocks").join(salted.drop("__blocks"), [*keys, "__block"]).drop("__block")
