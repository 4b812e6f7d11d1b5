"""Events from points in time and space, and runs in sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """df with session (from 1 per key): a new one where the time since the last row exceeds ``gap``.

    Rows in one time slot as wide as the gap are always of one session, so sessions are
    found on the first and last time of each slot; the rows of a hot key are never
    sorted in one task. Rows without a time get no session.
    """
    slotted = df.withColumn("__slot", F.floor(F.col(t) / F.lit(gap)))
    slots = slotted.where(F.col(t).isNotNull()).groupBy(*keys, "__slot").agg(F.min(t).alias("__first"), F.max(t).alias("__last"))
    order = Window.partitionBy(*keys).orderBy("__slot")
    opens = F.coalesce(F.col("__first") - F.lag("__last").over(order) > gap, F.lit(True)).cast("int")
    numbered = slots.withColumn("__opens", opens).withColumn("session", F.sum("__opens").over(order))
    return slotted.join(numbered.select(*keys, "__slot", "session"), [*keys, "__slot"], "left").drop("__slot")


def event_sweep(
    points: DataFrame, keys: list[str], gap: float = 4 * 3600, most_km: float = 5.0, least: int = 3
) -> DataFrame:
    """points (keys, id, t, lat, lon) with event, the smallest id-in-order of its event.

    In time order a point opens a new event if the gap since the last one exceeds
    ``gap`` or it lies farther than ``most_km`` from the running centre; events of fewer
    than ``least`` points are dropped. A gap resets the state, so the stretches between
    gaps are exact, independent units: they are found by a window and swept side by
    side. Equal times keep the order of id.
    """
    cut = gap_sessions(points.where("t is not null and lat is not null and lon is not null"), keys, "t", gap)
    placed = cut.repartition(*keys, "session").sortWithinPartitions(*keys, "session", "t", "id")
    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"id {kinds['id']}", f"event {kinds['id']}", "size bigint"])

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {"key": None, "members": [], "lat": 0.0, "lon": 0.0}

        def close(rows: list) -> None:
            size = len(state["members"])
            if size >= least:
                rows += [(*state["key"][:-1], member, state["members"][0], size) for member in state["members"]]

        columns = [*keys, "id", "event", "size"]
        for batch in batches:
            rows: list = []
            for *key, number, lat, lon in zip(*(batch[c] for c in (*keys, "session", "id", "lat", "lon"))):
                size = len(state["members"])
                far = False
                if size and state["key"] == key:
                    a, b = np.radians(state["lat"] / size), np.radians(lat)
                    half = (
                        np.sin((b - a) / 2) ** 2
                        + np.cos(a) * np.cos(b) * np.sin(np.radians(lon - state["lon"] / size) / 2) ** 2
                    )
                    far = 2 * 6371.0 * np.arcsin(np.sqrt(min(1.0, half))) > most_km
                if state["key"] != key or far:
                    if size:
                        close(rows)
                    state.update(key=key, members=[], lat=0.0, lon=0.0)
                state["members"].append(number)
                state["lat"] += lat
                state["lon"] += lon
            yield pd.DataFrame(rows, columns=columns)
        rows = []
        if state["members"]:
            close(rows)
        yield pd.DataFrame(rows, columns=columns)

    return placed.select(*keys, "session", "id", "lat", "lon").mapInPandas(sweep, schema)


def repeated_runs(df: DataFrame, keys: list[str], order: str, value: str, least: int) -> DataFrame:
    """df with run_length and in_loop: repeats of a run of ``least`` or more equal values but the first.

    Null and blank values belong to no run and end one.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    blank = F.col(value).isNull() | (F.col(value) == "")
    changes = F.when(blank | ~F.col(value).eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    marked = df.withColumn("__run", changes).withColumn("__run", F.sum("__run").over(w))
    run = Window.partitionBy(*keys, "__run")
    return (
        marked.withColumn("run_length", F.count(F.lit(1)).over(run))
        .withColumn("__at", F.row_number().over(run.orderBy(order)))
        .withColumn("in_loop", ~blank & (F.col("run_length") >= least) & (F.col("__at") > 1))
        .drop("__run", "__at")
    )


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, start, end of merged intervals; touching ones merge."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col(start) > reach, F.lit(True)).cast("int")
    marked = df.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(w))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def gaps_between(df: DataFrame, keys: list[str], start: str, end: str, total: str, pad: float = 0.0) -> DataFrame:
    """keys, start, end: what intervals (silences) leave of 0..total, padded, merged and clipped.

    Keys need at least one row; a row with null start and end stands for no interval.
    """
    silences = merge_intervals(df.where(F.col(start).isNotNull() & F.col(end).isNotNull()), keys, start, end)
    length = df.groupBy(*keys).agg(F.max(total).alias("total"))
    w = Window.partitionBy(*keys).orderBy("start")
    before = silences.withColumn("from", F.coalesce(F.lag("end").over(w), F.lit(0.0))).select(
        *keys, F.col("from").alias("s"), F.col("start").alias("e")
    )
    last = length.join(silences.groupBy(*keys).agg(F.max("end").alias("s")), keys, "left").select(
        *keys, F.coalesce("s", F.lit(0.0)).alias("s"), F.col("total").alias("e")
    )
    speech = before.unionByName(last).where("e > s")
    padded = speech.join(length, keys).select(
        *keys,
        F.greatest(F.col("s") - pad, F.lit(0.0)).alias("s"),
        F.least(F.col("e") + pad, F.col("total")).alias("e"),
    )
    return merge_intervals(padded, keys, "s", "e")
