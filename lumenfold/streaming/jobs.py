"""Incremental jobs: registration, versioned work, replay, sessions of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import insert_absent


def register(known: DataFrame, listing: DataFrame, now: float, settle_s: float = 3600.0) -> DataFrame:
    """known (path, bytes, mtime) and the listed files it lacks that have settled; adds inserted.

    A file counts as settled when its mtime is at least ``settle_s`` before ``now``.
    """
    settled = listing.where(F.col("mtime") <= F.lit(now - settle_s)).select("path", "bytes", "mtime")
    return insert_absent(known.select("path", "bytes", "mtime"), settled, ["path"])


def register_stream(spark: SparkSession, source: DataFrame, ledger: str, checkpoint: str, settle_s: float, now: float) -> StreamingQuery:
    """Registers files of a stream (path, bytes, mtime) in a ledger table, each path once.

    A batch reads only the ledger's partitions of its own path hashes, and appends; a
    batch that is run again finds its rows there and adds none.
    """

    def add(batch: DataFrame, number: int) -> None:
        parts = F.pmod(F.xxhash64("path"), F.lit(64)).cast("int")
        fresh = batch.where(F.col("mtime") <= F.lit(now - settle_s)).groupBy("path").agg(
            F.min("bytes").alias("bytes"), F.min("mtime").alias("mtime")
        ).withColumn("part", parts)
        # At most 64 part numbers; as a filter they keep the other folders of the ledger unread.
        touched = [row["part"] for row in fresh.select("part").distinct().collect()]
        try:
            old = batch.sparkSession.read.parquet(ledger).where(F.col("part").isin(touched)).select("path", "part")
            fresh = fresh.join(old, ["part", "path"], "left_anti").select("path", "bytes", "mtime", "part")
        except Exception as error:  # the ledger does not exist yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        fresh.repartition("part").sortWithinPartitions("path").write.mode("append").partitionBy("part").parquet(ledger)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watermark(registered: DataFrame, source: str) -> DataFrame:
    """key, value: the greatest mtime among newly registered rows."""
    return registered.where("inserted").agg(F.max("mtime").alias("value")).select(F.lit(f"watermark:{source}").alias("key"), "value")


def work_due(assets: DataFrame, state: DataFrame, worker: str, version: str) -> DataFrame:
    """Assets (key) that ``worker`` has not done at ``version``; malformed state rows count as undone."""
    done = state.where((F.col("worker") == worker) & F.col("version").eqNullSafe(F.lit(version))).select("key")
    return assets.join(done, "key", "left_anti")


def prune_state(state: DataFrame, live: DataFrame) -> DataFrame:
    """State rows whose key is live; refuses to prune everything."""
    kept = state.join(live.select("key"), "key", "left_semi")
    if kept.isEmpty() and not state.isEmpty():
        raise ValueError("no state row matches a live asset; nothing is pruned")
    return kept


def replay(entries: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries after, target after) of replaying unsynced entries (key, content, synced_hash).

    An entry is due when its content hash differs from the synced one; a replayed
    entry takes the hash of what was written, so a change under way stays due. Running
    it again changes nothing.
    """
    digest = F.sha2(F.coalesce(F.col("content"), F.lit("")), 256)
    due = entries.where(~digest.eqNullSafe(F.col("synced_hash")))
    kept = target.join(due.select("key"), "key", "left_anti")
    after = entries.withColumn("synced_hash", digest)
    return after, kept.unionByName(due.select("key", "content"))


def window_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """window start, event_type, n, total of a stream or table (ts, event_type, value), late rows within ``late``."""
    marked = events.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = marked.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def stream_sessions(points: DataFrame, key: str, gap_s: float, most_km: float = 5.0, least: int = 3) -> DataFrame:
    """key, start, end, size of events of a stream (key, t TIMESTAMP, lat, lon).

    The state of a key is the open event: last time, number, and sums of the
    positions. An event closes when a point comes later than the gap or farther from
    the centre than ``most_km``, or when event time passes the gap.
    """
    kinds = dict(points.dtypes)

    def step(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from math import asin, cos, radians, sin, sqrt

        rows = []
        held = state.get if state.exists else None

        def close(s) -> None:
            if s[2] >= least:
                rows.append((group[0], pd.Timestamp(s[0], unit="s"), pd.Timestamp(s[1], unit="s"), s[2]))

        if state.hasTimedOut:
            close(held)
            state.remove()
        else:
            frame = pd.concat(list(batches)).sort_values("t", kind="stable")
            for t, lat, lon in zip(frame["t"].map(pd.Timestamp.timestamp), frame["lat"], frame["lon"]):
                if held is not None:
                    clat, clon = held[3] / held[2], held[4] / held[2]
                    half = sin(radians(lat - clat) / 2) ** 2 + cos(radians(clat)) * cos(radians(lat)) * sin(radians(lon - clon) / 2) ** 2
                    if t - held[1] > gap_s or 12742.0 * asin(sqrt(min(1.0, half))) > most_km:
                        close(held)
                        held = None
                held = (t, t, 1, lat, lon) if held is None else (held[0], max(held[1], t), held[2] + 1, held[3] + lat, held[4] + lon)
            state.update(held)
            state.setTimeoutTimestamp(int((held[1] + gap_s) * 1000) + 1)
        yield pd.DataFrame(rows, columns=[key, "start", "end", "size"])

    return points.withWatermark("t", f"{int(gap_s)} seconds").groupBy(key).applyInPandasWithState(
        step,
        f"{key} {kinds[key]}, start timestamp, end timestamp, size bigint",
        "start double, last double, n bigint, lat double, lon double",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
