"""Connected components: forests of bounded partitions, contracted level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Edges that one task takes at a time.
TASK_EDGES = 500_000


def smallest_labels(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it) of an edge list, by vectorised hooking and jumping."""
    nodes, place = np.unique(np.concatenate([v, u]), return_inverse=True)
    a, b = place[: len(v)], place[len(v) :]
    label = np.arange(len(nodes))
    while True:
        one, two = label[a], label[b]
        low = np.minimum(one, two)
        following = label.copy()
        np.minimum.at(following, one, low)
        np.minimum.at(following, two, low)
        while True:
            jumped = following[following]
            if (jumped == following).all():
                break
            following = jumped
        if (following == label).all():
            return nodes, nodes[label]
        label = following


def _stars(edges: DataFrame, most: int) -> DataFrame:
    """v, u: one edge from each node of a lot to the smallest node of its component within the lot."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[np.ndarray]):
            node, label = smallest_labels(*np.concatenate(parts, axis=1))
            away = node != label
            return pa.RecordBatch.from_arrays([pa.array(node[away]), pa.array(label[away])], names=["v", "u"])

        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            held.append(np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype("i8") for n in (0, 1)]))
            size += batch.num_rows
            if size >= most:
                yield close(held)
                held, size = [], 0
        if size:
            yield close(held)

    return edges.select("v", "u").mapInArrow(scan, "v bigint, u bigint")


def components(edges: DataFrame, a: str, b: str, task_edges: int = TASK_EDGES, most_rounds: int = 60) -> DataFrame:
    """node, component: every node with an edge and the smallest node it is linked to.

    Edges are reduced to stars lot by lot. While the stars do not fit one lot, a round
    takes every node to one of its star centres and links the centres that share a
    node; nodes that are no centre leave with a pointer to theirs, so the next round
    works on centres only. Groups are aggregated, never collected, so one component may
    hold any share of the nodes. The last lot is final, and the pointers are followed
    back level by level. Ids are integers; null ends and self pairs link nothing.
    """
    scratch = Scratch(edges.sparkSession, "components")
    kind = edges.schema[a].dataType.simpleString()
    pairs = edges.select(F.col(a).cast("bigint").alias("v"), F.col(b).cast("bigint").alias("u")).where("v is not null and u is not null and v <> u")
    stars = scratch.keep(_stars(pairs, task_edges), "stars")
    left = stars.count()
    levels: list[DataFrame] = []
    for _ in range(most_rounds):
        if left <= task_edges:
            break
        centre = scratch.keep(stars.groupBy("v").agg(F.min("u").alias("c"), F.max("u").alias("d")), "centres")
        # Links between the centres of a node go through its smallest one.
        shared = stars.join(centre.where("c < d").select("v", "c"), "v").where("u <> c").select(F.col("u").alias("v"), F.col("c").alias("u"))
        middle = stars.select(F.col("u").alias("v")).distinct()
        inner = centre.join(middle, "v", "left_semi").select("v", F.col("c").alias("u"))
        levels.append(scratch.keep(centre.join(middle, "v", "left_anti").select("v", F.col("c").alias("u")), "level"))
        parts = max(1, -(-left // task_edges))
        linked = shared.unionByName(inner).distinct().repartition(parts, "u")
        following = scratch.keep(_stars(linked, task_edges), "stars")
        scratch.drop(stars, centre)
        stars, count = following, following.count()
        # If hardly anything met, the next lots are drawn another way.
        if count > 0.9 * left:
            stars = stars.repartition(parts, F.col("v"))
        left = count
    else:
        raise RuntimeError(f"no convergence within {most_rounds} rounds")
    last = _stars(stars.coalesce(1), 2 * task_edges)
    done = scratch.keep(last.select(F.col("v").alias("node"), F.col("u").alias("component")), "labels")
    for level in reversed(levels):
        above = done.select(F.col("node").alias("u"), F.col("component").alias("top"))
        placed = level.join(above, "u", "left").select(F.col("v").alias("node"), F.coalesce("top", "u").alias("component"))
        done = scratch.keep(done.unionByName(placed), "labels")
    out = done.unionByName(done.select(F.col("component").alias("node"), "component").distinct())
    return out.select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
