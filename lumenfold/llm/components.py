"""Consolidating pairwise matches into groups, by hierarchical union-find.

Every partition of edges is reduced to its spanning forest by union-find, a star
edge per record to the smallest record of its local component. Forests are merged
round by round: a record with several local roots links those roots, records that
are nobody's root retire with a pointer to theirs, and the remaining edges go to
partitions of bounded size. When they fit one partition, union-find over them is
final, and the retired records follow their pointers back.

Defined results: null ends and self pairs link nothing; repeated pairs and either
order count once; no edges give no groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Edges of one partition, which bounds the memory of a task.
PARTITION_EDGES = 1_000_000
MOST_ROUNDS = 60


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, root) of every record that is not the smallest of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    half = len(a)
    for u, v in zip(place[:half].tolist(), place[half:].tolist()):
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u < v:
            parent[v] = u
        elif v < u:
            parent[u] = v
    root = np.asarray(parent, dtype="i8")
    while True:
        up = root[root]
        if (up == root).all():
            break
        root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def local_forests(edges: DataFrame, bound: int = PARTITION_EDGES) -> DataFrame:
    """v, r: the spanning forests of blocks of at most ``bound`` edges of each partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(v, r):
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(r, pa.int64())], names=["v", "r"])

        held_a, held_b, held = [], [], 0
        for batch in batches:
            held_a.append(batch.column(0).to_numpy(zero_copy_only=False))
            held_b.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= bound:
                v, r = spanning_forest(np.concatenate(held_a), np.concatenate(held_b))
                # A forest has fewer edges than its block; if hardly fewer, it is passed on.
                if len(v) > bound // 2:
                    yield out(v, r)
                    held_a, held_b, held = [], [], 0
                else:
                    held_a, held_b, held = [v], [r], len(v)
        if held:
            yield out(*spanning_forest(np.concatenate(held_a), np.concatenate(held_b)))

    return edges.mapInArrow(scan, "v bigint, r bigint")


def connected_components(
    edges: DataFrame, a: str = "a", b: str = "b", partition_edges: int = PARTITION_EDGES
) -> DataFrame:
    """node, component: every record with a link, and the smallest record linked to it."""
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.col(a).cast("bigint").alias("v"), F.col(b).cast("bigint").alias("r")).where(
        F.col("v").isNotNull() & F.col("r").isNotNull() & (F.col("v") != F.col("r"))
    )
    forest = scratch.keep(local_forests(pairs, partition_edges), "forest")
    left = forest.count()
    retired: list[DataFrame] = []
    for _ in range(MOST_ROUNDS):
        if left <= partition_edges:
            break
        # Merge: one root per record; its other roots are linked to that one.
        least = forest.groupBy("v").agg(F.min("r").alias("m"))
        linked = (
            forest.join(least, "v")
            .where(F.col("r") != F.col("m"))
            .select(F.col("r").alias("v"), F.col("m").alias("r"))
            .distinct()
        )
        least = scratch.keep(least, "least")
        roots = forest.select(F.col("r").alias("v")).distinct()
        leaves = least.join(roots, "v", "left_anti").select("v", F.col("m").alias("r"))
        retired.append(scratch.keep(leaves, "retired"))
        # Roots that have a root themselves stay, each linked to the root of its root.
        inner = least.join(roots, "v", "left_semi").select("v", F.col("m").alias("r"))
        above = inner.select(F.col("v").alias("r"), F.col("r").alias("top"))
        jumped = inner.join(above, "r", "left").select("v", F.coalesce("top", "r").alias("r"))
        active = linked.unionByName(inner).unionByName(jumped).distinct()
        parts = max(1, -(-left // partition_edges))
        merged = local_forests(active.repartition(parts, F.least("v", "r")), partition_edges)
        following = scratch.keep(merged, "forest")
        scratch.drop(forest, least)
        forest, left = following, following.count()
    else:
        raise RuntimeError(f"no convergence within {MOST_ROUNDS} rounds")
    # What is left fits one partition: union-find over it is final.
    forest = local_forests(forest.coalesce(1), 2 * partition_edges)
    done = scratch.keep(forest.select(F.col("v").alias("node"), F.col("r").alias("component")), "done")
    for leaves in reversed(retired):
        top = done.select(F.col("node").alias("r"), "component")
        placed = leaves.join(top, "r", "left").select(
            F.col("v").alias("node"), F.coalesce("component", "r").alias("component")
        )
        done = scratch.keep(done.unionByName(placed), "done")
    return done.unionByName(done.select(F.col("component").alias("node"), "component").distinct())


def consolidate(
    ledger: DataFrame, membership: DataFrame, pairs: DataFrame, most_bits: int = 6
) -> DataFrame:
    """asset_id, group_id: every ledger record in a group of two or more.

    Ledger records are linked by a common cluster (each to the cluster's smallest
    one, not to all) or by a pair whose fingerprints are present and differ in at
    most ``most_bits`` bits. Ids without a ledger record link nothing.
    """
    known = ledger.select(F.col("id").alias("asset_id"), "phash").where(F.col("asset_id").isNotNull())
    joined = (
        membership.select("cluster_id", "asset_id")
        .where(F.col("cluster_id").isNotNull())
        .join(known.select("asset_id"), "asset_id", "left_semi")
    )
    heads = joined.groupBy("cluster_id").agg(F.min("asset_id").alias("head"))
    stars = joined.join(heads, "cluster_id").select(F.col("asset_id").alias("a"), F.col("head").alias("b"))
    prints = known.where(F.col("phash").isNotNull())
    tested = (
        pairs.select("asset_a", "asset_b")
        .where(F.col("asset_a") != F.col("asset_b"))
        .join(prints.select(F.col("asset_id").alias("asset_a"), F.col("phash").alias("one")), "asset_a")
        .join(prints.select(F.col("asset_id").alias("asset_b"), F.col("phash").alias("two")), "asset_b")
        .where(F.bit_count(F.col("one").bitwiseXOR(F.col("two"))) <= most_bits)
        .select(F.col("asset_a").alias("a"), F.col("asset_b").alias("b"))
    )
    grouped = connected_components(stars.where("a <> b").unionByName(tested))
    return grouped.select(F.col("node").alias("asset_id"), F.col("component").alias("group_id"))
