import random

from conftest import rows_of

from lumenfold.llm import components as module
from lumenfold.llm.components import connected_components, consolidate


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    return {(x, find(x)) for x in linked}


def check(spark, edges, bound):
    frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    return rows_of(connected_components(frame, partition_edges=bound), "node", "component")


def test_random_graphs_with_small_partitions(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += edges[:20] + [(b, a) for a, b in edges[:20]] + [(7, 7), (None, 3), (3, None)]
    for bound in (1_000_000, 40):
        assert check(spark, edges, bound) == brute(edges)


def test_chain_in_random_order_and_star(spark):
    names = list(range(200))
    random.Random(6).shuffle(names)
    chain = list(zip(names, names[1:]))
    star = [(1000, 1001 + n) for n in range(300)]
    assert check(spark, chain + star, 50) == brute(chain + star)


def test_empty(spark):
    assert check(spark, [], 10) == set()


def test_consolidate(spark):
    ledger = [(n, n) for n in range(1, 9)] + [(1, 1), (20, None), (21, 0), (22, 127)]
    ledger = spark.createDataFrame([(a, p, "x") for a, p in ledger], "id bigint, phash bigint, cluster_id string")
    membership = [(1, 1), (1, 2), (1, 2), (2, 2), (2, 3), (3, 99), (3, 4), (None, 5), (None, 6)]
    membership = spark.createDataFrame(membership, "cluster_id bigint, asset_id bigint")
    pairs = [(5, 6), (6, 5), (7, 7), (20, 8), (8, 99), (21, 22), (5, None)]
    pairs = spark.createDataFrame(pairs, "asset_a bigint, asset_b bigint")
    found = rows_of(consolidate(ledger, membership, pairs))
    assert found == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}


def test_forest_of_a_block_is_small():
    import numpy as np

    v, r = module.spanning_forest(np.array([3, 2, 9, 3]), np.array([2, 1, 9, 1]))
    assert set(zip(v.tolist(), r.tolist())) == {(3, 1), (2, 1)}
