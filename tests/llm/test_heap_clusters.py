"""Clusters against plain Lloyd rounds."""

from hashlib import sha256

import numpy as np
import pytest

from sumtrail.llm import heap_clusters

KIND = "id long, vector array<long>"


def plain(rows, length, k=8, rounds=10, seed=3, largest=heap_clusters.LARGEST):
    rows = [(i, [int(x) for x in v]) for i, v in rows if v is not None and len(v) == length and None not in v and max(map(abs, v)) <= largest]
    key = lambda r: (r[0] is None, "" if r[0] is None else sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(rows, key=key)[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [near(v)[0] for _, v in rows]
        for c in range(len(centroids)):
            held = [v for (_, v), o in zip(rows, own) if o == c]
            if held:
                centroids[c] = [sum(x) // len(held) for x in zip(*held)]
    found = [(i, *near(v)) for i, v in rows]
    held = lambda n: n if n < 1 << 63 else None
    total = held(sum(d for _, _, d in found))
    return sorted(((i, c, d, held(sum(e for _, o, e in found if o == c)), total, sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                   for i, c, d in found), key=repr)


def check(spark, rows, length, **more):
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = heap_clusters.report(df, length, **more)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, length, **more)


@pytest.mark.parametrize("block", [4096, 7])
def test_random_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(heap_clusters.packed, "__defaults__", (block,))
    r = np.random.default_rng(block)
    check(spark, [(i, [int(x) for x in r.integers(-30, 30, 3) + 20 * (i % 4)]) for i in range(120)], 3)


def test_ties_copies_and_empty_clusters(spark):
    # All on few places: many equal distances, equal starts, clusters that stay empty.
    check(spark, [(i, [i % 3, 0]) for i in range(60)], 2, rounds=4)
    check(spark, [(i, [1, 1]) for i in range(40)] + [(40, [9, 9])], 2, rounds=4)


def test_nulls_lengths_large_and_few(spark):
    rows = [(1, [1, 2]), (2, None), (3, [None, 1]), (4, [1]), (5, []), (6, [1 << 40, 0]), (None, [5, 5]), (7, [-(1 << 27), 1 << 27]), (1, [3, 2]), (1, [1, 2])]
    check(spark, rows, 2, rounds=3)
    check(spark, rows, 2, k=2, rounds=3)
    check(spark, rows[:1], 2)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(1)
    check(spark, [(i, [int(x) for x in r.integers(-(1 << 27), 1 << 27, 64)]) for i in range(40)], 64, rounds=3)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], KIND)
    assert heap_clusters.report(empty, 2).count() == 0
    rows = spark.createDataFrame([(i, [i, 0], "x", 1) for i in range(20)], f"{KIND}, block string, cluster int")
    got = heap_clusters.report(rows, 2, k=2)
    assert got.count() == 20 and got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_only_expired_vectors_are_popped():
    r = np.random.default_rng(2)
    vectors = np.concatenate([r.integers(-9, 9, (300, 4)) + c for c in ([0] * 4, [200] * 4, [90, 0, 0, 0])])
    centroids = np.array([[0] * 4, [200] * 4, [60, 0, 0, 0]])
    distances = heap_clusters.squared(vectors, centroids)
    near = distances.argmin(axis=1)
    heaps = heap_clusters.Heaps.new(heap_clusters.gaps(distances, near), near, 3)
    drift = np.zeros(3)
    popped = 0
    for step in range(30):
        moved = centroids + np.array([[1, 0, 0, 0], [0, 0, 0, 0], [1, 0, 0, 0]])
        drift, centroids = drift + heap_clusters.drifts(centroids, moved), moved
        places, _ = heaps.expired(drift)
        popped += len(places)
        distances = heap_clusters.squared(vectors[places], centroids)
        near = distances.argmin(axis=1)
        heaps.enter(heap_clusters.gaps(distances, near) + drift[near], places, near)
        assert (heaps.clusters(900) == heap_clusters.squared(vectors, centroids).argmin(axis=1)).all()
    assert 0 < popped < 0.2 * 30 * 900


def test_rounds_join_without_a_shuffle(spark):
    rows = spark.createDataFrame([(i, [i % 50, i % 7]) for i in range(500)], KIND)
    blocks, a = heap_clusters.bucketed(heap_clusters.packed(rows, 2, 50), 4)
    heaps, b = heap_clusters.bucketed(heap_clusters._entered(blocks, np.array([[0, 0], [40, 3]]), 2), 4)
    plan = blocks.hint("merge").join(heaps, "block")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for name in (a, b):
        heap_clusters._dropped(spark, name)
