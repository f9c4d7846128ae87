"""Hard negatives against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumtrail.llm import hard_negatives

KIND = "id long, label int, vector array<long>"


def plain(rows, anchors, positives=5, negatives=10, low=30, high=90):
    rows = [r for r in rows if None not in r and None not in r[2] and max(map(abs, r[2]), default=0) <= hard_negatives.LARGEST and r[2]]
    anchors = {(a, label, tuple(v)) for a, label, v in (r for r in rows if r[0] in anchors)}
    out = []
    for a, label, v in anchors:
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, other) for i, other, w in rows if i != a and len(w) == len(v))
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(-s, i) for s, i, other in scored if other != label and low * -score <= 100 * -s <= high * -score][:negatives]
            out += [(a, p, k, i, -score, s) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def check(spark, rows, anchors, **more):
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = hard_negatives.mined(df, df.where(F.col("id").isin(*anchors)), **more)
    assert sorted(map(tuple, got.collect())) == plain(rows, set(anchors), **more)
    return got


def near_rows(n, seed, dim=6, size=40):
    """Clusters of near vectors, so that bounds along the tree do leave rows out."""
    r = np.random.default_rng(seed)
    centres = r.integers(-size, size, (5, dim))
    return [(i, int(r.integers(0, 4)), [int(x) for x in centres[i % 5] + r.integers(-2, 3, dim)]) for i in range(n)]


@pytest.mark.parametrize("chunk, block, most", [(512, 2048, 1 << 24), (4, 16, 300), (1, 1, 1)])
def test_chunks_blocks_and_passes(spark, monkeypatch, chunk, block, most):
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "PIVOTS", 3)
    monkeypatch.setattr(hard_negatives.packed, "__defaults__", (block,))
    monkeypatch.setattr(hard_negatives.passes, "__defaults__", (most,))
    check(spark, near_rows(90, 1), range(0, 90, 9 if chunk > 1 else 45))


def test_windows_signs_and_ties(spark):
    rows = near_rows(60, 2, size=3) + [(i, i % 2, [0, 0, 0, 0, 0, 0]) for i in range(100, 110)] + [(i, 1, [1, 1, 1, 1, 1, 1]) for i in range(110, 130)]
    check(spark, rows, [0, 1, 100, 101, 110, 111], low=10, high=100)
    check(spark, rows, [0, 110], positives=50, negatives=2)


def test_nulls_lengths_copies_and_one_label(spark):
    rows = [
        (0, 1, [5, 0]), (1, 1, [4, 1]), (2, 2, [3, 0]), (3, 2, [2, 9]), (3, 2, [2, 9]), (4, None, [3, 0]), (None, 2, [3, 0]), (5, 2, None),
        (6, 2, [None, 3]), (7, 2, [3]), (8, 2, []), (9, 2, [1 << 40, 0]), (10, 1, [2]), (11, 2, [1]), (0, 1, [5, 0]), (12, 3, [3, 3, 3])]
    got = check(spark, rows, [0, 7, 8, 10, 12])
    assert got.where("anchor_id = 0 and negative_id = 3").count() in (0, 2)
    check(spark, [(i, 7, [i, 1]) for i in range(30)], [0, 10])


def test_large_components_are_exact(spark):
    r = np.random.default_rng(3)
    check(spark, [(i, i % 3, [int(x) for x in r.integers(-(1 << 23), 1 << 23, 40)]) for i in range(60)], range(0, 60, 6), low=0, high=100)


def test_whole_takes_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan")]), (3, [None, 1.0]), (4, None), (5, [float("-inf")]), (6, []), (7, [1e300])], "i int, v array<double>")
    got = {r.i: r.w for r in df.select("i", hard_negatives.whole(F.col("v"), 256).alias("w")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: [], 7: [10**17]}


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], KIND)
    assert hard_negatives.mined(empty, empty).count() == 0
    rows = spark.createDataFrame([(i, i % 2, [i + 1, 1], "x", 5, 1) for i in range(20)], f"{KIND}, chunk string, dim int, score int")
    assert hard_negatives.mined(rows, rows.where("id < 2")).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_tree_is_minimal_and_bounds_leave_rows_out(spark):
    r = np.random.default_rng(4)
    m = r.integers(-50, 50, (40, 5)).astype(float)
    order, parent, edge = hard_negatives.spanning_tree(m)
    assert sorted(order.tolist()) == list(range(40)) and all(p < k for k, p in enumerate(parent) if k)
    assert all(np.isclose(edge[k], np.linalg.norm(m[order[k]] - m[order[parent[k]]])) for k in range(1, 40))
    joined, rest, total = {0}, set(range(1, 40)), 0.0
    while rest:
        d, b = min((np.linalg.norm(m[a] - m[b]), b) for a in joined for b in rest)
        total, joined, rest = total + d, joined | {b}, rest - {b}
    assert np.isclose(edge.sum(), total)

    rows = near_rows(400, 5, size=400)
    block = {"ids": np.array([i for i, _, _ in rows]).tobytes(), "labels": np.array([x for _, x, _ in rows]).tobytes(), "dim": 6, "width": 4,
             "vectors": np.array([v for _, _, v in rows], "<i4").tobytes()}
    own = rows[:100]
    order, parent, edge = hard_negatives.spanning_tree(np.array([v for _, _, v in own], float))
    chunk = {"own_ids": np.array([own[i][0] for i in order]).tobytes(), "own_labels": np.array([own[i][1] for i in order]).tobytes(), "dim": 6,
             "own_width": 4, "own_vectors": np.array([own[i][2] for i in order], "<i4").tobytes(), "parents": parent.tobytes(), "edges": edge.tobytes(),
             "goals": [{"place": k, "goal": 1, "low": 0, "high": 10} for k in range(100)]}
    scored = hard_negatives._Chunk(chunk, 3).search(hard_negatives._Block(block))
    assert scored < 0.5 * 100 * 400
