"""Targets, lattice and schedule of the mix."""

import math

import pytest
from pyspark.sql import functions as F

from sumtrail.llm import mixing


def filled(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    """Targets by plain iteration."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), total * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= most * sizes[s]}
        if not full:
            out |= {s: w[s] * level for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1_000, "c": 30, None: 500}, {"a": 5}, {"é": 7, "z": 900, "Z": 20, "": 4}, {"a": 0, "b": 100}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9), (sizes, s)


def test_lattice_visits_every_position_once_and_evenly():
    for n in (1, 2, 10, 997, 1_000):
        m = mixing.step(n)
        assert sorted(i * m % n for i in range(n)) == list(range(n))
    n, m = 1_000, mixing.step(1_000)
    for k in range(100, 1_001, 100):  # in any start of the schedule, an interval gets its share
        inside = sum((i * m % n) < 250 for i in range(k))
        assert abs(inside - k / 4) <= 3


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_mix(docs):
    rows = mixing.report(docs).toPandas()
    assert len(rows) == docs.count()
    by = rows.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.source_size).all()
    assert (abs(by.taken - by.target) <= 0.01 * by.target + 1).all()
    assert (rows.taken <= 2 * rows["size"]).all()
    want = filled(dict(by.source_size))
    assert all(math.isclose(by.target[s], want[s], rel_tol=1e-9) for s in want)
    again = mixing.report(docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert rows[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()


def test_schedule_covers_blocks_in_turn(docs):
    place = mixing.placed(docs)
    quota = mixing.quotas(place.groupBy("source").agg(F.sum("size").alias("source_size")))
    slots = mixing.slots(quota).toPandas()
    assert slots.slot.is_unique
    for source, rows in slots.sort_values("slot").groupby("source"):
        blocks = int(rows.block.max()) + 1
        assert [int(e * blocks + b) for e, b in zip(rows.epoch, rows.block)] == list(range(len(rows)))
    made = mixing.schedule(place, quota).groupBy("slot").agg(F.sum("words").alias("n")).toPandas()
    assert made.n.max() <= mixing.MIX.block_words


def test_edges(spark):
    schema = "doc_id long, text string, source string, size string, target int, n int"
    rows = [(1, None, "a", "", 1, 1), (2, "", "a", "", 1, 1), (3, " \n", None, "", 1, 1), (None, "one two", None, "", 1, 1),
            (5, "x y z", "b", "", 1, 1), (5, "x y z", "b", "", 1, 1), (6, "w " * 30_000, "a", "", 1, 1)]
    df = spark.createDataFrame(rows, schema)
    got = mixing.report(df).toPandas()
    assert len(got) == 7
    assert (got.taken <= 2 * got["size"]).all()
    assert got[got["size"] == 0].taken.sum() == 0
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = {(r.doc_id, r.n) for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(i in (None, 5, 6) for i, _ in copies)
    assert mixing.report(df.limit(0)).count() == 0
    assert mixing.mixed(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r)[:2] + (r.taken,) for r in mixing.report(one).collect()] == [(1, 0, 0)]


def test_words_of_the_mix(docs):
    """The stage's rows, whole documents, come near the targets too."""
    sized = mixing.mixed(docs).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n"))
    got = {r.source: r.n for r in sized.collect()}
    by = mixing.report(docs).groupBy("source").agg(F.max("target").alias("t"), F.max("size").alias("longest")).collect()
    for r in by:
        assert abs(got.get(r.source, 0) - r.t) <= r.longest + 1
