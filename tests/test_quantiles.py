"""Exact quantiles against brute force, with hot keys and tied values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumtrail.functions.quantiles import exact_quantiles

FRACTIONS = [0.25, 0.5, 0.75]


def frame(spark, rows):
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "k string, x double")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 5000])
@pytest.mark.parametrize("kind", ["distinct", "tied", "heavy"])
def test_ungrouped(spark, n, kind):
    rng = np.random.default_rng(n)
    x = {"distinct": rng.random(n), "tied": rng.integers(0, 3, n), "heavy": np.exp(rng.normal(size=n) * 6)}[kind]
    df = frame(spark, [("a", v) for v in x])
    row = exact_quantiles(df, "x", FRACTIONS).first()
    assert np.allclose([row.q25, row.q50, row.q75], np.quantile(x, FRACTIONS), rtol=1e-12)
    rank = exact_quantiles(df, "x", [0.33, 0.66], rank_form=True).first()
    ordered = np.sort(x)
    assert [rank.q33, rank.q66] == [ordered[int(np.floor(n * f))] for f in (0.33, 0.66)]


def test_hot_null_and_small_keys(spark):
    """One key holds most rows, one key is NULL, one has a single row."""
    rng = np.random.default_rng(5)
    groups = {"hot": rng.normal(size=4000), None: rng.normal(size=50), "one": np.array([3.0])}
    df = frame(spark, [(k, v) for k, x in groups.items() for v in x])
    got = {r.k: r for r in exact_quantiles(df, "x", FRACTIONS, ["k"], extra=[F.avg("_x").alias("m")]).collect()}
    assert set(got) == set(groups)
    for key, x in groups.items():
        assert got[key].n == len(x)
        assert np.allclose([got[key].q25, got[key].q50, got[key].q75], np.quantile(x, FRACTIONS))
        assert np.isclose(got[key].m, x.mean())


def test_missing_values_are_skipped(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert exact_quantiles(df, "x", [0.5]).first().q50 == 2.0
    empty = spark.createDataFrame([("a", None)], "k string, x double")
    assert exact_quantiles(empty, "x", [0.5], ["k"]).count() == 0


def test_large_enough_for_the_sketch_to_be_inexact(spark):
    """More rows than the sketch keeps: only brackets survive and stay exact."""
    df = spark.range(300_000).select((F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    got = exact_quantiles(df, "x", FRACTIONS).first()
    want = np.quantile(np.array([r.x for r in df.collect()]), FRACTIONS)
    assert np.allclose([got.q25, got.q50, got.q75], want, rtol=1e-12)


def test_not_numbers_are_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    row = exact_quantiles(df, "x", [0.5], names=["median"]).first()
    assert (row.n, row.median) == (2, 1.5)


def test_rows_of_a_bracket_are_counted_in_parts(spark):
    """No window runs over all rows of a bracket: each is by key and part, or over the parts."""
    df = spark.range(1000).selectExpr("cast(id as double) as x")
    plan = exact_quantiles(df, "x", [0.25, 0.5])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("_part" in line or "_in_part" in line for line in windows)


@pytest.mark.parametrize("ranked", [1, 50_000])
def test_quantiles_from_counts(spark, ranked):
    import math
    import random

    from sumtrail.functions.quantiles import counted_quantiles

    random.seed(ranked)
    groups = {
        "wide": [(random.choice([-1, 1]) * 10 ** random.uniform(-300, 300), random.randint(1, 9)) for _ in range(200)],
        "near": [(1e9 + random.random(), 1) for _ in range(300)],
        "hot": [(5.0, 1_000_000), (4.0, 3), (6.0, 2), (6.0, 1)],
        "ends": [(-1.7e308, 1), (1.7e308, 1), (5e-324, 1), (0.0, 1), (-0.0, 2)],
        "one": [(7.25, 1)], "two": [(1.0, 1), (2.0, 1)],
        "none": [(None, 3), (float("nan"), 1), (float("inf"), 2), (3.0, 0)],
    }
    rows = [(k, x, n) for k, found in groups.items() for x, n in found]
    df = spark.createDataFrame(rows, "k string, x double, n long").repartition(4)
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: tuple(r)[1:] for r in counted_quantiles(df, "x", "n", fractions, ["k"], ranked=ranked).collect()}
    assert set(got) == set(groups) - {"none"}
    for k in got:
        held = sorted((x, n) for x, n in groups[k] if n)
        total = sum(n for _, n in held)

        def at(rank):
            for x, n in held:
                if rank < n:
                    return x
                rank -= n

        want = []
        for f in fractions:
            p = (total - 1) * f
            low, high = at(math.floor(p)), at(math.ceil(p))
            want.append(low + (high - low) * (p - math.floor(p)) if low != high else low)
        assert got[k][0] == total
        assert all(a == b or math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[k][1:], want)), (k, got[k], want)
