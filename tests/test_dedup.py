"""Removing repeated rows with hashes first."""

import random

import pytest

from sumtrail.operators import clean


@pytest.mark.parametrize("few", [0, 3, 100_000])
def test_each_row_once(spark, few):
    random.seed(few)
    cells = ["", "a", " a ", "1", "n/a", "a|", "é", "1:a", "-"]
    rows = [(random.choice(cells), random.choice(cells), None if random.random() < 0.2 else random.choice(cells)) for _ in range(400)]
    rows += [(f"own {i}", "x", "y") for i in range(50)]
    df = spark.createDataFrame(rows, "_key string, count string, `b.c` string").repartition(5)
    got = clean.deduplicated(df, True, few)
    want = clean.standardised(df).distinct()
    assert got.columns == want.columns
    key = lambda frame: sorted((tuple(r) for r in frame.collect()), key=repr)
    assert key(got) == key(want)


def test_rows_that_occur_once_are_not_shuffled(spark):
    df = spark.createDataFrame([(f"k{i}", "x" * 50) for i in range(300)] + [("same", "row")] * 40, "a string, b string").repartition(4).cache()
    df.count()
    out = clean.deduplicated(df, True)
    assert out.count() == 301
    plan = out._jdf.queryExecution().executedPlan().toString()
    # The only exchange by key is that of rows whose hash occurs twice.
    anti = plan[plan.index("LeftAnti") : plan.index("LeftSemi")]
    assert "Exchange hashpartitioning" not in anti.split("HashAggregate")[0]
    assert clean.deduplicated(df.limit(0), True).count() == 0


def test_wide_tables_go_by_hash(spark, monkeypatch):
    asked = []
    plain = clean.deduplicated
    monkeypatch.setattr(clean, "deduplicated", lambda df, by_hash=False: asked.append(by_hash) or plain(df, by_hash))
    for width in (5, 400):
        df = spark.createDataFrame([(str(i % 10), "x" * width) for i in range(30)], "a string, b string")
        assert clean.clean(df).rows.count() == 10
    assert asked == [False, True]
