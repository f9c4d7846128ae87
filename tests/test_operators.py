"""Hand-computed cases and invariants of single operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from checks.views import dirty_events, sales
from sumtrail.operators import actions as ac
from sumtrail.operators import breakdown as bd
from sumtrail.operators import clean as cl
from sumtrail.operators import profile as pf
from sumtrail.operators import retail as rt
from sumtrail.operators import scorecard as sc
from sumtrail.operators import segments as sg
from sumtrail.operators import series as sr
from sumtrail.operators import stats as st
from sumtrail.session import written


def month_series(spark, values, start=(2024, 1)):
    rows = [(dt.date(start[0] + (start[1] - 1 + i) // 12, (start[1] - 1 + i) % 12 + 1, 1), float(v), 1)
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "month date, value double, n bigint")


def facts(spark, values, quality=80, repeat=None):
    series = month_series(spark, values)
    shape = sr.selected_outlook(series).select(
        "periods", "total", "first_value", "last_value", "mean", "sd", "next_value", "confidence")
    drops = sr.anomalies(series).agg(F.count_if(F.col("is_anomaly") & (F.col("actual") < F.col("expected"))).alias("drops"))
    customers = repeat and len(repeat)
    return shape.crossJoin(drops).withColumns({
        "quality_score": F.lit(quality), "customers": F.lit(customers).cast("bigint"),
        "repeaters": F.lit(repeat and sum(v > 1 for v in repeat)).cast("bigint"),
        "at_risk": F.lit(None).cast("bigint"), "churn_score": F.lit(None).cast("bigint"),
        "revenue_at_risk": F.lit(None).cast("double"), "top_share": F.lit(None).cast("double"),
        "top_label": F.lit(None).cast("string"),
    })


def health(spark, *args, **kwargs):
    return sc.health_scores(facts(spark, *args, **kwargs)).first()


def test_health_scores(spark):
    assert health(spark, [100, 120, 150, 200]).trend > health(spark, [100, 100, 100, 100]).trend
    assert health(spark, [50, 500, 20, 800, 10]).stability < health(spark, [100, 102, 98, 101, 99]).stability
    neutral = health(spark, [100])
    assert (neutral.trend, neutral.customer, neutral.quality) == (12, 12, 20)
    extreme = health(spark, [1, 1_000_000], quality=0)
    assert all(0 <= v <= 25 for v in (extreme.trend, extreme.customer, extreme.quality, extreme.stability))
    assert 0 <= extreme.total <= 100
    assert health(spark, [100], repeat=[5, 4]).customer > health(spark, [100], repeat=[1, 1]).customer


def test_holt_and_trend(spark):
    row = sr.forecast_outlook(month_series(spark, [100, 120, 150, 200])).first()
    assert row.holt == 204.0
    single = sr.linear_forecast(month_series(spark, [5])).collect()
    assert [r.value for r in single] == [0.0] * 6
    assert single[0].month == dt.date(2024, 2, 1)


def test_forecast_crosses_the_year(spark):
    points = sr.linear_forecast(month_series(spark, [1, 2, 3], start=(2024, 10))).orderBy("month").collect()
    assert [r.month for r in points][:2] == [dt.date(2025, 1, 1), dt.date(2025, 2, 1)]
    assert [r.value for r in points][:2] == [4.0, 5.0]


def test_anomalies_need_three_months(spark):
    assert sr.anomalies(month_series(spark, [1, 2])).count() == 0
    flat = sr.anomalies(month_series(spark, [5, 5, 5])).collect()
    assert [r.z_score for r in flat] == [0.0] * 3
    spike = sr.anomalies(month_series(spark, [10] * 11 + [100])).where("is_anomaly").collect()
    assert [r.actual for r in spike] == [100.0]


def test_every_action_rule_can_fire(spark):
    base = facts(spark, [100, 90, 95, 92, 91, 90], quality=60, repeat=[1, 2, 3]).withColumns({
        "top_share": F.lit(70.0), "churn_score": F.lit(65).cast("bigint"), "at_risk": F.lit(2).cast("bigint"),
        "revenue_at_risk": F.lit(50.0), "next_value": F.lit(500.0), "strong_pair": F.lit(True)})
    every = ac.ranked_actions(base).orderBy("rule").collect()
    assert [r.rule for r in every] == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert [r.rule for r in ac.ranked_actions(base, k=6).orderBy("rule").collect()] == [1, 2, 3, 4, 5, 6]
    quiet = base.withColumns({
        "top_share": F.lit(10.0), "churn_score": F.lit(0).cast("bigint"), "at_risk": F.lit(0).cast("bigint"),
        "next_value": F.lit(0.0), "customers": F.lit(500).cast("bigint"), "first_value": F.lit(10.0)})
    assert [r.rule for r in ac.ranked_actions(quiet).orderBy("rule").collect()] == [7, 8, 9]
    by_rule = {r.rule: r for r in every}
    assert by_rule[1].urgency == "immediate" and by_rule[1].value == 391.0
    assert by_rule[4].related_risks == "customer_base,churn" and by_rule[4].urgency == "immediate"


def test_retail_rules(spark):
    lines = spark.createDataFrame(
        [("a", "x", "£10.00", "2 pcs"), ("a", "y", "1", "0"), ("b", "x", "bad", "5")],
        "customer string, product string, unit_price string, qty string")
    kept = rt.line_revenue(lines, "unit_price", "qty")
    assert sorted(r.line_revenue for r in kept.collect()) == [1.0, 20.0]
    totals = rt.line_revenue(lines.withColumnRenamed("unit_price", "total_amount"), "total_amount", "qty")
    assert sorted(r.line_revenue for r in totals.collect()) == [1.0, 10.0]
    risk = rt.dependency_risk(kept, "product").first()
    assert (risk.product, risk.level, risk.share_pct) == ("x", "high", 95)


def test_correlation_of_a_constant_column_is_zero(spark):
    df = spark.range(10).select(F.col("id").alias("a"), F.lit(3.0).alias("b"), (-F.col("id")).alias("c"))
    got = {(r.column_a, r.column_b): (r.coefficient, r.strength, r.direction)
           for r in st.correlations(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == (0.0, "negligible", "none")
    assert got["a", "c"] == (-1.0, "very_strong", "negative")


def test_null_keys_are_groups(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "b", 3.0), ("k", "a", 5.0)], "k string, c string, v double")
    got = {(r.k, r.label): r.pct for r in bd.breakdown(df, "c", "v", ["k"]).collect()}
    assert got == {(None, "a"): 25.0, (None, "b"): 75.0, ("k", "a"): 100.0}


def test_shares_sum_to_one_hundred(spark, sf):
    f = sales(spark, sf, "region", "product", "revenue")
    sums = bd.breakdown(f, "product", "revenue", ["region"]).groupBy("region").agg(F.sum("pct").alias("p"))
    assert all(abs(r.p - 100) < 0.5 for r in sums.collect())


def test_grouped_total_equals_ungrouped(spark, sf):
    f = sales(spark, sf, "region", "order_date", "revenue")
    whole = st.monthly_series(f, "order_date", "revenue").agg(F.sum("value")).first()[0]
    parts = st.monthly_series(f, "order_date", "revenue", ["region"]).agg(F.sum("value")).first()[0]
    assert abs(whole - parts) < 0.01


@pytest.mark.parametrize("operator", [
    lambda df: bd.breakdown(df, "product", "revenue"),
    lambda df: st.monthly_series(df, "order_date", "revenue", ["product"]),
    lambda df: sg.customer_segments(sg.customer_rollup(df, "customer_id", "order_date", "revenue")).drop("spend"),
    lambda df: st.numeric_summary(df, ["revenue"]).drop("sd", "variance", "mean"),
])
def test_independent_of_partitioning(spark, sf, operator):
    f = written(sales(spark, sf, "customer_id", "order_date", "product", "revenue"))
    assert sorted(map(str, operator(f.repartition(1)).collect())) == sorted(map(str, operator(f.repartition(16)).collect()))


def test_hot_key_gives_the_same_segments(spark):
    """A key holding most of the rows is scored like the same key alone."""
    rows = [("hot", i % 97, dt.date(2024, 1 + i % 12, 1), float(i % 13)) for i in range(3000)]
    rows += [("cold", i, dt.date(2024, 1 + i % 12, 1), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, customer int, day date, v double")

    def segments(frame, by):
        rolled = sg.customer_rollup(frame, "customer", "day", "v", by)
        return {(r.customer, r.segment, r.score) for r in sg.customer_segments(rolled, by).collect() if not by or r.k == "hot"}

    assert segments(df, ["k"]) == segments(df.where("k = 'hot'"), [])


def test_cleaning_is_idempotent(spark, sf):
    once = written(cl.clean(dirty_events(spark, sf)).rows)
    again = cl.clean(once)
    assert again.log.where("action LIKE 'remove%' OR action LIKE 'trim%' OR action LIKE 'standard%'").count() == 0
    assert sorted(map(str, again.rows.collect())) == sorted(map(str, once.collect()))


def test_imputation_gates(spark):
    rows = [(str(i), None if i % 2 else "a", "1" if i % 3 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, half string, third string")
    cleaned = cl.clean(df)
    assert cleaned.rows.where("half IS NULL").count() == 15      # more than 40 % missing
    assert cleaned.rows.where("third IS NULL").count() == 0


def test_exact_and_approximate_profiles_agree(spark, sf):
    r = dirty_events(spark, sf)
    columns = ["column_name", "inferred_type", "rows", "missing", "missing_pct", "avg_length", "min", "max",
               "first_day", "last_day", "months", "as_number", "as_date"]
    exact = pf.profile_columns(r).select(*columns).orderBy("column_name").collect()
    assert exact == pf.approximate_profile(r).select(*columns).orderBy("column_name").collect()


def test_profile_of_an_empty_column(spark):
    df = spark.createDataFrame([("1", None), ("2", "n/a")], "a string, b string")
    row = pf.profile_columns(df).where("column_name = 'b'").first()
    assert (row.inferred_type, row.missing_pct, row.samples, row.is_constant) == ("empty", 100.0, [], False)


def test_live_queries_registered():
    assert {"live_revenue", "live_customers"} <= set(QUERIES)


def test_sums_do_not_depend_on_the_order_of_rows(spark, sf):
    """Values near a half cent, added in any partitioning, give the same totals."""
    rows = [("a" if k % 3 else "b", f"2024-{1 + k % 12:02d}-01", 0.005 + (k % 97) * 0.01, f"c{k % 11}") for k in range(5_000)]
    df = spark.createDataFrame(rows, "label string, day string, x double, customer string")
    from sumtrail.operators import segments as sg

    def results(n):
        d = df.repartition(n)
        return [
            sorted(map(tuple, bd.category_sums(d, "label", "x").collect())),
            sorted(map(tuple, st.monthly_series(d, "day", "x").collect())),
            sorted(map(tuple, sg.customer_rollup(d, "customer", "day", "x").collect())),
        ]

    assert results(1) == results(16)


def test_role_evidence_comes_from_all_values(spark):
    """One value in ten carries the sign, and none of the eight smallest does."""
    from sumtrail.operators import profile as pf
    from sumtrail.operators import roles as rl

    df = spark.createDataFrame([(f"£{k}" if k % 10 == 0 else f"{k:05d}",) for k in range(200)], "amount string")
    scores = {r.role: [e.source for e in r.evidence] for r in rl.role_scores(pf.profile_columns(df)).collect()}
    assert "value_pattern" in scores["revenue"]
