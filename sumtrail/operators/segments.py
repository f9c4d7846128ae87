"""Customer roll-up, recency/frequency/spend segments and churn exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import join_by
from sumtrail.functions.quantiles import exact_quantiles
from sumtrail.functions.values import clamp, finite, half_up, half_up_long, ratio, strip, total
from sumtrail.operators.series import series_shape
from sumtrail.session import written

METRICS = ["spend", "orders", "months_active"]


def customer_rollup(df: DataFrame, customer: str, date: str, measure: str,
                    by: Sequence[str] = (), recency: str = "tenure",
                    order_key: str | None = None) -> DataFrame:
    """Spend, orders and months since the first purchase, per customer.

    ``recency="last"`` counts from the last purchase instead. Orders are rows
    unless ``order_key`` names the column that identifies an order. Spend is
    added as decimals and rounded to two of them, so it does not depend on the
    order of summation and a customer at a cut point compares equal to it. The
    sums per customer are written once, and all later stages read them.
    """
    id_ = strip(F.col(customer).cast("string"))
    month = F.trunc(F.col(date).cast("date"), "month")
    orders = F.countDistinct(order_key) if order_key else F.count(F.lit(1))
    rolled = written(
        df.where(finite(F.col(measure)).isNotNull() & (id_ != ""))
        .groupBy(*by, id_.alias("customer"))
        .agg(
            half_up(total(F.col(measure)), 2).alias("spend"), orders.alias("orders"),
            F.min(month).alias("first_month"), F.max(month).alias("last_month"),
        )
    )
    return with_months_active(rolled, by, recency)


def with_months_active(rolled: DataFrame, by: Sequence[str] = (), recency: str = "tenure") -> DataFrame:
    """Months since each customer's first (or last) month, counted from the newest month of the key.

    ``rolled`` is read twice and should be a written table.
    """
    newest = rolled.groupBy(*by).agg(F.max("last_month").alias("newest_month"))
    start = F.coalesce("last_month" if recency == "last" else "first_month", "newest_month")
    months = F.greatest(F.lit(1.0), F.months_between("newest_month", start)).cast("bigint")
    return join_by(rolled, newest, by).withColumn("months_active", months)


def tercile_cuts(customers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank-form cut points of the three metrics, one row per key and metric."""
    long = customers.select(*by, *[F.col(m).cast("double").alias(m) for m in METRICS]).unpivot(
        list(by), METRICS, "metric", "x"
    )
    fractions = [fixed.LOWER_TERCILE, fixed.UPPER_TERCILE]
    return exact_quantiles(long, "x", fractions, [*by, "metric"], rank_form=True, names=["lower", "upper"])


def customer_segments(customers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score 1-3 on each metric and name the segment of every customer."""
    # Read for the sketch, for the cut points and for the scores: the roll-up reads its written sums each time.
    cuts = tercile_cuts(customers, by).groupBy(*by).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(edge))).alias(f"{m}_{edge}")
        for m in METRICS for edge in ("lower", "upper")
    ])
    active = F.col("months_active")
    r = F.when(active <= F.col("months_active_lower"), 3).when(active <= F.col("months_active_upper"), 2).otherwise(1)

    def high_is_good(metric: str) -> Column:
        x = F.col(metric)
        return F.when(x >= F.col(f"{metric}_upper"), 3).when(x >= F.col(f"{metric}_lower"), 2).otherwise(1)

    score = F.col("r") + F.col("f") + F.col("m")
    segment = (
        F.when(score >= 8, "champion").when(score >= 6, "loyal").when(score >= 5, "atRisk")
        .when(F.col("r") == 1, "lost").otherwise("new")
    )
    scored = join_by(customers, cuts, by).withColumns(
        {"r": r, "f": high_is_good("orders"), "m": high_is_good("spend")}
    )
    return scored.select(
        *by, "customer", half_up(F.col("spend")).alias("monetary"), F.col("orders").alias("frequency"),
        segment.alias("segment"), score.cast("bigint").alias("score"), "spend",
    )


def churn_score(repeat_pct: Column, change_pct: Column, customers: Column, cv: Column) -> Column:
    """0-100 from repeat share, decline, size of the base and volatility."""
    decline = F.when(change_pct < 0, F.least(F.lit(25.0), -change_pct)).otherwise(0.0)
    thin = F.when(customers < 50, 25 - customers / 2).otherwise(0.0)
    points = F.greatest(F.lit(0.0), 30 - repeat_pct) + decline + thin + F.least(F.lit(15.0), cv * 30)
    return clamp(half_up(points), 0, 100)


def churn_exposure(segments: DataFrame, series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Repeat rate, churn score and revenue at risk, one row per key."""
    base = segments.groupBy(*by).agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("spend").alias("revenue"),
        F.count_if(F.col("frequency") > 1).alias("repeaters"),
        F.count_if(F.col("segment").isin("atRisk", "lost")).alias("at_risk"),
    )
    shape = series_shape(series, by).select(*by, "periods", "first_value", "last_value", "mean", "sd")
    joined = join_by(base, shape, by, "left")
    first = F.when(F.col("first_value") != 0, F.col("first_value")).otherwise(F.lit(1.0))
    several = F.coalesce(F.col("periods"), F.lit(0)) > 1
    change = F.when(several, (F.col("last_value") - F.col("first_value")) / first * 100).otherwise(0.0)
    cv = F.when(several, ratio(F.col("sd"), F.col("mean"))).otherwise(0.0)
    repeat = half_up_long(F.col("repeaters") / F.col("customers") * 100)
    scored = joined.withColumn("repeat_rate", repeat).withColumn(
        "churn_score", churn_score(F.col("repeat_rate"), change, F.col("customers"), cv)
    )
    risk = F.col("churn_score") / 100
    at_risk = F.col("revenue") * risk * (F.col("at_risk") / F.col("customers")) * 0.5
    return scored.select(
        *by, "customers", "repeaters", "at_risk", "repeat_rate",
        F.col("churn_score").cast("bigint").alias("churn_score"),
        half_up(at_risk + F.col("revenue") * risk * 0.1).alias("revenue_at_risk"),
    )
