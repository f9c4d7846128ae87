"""Retail indicators over order lines: line revenue and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import join_by
from sumtrail.functions.values import (
    clamp, half_up, half_up_long, is_missing, price_of, quantity_of, ratio, strip,
    total,
)
from sumtrail.operators.breakdown import category_sums
from sumtrail.operators.series import anomalies, linear_forecast, series_shape
from sumtrail.session import written


def find_columns(catalog: DataFrame) -> DataFrame:
    """Column of every retail field, per dataset, by words in the header.

    ``catalog`` has (dataset, position, column_name). The earliest word in the
    preference list wins, then the leftmost column.
    """
    header = F.lower(F.trim(F.regexp_replace("column_name", '"', "")))
    picks = []
    for field, words in fixed.RETAIL_COLUMNS.items():
        priority = F.lit(None).cast("int")
        for i, word in reversed(list(enumerate(words))):
            priority = F.when(header.contains(word), i).otherwise(priority)
        best = F.min(F.when(priority.isNotNull(), F.struct(priority.alias("p"), "position", "column_name")))
        picks.append(F.struct(F.lit(field).alias("field"), best["column_name"].alias("column_name")))
    return catalog.groupBy("dataset").agg(F.array(*picks).alias("_f")).select(
        "dataset", F.inline("_f")
    ).where("column_name IS NOT NULL")


def holds_totals(header: str) -> bool:
    """Whether an amount column already is a line total, judged by its name."""
    return any(word in header.lower() for word in fixed.RETAIL_TOTAL_WORDS)


def line_revenue(df: DataFrame, amount: str, quantity: str | None = None) -> DataFrame:
    """Add ``line_revenue`` and keep the rows where it is positive."""
    price = price_of(F.col(amount).cast("string")) if df.schema[amount].dataType.simpleString() == "string" \
        else F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    revenue = price
    if quantity and not holds_totals(amount):
        if df.schema[quantity].dataType.simpleString() == "string":
            units = quantity_of(F.col(quantity))
        else:
            q = F.col(quantity).cast("double")
            units = F.when(q.isNull() | (q == 0), 1.0).otherwise(q)
        revenue = price * units
    return df.withColumn("line_revenue", revenue).where("line_revenue > 0")


def sales_totals(lines: DataFrame, by: Sequence[str] = (), order_key: str | None = None) -> DataFrame:
    """Revenue, orders (rows unless ``order_key``) and average order value."""
    orders = F.countDistinct(order_key) if order_key else F.count(F.lit(1))
    totals = lines.groupBy(*by).agg(total(F.col("line_revenue")).alias("_sum"), orders.alias("orders"))
    return totals.select(
        *by, half_up(F.col("_sum")).alias("revenue"), "orders",
        half_up(F.col("_sum") / F.col("orders"), 2).alias("average_order"),
    )


def _bucket(x: Column, edges: Sequence[float]) -> Column:
    bucket = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        bucket = F.when(x < edge, i).otherwise(bucket)
    return bucket


def _bucket_counts(df: DataFrame, x: str, edges: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Counts per value bucket; every bucket appears for every key."""
    bucket = _bucket(F.col(x), edges)
    counts = df.groupBy(*by).agg(*[
        F.count_if(bucket == i).alias(f"b{i}") for i in range(len(edges) + 1)
    ])
    lows, highs = [None, *edges], [*edges, None]
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).cast("bigint").alias("bucket"),
            F.lit(low).cast("double").alias("from_value"),
            F.lit(high).cast("double").alias("below_value"), F.col(f"b{i}").alias("n"),
        )
        for i, (low, high) in enumerate(zip(lows, highs))
    ])
    return counts.select(*by, F.inline(rows))


def order_value_buckets(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _bucket_counts(lines, "line_revenue", fixed.ORDER_VALUE_EDGES, by)


def customer_spend(lines: DataFrame, customer: str, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Spend, orders and first month of every customer."""
    id_ = strip(F.col(customer).cast("string"))
    return lines.where(id_ != "").groupBy(*by, id_.alias("customer")).agg(
        half_up(total(F.col("line_revenue")), 2).alias("spend"), F.count(F.lit(1)).alias("orders"),
        F.min(F.trunc(F.col(date).cast("date"), "month")).alias("first_month"),
    )


def lifetime_value_buckets(customers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _bucket_counts(customers, "spend", fixed.LIFETIME_VALUE_EDGES, by)


def new_customers_per_month(customers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    known = customers.where("first_month IS NOT NULL")
    return known.groupBy(*by, F.col("first_month").alias("month")).agg(F.count(F.lit(1)).alias("customers"))


def customer_counts(customers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = customers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_customers"), F.count_if(F.col("orders") > 1).alias("repeat_customers"),
    )
    return counts.select(
        *by, "unique_customers", "repeat_customers",
        (F.col("unique_customers") - F.col("repeat_customers")).alias("new_customers"),
        half_up_long(ratio(F.col("repeat_customers"), F.col("unique_customers")) * 100).alias("repeat_rate"),
    )


def fill_rates(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Share of non-blank cells per column, all columns in one aggregate."""
    columns = [c for c in (columns or df.columns) if c not in by]
    shares = df.groupBy(*by).agg(*[
        F.avg(F.when(F.col(f"`{c}`").isNull() | (strip(F.col(f"`{c}`").cast("string")) == ""), 0.0).otherwise(1.0)).alias(f"_fill_{c}")
        for c in columns
    ])
    rows = F.array(*[
        F.struct(
            F.lit(i + 1).cast("bigint").alias("position"), F.lit(c).alias("column_name"),
            half_up_long(F.col(f"`_fill_{c}`") * 100).alias("pct"),
        )
        for i, c in enumerate(columns)
    ])
    return shares.select(*by, F.inline(rows))


def fill_score(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rates.groupBy(*by).agg(half_up_long(F.avg("pct")).alias("quality"), F.avg("pct").alias("_pct"))


def growth(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trend growth rate and first-to-last change of the monthly revenue."""
    several = F.col("periods") > 1
    first = F.when(F.col("first_value") != 0, F.col("first_value")).otherwise(F.lit(1.0))
    rate = half_up_long(ratio(F.col("slope"), F.col("last_value")) * 100)
    change = half_up((F.col("last_value") - F.col("first_value")) / first * 100, 1)
    return series_shape(series, by).select(
        *by, F.when(several, rate).otherwise(F.lit(0)).cast("bigint").alias("growth_rate"),
        F.when(several, change).otherwise(0.0).alias("revenue_change"),
    )


def forecast_total(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of the six forecast months and the next month by either model."""
    series = written(series)
    points = linear_forecast(series, by)
    total = points.groupBy(*by).agg(
        F.sum("value").alias("forecast_total"), F.min_by("value", "month").alias("_next"),
    )
    holt = series_shape(series, by).select(*by, "holt")
    return join_by(total, holt, by).select(
        *by, "forecast_total", F.greatest("_next", "holt").alias("next_month"),
    )


def shortfall_at_risk(series: DataFrame, churn: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shortfall of the weak months plus a share of revenue exposed to churn.

    ``churn`` has (by..., churn_score).
    """
    series = written(series)
    weak = F.col("is_anomaly") & (F.col("actual") < F.col("expected"))
    gap = anomalies(series, by).groupBy(*by).agg(
        F.sum(F.when(weak, F.col("expected") - F.col("actual")).otherwise(0.0)).alias("_gap")
    )
    total = series.groupBy(*by).agg(F.sum("value").alias("_total"))
    joined = join_by(join_by(total, churn.select(*by, "churn_score"), by), gap, by, "left")
    exposed = F.col("_total") * F.col("churn_score") / 100 * 0.15
    return joined.select(*by, half_up(F.coalesce("_gap", F.lit(0.0)) + exposed).alias("revenue_at_risk"))


def retail_health(series: DataFrame, customers: DataFrame, quality: DataFrame,
                  by: Sequence[str] = ()) -> DataFrame:
    """Four-pillar health with the customers-per-order pillar.

    ``quality`` has (by..., _pct): the mean fill rate.
    """
    counts = customers.groupBy(*by).agg(F.count(F.lit(1)).alias("_customers"), F.sum("orders").alias("_orders"))
    shape = join_by(series_shape(series, by), join_by(counts, quality, by), by, "left")
    first = F.when(F.col("first_value") != 0, F.col("first_value")).otherwise(F.lit(1.0))
    change = (F.col("last_value") - F.col("first_value")) / first
    trend = F.when(F.col("periods") > 1, clamp(12 + change * 25, 0, 25)).otherwise(12.0)
    base = F.least(F.lit(25.0), half_up(F.col("_customers") / F.col("_orders") * 80))
    customer = F.when(F.col("_customers") > 0, base).otherwise(10.0)
    mean = F.when(F.col("mean") != 0, F.col("mean")).otherwise(F.lit(1.0))
    stability = F.when(F.col("periods") > 2, clamp(half_up(25 - F.col("sd") / mean * 30), 0, 25)).otherwise(15.0)
    data = half_up(F.coalesce("_pct", F.lit(0.0)) * 0.25)
    return shape.select(
        *by, half_up_long(trend).alias("trend"), customer.cast("bigint").alias("customer"),
        data.cast("bigint").alias("quality"), stability.cast("bigint").alias("stability"),
        clamp(half_up(trend + customer + data + stability), 0, 100).cast("bigint").alias("total"),
    )


def dependency_risk(lines: DataFrame, product: str, by: Sequence[str] = ()) -> DataFrame:
    """Risk of leaning on one product; keys without that risk give no row."""
    sums = category_sums(lines, product, "line_revenue", by)
    heads = sums.groupBy(*by).agg(
        F.sum("sum").alias("_total"),
        F.min(F.struct((-F.col("sum")).alias("key"), F.col("label").alias("label"))).alias("_top"),
    )
    share = ratio(-F.col("_top")["key"], F.col("_total")) * 100
    level = F.when(share > 50, "high").when(share > 30, "medium")
    return heads.select(*by, F.col("_top")["label"].alias("product"), half_up_long(share).alias("share_pct"),
                        level.alias("level")).where("level IS NOT NULL")


def small_base_actions(lines: DataFrame, customers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Actions for a low average order and for a small customer base."""
    facts = join_by(
        sales_totals(lines, by),
        customers.groupBy(*by).agg(F.count(F.lit(1)).alias("_customers")), by, "left",
    )
    few = F.coalesce("_customers", F.lit(0)).between(1, 99)
    fired = F.array_compact(F.array(
        F.when(F.col("average_order") < 100, F.struct(
            F.lit("raise_average_order").alias("action"), F.col("average_order").alias("evidence"))),
        F.when(few, F.struct(
            F.lit("loyalty_programme").alias("action"), F.col("_customers").cast("double").alias("evidence"))),
    ))
    return facts.select(*by, F.inline(fired))
