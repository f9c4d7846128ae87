"""Which analyses a dataset supports: eleven gates over its column roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions.values import half_up

MIN_ROWS_DISTRIBUTION = 10
MIN_ROWS_CORRELATION = 15
MIN_ROWS_SEASONALITY = 30
MIN_MONTHS_ANOMALY = 3
MIN_MONTHS_FORECAST = 6
MIN_MONTHS_COHORT = 2
NUMERIC_ORDER = ["price", "cost", "revenue", "quantity", "percentage", "inventory", "duration"]


def _role_table(roles: DataFrame) -> DataFrame:
    """One row per dataset with the best column of each role as a struct."""

    def best(role: str) -> Column:
        entry = F.struct(
            (-F.col("confidence")).alias("key"), F.col("position"), F.col("column_name"),
            F.col("confidence"), F.coalesce("months", F.lit(0)).alias("months"),
        )
        return F.min(F.when(F.col("role") == role, entry)).alias(f"_{role}")

    order = F.array_position(F.array(*map(F.lit, NUMERIC_ORDER)), F.col("role"))
    numeric = F.when(order > 0, F.struct(
        order.alias("order"), (-F.col("confidence")).alias("key"), F.col("position"),
        F.col("column_name"), F.col("confidence"),
    ))
    wanted = ["date", "revenue", "price", "cost", "quantity", "customer", "identifier",
              "category", "product", "location", "status"]
    return roles.groupBy("dataset").agg(
        F.max("rows").alias("rows"), *[best(role) for role in wanted],
        F.array_sort(F.collect_list(numeric)).alias("_numeric"),
    )


def gates(roles: DataFrame) -> DataFrame:
    """(dataset, sequence, capability, available, columns, confidence)."""
    table = _role_table(roles)
    common = table.withColumns({
        "_money": F.coalesce("_revenue", "_price", "_cost"),
        "_group": F.coalesce("_category", "_product", "_location", "_status"),
        "_who": F.coalesce("_identifier", "_customer"),
    }).withColumn("_measure", F.coalesce("_money", "_quantity"))

    date, measure, money = F.col("_date"), F.col("_measure"), F.col("_money")
    group, customer, who = F.col("_group"), F.col("_customer"), F.col("_who")
    months = F.coalesce(date["months"], F.lit(0))
    first, second = F.try_element_at("_numeric", F.lit(1)), F.try_element_at("_numeric", F.lit(2))
    rows = F.col("rows")
    rules = [
        ("trend_analysis", [date, measure], F.lit(True)),
        ("comparison", [group, measure], F.lit(True)),
        ("distribution", [measure], rows >= MIN_ROWS_DISTRIBUTION),
        ("correlation", [first, second], rows >= MIN_ROWS_CORRELATION),
        ("segmentation", [customer, date, money], F.lit(True)),
        ("anomaly_detection", [date, measure], months >= MIN_MONTHS_ANOMALY),
        ("forecasting", [date, measure], months >= MIN_MONTHS_FORECAST),
        ("concentration_analysis", [group, money], F.lit(True)),
        ("cohort_analysis", [customer, date], months >= MIN_MONTHS_COHORT),
        ("transaction_analysis", [who, date, money], F.lit(True)),
        ("seasonality", [date, measure], rows >= MIN_ROWS_SEASONALITY),
    ]
    entries = []
    for i, (name, needed, condition) in enumerate(rules):
        open_ = condition
        for column in needed:
            open_ = open_ & column.isNotNull()
        mean = sum((c["confidence"] for c in needed), F.lit(0.0)) / len(needed)
        entries.append(F.struct(
            F.lit(i + 1).cast("bigint").alias("sequence"), F.lit(name).alias("capability"),
            open_.alias("available"),
            F.when(open_, F.concat_ws(",", *[c["column_name"] for c in needed])).otherwise("").alias("columns"),
            F.when(open_, half_up(mean, 2)).otherwise(0.0).alias("confidence"),
        ))
    return common.select("dataset", F.inline(F.array(*entries)))


def open_gates(gate_table: DataFrame) -> DataFrame:
    """Gates open and gates in all, per dataset."""
    return gate_table.groupBy("dataset").agg(
        F.count_if("available").alias("open"), F.count(F.lit(1)).alias("total"),
    )
