"""Derived columns: calendar parts, transaction value, margin, quartile band."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import join_by
from sumtrail.functions.quantiles import exact_quantiles
from sumtrail.functions.values import half_up, ratio


def calendar_parts(df: DataFrame, date: str) -> DataFrame:
    d = F.col(date).cast("date")
    return df.withColumns({
        "year": F.year(d).cast("bigint"),
        "month": F.month(d).cast("bigint"),
        "month_label": F.date_format(d, "MMM yy"),
        "day_of_week": (F.dayofweek(d) - 1).cast("bigint"),
        "quarter": F.quarter(d).cast("bigint"),
        "month_key": F.date_format(d, "yyyy-MM"),
    })


def transaction_value(df: DataFrame, price: str, quantity: str) -> DataFrame:
    """price x quantity to two decimals, for tables without a total column."""
    return df.withColumn("transaction_value", half_up(F.col(price) * F.col(quantity), 2))


def margin(df: DataFrame, revenue: str, cost: str) -> DataFrame:
    gain = F.col(revenue) - F.col(cost)
    return df.withColumns({
        "margin": half_up(gain, 2),
        "margin_pct": half_up(ratio(gain, F.col(revenue)) * 100, 1),
    })


def value_bands(df: DataFrame, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartile band of ``measure`` within its key; needs eight values."""
    cuts = exact_quantiles(df, measure, [0.25, 0.5, 0.75], by, names=["_q1", "_q2", "_q3"])
    x = F.col(measure)
    low, medium, high, top = fixed.BANDS
    band = (
        F.when(x.isNull() | (F.col("_cut_n") < 8), F.lit(None).cast("string"))
        .when(x <= F.col("_q1"), low)
        .when(x <= F.col("_q2"), medium)
        .when(x <= F.col("_q3"), high)
        .otherwise(top)
    )
    banded = join_by(df, cuts.withColumnRenamed("n", "_cut_n"), by, "left")
    return banded.withColumn("band", band).drop("_cut_n", "_q1", "_q2", "_q3")
