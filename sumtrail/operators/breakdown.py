"""Breakdowns of a measure and the result tables built from other operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions.grouping import join_by, share_of_total, top_rows
from sumtrail.functions.values import finite, half_up, ratio, strip, total
from sumtrail.session import written

# Weight of an analysis in the ranking; others count 1.
ANALYSIS_WEIGHTS = {
    "trend_analysis": 1.15,
    "forecasting": 1.15,
    "segmentation": 1.1,
    "concentration_analysis": 1.05,
    "anomaly_detection": 1.05,
}


def category_sums(df: DataFrame, category: str, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Unrounded sum and count per non-blank label."""
    label = strip(F.col(category).cast("string"))
    return (
        df.where(finite(F.col(measure)).isNotNull() & (label != ""))
        .groupBy(*by, label.alias("label"))
        .agg(total(F.col(measure)).alias("sum"), F.count(F.lit(1)).alias("n"))
    )


def breakdown(df: DataFrame, category: str, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Value, count and share of the total for every label."""
    sums = share_of_total(category_sums(df, category, measure, by), "sum", by)
    share = half_up(ratio(F.col("sum"), F.col("total")) * 100, 1)
    return sums.select(*by, "label", half_up(F.col("sum"), 2).alias("value"), "n", share.alias("pct"))


def top_categories(df: DataFrame, category: str, measure: str, by: Sequence[str] = (),
                   k: int = 8) -> DataFrame:
    sums = category_sums(df, category, measure, by)
    values = sums.select(*by, "label", half_up(F.col("sum"), 2).alias("value"))
    return top_rows(values, by, [F.desc("value"), F.col("label")], k)


def concentration(df: DataFrame, category: str, measure: str, by: Sequence[str] = (),
                  k: int = 5) -> DataFrame:
    """Share of the ``k`` largest labels; the rest is one row, if positive."""
    sums = category_sums(df, category, measure, by)
    # One row per label, read for the totals, the head and the rest.
    values = written(sums.select(*by, "label", half_up(F.col("sum"), 2).alias("value")))
    totals = values.groupBy(*by).agg(F.sum("value").alias("total")).where("total > 0")
    head = join_by(top_rows(values, by, [F.desc("value"), F.col("label")], k), totals, by)
    rest = (
        head.groupBy(*by, "total")
        .agg(F.sum("value").alias("_head"))
        .select(
            *by, F.lit(k + 1).cast("bigint").alias("position"), F.lit("Other").alias("label"),
            half_up(F.col("total") - F.col("_head"), 2).alias("value"), "total",
        )
        .where("value > 0")
    )
    share = half_up(F.col("value") / F.col("total") * 100, 1)
    columns = [*by, "position", "label", "value", "total"]
    return (
        head.select(*columns).unionByName(rest.select(*columns))
        .withColumn("pct", share).drop("total")
    )


def histogram(df: DataFrame, measure: str, by: Sequence[str] = (), bins: int = 6) -> DataFrame:
    """Equal-width bins from minimum to maximum; the last bin is closed."""
    x = finite(F.col(measure))
    numbers = df.select(*by, x.alias("x")).where("x IS NOT NULL")
    range_ = numbers.groupBy(*by).agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("total"),
    ).where("total >= 8")
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    range_ = range_.withColumn("width", span / bins)
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / F.col("width")).cast("int"))
    counts = (
        join_by(numbers, range_, by)
        .groupBy(*by, "low", "width", F.greatest(F.lit(0), bin_).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = F.map_from_entries(F.collect_list(F.struct("_bin", "n")))
    per_key = counts.groupBy(*by, "low", "width").agg(found.alias("_found"))
    every = per_key.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin"))
    return every.select(
        *by, F.col("_bin").cast("bigint").alias("bin"),
        half_up(F.col("low") + F.col("_bin") * F.col("width")).alias("from_value"),
        half_up(F.col("low") + (F.col("_bin") + 1) * F.col("width")).alias("to_value"),
        F.coalesce(F.try_element_at("_found", F.col("_bin")), F.lit(0)).cast("bigint").alias("n"),
    )


def strongest_pair(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The pair with the largest coefficient, unless it is negligible."""
    order = [F.desc(F.abs("coefficient")), F.col("pair")]
    best = top_rows(pairs, by, order, 1)
    return best.where("strength <> 'negligible'").drop("position", "pair")


def pair_points(df: DataFrame, a: str, b: str, order: Sequence[Column], by: Sequence[str] = (),
                k: int | None = None) -> DataFrame:
    """All points of a column pair, or a sample: the first ``k`` in ``order``, numbered.

    A hash of the rows' key as order makes the sample independent of time and place.
    """
    points = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if k is None:
        return points.select(*by, F.col(a).alias("x"), F.col(b).alias("y"))
    ranked = top_rows(points, by, order, k)
    return ranked.select(*by, "position", F.col(a).alias("x"), F.col(b).alias("y"))


def history_and_forecast(series: DataFrame, forecast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    past = series.select(*by, "month", F.col("value").alias("historical"))
    future = forecast.select(*by, "month", F.col("value").alias("forecast"))
    return past.unionByName(future, allowMissingColumns=True)


def flagged_periods(anomalies: DataFrame) -> DataFrame:
    return anomalies.where("is_anomaly").drop("is_anomaly")


def segment_sizes(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return segments.groupBy(*by, "segment").agg(F.count(F.lit(1)).alias("customers"))


def recent_periods(series: DataFrame, by: Sequence[str] = (), k: int = 12) -> DataFrame:
    return top_rows(series, by, [F.desc("month")], k, "age")


def same_month_across_years(series: DataFrame, month: int, by: Sequence[str] = ()) -> DataFrame:
    """Every year's value of one calendar month, and their total with no year."""
    chosen = series.where(F.month("month") == month)
    years = chosen.select(*by, F.year("month").cast("bigint").alias("year"), "value", "n")
    total = chosen.groupBy(*by).agg(
        F.lit(None).cast("bigint").alias("year"),
        half_up(F.sum("value"), 2).alias("value"), F.sum("n").alias("n"),
    )
    return years.unionByName(total)


def rank_analyses(candidates: DataFrame, key: str = "dataset", k: int = 10) -> DataFrame:
    """Weight, cap and rank the candidate analyses of each dataset.

    ``candidates`` has (key, capability, confidence, coefficient, sequence);
    the coefficient is only set for correlations and scales their score.
    """
    base = half_up(F.col("confidence") * 100 * F.coalesce(F.abs("coefficient"), F.lit(1.0)))
    weight = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(v) for item in ANALYSIS_WEIGHTS.items() for v in item]),
            F.col("capability"),
        ),
        F.lit(1.0),
    )
    score = F.least(F.lit(100.0), half_up(base * weight)).cast("bigint")
    scored = candidates.withColumn("score", score)
    ranked = top_rows(scored, [key], [F.desc("score"), F.col("sequence")], k)
    return ranked.select(key, "position", "capability", "score")
