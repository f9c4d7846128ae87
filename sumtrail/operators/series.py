"""Forecasts, anomaly flags and model choice for monthly series, per key.

Input is the output of ``stats.monthly_series``: (by..., month, value, n).
A series has one row per month, so everything kept per key is bounded by the
length of the calendar, whatever the number of source rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import window_by
from sumtrail.functions.values import half_up, ratio


def volatility(mean: Column, sd: Column, n: Column) -> Column:
    """Coefficient of variation; 0 for a short or zero-mean series."""
    return F.when((n < 2) | (mean == 0), F.lit(0.0)).otherwise(sd / F.abs(mean))


def series_shape(series: DataFrame, by: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """One row per key with everything the models need, in one aggregation (and ``extra`` aggregates)."""
    indexed = series.withColumn("_x", F.row_number().over(window_by(by).orderBy("month")) - 1)
    points = F.sort_array(F.collect_list(F.struct("month", "value")))
    shape = indexed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"),
        F.sum("value").alias("total"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"),
        F.min_by("value", "month").alias("first_value"),
        F.max_by("value", "month").alias("last_value"),
        F.max("month").alias("last_month"),
        F.regr_slope("value", "_x").alias("slope"),
        F.regr_intercept("value", "_x").alias("intercept"),
        points.alias("points"),
        *extra,
    )
    return shape.withColumns({
        "slope": F.coalesce(F.nanvl("slope", F.lit(0.0)), F.lit(0.0)),
        "intercept": F.coalesce(F.nanvl("intercept", F.lit(0.0)), F.lit(0.0)),
        "cv": volatility(F.col("mean"), F.col("sd"), F.col("periods")),
        "holt": _holt_next(F.col("points")),
        "recent_mean": _recent_mean(F.col("points"), 3),
    })


def _holt_next(points: Column) -> Column:
    """Next value by double exponential smoothing over the ordered points."""
    values = F.transform(points, lambda p: p["value"])
    level, trend = F.lit(fixed.HOLT_LEVEL), F.lit(fixed.HOLT_TREND)

    def step(state, v):
        moved = level * v + (1 - level) * (state["level"] + state["trend"])
        turned = trend * (moved - state["level"]) + (1 - trend) * state["trend"]
        return F.struct(moved.alias("level"), turned.alias("trend"))

    first, second = values[0], F.try_element_at(values, F.lit(2))
    start = F.struct(first.alias("level"), (second - first).alias("trend"))
    folded = F.aggregate(F.slice(values, 2, F.size(values)), start, step,
                         lambda state: half_up(state["level"] + state["trend"]))
    return F.when(F.size(values) < 2, first).otherwise(folded)


def _recent_mean(points: Column, k: int) -> Column:
    tail = F.slice(points, F.greatest(F.lit(1), F.size(points) - (k - 1)), k)
    total = F.aggregate(tail, F.lit(0.0), lambda acc, p: acc + p["value"])
    return total / F.size(tail)


def _future(shape: DataFrame, horizon: int) -> DataFrame:
    steps = shape.select("*", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("_step"))
    return steps.withColumn("month", F.add_months("last_month", F.col("_step") + 1))


def _with_scenarios(df: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    rows = [
        F.struct(F.lit(s).alias("scenario"), F.lit(fixed.SCENARIOS[s]).alias("_factor"))
        for s in scenarios
    ]
    return df.select("*", F.inline(F.array(*rows)))


def _trend_points(shape: DataFrame, by: Sequence[str], scenarios: Sequence[str],
                  horizon: int) -> DataFrame:
    line = F.col("intercept") + F.col("slope") * (F.col("periods") + F.col("_step"))
    base = F.when(F.col("periods") < 2, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), line * F.col("_factor"))
    )
    out = _with_scenarios(_future(shape, horizon), scenarios).withColumn("_base", base)
    return out.withColumns({
        "value": half_up(F.col("_base")),
        "low": half_up(F.col("_base") - F.col("_base") * fixed.BAND_WIDTH),
        "high": half_up(F.col("_base") + F.col("_base") * fixed.BAND_WIDTH),
    })


def linear_forecast(series: DataFrame, by: Sequence[str] = (), scenarios: Sequence[str] = ("base",),
                    horizon: int = fixed.HORIZON) -> DataFrame:
    """Straight-line forecast of the next months with a 12 % band."""
    points = _trend_points(series_shape(series, by), by, scenarios, horizon)
    return points.select(*by, "scenario", "month", "value", "low", "high")


def _outlook_columns(shape: DataFrame) -> DataFrame:
    """Trend percentage and next period of the straight-line model."""
    last = F.when(F.col("last_value") != 0, F.col("last_value")).otherwise(F.lit(1.0))
    line = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.col("periods"))
    long_enough = F.col("periods") >= 2
    return shape.withColumns({
        "trend_pct": F.when(long_enough, half_up(F.col("slope") / last * 100, 1)).otherwise(0.0),
        "next_value": F.when(long_enough, F.greatest(half_up(line), F.col("holt"))).otherwise(0.0),
    })


def forecast_outlook(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    outlook = _outlook_columns(series_shape(series, by))
    return outlook.select(*by, "periods", "trend_pct", "holt", "next_value")


def moving_average_forecast(series: DataFrame, by: Sequence[str] = (),
                            horizon: int = fixed.HORIZON) -> DataFrame:
    """Mean of the last three months projected flat with a 10 % band."""
    flat = F.col("recent_mean")
    return _future(series_shape(series, by), horizon).select(
        *by, "month", half_up(flat).alias("value"),
        half_up(flat * 0.9).alias("low"), half_up(flat * 1.1).alias("high"),
    )


def _month_totals() -> list[Column]:
    """Total of each calendar month over the years."""
    return [F.sum(F.when(F.month("month") == m, F.col("value"))).alias(f"_month{m}") for m in range(1, 13)]


def _with_seasonality(shape: DataFrame) -> DataFrame:
    """Variance of the calendar-month totals against the variance of the series; needs ``_month_totals``."""
    totals = [half_up(F.col(f"_month{m}"), 2) for m in range(1, 13)]
    totals = [F.when(t > 0, t) for t in totals]
    zero = F.lit(0.0)
    n = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in totals), F.lit(0))
    known = shape.withColumn("_months", n).withColumn(
        "_mean", ratio(sum((F.coalesce(t, zero) for t in totals), zero), F.col("_months")))
    squares = sum((F.coalesce((t - F.col("_mean")) * (t - F.col("_mean")), zero) for t in totals), zero)
    whole = F.col("sd") * F.col("sd")
    strength = F.least(F.lit(1.0), squares / F.col("_months") / whole)
    seasonality = F.when((F.col("_months") >= 6) & (whole > 0), strength).otherwise(zero)
    return known.withColumn("seasonality", seasonality).drop("_months", "_mean", *[f"_month{m}" for m in range(1, 13)])


def _model_scores() -> Column:
    n, cv, s = F.col("periods"), F.col("cv"), F.col("seasonality")
    scores = {
        "holt_linear": F.when((n >= 12) & (cv < 0.8), 0.85).when(n >= 8, 0.6).otherwise(0.3),
        "moving_average": F.when(n < 12, 0.8).when(cv > 0.6, 0.65).otherwise(0.4),
        "seasonal_naive": F.when((s > 0.5) & (n >= 18), 0.9).when(s > 0.3, 0.6).otherwise(0.2),
        "linear_trend": F.when((cv < 0.4) & (n >= 10), 0.75).otherwise(0.35),
    }
    ranked = F.array(*[
        F.struct((-score).alias("key"), F.lit(i).alias("order"), F.lit(m).alias("model"))
        for i, (m, score) in enumerate(scores.items())
    ])
    return F.array_sort(ranked)


def _chosen(series: DataFrame, by: Sequence[str]) -> DataFrame:
    shape = _with_seasonality(series_shape(series, by, _month_totals()))
    return shape.withColumn("_models", _model_scores()).withColumns({
        "chosen_model": F.col("_models")[0]["model"],
        "confidence": -F.col("_models")[0]["key"],
    })


def choose_forecast_model(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The best-suited model, the model that is executed and those not chosen.

    Only the moving average has an execution of its own; every other choice
    runs the straight line.
    """
    others = F.transform(F.slice("_models", 2, 3), lambda m: m["model"])
    executed = F.when(F.col("chosen_model") == "moving_average", "moving_average").otherwise("linear_trend")
    return _chosen(series, by).select(
        *by, "chosen_model", executed.alias("executed_model"), "confidence",
        F.array_join(others, ",").alias("alternatives"),
        half_up(F.col("seasonality"), 2).alias("seasonality"),
        half_up(F.col("cv"), 2).alias("volatility"), "periods",
    )


def forecast(series: DataFrame, by: Sequence[str] = (), scenario: str = "base",
             horizon: int = fixed.HORIZON) -> DataFrame:
    """Forecast of every key by the model its own series selects."""
    points = _trend_points(_chosen(series, by), by, [scenario], horizon)
    flat, averaged = F.col("recent_mean"), F.col("chosen_model") == "moving_average"
    return points.select(
        *by, "scenario", "chosen_model", "month",
        F.when(averaged, half_up(flat)).otherwise(F.col("value")).alias("value"),
        F.when(averaged, half_up(flat * 0.9)).otherwise(F.col("low")).alias("low"),
        F.when(averaged, half_up(flat * 1.1)).otherwise(F.col("high")).alias("high"),
    )


def selected_outlook(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trend and next period under the selected model (flat for an average)."""
    chosen = _outlook_columns(_chosen(series, by))
    averaged = F.col("chosen_model") == "moving_average"
    return chosen.withColumns({
        "trend_pct": F.when(averaged, 0.0).otherwise(F.col("trend_pct")),
        "next_value": F.when(averaged, half_up(F.col("recent_mean"))).otherwise(F.col("next_value")),
    }).drop("_models", "points")


def anomalies(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """z-score of every month; keys with fewer than three months are left out."""
    w = window_by(by)
    scored = series.withColumns({
        "_n": F.count(F.lit(1)).over(w),
        "_mean": F.avg("value").over(w),
        "_sd": F.stddev_pop("value").over(w),
    }).where("_n >= 3")
    z = ratio(F.col("value") - F.col("_mean"), F.col("_sd"))
    return scored.select(
        *by, "month", half_up(F.col("value")).alias("actual"),
        half_up(F.col("_mean")).alias("expected"),
        half_up(z, 1).alias("z_score"), (F.abs(z) > fixed.Z_LIMIT).alias("is_anomaly"),
    )


def choose_anomaly_model(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Suitable detector per key; the z-score is the one that is executed."""
    short, wild = F.col("periods") < 20, F.col("cv") > 0.8
    return series_shape(series, by).select(
        *by,
        F.when(short | wild, "iqr").otherwise("z_score").alias("chosen_model"),
        F.lit("z_score").alias("executed_model"),
        F.when(short, 0.78).when(wild, 0.72).otherwise(0.84).alias("confidence"),
        F.when(short, "z_score,seasonal_residual").when(wild, "z_score").otherwise("iqr").alias("alternatives"),
    )
