"""Models that run as chosen: forecasts with a back-test, and three detectors of odd months.

``series.forecast`` and ``series.anomalies`` name the model that suits a series but
run the straight line (or the average) and the z-score. Here every model has its
own execution, and the choice may come from errors instead of rules.

Input is the output of ``stats.monthly_series``: (by..., month, value, n). All that
is kept per key is bounded by the length of the calendar. A forecast is one
aggregation per key and folds over its array of months; a detector is windows over
the months of a key, which share one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import window_by
from sumtrail.functions.values import half_up, ratio
from sumtrail.operators import series as sr

#: In the order in which equal errors are decided.
MODELS = ["holt_linear", "moving_average", "seasonal_naive", "linear_trend", "moving_seasonal"]
DETECTORS = ["z_score", "iqr", "seasonal_residual"]

#: Months forecast in a back-test, and the shortest history it forecasts from.
TESTS, HISTORY = 6, 3
#: Quartile distances beyond which a month is odd, and months that a seasonal residual needs.
FENCE, SEASONS = 1.5, 24


# -- forecasts ----------------------------------------------------------------


def _mean(values: Column) -> Column:
    """Mean of an array; null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))


def _last(values: Column, k: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - (k - 1)), k)


def _line(values: Column, step: Column) -> Column:
    """Least squares over 0, 1, ..., at ``step`` months after the first unknown one."""
    n = F.size(values).cast("double")
    sums = F.aggregate(
        values, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("xy")),
        lambda a, v: F.struct((a["x"] + 1).alias("x"), (a["y"] + v).alias("y"), (a["xy"] + a["x"] * v).alias("xy")))
    x, xx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = (n * sums["xy"] - x * sums["y"]) / (n * xx - x * x)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), sums["y"] / n + slope * (n + step - x / n)))


def _holt(values: Column, step: Column) -> Column:
    level, trend = F.lit(fixed.HOLT_LEVEL), F.lit(fixed.HOLT_TREND)

    def fold(state, v):
        moved = level * v + (1 - level) * (state["level"] + state["trend"])
        return F.struct(moved.alias("level"), (trend * (moved - state["level"]) + (1 - trend) * state["trend"]).alias("trend"))

    first, second = values[0], F.try_element_at(values, F.lit(2))
    start = F.struct(first.alias("level"), (second - first).alias("trend"))
    ahead = F.aggregate(F.slice(values, 2, F.size(values)), start, fold, lambda s: s["level"] + s["trend"] * (step + 1))
    return F.greatest(F.lit(0.0), F.when(F.size(values) < 2, first).otherwise(ahead))


def _predicted(points: Column, step: Column, target: Column) -> dict[str, Column]:
    """Value of every model ``step`` + 1 months after ``points``, which is the month ``target``."""
    values = F.transform(points, lambda p: p["value"])
    same = F.transform(F.filter(points, lambda p: F.month(p["month"]) == F.month(target)), lambda p: p["value"])
    flat = _mean(_last(values, 3))
    level = _mean(values)
    return {
        "holt_linear": _holt(values, step),
        "moving_average": flat,
        # Without that month in the past: the flat average.
        "seasonal_naive": F.coalesce(F.try_element_at(same, F.lit(-1)), flat),
        "linear_trend": _line(values, step),
        "moving_seasonal": F.coalesce(F.when(level != 0, _mean(_last(values, 12)) * _mean(same) / level), flat),
    }


def _picked(model: Column, values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(model == name, value).otherwise(out)
    return out


def _tested(shape: DataFrame) -> DataFrame:
    """Mean absolute error of every model over the last months, each forecast from those before it."""
    n = F.size("points")
    # At least one origin even for a short series, which then counts for nothing.
    origins = F.filter(F.sequence(F.greatest(F.lit(0), n - TESTS), n - 1), lambda o: o >= HISTORY)

    def misses(o):
        now = F.col("points")[o]
        made = _predicted(F.slice("points", 1, o), F.lit(0), now["month"])
        return F.struct(*[F.abs(v - now["value"]).alias(m) for m, v in made.items()])

    errors = shape.withColumn("_misses", F.transform(origins, misses))
    return errors.withColumns({f"mae_{m}": half_up(_mean(F.col(f"_misses.{m}")), 4) for m in MODELS}).drop("_misses")


def tested_models(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error of each model in the back-test and the model with the smallest.

    The last ``TESTS`` months are forecast one at a time from the months before
    them. A series too short for any has null errors and ``moving_average``.
    """
    return _with_tested(sr.series_shape(series, by)).select(*by, "periods", *[f"mae_{m}" for m in MODELS], "tested_model")


def _with_tested(shape: DataFrame) -> DataFrame:
    ranked = F.array_sort(F.array(*[F.struct(F.col(f"mae_{m}").alias("error"), F.lit(i).alias("order"), F.lit(m).alias("model")) for i, m in enumerate(MODELS)]))
    best = F.when(F.col("mae_moving_average").isNull(), "moving_average").otherwise(ranked[0]["model"])
    return _tested(shape).withColumn("tested_model", best)


def executed_forecast(series: DataFrame, by: Sequence[str] = (), model: str = "chosen", scenario: str = "base",
                      horizon: int = fixed.HORIZON) -> DataFrame:
    """Forecast of every key by a model that really runs.

    ``model`` is ``chosen`` (by the rules of ``series.choose_forecast_model``),
    ``tested`` (the smallest error in the back-test) or the name of one of
    ``MODELS`` for all keys. ``executed_model`` is the model of the values. The
    average has its band of 10 %, all others one of 12 %; scenarios scale every
    model but the average, which is flat.
    """
    if model == "chosen":
        shape = sr._chosen(series, by).withColumn("executed_model", F.col("chosen_model"))
    elif model == "tested":
        shape = _with_tested(sr.series_shape(series, by)).withColumn("executed_model", F.col("tested_model"))
    elif model in MODELS:
        shape = sr.series_shape(series, by).withColumn("executed_model", F.lit(model))
    else:
        raise ValueError(f"model must be chosen, tested or one of {MODELS}")
    ahead = sr._future(shape, horizon)
    averaged = F.col("executed_model") == "moving_average"
    value = _picked(F.col("executed_model"), _predicted(F.col("points"), F.col("_step"), F.col("month")))
    factor = F.when(averaged, F.lit(1.0)).otherwise(F.lit(fixed.SCENARIOS[scenario]))
    band = F.when(averaged, F.lit(0.1)).otherwise(F.lit(fixed.BAND_WIDTH))
    return ahead.withColumn("_base", value * factor).withColumn("_band", band).select(
        *by, F.lit(scenario).alias("scenario"), "executed_model", "month", half_up(F.col("_base")).alias("value"),
        half_up(F.col("_base") - F.col("_base") * F.col("_band")).alias("low"),
        half_up(F.col("_base") + F.col("_base") * F.col("_band")).alias("high"))


# -- odd months ---------------------------------------------------------------


def executed_anomalies(series: DataFrame, by: Sequence[str] = (), detector: str = "chosen") -> DataFrame:
    """Every month with what its detector expected, a score, and whether it is odd.

    ``detector`` is ``chosen`` (by the rules of ``series.choose_anomaly_model``) or
    one of ``DETECTORS`` for all keys; ``executed_model`` says which ran.

    * ``z_score``: distance from the mean in standard deviations, odd beyond 1.8.
    * ``iqr``: distance from the median in quartile distances, odd beyond 1.5
      quartile distances below the first or above the third quartile.
    * ``seasonal_residual``: what remains after the trend (a centred mean of
      twelve months, carried on flat at both ends) and the mean departure of the
      calendar month; odd and scored like ``iqr``, on remainders. A series of
      less than ``SEASONS`` months runs ``iqr``. Absent months are not months:
      fill gaps first where they mean 0.

    Keys with fewer than three months are left out. A score is 0 where all
    distances are.
    """
    if detector != "chosen" and detector not in DETECTORS:
        raise ValueError(f"detector must be chosen or one of {DETECTORS}")
    every = window_by(by)
    order = every.orderBy("month")
    year, inner = order.rowsBetween(-6, 6), order.rowsBetween(-5, 5)
    v = F.col("value")
    base = series.withColumns({
        "_n": F.count(F.lit(1)).over(every), "_mean": F.avg("value").over(every), "_sd": F.stddev_pop("value").over(every),
        "_q": F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(every),
        "_trend": F.when(F.count(F.lit(1)).over(year) == 13, (F.sum("value").over(year) + F.sum("value").over(inner)) / 24),
    }).where("_n >= 3")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    carried = F.coalesce("_trend", F.last("_trend", ignorenulls=True).over(before), F.first("_trend", ignorenulls=True).over(after))
    moved = base.withColumns({"_carried": carried, "_moon": F.month("month"), "_departure": v - F.col("_trend")})
    month = Window.partitionBy(*by, "_moon")
    moved = moved.withColumn("_season", F.coalesce(F.avg("_departure").over(month), F.lit(0.0)))
    moved = moved.withColumn("_usual", F.col("_carried") + F.col("_season") - F.avg("_season").over(every))
    moved = moved.withColumn("_rest", v - F.col("_usual"))
    moved = moved.withColumn("_rq", F.percentile("_rest", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(every))

    long_enough = F.col("_n") >= SEASONS
    if detector == "chosen":
        cv = sr.volatility(F.col("_mean"), F.col("_sd"), F.col("_n"))
        model = F.when((F.col("_n") < 20) | (cv > 0.8), F.lit("iqr")).otherwise(F.lit("z_score"))
    elif detector == "seasonal_residual":
        model = F.when(long_enough, F.lit(detector)).otherwise(F.lit("iqr"))
    else:
        model = F.lit(detector)

    def fenced(x: Column, q: Column) -> tuple[Column, Column]:
        width = q[2] - q[0]
        return ratio(x - q[1], width), (x < q[0] - FENCE * width) | (x > q[2] + FENCE * width)

    z = ratio(v - F.col("_mean"), F.col("_sd"))
    wide, odd = fenced(v, F.col("_q"))
    rest, strange = fenced(F.col("_rest"), F.col("_rq"))
    by_model = lambda a, b, c: F.when(F.col("executed_model") == "z_score", a).when(F.col("executed_model") == "iqr", b).otherwise(c)
    return moved.withColumn("executed_model", model).select(
        *by, "month", "executed_model", half_up(v).alias("actual"),
        half_up(by_model(F.col("_mean"), F.col("_q")[1], F.col("_usual"))).alias("expected"),
        half_up(by_model(z, wide, rest), 1).alias("score"),
        by_model(F.abs(z) > fixed.Z_LIMIT, odd, strange).alias("is_anomaly"))
