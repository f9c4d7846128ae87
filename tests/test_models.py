"""Models that run as chosen, by hand and by plain loops."""

import datetime
import random
import statistics

import pytest

from sumtrail.operators import models as md


def month(k):
    return datetime.date(2020 + k // 12, k % 12 + 1, 1)


def series(spark, values, key="a", skip=()):
    rows = [(key, month(k), float(v), 1) for k, v in enumerate(values) if k not in skip]
    return spark.createDataFrame(rows, "key string, month date, value double, n long")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("month").collect()]


SEASON = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120]


def test_seasonal_naive_repeats_the_last_year(spark):
    df = series(spark, SEASON + [2 * v for v in SEASON])
    assert values(md.executed_forecast(df, ["key"], "seasonal_naive", horizon=14)) == [2 * v for v in SEASON] + [20, 40]


def test_seasonal_naive_takes_an_older_year_where_a_month_is_absent(spark):
    df = series(spark, SEASON + [2 * v for v in SEASON], skip=[13])
    assert values(md.executed_forecast(df, ["key"], "seasonal_naive", horizon=2)) == [20, 20]


def test_a_month_never_seen_is_the_flat_average(spark):
    df = series(spark, [3, 6, 9, 12])
    for model in ("seasonal_naive", "moving_seasonal"):
        assert values(md.executed_forecast(df, ["key"], model, horizon=2)) == [9, 9]


def test_moving_seasonal_scales_the_year_by_its_level(spark):
    df = series(spark, SEASON + [2 * v for v in SEASON])
    # Mean of the last year 130, of all 97.5; January has 15 on average.
    assert values(md.executed_forecast(df, ["key"], "moving_seasonal", horizon=1)) == [20]


def test_line_average_and_bands(spark):
    df = series(spark, [10, 20, 30, 40])
    assert values(md.executed_forecast(df, ["key"], "linear_trend", horizon=2)) == [50, 60]
    flat = md.executed_forecast(df, ["key"], "moving_average", scenario="optimistic", horizon=1).first()
    assert (flat.value, flat.low, flat.high) == (30, 27, 33)
    line = md.executed_forecast(df, ["key"], "linear_trend", scenario="conservative", horizon=1).first()
    assert (line.value, line.low, line.high) == (43, 37, 48)  # 42.5 with 12 %
    assert values(md.executed_forecast(series(spark, [40, 30, 5]), ["key"], "linear_trend", horizon=3)) == [0, 0, 0]


def test_backtest_against_loops(spark):
    random.seed(4)

    def line(v, ahead):
        if len(v) < 2:
            return 0.0
        slope, start = statistics.linear_regression(range(len(v)), v)
        return max(0.0, start + slope * (len(v) + ahead - 1))

    def holt(v):
        level, trend = v[0], v[1] - v[0]
        for x in v[1:]:
            old = level
            level = 0.4 * x + 0.6 * (level + trend)
            trend = 0.3 * (level - old) + 0.7 * trend
        return max(0.0, level + trend)

    def predictions(v):
        flat = statistics.fmean(v[-3:])
        same = v[len(v) % 12 :: 12]
        return {"holt_linear": holt(v), "moving_average": flat, "seasonal_naive": same[-1] if same else flat, "linear_trend": line(v, 1),
                "moving_seasonal": statistics.fmean(v[-12:]) * statistics.fmean(same) / statistics.fmean(v) if same and sum(v) else flat}

    whole = None
    known = {}
    for key, n in (("a", 40), ("b", 7), ("c", 4), ("d", 3), ("e", 1)):
        known[key] = [random.uniform(1, 99) + 50 * (k % 12 == 3) for k in range(n)]
        one = series(spark, known[key], key)
        whole = one if whole is None else whole.unionByName(one)
    got = {r.key: r for r in md.tested_models(whole, ["key"]).collect()}
    for key, v in known.items():
        misses = [{m: abs(p - v[o]) for m, p in predictions(v[:o]).items()} for o in range(max(3, len(v) - 6), len(v))]
        if not misses:
            assert got[key].tested_model == "moving_average" and got[key].mae_linear_trend is None
            continue
        mae = {m: statistics.fmean(e[m] for e in misses) for m in md.MODELS}
        for m in md.MODELS:
            assert abs(got[key][f"mae_{m}"] - mae[m]) < 1e-3
        assert got[key].tested_model == min(md.MODELS, key=mae.get)
    ran = {r.key: r.executed_model for r in md.executed_forecast(whole, ["key"], "tested", horizon=1).collect()}
    assert ran == {k: r.tested_model for k, r in got.items()}


def test_chosen_models_run(spark):
    even = series(spark, [100 + k % 3 for k in range(14)])
    got = md.executed_forecast(even, ["key"]).first()
    assert got.executed_model == "holt_linear"
    short = md.executed_forecast(series(spark, [5, 6, 7]), ["key"], horizon=2)
    assert [(r.executed_model, r.value) for r in short.collect()] == [("moving_average", 6), ("moving_average", 6)]
    with pytest.raises(ValueError):
        md.executed_forecast(even, ["key"], "oracle")


def odd(df, **more):
    return {str(r.month): r for r in md.executed_anomalies(df, ["key"], **more).collect() if r.is_anomaly}


def test_quartile_fences(spark):
    df = series(spark, [10, 11, 12, 13, 14, 15, 16, 60])
    assert set(odd(df)) == {"2020-08-01"}
    r = odd(df)["2020-08-01"]  # quartiles 11.75, 13.5 and 15.25
    assert (r.executed_model, r.expected, r.score) == ("iqr", 14, 13.3)
    assert not odd(series(spark, [5, 5, 5, 5])) and md.executed_anomalies(series(spark, [5, 9]), ["key"]).count() == 0
    assert set(odd(series(spark, [5, 5, 5, 5, 9]))) == {"2020-05-01"}


def test_z_score_is_run_where_it_is_chosen(spark):
    df = series(spark, [100 + k % 2 for k in range(29)] + [140])
    r = odd(df)["2022-06-01"]
    assert r.executed_model == "z_score" and r.score > 5


def test_seasonal_residual_finds_what_a_season_hides(spark):
    value = [k + SEASON[k % 12] for k in range(48)]
    value[26] += 60  # a March that looks like an August
    df = series(spark, value)
    assert set(odd(df, detector="seasonal_residual")) >= {"2022-03-01"}
    assert "2022-03-01" not in odd(df, detector="iqr") and "2022-03-01" not in odd(df, detector="z_score")
    assert all(r.executed_model == "iqr" for r in md.executed_anomalies(series(spark, SEASON), ["key"], "seasonal_residual").collect())


def test_regular_season_has_no_remainder(spark):
    df = series(spark, [3 * k + SEASON[k % 12] for k in range(60)])
    inner = [r for r in md.executed_anomalies(df, ["key"], "seasonal_residual").collect() if "2021" <= str(r.month) < "2024"]
    assert all(abs(r.actual - r.expected) <= 2 for r in inner)
