import datetime as dt

import pytest
from pyspark.sql import functions as F

from sumtrail.functions import values as vl


def evaluate(spark, function, cells, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r.v for r in df.select("i", function(F.col("c")).alias("v")).orderBy("i").collect()]


def test_half_up_rounds_halves_up(spark):
    got = evaluate(spark, vl.half_up, [-2.5, 2.5, -0.5, 0.49999, 1e20, None], "double")
    assert got == [-2.0, 3.0, 0.0, 0.0, 1e20, None]
    assert evaluate(spark, lambda c: vl.half_up(c, 2), [1.005, -1.25, 3e17], "double") == [1.0, -1.25, 3e17]


def test_missing_markers(spark):
    cells = ["", "  ", "N/A", "na", "NULL", "None", "-", "--", "NaN", "undefined", "?", None, "0", "n", "no"]
    assert evaluate(spark, vl.is_missing, cells) == [True] * 12 + [False] * 3


def test_numbers(spark):
    cells = ["£1,200.50", "12%", "-", "", "abc", "1e3", ".5", "5.", " 7 ", "1e999", None, "+4", "1d", "Infinity",
             "5%%", "-3", "1 000"]
    want = [1200.5, 12.0, None, None, None, 1000.0, 0.5, 5.0, 7.0, None, None, 4.0, None, None, None, -3.0, 1000.0]
    assert evaluate(spark, vl.to_number, cells) == want


def test_amounts_default_to_zero(spark):
    assert evaluate(spark, vl.to_amount, ["€5", "x", None, "7%"]) == [5.0, 0.0, 0.0, 0.0]


def test_leading_numbers(spark):
    assert evaluate(spark, vl.price_of, ["12 pcs", "abc", None, "£3.5"]) == [12.0, 0.0, 0.0, 3.5]
    assert evaluate(spark, vl.quantity_of, ["12 pcs", "abc", "0", None]) == [12.0, 1.0, 1.0, 1.0]


DATES = {
    "2024-01-05": dt.date(2024, 1, 5), "2024-1-5": dt.date(2024, 1, 5),
    "2024-01-05 10:00:00": dt.date(2024, 1, 5), "2024-01-05T23:30:00-05:00": dt.date(2024, 1, 6),
    "1/31/2024": dt.date(2024, 1, 31), "31/1/2024": None, "3.4.24": dt.date(2024, 3, 4),
    "3.4.75": dt.date(1975, 3, 4), "5 March 2024": dt.date(2024, 3, 5), "March 5, 2024": dt.date(2024, 3, 5),
    "2024/02/03": dt.date(2024, 2, 3), "2024-13-45": None, "12 Foo 2024": None,
}


def test_days(spark):
    assert evaluate(spark, vl.to_day, list(DATES)) == list(DATES.values())
    assert evaluate(spark, vl.looks_like_date, list(DATES)) == [True] * len(DATES)
    assert evaluate(spark, vl.looks_like_date, ["2024", "1.5", "abc", "", None]) == [False] * 5
    assert evaluate(spark, lambda c: vl.to_day(c, True), ["31/1/2024"]) == [dt.date(2024, 1, 31)]


@pytest.mark.parametrize("number,text", [(1200.0, "1200"), (12345678.5, "12345678.5"), (0.25, "0.25"), (-3.0, "-3")])
def test_plain_text(spark, number, text):
    assert evaluate(spark, vl.plain_text, [number], "double") == [text]
