"""Descriptive statistics of numeric, categorical and dated columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import join_by, share_of_total, top_rows
from sumtrail.functions.quantiles import exact_quantiles
from sumtrail.functions.values import finite, half_up, total
from sumtrail.session import written


def measures_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), blank_as_zero: bool = False) -> DataFrame:
    """(by..., column_name, x) with one row per non-missing number, or per row if blanks count as 0."""
    numbers = {c: finite(F.col(c)) for c in columns}
    wide = df.select(*by, *[(F.coalesce(x, F.lit(0.0)) if blank_as_zero else x).alias(c) for c, x in numbers.items()])
    return wide.unpivot(list(by), list(columns), "column_name", "x").where("x IS NOT NULL")


def numeric_mode(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent number per key if it occurs at least twice (tie: smallest)."""
    counts = long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    best = F.min(F.struct((-F.col("_n")).alias("rank"), F.col("x").alias("x")))
    return counts.groupBy(*keys).agg(best["x"].alias("mode"))


def outlier_fences(quartiles: DataFrame) -> DataFrame:
    spread = F.col("q75") - F.col("q25")
    return quartiles.withColumns({
        "fence_low": F.col("q25") - 1.5 * spread,
        "fence_high": F.col("q75") + 1.5 * spread,
    })


def numeric_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), blank_as_zero: bool = False) -> DataFrame:
    """One row per key and column; columns with fewer than two values are left out."""
    keys = [*by, "column_name"]
    long = measures_long(df, columns, by, blank_as_zero)
    # Written, so that a few keys are broadcast and no task gets all numbers of a column.
    moments = written(exact_quantiles(long, "x", [0.25, 0.5, 0.75], keys, extra=[
        F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("sd"), F.var_pop("_x").alias("variance"),
        F.min("_x").alias("min"), F.max("_x").alias("max"),
    ]))
    fences = outlier_fences(moments)
    outside = (F.col("x") < F.col("fence_low")) | (F.col("x") > F.col("fence_high"))
    outliers = (
        join_by(long, fences.select(*keys, "fence_low", "fence_high"), keys)
        .groupBy(*keys).agg(F.count_if(outside).alias("outliers"))
    )
    named = moments.where("n >= 2").withColumnsRenamed({"q25": "q1", "q50": "median", "q75": "q3"})
    rounded = [half_up(F.col(c), 2).alias(c) for c in ("mean", "median", "q1", "q3", "sd", "variance")]
    complete = join_by(join_by(named, outliers, keys), numeric_mode(long, keys), keys, "left")
    return complete.select(*keys, "n", *rounded, "mode", "min", "max", "outliers")


def outlier_examples(df: DataFrame, column: str, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """The ``k`` largest values outside the quartile fences, per key."""
    fences = outlier_fences(written(exact_quantiles(df, column, [0.25, 0.75], by).drop("n")))
    x = F.col(column)
    outside = join_by(df, fences, by).where((x < F.col("fence_low")) | (x > F.col("fence_high")))
    ranked = top_rows(outside.select(*by, x.alias("x")), by, [F.desc("x")], k)
    return ranked.select(*by, "position", half_up(F.col("x"), 2).alias("value"))


def category_frequencies(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                         k: int = 15) -> DataFrame:
    """Counts and shares of the ``k`` most frequent labels per key and column."""
    keys = [*by, "column_name"]
    text = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns])
    long = text.unpivot(list(by), list(columns), "column_name", "label").where("label <> ''")
    counts = long.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    shared = share_of_total(counts, "n", keys, "total_rows")
    ranked = top_rows(shared, keys, [F.desc("n"), F.col("label")], k)
    pct = half_up(F.col("n") / F.col("total_rows") * 100, 1)
    return ranked.select(*keys, "position", "label", "n", pct.alias("pct"), "total_rows")


def strength_label(r: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(size < 0.1, "negligible")
        .when(size < 0.3, "weak")
        .when(size < 0.5, "moderate")
        .when(size < 0.7, "strong")
        .otherwise("very_strong")
    )


def direction_label(r: Column) -> Column:
    return F.when(r > 0.05, "positive").when(r < -0.05, "negative").otherwise("none")


def correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                 first: int | None = None) -> DataFrame:
    """Pearson coefficient of every column pair, all pairs in one aggregate.

    ``first`` limits the pairs to those among the first columns; zero variance
    gives 0 and pairs with fewer than five common values are left out.
    """
    pairs = list(combinations(columns[:first] if first else columns, 2))
    numbers = df.select(*by, *[finite(F.col(c)).alias(c) for c in columns])
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggregates.append(F.count_if(both).alias(f"n{i}"))
        # Not ``corr``, which fails on a constant column in ANSI mode.
        r = F.signum(F.covar_pop(a, b)) * F.sqrt(F.regr_r2(a, b))
        aggregates.append(F.coalesce(r, F.lit(0.0)).alias(f"r{i}"))
    wide = numbers.groupBy(*by).agg(*aggregates)
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("pair"),
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            F.col(f"n{i}").alias("n"),
            F.col(f"r{i}").alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return (
        wide.select(*by, F.inline(F.array(*rows)))
        .where("n >= 5")
        .select(
            *by, "pair", "column_a", "column_b", "n",
            half_up(F.col("r"), 2).alias("coefficient"),
            strength_label(F.col("r")).alias("strength"),
            direction_label(F.col("r")).alias("direction"),
        )
    )


def monthly_series(df: DataFrame, date: str, measure: str, by: Sequence[str] = (), fill_gaps: bool = False) -> DataFrame:
    """Sum and count of ``measure`` per calendar month.

    Empty months are absent, or with ``fill_gaps`` 0 between the first and last month of the key.
    """
    series = (
        df.where(finite(F.col(measure)).isNotNull() & F.col(date).isNotNull())
        .groupBy(*by, F.trunc(F.col(date).cast("date"), "month").alias("month"))
        .agg(half_up(total(F.col(measure)), 2).alias("value"), F.count(F.lit(1)).alias("n"))
    )
    if not fill_gaps:
        return series
    # A key has at most as many months as the calendar.
    whole = series.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("month", F.struct("value", "n")))).alias("_found"),
        F.sequence(F.min("month"), F.max("month"), F.expr("interval 1 month")).alias("_months"))
    each = whole.select(*by, "_found", F.explode("_months").alias("month"))
    hit = F.try_element_at("_found", F.col("month"))
    return each.select(*by, "month", F.coalesce(hit["value"], F.lit(0.0)).alias("value"), F.coalesce(hit["n"], F.lit(0)).cast("bigint").alias("n"))


def _cycle_totals(df: DataFrame, slot: Column, measure: str, by: Sequence[str],
                  labels: Sequence[str], base: int) -> DataFrame:
    """Totals per slot of a fixed cycle, with a row for every slot of every key."""
    sums = (
        df.where(finite(F.col(measure)).isNotNull() & slot.isNotNull())
        .groupBy(*by, slot.alias("_slot"))
        .agg(half_up(total(F.col(measure)), 2).alias("value"), F.count(F.lit(1)).alias("n"))
    )
    # At most one entry per slot and key, so the collected map is bounded.
    found = F.map_from_entries(F.collect_list(F.struct("_slot", F.struct("value", "n"))))
    per_key = sums.groupBy(*by).agg(found.alias("_found"))
    slots = F.array(*[
        F.struct(F.lit(i + base).alias("_slot"), F.lit(label).alias("label"))
        for i, label in enumerate(labels)
    ])
    filled = per_key.select(*by, "_found", F.inline(slots))
    hit = F.try_element_at("_found", F.col("_slot"))
    return filled.select(
        *by, F.col("_slot").cast("bigint").alias("slot"), "label",
        F.coalesce(hit["value"], F.lit(0.0)).alias("value"),
        F.coalesce(hit["n"], F.lit(0)).cast("bigint").alias("n"),
    )


def weekday_totals(df: DataFrame, date: str, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Totals for Sunday (0) to Saturday (6)."""
    slot = F.dayofweek(F.col(date).cast("date")) - 1
    return _cycle_totals(df, slot, measure, by, fixed.WEEKDAYS, 0)


def month_totals(df: DataFrame, date: str, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Totals for January (1) to December (12) over all years."""
    return _cycle_totals(df, F.month(F.col(date).cast("date")), measure, by, fixed.MONTHS, 1)
