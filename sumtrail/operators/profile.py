"""Column profiles of text tables.

The shared stage is a count per distinct cell text. It is combined map-side,
so repeated values (a hot value, a blank column) collapse before the shuffle,
and every pattern is tested once per distinct text instead of once per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import join_by, top_rows
from sumtrail.functions.quantiles import counted_quantiles
from sumtrail.functions.values import (
    finite, half_up, looks_like_date, strip, to_day, to_number,
)
from sumtrail.session import written

KEYS = ["dataset", "column_name"]
SAMPLE_SIZE = 8


def as_text(df: DataFrame) -> DataFrame:
    """The same table with every column as text."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def cells(df: DataFrame, dataset: str = "data") -> DataFrame:
    """(dataset, column_name, raw), one row per cell, missing as ''."""
    text = as_text(df).na.fill("")
    long = text.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column_name", "raw")
    return long.select(F.lit(dataset).alias("dataset"), "column_name", "raw")


def _numbered_cells(df: DataFrame, first: int) -> DataFrame:
    """(place, raw), one row per cell, missing as ''; columns are numbered from ``first``."""
    text = as_text(df).na.fill("")
    return text.select(F.inline(F.array(*[
        F.struct(F.lit(first + i).alias("place"), F.col(f"`{c}`").alias("raw")) for i, c in enumerate(text.columns)])))


def value_counts(long: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """(dataset, column_name, value, n, chars): one row per distinct trimmed text."""
    return long.groupBy(*by, strip(F.col("raw")).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("chars")
    )


FLAGS = ["is_date", "is_boolean", "is_bit", "is_padded_iso", "is_plain", "has_currency", "has_percent", "is_email",
         "is_postcode", "is_item_code", "is_date_shaped"]


def _tested(counts: DataFrame, dayfirst: bool) -> DataFrame:
    """Add what each distinct text looks like; missing markers look like nothing.

    Texts have no blanks at their ends. Most of a large table are plain numbers,
    which no other pattern needs to see: they go a short way of their own, and
    ``counts``, read by both, should be written. Of the others each is only tested
    for what its first character or its length allows.
    """
    v, digits = F.col("value"), F.col("value").rlike(fixed.ONLY_DIGITS)
    short, code = F.length("value") <= fixed.LONGEST_BOOLEAN, F.length("value") <= fixed.LONGEST_ITEM_CODE
    known = {
        "is_bit": short & v.rlike(fixed.BOOLEAN_WORD_OR_BIT), "is_plain": F.lit(True), "is_item_code": code & v.rlike(fixed.ITEM_CODE),
    }
    plain = counts.where(digits).withColumns({
        "present": F.lit(True),
        "number": F.nullif(F.nullif(v.try_cast("double"), F.lit(float("inf"))), F.lit(float("-inf"))),
        "day": F.lit(None).cast("date"),
        **{flag: known.get(flag, F.lit(False)) for flag in FLAGS},
    })
    present = ~F.lower(v).isin(fixed.MISSING_MARKERS)
    # Read by several columns, evaluated once.
    seen = counts.where(~digits).withColumn("present", present).withColumn(
        "_dated", F.col("present") & looks_like_date(v, stripped=True))
    present, dated = F.col("present"), F.col("_dated")
    other = seen.withColumns({
        "number": to_number(F.when(present & v.rlike(fixed.NUMBER_START), v)),
        "day": F.when(dated, to_day(v, dayfirst, stripped=True)),
        "is_date": dated & ~v.rlike(fixed.PLAIN_NUMBER),
        "is_boolean": present & short & v.rlike(fixed.BOOLEAN_WORD),
        "is_bit": present & short & v.rlike(fixed.BOOLEAN_WORD_OR_BIT),
        "is_padded_iso": dated & v.rlike(fixed.PADDED_ISO_DAY),
        "is_plain": present & v.rlike(fixed.PLAIN_NUMBER),
        "has_currency": present & v.rlike(fixed.CURRENCY_SIGN),
        "has_percent": present & v.contains("%") & v.rlike(fixed.PERCENT_SIGN),
        "is_email": present & v.contains("@") & v.rlike(fixed.EMAIL),
        "is_postcode": present & v.rlike(fixed.POSTCODE),
        "is_item_code": present & code & v.rlike(fixed.ITEM_CODE),
        "is_date_shaped": dated & v.rlike(f"{fixed.ISO_DAY}|{fixed.SLASH_DAY}"),
    }).drop("_dated")
    return plain.unionByName(other)


def _count(flag: Column) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0)).cast("bigint")


def _column_type(values: Column, numbers: Column, dates: Column, booleans: Column) -> Column:
    return (
        F.when(values == 0, "empty")
        .when(numbers / values >= fixed.NUMBER_SHARE, "number")
        .when(dates / values >= fixed.DATE_SHARE, "date")
        .when(booleans / values >= fixed.BOOLEAN_SHARE, "boolean")
        .otherwise("string")
    )


def infer_types(df: DataFrame, dataset: str = "data", dayfirst: bool = False) -> DataFrame:
    """Type of every column from all of its values."""
    typed = _tested(written(value_counts(cells(df, dataset))), dayfirst).groupBy(*KEYS).agg(
        _count(F.col("present")).alias("non_missing"),
        _count(F.col("number").isNotNull()).alias("as_number"),
        _count(F.col("is_date")).alias("as_date"),
        _count(F.col("is_boolean")).alias("as_boolean"),
    )
    kind = _column_type(*map(F.col, ("non_missing", "as_number", "as_date", "as_boolean")))
    return typed.withColumn("inferred_type", kind)


def _totals() -> list[Column]:
    """Counts over tested rows that both kinds of profile share."""
    return [
        _count(F.col("present")).alias("non_missing"),
        F.sum(F.when(F.col("present"), F.col("chars"))).alias("_chars"),
        _count(F.col("number").isNotNull()).alias("as_number"),
        _count(F.col("is_date")).alias("as_date"),
        _count(F.col("is_boolean")).alias("as_boolean"),
        _count(F.col("is_bit")).alias("as_bit"),
        _count(F.col("is_padded_iso")).alias("padded_iso"),
        _count(F.col("is_plain")).alias("plain_numbers"),
        _count(F.col("has_currency")).alias("with_currency"),
        _count(F.col("has_percent")).alias("with_percent"),
        _count(F.col("is_email")).alias("as_email"),
        _count(F.col("is_postcode")).alias("as_postcode"),
        _count(F.col("is_item_code")).alias("as_item_code"),
        _count(F.col("is_date_shaped")).alias("date_shaped"),
        F.min("number").alias("_min"),
        F.max("number").alias("_max"),
        F.min("day").alias("_first_day"),
        F.max("day").alias("_last_day"),
    ]


def profile_columns(df: DataFrame, dataset: str = "data", dayfirst: bool = False) -> DataFrame:
    """One row per column: type, completeness, cardinality, samples, statistics."""
    return profile_tables({dataset: df}, dayfirst)


def profile_tables(tables: dict[str, DataFrame], dayfirst: bool = False) -> DataFrame:
    """Profiles of several tables in one plan, one row per table and column."""
    columns = [(name, c) for name, df in tables.items() for c in df.columns]
    first = dict(reversed([(name, i) for i, (name, _) in enumerate(columns)]))
    long = reduce(DataFrame.unionByName, [_numbered_cells(df, first[name]) for name, df in tables.items()])
    key = ["place"]
    # Written once: every cell is read a single time. Tests are cheaper made again than written.
    counts = written(value_counts(long, key))
    tested = _tested(counts, dayfirst)
    summary = tested.groupBy(*key).agg(
        F.sum("n").alias("rows"), F.count_if("present").alias("distinct_values"), *_totals()
    )
    days = tested.where("day is not null").select(*key, F.trunc("day", "month").alias("month")).distinct()
    months = days.groupBy(*key).agg(F.count(F.lit(1)).alias("_months"))
    # Numbers are read from text once, in this step; whether there is one is asked of the written table.
    n, numberlike = F.col("n"), F.col("value").rlike(fixed.NUMBER_START)
    numbers = written(_tested(counts.where(numberlike), dayfirst).select(*key, F.col("number").alias("x"), "n"))
    numbers = numbers.where(finite(F.col("x")).isNotNull())
    means = written(numbers.groupBy(*key).agg((F.sum(F.col("x") * n) / F.sum("n")).alias("_mean"), F.sum("n").alias("_n")))
    off = F.col("x") - F.col("_mean")
    spread = join_by(numbers, means, key).groupBy(*key, "_mean").agg(F.sqrt(F.sum(off * off * n) / F.max("_n")).alias("_sd"))
    moments = join_by(spread, counted_quantiles(numbers, "x", "n", [0.5], key, ["_median"], stored=True).drop("n"), key)
    head = _smallest(counts.select(*key, "value"), key, SAMPLE_SIZE)
    samples = head.groupBy(*key).agg(F.sort_array(F.collect_list("value")).alias("samples"))
    joined = summary
    for part in (months, moments, samples):
        joined = join_by(joined, part, key, "left")
    names = F.array(*[F.struct(F.lit(name).alias("dataset"), F.lit(c).alias("column_name")) for name, c in columns])
    named = joined.withColumn("_months", F.coalesce("_months", F.lit(0))).select("*", names[F.col("place")].alias("_name")).select(
        "*", "_name.*")
    return _profile_row(named, {name: df.columns for name, df in tables.items()})


#: One in so many values sets the bound below which the smallest are looked for.
BOUND_SHARE = 64


def _smallest(values: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` smallest texts per key that are no missing markers, of distinct texts.

    The ``k``-th smallest of any part of them is a bound, so that few rows are left to test and sort.
    """
    v = F.col("value")
    present = ~F.lower(v).isin(fixed.MISSING_MARKERS)
    part = values.where((F.pmod(F.xxhash64(v), F.lit(BOUND_SHARE)) == 0) & present)
    bound = written(top_rows(part, by, [v], k).where(F.col("position") == k).select(*by, v.alias("_most")))
    near = join_by(values, bound, by, "left").where(F.when(F.col("_most").isNull() | (v <= F.col("_most")), present))
    return top_rows(near.drop("_most"), by, [v], k)


def approximate_profile(df: DataFrame, dataset: str = "data", dayfirst: bool = False) -> DataFrame:
    """The same rows from one pass without shuffling values.

    Distinct counts come from a sketch and the median from another; samples
    are the smallest and largest text. Use it where exact distinct counts of
    near-unique columns are not worth shuffling the columns.
    """
    rows = cells(df, dataset).select(
        *KEYS, strip(F.col("raw")).alias("value"), F.lit(1).alias("n"), F.length("raw").alias("chars"),
    )
    x = F.col("number")
    value = F.when(F.col("present"), F.col("value"))
    summary = _tested(rows, dayfirst).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(value, 0.01).alias("distinct_values"),
        *_totals(),
        # Bounded: one entry per calendar month.
        F.size(F.collect_set(F.trunc("day", "month"))).cast("bigint").alias("_months"),
        F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"), F.percentile_approx(x, 0.5).alias("_median"),
        F.array_distinct(F.array_compact(F.array(F.min(value), F.max(value)))).alias("samples"),
    )
    return _profile_row(summary, {dataset: df.columns})


def _profile_row(joined: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    places = F.create_map(*[
        F.lit(v) for name, found in columns.items() for i, c in enumerate(found) for v in (f"{name}\n{c}", i)
    ])
    filled, rows = F.col("non_missing"), F.col("rows")
    kind = _column_type(*map(F.col, ("non_missing", "as_number", "as_date", "as_boolean")))

    def only(kind_name: str, column: str) -> Column:
        return F.when(F.col("inferred_type") == kind_name, F.col(column))

    some = filled > 0
    return joined.withColumn("inferred_type", kind).select(
        "dataset",
        F.try_element_at(places, F.concat_ws("\n", *KEYS)).cast("bigint").alias("position"),
        "column_name", "inferred_type", "rows", "non_missing",
        (rows - filled).alias("missing"),
        half_up((rows - filled) / rows * 100, 1).alias("missing_pct"),
        "distinct_values",
        F.when(some, half_up(F.col("distinct_values") / filled, 3)).otherwise(0.0).alias("uniqueness"),
        ((F.col("distinct_values") <= 1) & some).alias("is_constant"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        F.when(some, half_up(F.col("_chars") / filled)).otherwise(0.0).cast("bigint").alias("avg_length"),
        only("number", "_min").alias("min"), only("number", "_max").alias("max"),
        only("number", "_mean").alias("mean"), only("number", "_median").alias("median"),
        F.when((kind == "number") & (F.col("as_number") < 2), 0.0)
        .otherwise(only("number", "_sd")).alias("sd"),
        only("date", "_first_day").alias("first_day"), only("date", "_last_day").alias("last_day"),
        only("date", "_months").alias("months"),
        "as_number", "as_date", "as_boolean", "as_bit", "padded_iso", "plain_numbers",
        "with_currency", "with_percent", "as_email", "as_postcode", "as_item_code", "date_shaped",
    )


def row_key(df: DataFrame) -> Column:
    """256-bit hash of a row: equal for equal rows, NULL told from blank and one cell from the next."""
    texts = [F.col(f"`{c}`").cast("string") for c in df.columns]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def duplicate_rows(df: DataFrame, dataset: str = "data") -> DataFrame:
    """Row count, distinct rows and repeats beyond the first of each row.

    Rows are told apart by a 256-bit hash, so 32 bytes a row are shuffled and not the row.
    """
    distinct = df.groupBy(row_key(df).alias("_row")).agg(F.count(F.lit(1)).alias("_n"))
    totals = distinct.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
    )
    return totals.select(
        F.lit(dataset).alias("dataset"), F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates"),
    )
