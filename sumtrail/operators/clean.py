"""Cleaning of text tables, with a log of every kind of change.

Steps, in this order: trim, blank out missing markers, drop exact duplicates,
normalise numbers and dates, fill gaps. Cells stay text and an unreadable cell
of a number or date column is kept as it is; ``typed`` gives the typed table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import join_by
from sumtrail.functions.quantiles import exact_quantiles
from sumtrail.functions.values import is_missing, looks_like_date, plain_text, strip, to_day, to_number
from sumtrail.operators.profile import as_text, infer_types, profile_columns, row_key
from sumtrail.session import is_written, written


@dataclass
class Cleaned:
    rows: DataFrame
    log: DataFrame


def standardised(df: DataFrame) -> DataFrame:
    """Trimmed cells with NULL for every missing marker."""
    text = as_text(df)
    return text.select(*[
        F.when(~is_missing(F.col(f"`{c}`")), strip(F.col(f"`{c}`"))).alias(c) for c in text.columns
    ])


#: Hashes of repeated rows (32 bytes each) that are broadcast at most, and the characters that make a row wide.
FEW_REPEATED, WIDE = 100_000, 256


def deduplicated(df: DataFrame, by_hash: bool = False, few: int = FEW_REPEATED) -> DataFrame:
    """Standardised rows, each once.

    With ``by_hash``, rows are shuffled as hashes of 256 bits; only rows whose hash
    occurs twice are shuffled whole, and all others stay where they are. That pays
    for wide rows, as it reads them three times. With more than ``few`` repeated
    hashes, whole rows are shuffled in one go after all.
    """
    rows = standardised(df)
    if not by_hash:
        return rows.distinct()
    key = "_key"
    while key in rows.columns:
        key += "_"
    repeated = written(rows.select(row_key(rows).alias(key)).groupBy(key).count().where("count > 1").select(key))
    if repeated.limit(few + 1).count() > few:
        return rows.distinct()
    keyed, repeated = rows.withColumn(key, row_key(rows)), F.broadcast(repeated)
    once = keyed.join(repeated, key, "left_anti").drop(key)
    again = keyed.join(repeated, key, "left_semi").drop(key).distinct()
    return once.unionByName(again)


def _normal_form(c: str, kind: str, dayfirst: bool) -> Column:
    cell = F.col(f"`{c}`")
    if kind == "number":
        return F.coalesce(plain_text(to_number(cell)), cell)
    if kind == "date":
        day = F.when(looks_like_date(cell), to_day(cell, dayfirst))
        return F.coalesce(day.cast("string"), cell)
    return cell


def normalised(df: DataFrame, types: dict[str, str], dayfirst: bool = False) -> DataFrame:
    """Numbers and dates in one form; every number is read once, in a step of its own."""
    numbers = {c: f"_number_{i}" for i, c in enumerate(df.columns) if types.get(c) == "number"}
    while set(numbers.values()) & set(df.columns):
        numbers = {c: f"{name}_" for c, name in numbers.items()}
    read = df.select("*", *[
        to_number(F.when(~F.col(f"`{c}`").rlike(fixed.WHOLE_NUMBER), F.col(f"`{c}`"))).alias(name)
        for c, name in numbers.items()])
    return read.select(*[
        (F.coalesce(plain_text(F.col(numbers[c])), F.col(f"`{c}`")) if c in numbers
         else _normal_form(c, types.get(c, "string"), dayfirst)).alias(c) for c in df.columns
    ])


def fillable_columns(profile: Iterable[Row]) -> dict[str, str]:
    """Columns that may be filled, by the gates of the raw profile."""
    return {
        p.column_name: p.inferred_type
        for p in profile
        if 0 < p.missing and p.missing_pct <= fixed.IMPUTE_MISSING_LIMIT
        and p.uniqueness <= fixed.IMPUTE_UNIQUENESS_LIMIT
        and p.inferred_type in ("number", "string", "boolean")
    }


def numeric_fills(rows: DataFrame, columns: list[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, fill, method): median of a skewed column, else its mean."""
    numbers = rows.select(*by, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])
    long = numbers.unpivot(list(by), [F.col(f"`{c}`") for c in columns], "column_name", "x").where(
        "x IS NOT NULL AND NOT isnan(x)"
    )
    moments = exact_quantiles(long, "x", [0.5], [*by, "column_name"], names=["median"], extra=[
        F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("sd"),
    ])
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.lit(1.0))
    skewed = F.abs(F.col("mean") - F.col("median")) / sd > fixed.SKEW_LIMIT
    return moments.select(
        *by, "column_name",
        plain_text(F.when(skewed, F.col("median")).otherwise(F.col("mean"))).alias("fill"),
        F.when(skewed, "impute_numeric_median").otherwise("impute_numeric_mean").alias("method"),
    )


def label_fills(rows: DataFrame, columns: list[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_name, fill, method): most frequent text, ties by smallest text."""
    picked = rows.select(*by, *[F.col(f"`{c}`") for c in columns])
    long = picked.unpivot(list(by), [F.col(f"`{c}`") for c in columns], "column_name", "value")
    counts = long.where("value IS NOT NULL").groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value")))
    return counts.groupBy(*by, "column_name").agg(best["value"].alias("fill")).withColumn(
        "method", F.lit("impute_categorical_mode")
    )


def fills(rows: DataFrame, fillable: dict[str, str], by: Sequence[str] = ()) -> DataFrame | None:
    """Fill of every fillable column, per key of ``by`` if given; keys are not filled themselves."""
    fillable = {c: kind for c, kind in fillable.items() if c not in by}
    if fillable:
        # Read by several passes; what is before it may be a shuffle of all rows.
        rows = written(rows.select(*by, *[F.col(f"`{c}`") for c in fillable])) if not is_written(rows) else rows
    numeric = [c for c, kind in fillable.items() if kind == "number"]
    labels = [c for c, kind in fillable.items() if kind != "number"]
    parts = []
    if numeric:
        parts.append(numeric_fills(rows, numeric, by))
    if labels:
        parts.append(label_fills(rows, labels, by))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def filled(rows: DataFrame, values: DataFrame | None, columns: Iterable[str], by: Sequence[str] = ()) -> DataFrame:
    """Replace NULL in ``columns`` from ``values``, one row per column (and key of ``by``).

    A key without any value of a column keeps its gaps.
    """
    if values is None:
        return rows
    columns = set(columns) - set(by)
    # One field per column, bounded by the width of the table; one row, or one per key.
    one_row = values.groupBy(*by).agg(*[
        F.max(F.when(F.col("column_name") == c, F.col("fill"))).alias(f"_fill_{c}") for c in sorted(columns)
    ])
    joined = join_by(rows, one_row, by, "left")
    return joined.select(*[
        F.coalesce(F.col(f"`{c}`"), F.col(f"`_fill_{c}`")).alias(c) if c in columns else F.col(f"`{c}`")
        for c in rows.columns
    ])


def _change_log(df: DataFrame, unique: DataFrame, types: dict[str, str], fillable: dict[str, str],
                values: DataFrame | None, dayfirst: bool) -> DataFrame:
    text = as_text(df).na.fill("")
    columns = text.columns
    trimmed = sum((F.when(strip(F.col(f"`{c}`")) != F.col(f"`{c}`"), 1).otherwise(0) for c in columns), F.lit(0))
    marked = sum(
        (F.when((strip(F.col(f"`{c}`")) != "") & is_missing(F.col(f"`{c}`")), 1).otherwise(0) for c in columns),
        F.lit(0),
    )
    before = text.agg(
        F.sum(trimmed).alias("trimmed"), F.sum(marked).alias("marked"), F.count(F.lit(1)).alias("rows_before"),
    )
    converted = {c: kind for c, kind in types.items() if kind in ("number", "date")}
    after = unique.agg(
        F.count(F.lit(1)).alias("rows_after"),
        *[F.count_if(_normal_form(c, kind, dayfirst) != F.col(f"`{c}`")).alias(f"converted_{c}")
          for c, kind in converted.items()],
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"gaps_{c}") for c in fillable],
    )

    def entry(step: int, action: str, column: str | None, count: Column) -> Column:
        return F.struct(
            F.lit(step).cast("bigint").alias("step"), F.lit(action).alias("action"),
            F.lit(column).cast("string").alias("column_name"), count.cast("bigint").alias("n"),
        )

    place = {c: i for i, c in enumerate(columns)}
    entries = [
        entry(1, "trim_values", None, F.col("trimmed")),
        entry(2, "standardise_missing", None, F.col("marked")),
        entry(3, "remove_duplicate_rows", None, F.col("rows_before") - F.col("rows_after")),
    ]
    for c, kind in converted.items():
        action = "convert_numeric" if kind == "number" else "convert_date"
        entries.append(entry(10 + place[c], action, c, F.col(f"`converted_{c}`")))
    for c in fillable:
        entries.append(entry(10_000 + place[c], "impute", c, F.col(f"`gaps_{c}`")))
    log = before.crossJoin(F.broadcast(after)).select(F.inline(F.array(*entries)))
    if values is None:
        return log.where("n > 0")
    methods = values.select(F.col("column_name").alias("_column"), "method")
    named = log.join(methods, (F.col("column_name") == F.col("_column")) & (F.col("action") == "impute"), "left")
    # A column without a single value offers nothing to fill with.
    named = named.where("n > 0 AND (action <> 'impute' OR method IS NOT NULL)")
    return named.select("step", F.coalesce("method", "action").alias("action"), "column_name", "n")


def clean(df: DataFrame, profile: Iterable[Row] | None = None, dayfirst: bool = False) -> Cleaned:
    """Cleaned rows and the log of changes.

    The raw profile (one row per column) decides which columns are converted
    and filled; it is the only thing read by the driver.
    """
    if profile is None:
        profile = profile_columns(df, dayfirst=dayfirst).collect()
    profile = list(profile)
    types = {p.column_name: p.inferred_type for p in profile}
    fillable = fillable_columns(profile)
    # Removing duplicates is the costly step; the fills, the log and the
    # result all read its output, so it is done once.
    unique = written(deduplicated(df, by_hash=sum(p.avg_length for p in profile) > WIDE))
    rows = written(normalised(unique, types, dayfirst))
    values = fills(rows, fillable)
    return Cleaned(
        rows=filled(rows, values, fillable),
        log=_change_log(df, unique, types, fillable, values, dayfirst),
    )


def typed(df: DataFrame, types: dict[str, str] | None = None, dayfirst: bool = False) -> DataFrame:
    """Typed columns for analysis; unreadable cells become NULL."""
    if types is None:
        types = {r.column_name: r.inferred_type for r in infer_types(df, dayfirst=dayfirst).collect()}

    def column(c: str) -> Column:
        cell, kind = F.col(f"`{c}`"), types.get(c, "string")
        if kind == "number":
            return to_number(cell)
        if kind == "date":
            return to_day(cell, dayfirst)
        if kind == "boolean":
            return F.lower(strip(cell)).isin("true", "yes", "y")
        return F.when(~is_missing(cell), strip(cell))

    return df.select(*[column(c).alias(c) for c in df.columns])


def rejects(df: DataFrame, types: dict[str, str], dayfirst: bool = False) -> DataFrame:
    """(column_name, n): non-missing cells that the typed table cannot hold."""
    chosen = {c: kind for c, kind in types.items() if kind in ("number", "date")}
    lost = [
        F.struct(F.lit(c).alias("column_name"), F.count_if(
            ~is_missing(F.col(f"`{c}`"))
            & (to_number(F.col(f"`{c}`")) if kind == "number" else to_day(F.col(f"`{c}`"), dayfirst)).isNull()
        ).alias("n"))
        for c, kind in chosen.items()
    ]
    return as_text(df).agg(F.array(*lost).alias("_lost")).select(F.inline("_lost"))
