"""Quality scores from column profiles: expressions over one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.values import clamp, half_up, half_up_long


def _weighted(prefix: str = "") -> Column:
    return sum((F.col(f"{axis}{prefix}") * w for axis, w in fixed.QUALITY_WEIGHTS.items()), F.lit(0.0))


def column_quality(profile: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Completeness, validity, consistency, uniqueness and score per column.

    ``roles`` has (dataset, column_name, role); identifiers lose points for
    repeated values, every other column is fully unique by definition.
    """
    present, kind = F.col("non_missing"), F.col("inferred_type")
    matching = (
        F.when(kind == "number", F.col("as_number")).when(kind == "date", F.col("as_date"))
        .when(kind == "boolean", F.col("as_bit")).otherwise(present)
    )
    formatted = (
        F.when(kind == "date", F.col("padded_iso")).when(kind == "number", F.col("plain_numbers"))
        .otherwise(present)
    )
    validity = F.when(present == 0, 100.0).otherwise(half_up(matching / present * 100, 1))
    consistency = F.when(present < 2, 100.0).otherwise(half_up(formatted / present * 100, 1))
    if roles is None:
        with_role = profile.withColumn("role", F.lit("unknown"))
    else:
        chosen = roles.select("dataset", "column_name", "role")
        with_role = profile.join(chosen, ["dataset", "column_name"], "left").na.fill("unknown", ["role"])
    identifier = F.col("role") == "identifier"
    scored = with_role.select(
        "dataset", "position", "column_name", "role", "inferred_type",
        F.greatest(F.lit(0.0), 100 - F.col("missing_pct")).alias("completeness"),
        validity.alias("validity"), consistency.alias("consistency"),
        F.when(identifier, half_up(F.col("uniqueness") * 100, 1)).otherwise(100.0).alias("uniqueness"),
    )
    return scored.withColumn("score", half_up_long(_weighted()))


def quality_flags(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(dataset, column_name, flag, value): every breached quality limit."""
    def flag(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("flag"), value.cast("double").alias("value"))

    found = F.array_compact(F.array(
        F.when(F.col("completeness") < 70, flag("incomplete", half_up(100 - F.col("completeness")))),
        F.when(
            (F.col("validity") < 85) & (F.col("inferred_type") != "string"),
            flag("invalid_values", half_up(F.col("validity"))),
        ),
        F.when(
            (F.col("role") == "identifier") & (F.col("uniqueness") < 98),
            flag("repeated_identifier", half_up(F.col("uniqueness"))),
        ),
    ))
    per_column = columns.select("dataset", "column_name", F.inline(found))
    share = duplicates.select("dataset", _duplicate_pct().alias("value")).where("value > 1")
    whole = share.select(
        "dataset", F.lit(None).cast("string").alias("column_name"),
        F.lit("duplicate_rows").alias("flag"), "value",
    )
    return per_column.unionByName(whole)


def _duplicate_pct() -> Column:
    return F.when(F.col("rows") > 0, half_up(F.col("duplicates") / F.col("rows") * 100, 1)).otherwise(0.0)


def dataset_quality(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Mean of every axis and the overall score, less a penalty for duplicates."""
    means = columns.groupBy("dataset").agg(*[
        half_up_long(F.avg(axis)).alias(axis) for axis in fixed.QUALITY_WEIGHTS
    ])
    joined = means.join(
        duplicates.select("dataset", _duplicate_pct().alias("duplicate_pct")), "dataset"
    )
    penalty = F.least(F.lit(float(fixed.DUPLICATE_PENALTY_CAP)), F.col("duplicate_pct"))
    score = clamp(half_up(_weighted() - penalty), 0, 100).cast("bigint")
    return joined.withColumn("score", score)
