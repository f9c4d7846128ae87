"""Business role of every column, scored from its profile.

Works on profile rows (one per column), so any number of tables is classified
at once. Roles and hints are literals inside the expressions: no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import top_rows
from sumtrail.functions.values import clamp, half_up

COLUMN = ["dataset", "position", "column_name"]


def header_words(name: Column) -> Column:
    spaced = F.regexp_replace(F.lower(name), r"[_\-\s]+", " ")
    return F.trim(spaced)


def _name_weight(role: str) -> Column:
    words = header_words(F.col("column_name"))
    hints = fixed.ROLE_HINTS[role]
    contains = F.lit(False)
    for hint in hints:
        contains = contains | words.contains(hint)
    return F.when(words.isin(hints), fixed.NAME_EQUAL).when(contains, fixed.NAME_CONTAINS)


def _share(count: str) -> Column:
    """Share of all values that match, by a count of the profile; NULL without values."""
    return F.when(F.col("non_missing") > 0, F.col(count) / F.col("non_missing"))


def _pattern_weight(role: str) -> Column:
    none = F.lit(None).cast("double")
    if role == "date":
        f = _share("date_shaped")
        return F.when(f >= 0.5, 0.3 * f)
    if role in ("price", "cost", "revenue"):
        f = _share("with_currency")
        return F.when(f > 0, 0.25 * f)
    if role == "percentage":
        f = _share("with_percent")
        in_range = f.isNotNull() & (F.col("min") >= 0) & (F.col("max") <= 100)
        return F.when(f > 0, 0.25 * f).when(in_range, 0.12)
    if role == "customer":
        f = _share("as_email")
        return F.when(f >= 0.5, 0.25 * f)
    if role == "location":
        return F.when(_share("as_postcode") >= 0.3, 0.2)
    if role in ("identifier", "product"):
        f = _share("as_item_code")
        return F.when(f >= 0.5, 0.15 * f)
    return none


def _type_weight(role: str) -> Column:
    kind = "number" if role in fixed.NUMERIC_ROLES else "date" if role == "date" else None
    if kind is None:
        return F.lit(None).cast("double")
    return F.when(F.col("inferred_type") == kind, fixed.TYPE_AGREES).otherwise(fixed.TYPE_DISAGREES)


def _cardinality_weight(role: str) -> Column:
    u, d = F.col("uniqueness"), F.col("distinct_values")
    if role == "identifier":
        return F.when(u > 0.9, 0.2).when(u > 0.7, 0.1)
    if role == "customer":
        return F.when((u > 0.4) & (u < 0.98), 0.15)
    if role in ("category", "status"):
        return F.when((d > 0) & (d <= 30) & (u < 0.15), 0.15)
    if role == "product":
        return F.when((u > 0.02) & (u < 0.6), 0.1)
    if role == "location":
        return F.when((d > 0) & (d <= 60) & (F.col("rows") > 20), 0.1)
    return F.lit(None).cast("double")


def _range_weight(role: str) -> Column:
    low, high = F.col("min"), F.col("max")
    if role == "percentage":
        return F.when((low >= 0) & (high <= 100), 0.1)
    if role == "quantity":
        return F.when(low >= 0, 0.1)
    if role in ("price", "cost", "revenue"):
        return F.when(low >= 0, 0.1).when(low < 0, -0.15)
    return F.lit(None).cast("double")


def _ranked_roles() -> Column:
    """All roles of a profile row with score and evidence, best first."""
    entries = []
    for order, role in enumerate(fixed.ROLE_HINTS):
        parts = {
            "name_match": _name_weight(role),
            "value_pattern": _pattern_weight(role),
            "type_consistency": _type_weight(role),
            "cardinality": _cardinality_weight(role),
            "range_check": _range_weight(role),
        }
        total = sum((F.coalesce(w, F.lit(0.0)) for w in parts.values()), F.lit(0.0))
        evidence = F.filter(
            F.array(*[
                F.struct(F.lit(source).alias("source"), w.cast("double").alias("weight"))
                for source, w in parts.items()
            ]),
            lambda e: e["weight"].isNotNull(),
        )
        entries.append(F.struct(
            (-clamp(total, 0, 1)).alias("key"), F.lit(order).alias("role_order"), F.lit(role).alias("role"),
            evidence.alias("evidence"),
        ))
    return F.array_sort(F.array(*entries))


def role_scores(profile: DataFrame) -> DataFrame:
    """One row per column and role with the score and the evidence behind it."""
    scored = profile.where("inferred_type <> 'empty'").select(*COLUMN, F.inline(_ranked_roles()))
    return scored.select(*COLUMN, "role", (-F.col("key")).alias("score"), "evidence")


def display_type(role: Column) -> Column:
    """How values of a role are shown; needs inferred_type, as_email and as_item_code."""
    kind = F.col("inferred_type")
    return (
        F.when(kind == "empty", "unknown")
        .when(role.isin("price", "cost", "revenue"), "currency")
        .when(role.isin("quantity", "inventory"), "count")
        .when(role == "date", "date")
        .when(role == "percentage", "percentage")
        .when((role == "customer") & (F.col("as_email") > 0), "email")
        .when((role == "identifier") | ((role == "product") & (F.col("as_item_code") > 0)), "code")
        .when(role.isin("category", "status", "location"), "category_label")
        .when(kind == "boolean", "boolean")
        .when(kind == "string", "free_text")
        .otherwise("unknown")
    )


def classify_columns(profile: DataFrame, overrides: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Chosen role per column with confidence, review flag and alternatives.

    ``overrides`` maps (dataset, column) to a role that wins with confidence 1.
    Row and month counts are carried along for the gates.
    """
    usable = F.when(F.col("inferred_type") != "empty", _ranked_roles())
    found = profile.select(*COLUMN, "inferred_type", "as_email", "as_item_code", "rows", "months", usable.alias("_ranked"))
    best = F.col("_ranked")[0]
    score = F.coalesce(-best["key"], F.lit(0.0))
    role = F.when(score >= fixed.ROLE_FLOOR, best["role"]).otherwise("unknown")
    others = F.filter("_ranked", lambda r: (r["role"] != F.col("_role")) & (-r["key"] >= fixed.ALTERNATIVE_FLOOR))
    chosen = found.withColumns({"_role": role, "_score": score}).withColumns({
        "alternatives": F.coalesce(
            F.array_join(F.transform(F.slice(others, 1, 3), lambda r: r["role"]), ","), F.lit("")
        ),
        "evidence": F.when(F.col("_role") != "unknown", best["evidence"]),
    })
    picked = F.lit(None).cast("string")
    for (dataset, column), wanted in (overrides or {}).items():
        picked = F.when((F.col("dataset") == dataset) & (F.col("column_name") == column), wanted).otherwise(picked)
    confirmed = chosen.withColumn("_picked", picked)
    final = F.coalesce("_picked", "_role")
    return confirmed.select(
        *COLUMN, "inferred_type", "rows", "months", final.alias("role"), display_type(final).alias("display_type"),
        F.when(F.col("_picked").isNotNull(), 1.0).otherwise(half_up(F.col("_score"), 2)).alias("confidence"),
        (F.col("_picked").isNull() & (F.col("_score") < fixed.REVIEW_BELOW)).alias("needs_review"),
        "alternatives", "evidence",
    )


def mapping_warnings(roles: DataFrame) -> DataFrame:
    """(dataset, warning, columns): missing date, missing money, weak guesses."""
    sure = F.col("confidence") >= 0.5
    weak = F.col("needs_review") & (F.col("role") != "unknown")
    facts = roles.groupBy("dataset").agg(
        F.count_if(sure & (F.col("role") == "date")).alias("dates"),
        F.count_if(sure & F.col("role").isin("revenue", "price", "cost")).alias("money"),
        F.array_sort(F.collect_list(F.when(weak, F.struct("position", "column_name")))).alias("_weak"),
    )
    names = F.array_join(F.transform("_weak", lambda w: w["column_name"]), ",")
    found = F.array_compact(F.array(
        F.when(F.col("dates") == 0, F.struct(F.lit("no_date_column").alias("warning"), F.lit("").alias("columns"))),
        F.when(F.col("money") == 0, F.struct(F.lit("no_money_column").alias("warning"), F.lit("").alias("columns"))),
        F.when(F.size("_weak") > 0, F.struct(F.lit("low_confidence").alias("warning"), names.alias("columns"))),
    ))
    return facts.select("dataset", F.inline(found))


def best_columns(roles: DataFrame) -> DataFrame:
    """Highest-confidence column of every role in every dataset."""
    known = roles.where("role <> 'unknown'")
    ranked = top_rows(known, ["dataset", "role"], [F.desc("confidence"), F.col("position")], 1)
    return ranked.select("dataset", "role", "column_name", "confidence")


def primary_measures(roles: DataFrame) -> DataFrame:
    """Main measure per dataset: one for series, one for breakdowns.

    A table with price and quantity but no revenue uses their product.
    """
    best = best_columns(roles)

    def first_of(order: list[str]) -> Column:
        rank = F.array_position(F.array(*map(F.lit, order)), F.col("role"))
        return F.min(F.when(rank > 0, F.struct(rank.alias("rank"), F.col("column_name").alias("name"))))

    def has(role: str) -> Column:
        return F.count_if(F.col("role") == role) > 0

    facts = best.groupBy("dataset").agg(
        first_of(fixed.SERIES_MEASURES).alias("_series"),
        first_of(fixed.BREAKDOWN_MEASURES).alias("_breakdown"),
        (has("price") & has("quantity") & ~has("revenue")).alias("_derived"),
    )
    derived = F.when(F.col("_derived"), "transaction_value")
    return facts.select(
        "dataset",
        F.coalesce(derived, F.col("_series")["name"]).alias("series_measure"),
        F.coalesce(derived, F.col("_breakdown")["name"]).alias("breakdown_measure"),
    )
