"""From a raw table to its analyses: the operators in order.

Only two small tables reach the driver, both with one row per column of the
input: the raw profile, which decides the cleaning, and the column roles,
which decide which columns the later stages read. Results are lazy DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import join_by
from sumtrail.operators import actions as ac
from sumtrail.operators import breakdown as bd
from sumtrail.operators import clean as cl
from sumtrail.operators import features as ft
from sumtrail.operators import gates as gt
from sumtrail.operators import quality as ql
from sumtrail.operators import roles as rl
from sumtrail.operators import scorecard as sc
from sumtrail.operators import segments as sg
from sumtrail.operators import series as sr
from sumtrail.operators import stats as st
from sumtrail.operators.profile import duplicate_rows, profile_columns
from sumtrail.session import written

CATEGORY_ROLES = ["category", "product", "location", "status"]
NUMERIC_ROLES = ["price", "cost", "revenue", "quantity", "percentage", "inventory", "duration"]


def analyse(raw: DataFrame, dataset: str = "data", overrides: dict[str, str] | None = None,
            by: Sequence[str] = (), dayfirst: bool = False) -> dict[str, DataFrame]:
    """Profile, clean, classify and analyse one table.

    ``overrides`` fixes the role of a column; ``by`` names columns for which
    series, segments, scores, risks and actions are computed per value.
    """
    by = list(by)
    raw_profile = profile_columns(raw, dataset, dayfirst).collect()
    cleaned = cl.clean(raw, raw_profile, dayfirst)
    # Read by every later stage, so it is written once.
    rows = written(cleaned.rows)

    profile = written(profile_columns(rows, dataset, dayfirst))
    given = {(dataset, c): r for c, r in (overrides or {}).items()}
    roles = written(rl.classify_columns(profile, given))
    types = {p.column_name: p.inferred_type for p in profile.collect()}
    catalog = sorted(roles.collect(), key=lambda r: (-r.confidence, r.position))
    columns = [r for r in catalog if r.role != "unknown"]

    def best(*wanted: str) -> str | None:
        return next((c.column_name for role in wanted for c in columns if c.role == role), None)

    duplicates = duplicate_rows(rows, dataset)
    columns_quality = ql.column_quality(profile, roles)
    quality = ql.dataset_quality(columns_quality, duplicates)
    gate_table = gt.gates(roles)
    out = {
        "cleaned": rows, "cleaning_log": cleaned.log, "profile": profile, "roles": roles,
        "warnings": rl.mapping_warnings(roles), "column_quality": columns_quality, "quality": quality,
        "quality_flags": ql.quality_flags(columns_quality, duplicates), "gates": gate_table,
    }
    open_ = {g.capability: g.columns.split(",") for g in gate_table.where("available").collect()}

    table = cl.typed(rows, types, dayfirst)
    date, revenue, price = best("date"), best("revenue"), best("price")
    quantity, cost, customer = best("quantity"), best("cost"), best("customer")
    measure = best(*fixed.SERIES_MEASURES)
    if date:
        table = ft.calendar_parts(table, date)
    if price and quantity and not revenue:
        table = ft.transaction_value(table, price, quantity)
        measure = "transaction_value"
    if (revenue or price) and cost:
        table = ft.margin(table, revenue or price, cost)
    numeric = [c.column_name for role in NUMERIC_ROLES for c in columns
               if c.role == role and types[c.column_name] == "number"]
    numeric += [c for c in ("transaction_value", "margin", "margin_pct") if c in table.columns]
    labels = [c.column_name for role in CATEGORY_ROLES for c in columns
              if c.role == role and c.column_name not in by]
    group = labels[0] if labels else None
    out["features"] = table
    if measure is None or measure not in numeric:
        return out
    out["features"] = ft.value_bands(table, measure)
    out["numeric_summary"] = st.numeric_summary(table, numeric, by)
    if labels:
        out["category_frequencies"] = st.category_frequencies(table, labels, by)
    if "correlation" in open_ and len(numeric) > 1:
        out["correlations"] = st.correlations(table, numeric, by)
    if "comparison" in open_ and group:
        out["comparison"] = bd.top_categories(table, group, measure, by)
        out["breakdown"] = bd.breakdown(table, group, measure, by)
    if "distribution" in open_:
        out["distribution"] = bd.histogram(table, measure, by)
    group = group if "concentration_analysis" in open_ else None
    if group:
        out["concentration"] = bd.concentration(table, group, measure, by)
    if "trend_analysis" not in open_:
        return out

    # One row per month and key: cheap to keep, read by every model.
    series = written(st.monthly_series(table, date, measure, by))
    out["series"] = series
    if "seasonality" in open_:
        out["weekdays"] = st.weekday_totals(table, date, measure, by)
        out["months"] = st.month_totals(table, date, measure, by)
    if "forecasting" in open_:
        out["forecast_model"] = sr.choose_forecast_model(series, by)
        out["forecast"] = sr.forecast(series, by)
    if "anomaly_detection" in open_:
        out["anomaly_model"] = sr.choose_anomaly_model(series, by)
        out["anomalies"] = sr.anomalies(series, by)
    buyer = customer if "segmentation" in open_ else None
    if buyer:
        customers = sg.customer_rollup(table, buyer, date, measure, by)
        out["segments"] = written(sg.customer_segments(customers, by))
        out["churn"] = written(sg.churn_exposure(out["segments"], series, by))

    score = quality.select(F.col("score").alias("quality_score"))
    facts = written(sc.entity_facts(table, by, date, measure, buyer, group, score, series, out.get("churn")))
    out["facts"] = facts
    out["health"] = sc.health_scores(facts, by)
    out["risks"] = sc.risks(facts, by)
    scores = {q.column_name: q.score for q in columns_quality.collect()}
    named = {"category": group, "measure": measure, "customer": buyer}
    column_scores = {k: scores[v] for k, v in named.items() if v in scores}
    strong = out.get("correlations")
    if strong is not None:
        found = strong.groupBy(*by).agg(
            F.bool_or(F.col("strength").isin("strong", "very_strong")).alias("strong_pair")
        )
        facts = join_by(facts, found, by, "left").na.fill(False, ["strong_pair"])
    out["actions"] = ac.ranked_actions(facts, by, column_scores)
    out["action_totals"] = ac.action_totals(out["actions"], by)

    candidates = gate_table.where(
        F.col("available") & ~F.col("capability").isin("cohort_analysis", "transaction_analysis", "seasonality")
    ).withColumn("coefficient", F.lit(None).cast("double"))
    if strong is not None:
        # Of a keyed run, the strongest of all keys.
        pair = bd.strongest_pair(strong, by).agg(F.max_by("coefficient", F.abs("coefficient")).alias("_r"))
        candidates = candidates.join(F.broadcast(pair), F.col("capability") == "correlation", "left").withColumn(
            "coefficient", F.col("_r")
        ).where("capability <> 'correlation' OR _r IS NOT NULL")
    out["analyses"] = bd.rank_analyses(candidates)
    return out
