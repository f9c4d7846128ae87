"""Recommended actions per entity: fired rules, value, urgency and priority.

The rules are a parameter table. Nine rules fire from the facts of an entity;
those that fire are valued and ranked. All of it is array expressions on
one row per entity: no join and no shuffle beyond those behind the facts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions.grouping import window_by
from sumtrail.functions.values import clamp, half_up, ratio

MIN_FORECAST_MONTHS = 6


@dataclass(frozen=True)
class Rule:
    """One action rule.

    ``columns`` are the roles whose columns the action rests on; ``always``
    names risks related whatever their columns, optionally only at a level.
    """

    code: str
    impact: str
    value: str
    effort: str
    days: int
    floor: str
    columns: tuple[str, ...] = ()
    always: tuple[tuple[str, str | None], ...] = field(default=())


# Rules in the order in which they are kept.
RULES = [
    Rule("reduce_concentration", "high", "top_share", "medium", 7, "immediate", ("category", "measure")),
    Rule("accelerate_growth", "high", "growth", "high", 14, "this_month", ("measure",), (("churn", "high"),)),
    Rule("validate_near_term_growth", "high", "growth", "medium", 5, "this_month", ("measure",)),
    Rule("re_engage_customers", "high", "at_risk", "medium", 5, "this_month", ("customer",)),
    Rule("prevent_churn", "medium", "at_risk", "medium", 7, "immediate", ("customer",), (("volatility", "high"),)),
    Rule("build_loyalty", "medium", "at_risk", "medium", 5, "this_quarter", ("customer",)),
    Rule("improve_data", "medium", "baseline", "medium", 7, "this_quarter", (), (("data_quality", None),)),
    Rule("investigate_pair", "medium", "baseline", "medium", 5, "this_quarter", ("pair",)),
    Rule("review_periodically", "medium", "baseline", "low", 1, "this_quarter", (), (("data_quality", None),)),
]

# Columns each risk rests on.
RISK_COLUMNS = {
    "concentration": ("category", "measure"),
    "volatility": ("measure",),
    "customer_base": ("customer",),
    "churn": ("customer",),
    "shortfall": ("measure",),
    "data_quality": (),
}

# Share of the total, and low and high factors, per value formula.
VALUE_RANGES = {
    "top_share": (0.7, 1.3), "at_risk": (0.5, 1.2), "growth": (0.6, 1.5),
}
GROWTH_SHARE, CHURN_SHARE = 0.12, 0.15
BASELINE_SHARE, BASELINE_LOW, BASELINE_HIGH = 0.05, 0.02, 0.08
URGENCY_FACTORS = {"immediate": 1.3, "this_month": 1.1, "this_quarter": 1.0}
EFFORT_DIVISORS = {"low": 1.0, "medium": 2.5, "high": 5.0}
OPPORTUNITY_RULES = ["accelerate_growth", "validate_near_term_growth", "re_engage_customers"]


def _risk_levels() -> dict[str, Column]:
    """Level of each risk of the entity, NULL where it has none (as in ``risks``)."""
    share, cv = F.col("top_share"), ratio(F.col("sd"), F.col("mean"))
    customers, churn, quality = F.col("customers"), F.col("churn_score"), F.col("quality_score")
    return {
        "concentration": F.when(share > 60, "high").when(share > 40, "medium").when(share.isNotNull(), "low"),
        "volatility": F.when(F.col("periods") > 2, F.when(cv > 0.4, "high").when(cv > 0.2, "medium").otherwise("low")),
        "customer_base": F.when(customers < 20, "high").when(customers < 50, "medium").when(customers.isNotNull(), "low"),
        "churn": F.when(churn >= 60, "high").when(churn >= 35, "medium"),
        "shortfall": F.when(F.col("drops") >= 2, "medium"),
        "data_quality": F.when(quality < 70, "high").when(quality < 88, "medium"),
    }


def _fired() -> dict[str, Column]:
    first = F.when(F.col("first_value") != 0, F.col("first_value")).otherwise(F.lit(1.0))
    growth_pct = (F.col("last_value") - F.col("first_value")) / first * 100
    customers = F.coalesce("customers", F.lit(0))
    return {
        "reduce_concentration": F.col("top_share") > 60,
        "accelerate_growth": (F.col("periods") > 1) & (growth_pct < 5),
        "validate_near_term_growth":
            (F.col("periods") >= MIN_FORECAST_MONTHS) & (F.col("next_value") > F.col("last_value") * 1.1),
        "re_engage_customers": F.coalesce("at_risk", F.lit(0)) > 0,
        "prevent_churn": F.col("churn_score") >= 40,
        "build_loyalty": (customers > 0) & (customers < 100),
        "improve_data": F.col("quality_score") < 80,
        "investigate_pair": F.col("strong_pair"),
        "review_periodically": F.lit(True),
    }


def _value(kind: str) -> tuple[Column, Column, Column]:
    total = F.col("total")
    if kind == "baseline":
        return total * BASELINE_SHARE, total * BASELINE_LOW, total * BASELINE_HIGH
    base = {
        "top_share": total * (half_up(F.col("top_share")) / 100),
        "at_risk": F.when(F.col("revenue_at_risk") != 0, F.col("revenue_at_risk")).otherwise(total * CHURN_SHARE),
        "growth": total * GROWTH_SHARE,
    }[kind]
    low, high = VALUE_RANGES[kind]
    return base, base * low, base * high


def _confidence(columns: Sequence[str]) -> Column:
    """Dataset quality and the mean quality of the columns behind the rule."""
    if columns:
        mean = sum((F.col(f"quality_{c}") for c in columns), F.lit(0.0)) / len(columns) / 100
    else:
        mean = F.lit(0.75)
    return half_up(F.least(F.lit(0.95), F.col("quality_score") / 100 * 0.6 + mean * 0.4), 2)


def _lookup(values: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for item in values.items() for v in item])[key]


def ranked_actions(facts: DataFrame, by: Sequence[str] = (), column_quality: dict[str, float] | None = None,
                   pair_on_measure: bool = False, k: int | None = None) -> DataFrame:
    """Actions per entity, ranked by priority; with ``k`` only the first ``k`` rules that fire.

    ``facts`` are the entity facts plus ``strong_pair`` (whether a strong
    correlation was found; false if absent). ``column_quality`` gives the score
    of the category, measure, customer and pair columns (80 where unknown).
    """
    quality = {c: float((column_quality or {}).get(c, 80)) for c in ("category", "measure", "customer", "pair")}
    known = facts.withColumns({f"quality_{c}": F.lit(q) for c, q in quality.items()})
    if "strong_pair" not in facts.columns:
        known = known.withColumn("strong_pair", F.lit(False))
    levels, fired = _risk_levels(), _fired()

    entries = []
    for i, rule in enumerate(RULES):
        rests_on = set(rule.columns) | ({"measure"} if pair_on_measure and "pair" in rule.columns else set())
        related = []
        for name, level in levels.items():
            wanted = dict(rule.always).get(name, False)
            if rests_on & set(RISK_COLUMNS[name]) or wanted is None:
                related.append((name, level))
            elif wanted:
                related.append((name, F.when(level == wanted, level)))
        names = F.array_compact(F.array(*[F.when(lv.isNotNull(), F.lit(n)) for n, lv in related])) \
            if related else F.array().cast("array<string>")
        high = medium = F.lit(False)
        for _, level in related:
            high = high | F.coalesce(level == "high", F.lit(False))
            medium = medium | F.coalesce(level == "medium", F.lit(False))
        floor_now, floor_soon = rule.floor == "immediate", rule.floor in ("immediate", "this_month")
        urgency = (
            F.when(high | F.lit(floor_now), "immediate").when(medium | F.lit(floor_soon), "this_month")
            .otherwise("this_quarter")
        )
        value, low, high_value = _value(rule.value)
        entry = F.struct(
            F.lit(i + 1).cast("bigint").alias("rule"), F.lit(rule.code).alias("action"),
            F.lit(rule.impact).alias("impact"),
            half_up(value).alias("value"), half_up(low).alias("value_low"), half_up(high_value).alias("value_high"),
            urgency.alias("urgency"), F.lit(rule.effort).alias("effort"),
            F.lit(rule.days).cast("bigint").alias("days"),
            _confidence(rule.columns).alias("confidence"), F.array_join(names, ",").alias("related_risks"),
        )
        entries.append(F.when(fired[rule.code], entry))
    kept = F.array_compact(F.array(*entries))
    kept = kept if k is None else F.slice(kept, 1, k)
    exploded = known.select(*by, F.inline(kept))
    raw = (
        F.log10(F.col("value") + 100) * 10 * F.col("confidence")
        * _lookup(URGENCY_FACTORS, F.col("urgency")) * 10 / _lookup(EFFORT_DIVISORS, F.col("effort"))
    )
    scored = exploded.withColumn("priority", clamp(half_up(raw), 5, 100).cast("bigint"))
    # At most one row per rule and entity.
    w = window_by(by).orderBy(F.desc("priority"), "rule")
    return scored.withColumn("position", F.row_number().over(w).cast("bigint"))


def action_totals(actions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Value at risk (actions with a related risk) and opportunity value."""
    at_risk = F.when(F.col("related_risks") != "", F.col("value")).otherwise(0.0)
    opportunity = F.when(F.col("action").isin(OPPORTUNITY_RULES), F.col("value")).otherwise(0.0)
    return actions.groupBy(*by).agg(
        half_up(F.sum(at_risk)).alias("value_at_risk"), half_up(F.sum(opportunity)).alias("opportunity"),
    )
