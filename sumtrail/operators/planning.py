"""Scenario grids, threshold alerts, targets, outcomes and the audit view."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumtrail.functions.grouping import join_by
from sumtrail.functions.values import clamp, half_up, to_amount, total

COST_SHARE = 0.55
RETENTION_WEIGHT = 0.35
THRESHOLDS = {"health": 60, "quality": 75}
REVENUE_RISKS = ["volatility", "shortfall"]
AUDIT_LIMIT = 250


def scenario_grid(df: DataFrame, measure: str, by: Sequence[str] = (), cost: str | None = None,
                  price: Sequence[float] = (0,), volume: Sequence[float] = (0,),
                  unit_cost: Sequence[float] = (0,), retention: Sequence[float] = (0,)) -> DataFrame:
    """Projected revenue, cost and profit for every combination of levers (%)."""
    spent = total(F.col(cost)) if cost else total(F.col(measure)) * COST_SHARE
    base = df.groupBy(*by).agg(
        F.coalesce(total(F.col(measure)), F.lit(0.0)).alias("_revenue"),
        F.coalesce(spent, F.lit(0.0)).alias("_cost"),
    )
    # The grid is given by the caller and does not grow with the data.
    levers = F.array(*[
        F.struct(*[
            F.lit(float(v)).alias(n)
            for n, v in zip(("price_pct", "volume_pct", "unit_cost_pct", "retention_pct"), combination)
        ])
        for combination in product(price, volume, unit_cost, retention)
    ])
    grid = base.select("*", F.inline(levers))
    revenue = (
        F.col("_revenue") * (1 + F.col("price_pct") / 100) * (1 + F.col("volume_pct") / 100)
        * (1 + F.col("retention_pct") / 100 * RETENTION_WEIGHT)
    )
    costs = F.col("_cost") * (1 + F.col("volume_pct") / 100) * (1 + F.col("unit_cost_pct") / 100)
    return grid.select(
        *by, "price_pct", "volume_pct", "unit_cost_pct", "retention_pct",
        half_up(revenue, 2).alias("revenue"), half_up(costs, 2).alias("cost"),
        half_up(revenue - costs, 2).alias("profit"),
        half_up((revenue - costs) - (F.col("_revenue") - F.col("_cost")), 2).alias("profit_change"),
    )


def alerts(health: DataFrame, quality: DataFrame, risk_table: DataFrame, by: Sequence[str] = (),
           thresholds: dict[str, float] | None = None) -> DataFrame:
    """(by..., alert, value, threshold) for every breached rule.

    ``health`` has (by..., total), ``quality`` (by..., quality_score) or a
    single row, ``risk_table`` is the output of ``scorecard.risks``.
    """
    limit = {**THRESHOLDS, **(thresholds or {})}
    revenue = risk_table.where(F.col("risk").isin(REVENUE_RISKS) & (F.col("level") != "low"))
    moved = revenue.groupBy(*by).agg(F.count(F.lit(1)).alias("_moved"))
    keyed = [c for c in by if c in quality.columns]
    facts = join_by(join_by(health, quality, keyed), moved, by, "left")

    def alert(name: str, value: str, threshold: float | None):
        return F.struct(
            F.lit(name).alias("alert"), F.col(value).cast("double").alias("value"),
            F.lit(threshold).cast("double").alias("threshold"),
        )

    fired = F.array_compact(F.array(
        F.when(F.col("total") < limit["health"], alert("health_below", "total", limit["health"])),
        F.when(F.col("quality_score") < limit["quality"], alert("quality_below", "quality_score", limit["quality"])),
        F.when(F.col("_moved") > 0, alert("revenue_movement", "_moved", None)),
    ))
    return facts.select(*by, F.inline(fired))


# Default targets as (floor, step, ceiling) over the current value.
DEFAULT_TARGETS = {
    "health": (75, 10, 100), "quality": (90, 5, 100), "trend": (18, 4, 25), "confidence": (80, 8, 100),
}


def target_attainment(metrics: DataFrame, by: Sequence[str] = (),
                      targets: dict[str, float] | None = None) -> DataFrame:
    """Progress of every metric towards its target.

    ``metrics`` has (by..., health, quality, trend, confidence); a target that
    is not given defaults to a step above the current value within its bounds.
    """
    entries = []
    for name, (floor, step, ceiling) in DEFAULT_TARGETS.items():
        current = F.col(name).cast("double")
        default = F.least(F.lit(float(ceiling)), F.greatest(F.lit(float(floor)), current + step))
        target = F.lit(float(targets[name])) if targets and name in targets else default
        entries.append(F.struct(
            F.lit(name).alias("metric"), current.alias("current"), target.alias("target"),
        ))
    rows = metrics.select(*by, F.inline(F.array(*entries)))
    goal = F.when(F.col("target") != 0, F.col("target")).otherwise(F.lit(1.0))
    return rows.withColumns({
        "progress": half_up(clamp(F.col("current") / goal * 100, 0, 100), 1),
        "achieved": F.col("current") >= F.col("target"),
    })


def target_summary(attainment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return attainment.groupBy(*by).agg(
        F.count_if("achieved").alias("achieved"), F.count(F.lit(1)).alias("targets"),
        half_up(F.avg("progress")).alias("progress"),
    )


def outcome_totals(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected and recorded value and validated count of tracked decisions.

    ``outcomes`` has (by..., expected, actual text, status).
    """
    return outcomes.groupBy(*by).agg(
        half_up(total(F.col("expected")), 2).alias("expected"),
        half_up(total(to_amount(F.col("actual"))), 2).alias("actual"),
        F.count_if(F.col("status") == "validated").alias("validated"),
        F.count(F.lit(1)).alias("decisions"),
    )


def latest_events(events: DataFrame, tenant_column: str, tenant, time: str, tie: str,
                  kind_column: str | None = None, kind: str | None = None, k: int | None = AUDIT_LIMIT) -> DataFrame:
    """Newest ``k`` events of one tenant, of one type if asked for; ``k=None`` gives all."""
    mine = events.where(F.col(tenant_column) == tenant)
    if kind:
        mine = mine.where(F.col(kind_column) == kind)
    return mine if k is None else mine.orderBy(F.desc(time), F.desc(tie)).limit(k)


def event_types(events: DataFrame, tenant_column: str, tenant, kind_column: str) -> DataFrame:
    return events.where(F.col(tenant_column) == tenant).select(kind_column).distinct()
