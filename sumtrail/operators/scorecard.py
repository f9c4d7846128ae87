"""Health score and risks, one row per entity (region, product line, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumtrail.functions.grouping import join_by, share_of_total
from sumtrail.functions.values import clamp, finite, half_up, half_up_long, ratio, strip, total
from sumtrail.operators import breakdown as bd
from sumtrail.operators import segments as sg
from sumtrail.operators import series as sr
from sumtrail.session import written

RISKS = ["concentration", "volatility", "customer_base", "churn", "shortfall", "data_quality"]
LEVELS = ["high", "medium", "low"]


def concentration_facts(df: DataFrame, category: str, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Largest label and its share of the total, per key."""
    return _largest(bd.category_sums(df, category, measure, by), by)


def _largest(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    top = F.min(F.struct((-F.col("sum")).alias("key"), F.col("label").alias("label")))
    heads = sums.groupBy(*by).agg(F.sum("sum").alias("_total"), top.alias("_top")).where("_total > 0")
    share = -F.col("_top")["key"] / F.col("_total") * 100
    return heads.select(*by, F.col("_top")["label"].alias("top_label"), share.alias("top_share"))


def _parts(df: DataFrame, by: Sequence[str], date: str, measure: str, customer: str | None,
           category: str | None, months: bool) -> dict[str, DataFrame]:
    """Sums per month, customer and category of every entity, from one pass over the rows.

    The rows go through one aggregate over grouping sets, whose size is that of its
    results and not that of the combinations; it is written, and each part reads its set.
    """
    month = F.trunc(F.col(date).cast("date"), "month")
    keys = {"_month": month if months else None, "_customer": customer, "_label": category}
    keys = {k: strip(F.col(v).cast("string")) if isinstance(v, str) else v for k, v in keys.items() if v is not None}
    if not keys:
        return {}
    rows = df.where(finite(F.col(measure)).isNotNull()).select(
        *by, *[v.alias(k) for k, v in keys.items()], month.alias("_at"), F.col(measure).alias("_value"))
    sums = written(
        rows.groupingSets([[*by, k] for k in keys], *by, *keys).agg(
            F.grouping_id().alias("_set"), total(F.col("_value")).alias("sum"), F.count(F.lit(1)).alias("n"),
            F.min("_at").alias("first_month"), F.max("_at").alias("last_month"))
    )
    # A set's number has a bit for every key left out, the last key's lowest.
    full = (1 << len(keys)) - 1
    numbers = {k: full ^ (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    return {k: sums.where((F.col("_set") == n) & (F.col(k).isNotNull() if k == "_month" else F.col(k) != ""))
            for k, n in numbers.items()}


def entity_facts(df: DataFrame, by: Sequence[str], date: str, measure: str, customer: str | None = None,
                 category: str | None = None, quality: DataFrame | None = None,
                 series: DataFrame | None = None, churn: DataFrame | None = None) -> DataFrame:
    """Everything the scores, risks and actions need, one row per entity.

    Each part is an aggregate on the entity key and the parts are joined after
    aggregation, so the joins see one row per entity. ``quality`` has
    (by..., quality_score), or only quality_score when it holds for all.

    ``df`` is read once. ``series`` and
    ``churn`` (monthly series and churn exposure of the same rows) are taken as
    they are where a caller has them.
    """
    parts = _parts(df, by, date, measure, customer if churn is None else None, category, series is None)
    if series is None:
        series = written(parts["_month"].select(*by, F.col("_month").alias("month"), half_up(F.col("sum"), 2).alias("value"), "n"))
    outlook = sr.selected_outlook(series, by).select(
        *by, "periods", "total", "first_value", "last_value", "mean", "sd",
        "chosen_model", "confidence", "trend_pct", "next_value",
    )
    weak = F.col("is_anomaly") & (F.col("actual") < F.col("expected"))
    drops = sr.anomalies(series, by).groupBy(*by).agg(F.count_if(weak).alias("drops"))
    facts = join_by(outlook, drops, by, "left")
    if customer:
        if churn is None:
            rolled = parts["_customer"].select(
                *by, F.col("_customer").alias("customer"), half_up(F.col("sum"), 2).alias("spend"),
                F.col("n").alias("orders"), "first_month", "last_month")
            churn = sg.churn_exposure(sg.customer_segments(sg.with_months_active(rolled, by), by), series, by)
        facts = join_by(facts, churn, by, "left")
    else:
        facts = facts.withColumns({
            "customers": F.lit(None).cast("bigint"), "repeaters": F.lit(None).cast("bigint"),
            "at_risk": F.lit(None).cast("bigint"), "churn_score": F.lit(None).cast("bigint"),
            "revenue_at_risk": F.lit(None).cast("double"),
        })
    if category:
        sums = parts["_label"].select(*by, F.col("_label").alias("label"), "sum", "n")
        facts = join_by(facts, _largest(sums, by), by, "left")
    else:
        facts = facts.withColumns({
            "top_label": F.lit(None).cast("string"), "top_share": F.lit(None).cast("double"),
        })
    if quality is None:
        return facts.withColumn("quality_score", F.lit(100).cast("bigint"))
    keyed = [c for c in by if c in quality.columns]
    return join_by(facts, quality, keyed, "left" if keyed else "inner")


def _change(facts_first: Column, facts_last: Column) -> Column:
    return (facts_last - facts_first) / F.when(facts_first != 0, facts_first).otherwise(F.lit(1.0))


def health_scores(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Four pillars of 0-25 and their total; a missing basis scores neutral."""
    change = _change(F.col("first_value"), F.col("last_value"))
    trend = F.when(F.col("periods") > 1, clamp(12 + change * 25, 0, 25)).otherwise(12.0)
    repeat = half_up(F.col("repeaters") / F.col("customers") * 25) + 5
    customer = F.when(F.col("customers") > 0, F.least(F.lit(25.0), repeat)).otherwise(12.0)
    data = half_up(F.col("quality_score") / 100 * 25)
    cv = ratio(F.col("sd"), F.col("mean"))
    stability = F.when(F.col("periods") > 2, clamp(half_up(25 - cv * 30), 0, 25)).otherwise(15.0)
    points = clamp(half_up(trend + customer + data + stability), 0, 100)
    return facts.select(
        *by, half_up_long(trend).alias("trend"), customer.cast("bigint").alias("customer"),
        data.cast("bigint").alias("quality"), stability.cast("bigint").alias("stability"),
        points.cast("bigint").alias("total"),
    )


def health_band(score: Column) -> Column:
    return F.when(score >= 80, "strong").when(score >= 60, "watch").otherwise("critical")


def quality_band(score: Column, strict: bool = True) -> Column:
    """Card bands (90, 70), or the overview's (80, 60) when not ``strict``."""
    upper, lower = (90, 70) if strict else (80, 60)
    return F.when(score >= upper, "ready").when(score >= lower, "review").otherwise("repair")


def risks(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Risks of every entity, most severe first.

    (by..., position, risk, level, evidence); evidence is the number the level
    was read from.
    """
    share, cv = F.col("top_share"), ratio(F.col("sd"), F.col("mean"))
    customers, churn, quality = F.col("customers"), F.col("churn_score"), F.col("quality_score")

    def graded(value: Column, high: float, medium: float) -> Column:
        return F.when(value > high, "high").when(value > medium, "medium").otherwise("low")

    def risk(name: str, level: Column, evidence: Column, present: Column) -> Column:
        order = F.lit(RISKS.index(name))
        entry = F.struct(
            F.array_position(F.array(*map(F.lit, LEVELS)), level).alias("severity"), order.alias("order"),
            F.lit(name).alias("risk"), level.alias("level"), evidence.cast("double").alias("evidence"),
        )
        return F.when(present & level.isNotNull(), entry)

    found = F.array_sort(F.array_compact(F.array(
        risk("concentration", graded(share, 60, 40), half_up(share), share.isNotNull()),
        risk("volatility", graded(cv, 0.4, 0.2), half_up(cv * 100), F.col("periods") > 2),
        risk("customer_base",
             F.when(customers < 20, "high").when(customers < 50, "medium").otherwise("low"),
             customers, customers.isNotNull()),
        risk("churn", F.when(churn >= 60, "high").when(churn >= 35, "medium"), churn, churn.isNotNull()),
        risk("shortfall", F.when(F.col("drops") >= 2, "medium"), F.col("drops"), F.col("drops").isNotNull()),
        risk("data_quality", F.when(quality < 70, "high").when(quality < 88, "medium"), quality,
             quality.isNotNull()),
    )))
    return facts.select(*by, F.posexplode(found).alias("_at", "_risk")).select(
        *by, (F.col("_at") + 1).cast("bigint").alias("position"),
        F.col("_risk.risk"), F.col("_risk.level"), F.col("_risk.evidence"),
    )
