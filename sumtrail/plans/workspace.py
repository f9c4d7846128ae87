"""Several tables as one workspace: roles, purposes, relations and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sumtrail.functions.values import half_up
from sumtrail.operators import linkage as lk
from sumtrail.operators import roles as rl
from sumtrail.operators.profile import profile_tables
from sumtrail.session import written

METRIC_SCHEMA = "metric string, value double, pair bigint"


def _numeric_column(catalog: list[Row], dataset: str, *wanted: str) -> str | None:
    return next((c.column_name for c in catalog
                 if c.dataset == dataset and c.role in wanted and c.inferred_type == "number"), None)


def prepare_workspace(tables: dict[str, DataFrame],
                      overrides: dict[tuple[str, str], str] | None = None) -> dict[str, DataFrame]:
    """Classify every table, find the relations and compute what they support.

    The driver sees the column catalog and at most two relations per table
    pair; every value is compared and summed on the executors.
    """
    # One row per column of every table: written once, read by every stage.
    profile = written(profile_tables(tables))
    roles = written(rl.classify_columns(profile, overrides))
    order = {name: i for i, name in enumerate(tables)}
    catalog = sorted(roles.drop("evidence").collect(), key=lambda r: (order[r.dataset], r.position))
    purposes = lk.table_purposes(roles)
    relation_table = written(lk.relations(tables, lk.link_candidates(catalog, tables)))
    found = sorted(relation_table.collect(), key=lambda r: (-r.confidence, r.pair))
    purpose_of = {p.dataset: p.purpose for p in purposes.collect()}
    table_for = {}
    for name in tables:
        table_for.setdefault(purpose_of[name], name)

    sizes = profile.groupBy("dataset").agg(F.max("rows").alias("rows"))
    out = {
        "profile": profile, "roles": roles, "purposes": purposes, "relations": relation_table,
        "primary": lk.primary_table(purposes, sizes),
    }
    spark = roles.sparkSession
    metrics = [spark.createDataFrame([], METRIC_SCHEMA)]
    insights = [spark.createDataFrame([], "insight string, priority string, confidence double, pair bigint")]

    def link(a: str, b: str) -> Row | None:
        return next((r for r in found if {r.left_dataset, r.right_dataset} == {a, b}), None)

    def side(relation: Row, dataset: str) -> str:
        return relation.left_column if relation.left_dataset == dataset else relation.right_column

    def metric(name: str, df: DataFrame, value: str, pair: int | None) -> DataFrame:
        return df.select(
            F.lit(name).alias("metric"), F.col(value).cast("double").alias("value"),
            F.lit(pair).cast("bigint").alias("pair"),
        )

    def insight(name, df: DataFrame, priority, confidence: float, pair: int | None) -> DataFrame:
        return df.select(
            name.alias("insight"), priority.alias("priority"),
            F.lit(confidence).cast("double").alias("confidence"), F.lit(pair).cast("bigint").alias("pair"),
        ).where("priority IS NOT NULL")

    sales, inventory = table_for.get("sales"), table_for.get("inventory")
    finance, customers = table_for.get("finance"), table_for.get("customers")
    revenue = sales and _numeric_column(catalog, sales, "revenue")
    if sales and revenue:
        total = lk.total_amount(tables[sales], revenue).select(half_up(F.col("total"), 2).alias("total"))
        metrics.append(metric("connected_revenue", total, "total", None))
    if sales and inventory and (relation := link(sales, inventory)):
        demand = _numeric_column(catalog, sales, "quantity")
        stock = _numeric_column(catalog, inventory, "inventory", "quantity")
        if demand and stock:
            coverage = lk.stock_coverage(tables[sales], side(relation, sales), demand,
                                         tables[inventory], side(relation, inventory), stock)
            summary = lk.coverage_summary(coverage)
            out["stock_coverage"] = coverage
            metrics.append(metric("inventory_demand_coverage", summary, "coverage_pct", relation.pair))
            metrics.append(metric("products_requiring_review", summary, "under_stocked", relation.pair))
            name = F.when(F.col("priority") == "opportunity", "inventory_balanced").otherwise("inventory_review")
            insights.append(insight(name, summary, F.col("priority"), relation.confidence, relation.pair))
    if sales and customers and (relation := link(sales, customers)):
        linked = relation_table.where(F.col("pair") == relation.pair)
        metrics.append(metric("customer_linkage", linked, "overlap_pct", relation.pair))
        insights.append(insight(F.lit("customer_linkage_review"), linked.drop("confidence"),
                                lk.linkage_review(F.col("overlap_pct")), relation.confidence, relation.pair))
        out["unmatched_customers"] = lk.unmatched_keys(
            tables[sales], side(relation, sales), tables[customers], side(relation, customers))
    cost = finance and _numeric_column(catalog, finance, "cost")
    if sales and finance and revenue and cost:
        share = lk.contribution(tables[sales], revenue, tables[finance], cost)
        metrics.append(metric("cross_source_contribution", share, "contribution_pct", None))
        insights.append(insight(F.lit("finance_reconciliation"), share, F.lit("opportunity"), 0.7, None))
    out["metrics"] = reduce(DataFrame.unionByName, metrics)
    out["insights"] = reduce(DataFrame.unionByName, insights)
    out["confirmed_metrics"] = lk.confirmed_only(out["metrics"], relation_table)
    return out
