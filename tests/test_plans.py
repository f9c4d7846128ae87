"""Whole-table analyses and workspaces on small and on given tables."""

import pytest
from pyspark.sql import functions as F

from checks.views import table
from sumtrail.plans.analysis import analyse
from sumtrail.plans.workspace import prepare_workspace
from sumtrail.sources import sinks


def text(spark, header, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header))


def test_stock_workspace(spark):
    sales = text(spark, ["date", "product id", "quantity", "revenue"],
                 [("2026-01-01", "SKU-1", "10", "100"), ("2026-01-02", "SKU-2", "5", "75")])
    inventory = text(spark, ["product id", "inventory"], [("SKU-1", "4"), ("SKU-2", "20")])
    out = prepare_workspace({"sales.csv": sales, "inventory.csv": inventory})
    metrics = {r.metric: r.value for r in out["metrics"].collect()}
    assert metrics["inventory_demand_coverage"] == 160.0
    assert metrics["products_requiring_review"] == 1.0
    assert [r.priority for r in out["insights"].collect()] == ["high"]
    assert out["primary"].first().dataset == "sales.csv"


def test_no_metric_without_a_relation(spark):
    sales = text(spark, ["date", "product id", "quantity", "revenue"], [("2026-01-01", "SKU-1", "10", "100")])
    finance = text(spark, ["ledger code", "cost"], [("L-1", "40")])
    metrics = {r.metric for r in prepare_workspace({"sales.csv": sales, "finance.csv": finance})["metrics"].collect()}
    assert "inventory_demand_coverage" not in metrics and "connected_revenue" in metrics


def test_shared_attributes_are_not_keys(spark):
    stock = text(spark, ["product id", "inventory", "currency"], [("SKU-1", "4", "GBP"), ("SKU-2", "20", "GBP")])
    finance = text(spark, ["month", "gross revenue", "cost", "currency"],
                   [("2026-01-01", "100", "40", "GBP"), ("2026-02-01", "120", "45", "GBP")])
    relations = prepare_workspace({"inventory.csv": stock, "finance.csv": finance})["relations"].collect()
    assert not any("currency" in (r.left_column, r.right_column) for r in relations)


@pytest.mark.parametrize("by", [[], ["Region"]])
def test_analysis_end_to_end(spark, sf, tmp_path, by):
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    raw = orders.select(
        F.col("o_orderkey").cast("string").alias("Order ID"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Order Date"),
        F.col("c_mktsegment").alias("Product Category"),
        F.concat(F.lit("Zone "), F.col("c_nationkey").cast("string")).alias("Region"),
        F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("Customer"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Revenue"),
        (F.col("o_totalprice") * 0.6).cast("decimal(18,2)").cast("string").alias("Cost"),
    )
    out = analyse(raw, "orders", overrides={"Product Category": "category", "Customer": "customer"}, by=by)
    roles = {r.column_name: r.role for r in out["roles"].collect()}
    assert roles["Order Date"] == "date" and roles["Revenue"] == "revenue" and roles["Cost"] == "cost"
    for name in ("numeric_summary", "category_frequencies", "correlations", "breakdown", "distribution",
                 "concentration", "series", "weekdays", "months", "forecast", "anomalies", "segments", "churn",
                 "health", "risks", "actions", "action_totals", "analyses"):
        assert out[name].count() > 0, name
    assert out["features"].count() == raw.count()
    assert set(by) <= set(out["health"].columns)
    if not by:
        path = str(tmp_path / "runs")
        sinks.append_run(sinks.run_summary(
            "orders", out["profile"].agg(F.max("rows").alias("rows")), out["health"], out["quality"], out["gates"],
            out["risks"], out["actions"], out["action_totals"]), path)
        saved = sinks.load_runs(spark, path).first()
        assert saved.rows == raw.count() and 0 <= saved.health <= 100 and saved.gates.endswith("/11")
