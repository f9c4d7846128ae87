"""Input views over the given tables; every view keeps all of their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumtrail.session import shared_folder

# Where each column of the sales fact comes from.
SALES_COLUMNS = {
    "order_id": ("lineitem", "l_orderkey"),
    "order_date": ("orders", "CAST(o_orderdate AS DATE)"),
    "customer_id": ("orders", "o_custkey"),
    "status": ("orders", "o_orderstatus"),
    "product": ("part", "p_type"),
    "brand": ("part", "p_brand"),
    "region": ("region", "r_name"),
    "segment": ("customer", "c_mktsegment"),
    "units": ("lineitem", "l_quantity"),
    "revenue": ("lineitem", "l_extendedprice"),
    "cost": ("part", "p_retailprice * l_quantity"),
    "price": ("lineitem", "l_extendedprice / l_quantity"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The sales fact with the wanted columns, joining only what they need."""
    needed = {SALES_COLUMNS[c][0] for c in columns}
    fact = table(spark, sf_dir, "lineitem")
    if needed & {"orders", "customer", "region"}:
        fact = fact.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if needed & {"customer", "region"}:
        fact = fact.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if "region" in needed:
        places = table(spark, sf_dir, "nation").join(
            table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        fact = fact.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    if "part" in needed:
        fact = fact.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return fact.select(*[F.expr(SALES_COLUMNS[c][1]).alias(c) for c in columns])


def _money_text(c: str):
    return F.col(c).cast("decimal(18,2)").cast("string")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as untidy text: markers, currency signs, padding, mixed dates.

    Which cells are spoilt is arithmetic on the key, so that it can be repeated
    in SQL. No row is left out and the first 200 events appear twice.
    """
    events = table(spark, sf_dir, "events")
    id_ = F.col("event_id")
    kind = F.when(id_ % 17 == 0, "N/A").otherwise(F.col("event_type"))
    value = _money_text("value")
    dirty = events.select(
        "event_id",
        id_.cast("string").alias("event"),
        F.when(id_ % 31 == 0, F.date_format("ts", "M/d/yyyy"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(id_ % 29 == 0, F.concat(F.lit("  "), kind, F.lit(" "))).otherwise(kind).alias("event_type"),
        F.when(id_ % 19 == 0, "-").when(id_ % 23 == 0, F.concat(F.lit("£"), value)).otherwise(value).alias("value"),
        "props",
    )
    return dirty.unionAll(dirty.where("event_id < 200")).drop("event_id")


def workspace_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Five text tables that share keys: sales, inventory, customers, products, expenses."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")

    def text(c: str):
        return F.col(c).cast("string")

    return {
        "sales": lines.select(
            text("l_orderkey").alias("order_id"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
            text("o_custkey").alias("customer_id"), text("l_partkey").alias("part_id"),
            F.col("l_quantity").cast("bigint").cast("string").alias("quantity"),
            _money_text("l_extendedprice").alias("revenue"),
        ),
        "inventory": part.select(
            text("p_partkey").alias("part_id"), (F.col("p_size") * 20).cast("string").alias("inventory"),
        ),
        "customers": customer.select(
            text("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("segment"),
        ),
        "products": part.select(
            text("p_partkey").alias("part_id"), F.col("p_name").alias("product"),
            F.col("p_brand").alias("brand"), F.col("p_type").alias("type"),
            _money_text("p_retailprice").alias("price"),
        ),
        "expenses": table(spark, sf_dir, "supplier").select(
            text("s_suppkey").alias("ledger_code"), _money_text("s_acctbal").alias("cost"),
        ),
    }


def scratch_folder(spark: SparkSession) -> str:
    """A new folder on the shared storage of the cluster."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
