"""Running totals over a stream of events (Structured Streaming).

All state is the running aggregate itself: one row per open day, or one row
per customer. Duplicate delivery is left to the source and sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sumtrail.functions.values import total


def live_revenue(events: DataFrame, time: str, measure: str, lateness: str = "1 day",
                 period: str = "1 day") -> DataFrame:
    """Revenue and orders per period.

    Written with :func:`run_upserts`, every batch hands on the periods that it
    changed, so that no period waits for later events: after a finished input
    all of them are there. The watermark bounds the state that is kept.
    :func:`run_available` appends a period only once the watermark has passed it.
    """
    totals = (
        events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
        .groupBy(F.window(time, period).alias("_w"))
        .agg(total(F.col(measure)).alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )
    return totals.select(F.col("_w.start").cast("date").alias("day"), "revenue", "orders")


def live_customers(events: DataFrame, customer: str, time: str, measure: str) -> DataFrame:
    """Spend, orders and first day of every customer, updated as events arrive."""
    return events.groupBy(F.col(customer).alias("customer")).agg(
        total(F.col(measure)).alias("spend"), F.count(F.lit(1)).alias("orders"),
        F.min(F.col(time).cast("date")).alias("first_day"),
    )


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop, appending finished rows to Parquet."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def run_upserts(df: DataFrame, write_batch, checkpoint: str) -> StreamingQuery:
    """Hand the rows changed by each batch to ``write_batch(df, batch_id)``."""
    return (
        df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )
