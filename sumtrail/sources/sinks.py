"""Writers: fully quoted CSV and the append-only table of run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumtrail.functions.grouping import top_rows

RUNS_KEPT = 20


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header and every field quoted, quotes doubled."""
    text = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"') \
        .option("emptyValue", "").csv(path)


def run_summary(dataset: str, rows: DataFrame, health: DataFrame, quality: DataFrame, gate_table: DataFrame,
                risk_table: DataFrame, actions: DataFrame, totals: DataFrame) -> DataFrame:
    """One row that sums up a run over one dataset.

    Every input is already aggregated. Parts of a keyed run have a row per key:
    rows and values at risk add up, scores are averaged.
    """
    first_risk = risk_table.agg(F.min_by("risk", "position").alias("top_risk"))
    first_action = actions.agg(F.min_by("action", "position").alias("top_action"))
    opened = gate_table.agg(F.count_if("available").alias("open"), F.count(F.lit(1)).alias("gates"))
    out = rows.agg(F.sum("rows").alias("rows"))
    for part in (
        health.agg(F.round(F.avg("total")).cast("bigint").alias("health")),
        quality.agg(F.round(F.avg("score")).cast("bigint").alias("quality")),
        opened, first_risk, first_action, totals.agg(F.sum("value_at_risk").alias("value_at_risk")),
    ):
        out = out.crossJoin(F.broadcast(part))
    return out.select(
        F.lit(dataset).alias("dataset"), F.current_timestamp().alias("created_at"), "rows", "health", "quality",
        F.concat_ws("/", "open", "gates").alias("gates"),
        F.coalesce("top_risk", F.lit("none")).alias("top_risk"),
        F.coalesce("top_action", F.lit("none")).alias("top_action"), "value_at_risk",
    )


def append_run(summary: DataFrame, path: str) -> None:
    summary.write.mode("append").parquet(path)


def latest_runs(runs: DataFrame, k: int = RUNS_KEPT, dataset: str = "dataset", time: str = "created_at") -> DataFrame:
    """Newest ``k`` runs of every dataset, numbered from 1."""
    return top_rows(runs, [dataset], [F.desc(time)], k)


def load_runs(spark: SparkSession, path: str, k: int = RUNS_KEPT) -> DataFrame:
    return latest_runs(spark.read.parquet(path), k)
