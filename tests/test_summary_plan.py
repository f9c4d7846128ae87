"""Numbers of a column stay where they are when they are compared with its fences."""

import re

from pyspark.sql import functions as F

from sumtrail.operators.stats import numeric_summary


def test_rows_of_a_summary_are_not_shuffled_by_column(spark, tmp_path):
    rows = spark.range(20_000).select(F.rand(1).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 7).alias("b"))
    rows.write.parquet(f"{tmp_path}/rows")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 50_000)
    try:
        summary = numeric_summary(spark.read.parquet(f"{tmp_path}/rows"), ["a", "b"])
        plan = summary._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    expanded = [at for at, line in enumerate(plan) if "+- Expand" in line]
    assert expanded
    for at in expanded:
        assert not re.search(r"hashpartitioning\(column_name#\d+, 8\)", "".join(plan[at - 3 : at]))
    assert {(r.column_name, r.n, r.outliers) for r in summary.collect()} == {("a", 20_000, 0), ("b", 10_000, 0)}
