"""Batches that Python gets from Spark are bounded by rows."""

import pyarrow as pa
from pyspark.sql import types as T

from sumtrail.llm import common


def test_batches_are_bounded(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = 3 * common.BATCH_ROWS + 7
    schema = T.StructType([T.StructField("n", T.LongType())])
    got = [r.n for r in common.map_arrow(spark.range(0, rows, 1, 1), run, schema).collect()]
    assert sum(got) == rows
    assert max(got) <= common.BATCH_ROWS


def test_a_lower_limit_stays(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "10")
        common.bound_batches(spark)
        assert spark.conf.get(key) == "10"
        spark.conf.set(key, "0")  # no limit
        common.bound_batches(spark)
        assert spark.conf.get(key) == str(common.BATCH_ROWS)
    finally:
        spark.conf.set(key, old)
