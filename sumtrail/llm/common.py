"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows of an Arrow batch: a batch of texts and what comes of it lie in memory several times over.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The white space of the contracts, as bytes: bytes.split() splits on exactly these.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def per_row(df: DataFrame, columns: list[str], schema: T.StructType, row: Callable[..., tuple]) -> DataFrame:
    """Apply ``row`` to the given columns of every row, one Arrow batch at a time.

    ``row`` takes the values of ``columns`` and returns one tuple for ``schema``.
    Nothing is kept between rows, so memory is bounded by one batch.
    """
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(*values) for values in zip(*(batch.column(c).to_pylist() for c in columns))]
            columns_out = list(zip(*rows)) or [()] * len(target)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=f.type) for v, f in zip(columns_out, target)], schema=target)

    return map_arrow(df.select(*columns), run, schema)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors, in batches of ``BATCH_ROWS`` at most."""
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of rows per Arrow batch to ``BATCH_ROWS``; a lower one stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_sumtrail_shipped", None) == context.applicationId:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="sumtrail-"), "sumtrail.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._sumtrail_shipped = context.applicationId


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df
