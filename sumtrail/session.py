"""Session helpers shared by the command line, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "sumtrail") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables written between stages, one per application.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``, or else
    in the one given to ``SparkContext.setCheckpointDir``. Only a local master
    may do without: its one machine is driver and executor alike.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or _checkpoint_folder(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/sumtrail-{spark.sparkContext.applicationId}"


def _checkpoint_folder(spark: SparkSession) -> str:
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    return folder.get() if folder.isDefined() else ""


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="sumtrail-")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_sumtrail_shipped", None) == context.applicationId:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sumtrail-"), "sumtrail.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._sumtrail_shipped = context.applicationId


def forget(spark: SparkSession) -> None:
    """Delete every table this application has written to the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_written(df: DataFrame) -> bool:
    """True for what :func:`written` returns."""
    return getattr(df, "_is_written", False)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table on shared storage; unchanged if it already is one.

    For a result that several later stages read. Writing it cuts the lineage,
    so nothing before it is computed twice, and losing an executor costs only
    the tasks that ran on it. Read back, the table has a known size: joins
    broadcast it exactly when it is below the session's broadcast threshold.
    """
    if is_written(df):
        return df
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    # The schema is given, so that empty results can be read back as well.
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._is_written = True
    table._path = path
    return table


def release(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
