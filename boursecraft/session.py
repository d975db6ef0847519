"""Session settings that every job of this package relies on."""

from __future__ import annotations

import atexit
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "boursecraft", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session: UTC, adaptive execution, skew-join handling.

    On a cluster the partition counts come from the cluster's own configuration; ``conf``
    overrides anything for tests and benchmarks.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see.

    ``spark.checkpoint.dir`` as the cluster names it; where it is unset, a folder of this application
    under ``/tmp`` of Hadoop's default file system, which a cluster shares, removed at exit.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"/tmp/_boursecraft-{spark.sparkContext.applicationId}")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _own(spark, folder)
    return folder


_OWNED: set[str] = set()


def _own(spark: SparkSession, folder: str) -> None:
    """Remove a folder of this application when it ends."""
    if folder not in _OWNED:
        _OWNED.add(folder)
        atexit.register(_remove, spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped before: the folder is left to whoever cleans the file system
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tables_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; removed at exit."""
    folder = f"{work_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    _own(spark, folder)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure that ``checkpoint()`` has the shared folder; gives that folder."""
    current = spark._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    spark.sparkContext.setCheckpointDir(work_dir(spark))
    return spark._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and read it back as a table.

    Used where several later stages read the same reduced result: lineage ends here, lost
    executors re-read files instead of recomputing the scan, and later reads are pruned and sized
    by the file statistics. The table lives in the shared checkpoint folder until it is discarded or
    the application ends.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read any more."""
    for df in stored:
        _remove(df.sparkSession, df.stored_path)


def ship_functions(module_name: str) -> None:
    """Send a module's functions to executors by value: workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
