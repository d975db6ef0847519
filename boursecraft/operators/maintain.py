"""Current values kept up to date: a batch resolves the instruments that it names, and no others.

Two tables are stored under one root, both partitioned by a bucket of the instrument: the state of all
observations (newest rows and evidence, see ``reconcile.newest_state``) and the current values. A batch
is merged into the state of the buckets it touches, its instruments are resolved again from that state,
and the rows of those buckets are replaced. Raw observations are never read again.

A state merge is idempotent and the state is written before the values, so a batch that was
interrupted is simply applied again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boursecraft.operators import reconcile as R
from boursecraft.session import materialise

BUCKETS = 256


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("instrument_id"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, touched: DataFrame, buckets: int) -> None:
    """Replace the touched buckets. Each gets a row without an instrument, for a bucket that is left
    without rows would otherwise keep its old ones."""
    marks = touched.select(*[(F.col("bucket") if c == "bucket" else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns]).distinct()
    staged = materialise(rows.unionByName(marks), "staged")  # the table being replaced is also being read
    staged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _read(spark: SparkSession, path: str, touched: list[int] | None = None) -> DataFrame:
    """Rows of the touched buckets (all without a list): other partitions are not listed or opened."""
    rows = spark.read.parquet(path)
    return (rows if touched is None else rows.filter(F.col("bucket").isin(touched))).filter("instrument_id IS NOT NULL")


def read_state(spark: SparkSession, root: str, touched: list[int] | None = None) -> DataFrame:
    return _read(spark, f"{root}/state", touched)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The stored current values of all instruments."""
    return _read(spark, f"{root}/current").drop("bucket")


def build(root: str, obs: DataFrame, instruments: DataFrame, as_of, runs: DataFrame, ranked: DataFrame, files: DataFrame, rows: DataFrame,
          aliases: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Store state and current values of all observations."""
    spark = obs.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    _write(R.newest_state(obs.filter("instrument_id IS NOT NULL")).withColumn("bucket", _bucket(buckets)), f"{root}/state", every, buckets)
    state = read_state(spark, root).drop("bucket")
    current = R.resolve(state, instruments, as_of, runs, ranked, files, rows, aliases)
    _write(current.withColumn("bucket", _bucket(buckets)), f"{root}/current", every, buckets)


def apply(root: str, batch: DataFrame, instruments: DataFrame, as_of, runs: DataFrame, ranked: DataFrame, files: DataFrame, rows: DataFrame,
          aliases: DataFrame | None = None, was=None, also: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Bring the stored tables up to date with a batch of observations.

    ``was`` is the day of the last resolution, where it differs: instruments whose filings age past a
    limit in between are resolved too. ``also`` names instruments whose other layers changed (identity,
    ranking, archive). ``instruments``, ``runs`` and the rest are as for ``current_metrics``.
    """
    spark = batch.sparkSession
    new = materialise(R.newest_state(batch.filter("instrument_id IS NOT NULL")), "batch-state")
    named = new.select("instrument_id")
    if was is not None:
        named = named.unionByName(R.expired(read_state(spark, root), was, as_of))
    if also is not None:
        named = named.unionByName(also.select("instrument_id").filter("instrument_id IS NOT NULL"))
    touched = materialise(named.distinct().withColumn("bucket", _bucket(buckets)), "touched")
    numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # the number of buckets at most
    if not numbers:
        return
    ids = touched.select("instrument_id")
    state = read_state(spark, root, numbers)
    merged = R.merge_states(state.drop("bucket"), new).withColumn("bucket", _bucket(buckets))
    _write(merged, f"{root}/state", touched, buckets)
    hit = read_state(spark, root, numbers).drop("bucket").join(ids, "instrument_id", "left_semi")
    fresh = R.resolve(hit, instruments.join(ids, "instrument_id", "left_semi"), as_of, runs, ranked.join(ids, "instrument_id", "left_semi"), files, rows, aliases)
    rest = _read(spark, f"{root}/current", numbers).join(ids, "instrument_id", "left_anti")
    _write(rest.unionByName(fresh.withColumn("bucket", _bucket(buckets))), f"{root}/current", touched, buckets)
