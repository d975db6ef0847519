"""The two ingest operators as Structured Streaming jobs over a directory of files.

Semantics are the batch ones: an observation key is stored once, a bar key keeps its last write.
Each micro-batch calls the batch operator, which is idempotent, so a batch that is replayed after a
failure changes nothing. ``availableNow`` drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from boursecraft.session import materialise
from boursecraft.sinks import tables


def _files(spark: SparkSession, source: str, schema: StructType, fmt: str, per_batch: int | None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", True)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(source)


def stream_observations(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, instruments: DataFrame,
                        fmt: str = "parquet", per_batch: int | None = None, delay: str | None = None) -> StreamingQuery:
    """Append each observation key once.

    Without ``delay`` every batch is compared with the stored days that it names, however old they are.
    With it, keys are held in streaming state until the watermark has passed them by ``delay``: repeats
    are dropped there and stored days are not read again. What arrives later than that is not written;
    its number is in the query's progress, and ``append_observations`` takes it. Only the first batch of
    a start, which may repeat one that was cut off, is compared with the table.
    """
    rows, started = _files(spark, source, schema, fmt, per_batch), []
    if delay is not None:
        rows = rows.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(list(tables.OBSERVATION_KEY))

    def append(batch: DataFrame, epoch: int) -> None:
        if delay is not None:
            batch = materialise(batch, "stream-batch")  # the state is asked once a batch
        if delay is None or not started:
            tables.append_observations(batch, table, instruments)
        else:
            tables.append_new_observations(batch, table, instruments)
        started.append(epoch)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_bars(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, fmt: str = "parquet",
                per_batch: int | None = None, buckets: int = tables.BAR_BUCKETS) -> StreamingQuery:
    """Merge bars into the bucketed table; a batch that is repeated leaves the same rows."""
    def upsert(batch: DataFrame, _epoch: int) -> None:
        tables.upsert_bars(batch, table, buckets=buckets)

    return (
        _files(spark, source, schema, fmt, per_batch).writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
