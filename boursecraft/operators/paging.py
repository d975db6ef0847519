"""Pages of a sorted result from a stored range index.

Rows are sorted into ranges once and stored by range, each with its place in its range; the index is the
count of every range. A page reads the one or two ranges that hold it, however far back it is, and the
total is the sum of the counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boursecraft.session import tables_dir


@dataclass(frozen=True)
class PageIndex:
    """``starts``: range to the number of rows before it; ``total`` rows in all. One entry a range."""

    spark: SparkSession
    path: str
    schema: StructType
    starts: dict[int, int]
    total: int

    def ranges(self, after: int, size: int) -> list[int]:
        """The ranges that hold rows of the places ``after`` + 1 to ``after`` + ``size``."""
        ends = [*list(self.starts.values())[1:], self.total]
        return [r for (r, start), end in zip(self.starts.items(), ends) if start < after + size and end > after]

    def after(self, place: int, size: int, alias: str = "place") -> DataFrame:
        """The ``size`` rows behind a place (0: from the start), in order, with their own ``alias``."""
        held = self.ranges(place, size)
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        start = F.lit(0).cast("long")
        for r in held:
            start = F.when(F.col("_range") == r, F.lit(self.starts[r]).cast("long")).otherwise(start)
        found = rows.filter(F.col("_range").isin(held)).withColumn(alias, start + F.col("_row") + 1)
        return found.filter(F.col(alias).between(place + 1, place + size)).drop("_range", "_row").orderBy(alias)

    def page(self, number: int, size: int, alias: str = "place") -> DataFrame:
        """Page ``number`` (from 1) of ``size`` rows."""
        return self.after((number - 1) * size, size, alias)


def build_index(rows: DataFrame, order: Sequence[Column], ranges: int | None = None) -> PageIndex:
    """Sort and store ``rows`` once; ``order`` must decide between any two rows.

    Without ``ranges`` there are as many as the shuffle needs for its size.
    """
    spark, path = rows.sparkSession, f"{tables_dir(rows.sparkSession)}/pages-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id()  # the range in the upper 31 bits, the row within it in the lower 33
    placed = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order).withColumn("_place", place)
    split = placed.withColumns({"_range": F.shiftright("_place", 33).cast("int"), "_row": F.col("_place").bitwiseAND((1 << 33) - 1)}).drop("_place")
    split.write.partitionBy("_range").parquet(path)
    schema = StructType(sorted(split.schema.fields, key=lambda f: f.name == "_range"))  # the partition column comes last
    counts = spark.read.schema(schema).parquet(path).groupBy("_range").count().orderBy("_range").collect()
    starts, total = {}, 0
    for r in counts:
        starts[r["_range"]] = total
        total += r["count"]
    return PageIndex(spark, path, schema, starts, total)
