"""Substring search by postings of three-letter grams.

Every gram of a text column names the rows that have it. A needle of three letters or more reads the
postings of its rarest grams only, intersects them and verifies what is left against the text; a
shorter needle has no gram and is looked for in all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boursecraft.session import tables_dir

GRAM = 3
#: Partitions of the stored postings; grams of a needle whose postings are read.
BUCKETS = 64
READ = 3


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Postings:
    """Stored postings (gram, field, id) and the number of each gram's."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    id_column: str

    def grams(self, needle: str) -> list[str]:
        text = needle.strip().lower()
        return sorted({text[k : k + GRAM] for k in range(len(text) - GRAM + 1)})

    def _of(self, table: str, grams: Sequence[str]) -> DataFrame:
        buckets = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket("gram").alias("b")).distinct().collect()
        return self.spark.read.parquet(f"{self.path}/{table}").filter(F.col("bucket").isin([r["b"] for r in buckets]) & F.col("gram").isin(list(grams)))

    def candidates(self, needle: str) -> DataFrame | None:
        """Identifiers of the rows that may have the needle in a column; None if all may."""
        grams = self.grams(needle)
        if not grams:
            return None
        counts = {r["gram"]: r["n"] for r in self._of("counts", grams).collect()}  # one row for each gram of the needle
        if len(counts) < len(grams):
            return self._of("postings", []).select(self.id_column)
        rare = sorted(grams, key=lambda g: (counts[g], g))[:READ]
        found = self._of("postings", rare).groupBy(self.id_column, "field").agg(F.count("*").alias("n"))
        return found.filter(F.col("n") == len(rare)).select(self.id_column).distinct()

    def search(self, rows: DataFrame, needle: str) -> DataFrame:
        """The rows that have the needle, ignoring case, in one of the columns; all for an empty one."""
        from boursecraft.operators.explore import matches_text

        may = self.candidates(needle)
        rows = rows if may is None else rows.join(may, self.id_column, "left_semi")
        return rows.filter(matches_text(needle, *self.columns))


def build_postings(rows: DataFrame, columns: Sequence[str] = ("ticker", "shortName"), id_column: str = "instrument_id") -> Postings:
    """Store the postings of the columns' grams. A row has a gram once for each column."""
    path = f"{tables_dir(rows.sparkSession)}/postings-{uuid.uuid4().hex}"
    texts = rows.select(id_column, F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.lower(F.col(c)).alias("text")) for k, c in enumerate(columns)])))
    at = F.sequence(F.lit(1), F.length("text") - GRAM + 1)
    each = texts.filter(F.length("text") >= GRAM).select(id_column, "field", F.explode(F.array_distinct(F.transform(at, lambda k: F.substring("text", k, F.lit(GRAM))))).alias("gram")).distinct()
    each.withColumn("bucket", _bucket("gram")).repartition("bucket", "gram").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = rows.sparkSession.read.schema(f"gram string, field int, {id_column} {rows.schema[id_column].dataType.simpleString()}, bucket int").parquet(f"{path}/postings")
    stored.groupBy("bucket", "gram").agg(F.count("*").alias("n")).repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    return Postings(rows.sparkSession, path, tuple(columns), id_column)
