"""Newest-row and best-row picks.

Every pick is an aggregation (``max_by`` over a struct), not a window: partial aggregation on
the map side reduces each key to one row per task before the shuffle, so a key that holds a
third of the table costs one row per task instead of one giant window partition. Struct buffers
are aggregated by sorting, so a task sorts its own rows; only what is picked is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple. All other columns follow it."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ("observed_at", "id"),
           valid: str | None = None) -> DataFrame:
    """Newest row per key.

    ``valid='before'`` drops invalid rows first, ``'after'`` picks first and then drops the pick
    if it is invalid (an invalid newest row hides an older valid one), ``None`` ignores validity.
    """
    if valid == "before":
        return pick(df.filter("is_valid"), keys, order)
    picked = pick(df, keys, order)
    return picked.filter("is_valid") if valid == "after" else picked


def best_priority(df: DataFrame, keys: Sequence[str], priority: Column,
                  tie: Sequence[Column | str] = ("observed_at", "id")) -> DataFrame:
    """One row per key by smallest priority, then greatest tie tuple."""
    return pick(df, keys, [-priority, *tie])


def lookup_priority(provider: str, priorities: dict[str, int], default: int) -> Column:
    from boursecraft.functions.values import literal_map

    return F.coalesce(F.element_at(literal_map(priorities), F.col(provider)), F.lit(default))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def recent_runs(runs: DataFrame, count: int) -> DataFrame:
    """The ``count`` newest runs, with ``age`` 1 for the newest; ``count`` rows at most."""
    newest = runs.select("run_id", "created_at").orderBy(F.desc("created_at"), F.desc("run_id")).limit(count)
    return newest.withColumn("age", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("run_id"))))


def newest_run(runs: DataFrame) -> DataFrame:
    """The newest run: one row of run_id and created_at, or none."""
    newest = runs.agg(F.max_by(F.struct("run_id", "created_at"), F.struct("created_at", "run_id")).alias("r"))
    return newest.select("r.run_id", "r.created_at").filter(F.col("run_id").isNotNull())


def newest_files(files: DataFrame) -> DataFrame:
    """Newest archived file per source path."""
    return pick(files, ["source_path"], ["source_modified_at", "imported_at", "content_sha256"])
