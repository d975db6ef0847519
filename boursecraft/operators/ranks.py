"""Exact ranks over a whole universe without a whole-universe window.

A window without a partition key, or partitioned by one of two dozen metrics, would sort every
row in a handful of tasks. Both ranks here are instead computed from counts:

* ``percentile_ranks``: rows collapse to a (metric, value) histogram first (map-side combined);
  the histogram is cut into value ranges by boundaries taken from a quantile sketch; counts are
  accumulated inside each range and offset by the ranges below. The boundaries only balance the
  work - ranks are exact for any boundaries.
* ``ordinal_rank``: rows are numbered inside ranges of (score, id) and offset by the rows of the
  ranges before them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boursecraft.session import materialise

RANGES = 64
_BLOCK = 8
_SKETCH_ACCURACY = 500


def _with_range(rows: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """Number the range of each value. Boundaries are a quantile sketch of each key's rows, one row
    of at most ``ranges`` doubles per key; whether that is broadcast is left to its measured size."""
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    sketch = F.percentile_approx("value", probs, F.lit(_SKETCH_ACCURACY))
    bounds = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(sketch)).alias("_bounds"))
    bounds = bounds.withColumn("_ends", F.filter("_bounds", lambda _, i: i % _BLOCK == _BLOCK - 1))
    return rows.join(bounds, list(keys), "left").withColumn("_range", _position()).drop("_bounds", "_ends")


def _position() -> Column:
    """How many sorted boundaries lie below the value: first by block ends, then inside one block."""
    none = F.array().cast("array<double>")
    below = lambda array: F.size(F.filter(array, lambda b: b < F.col("value")))
    blocks = below(F.coalesce("_ends", none))
    return blocks * _BLOCK + below(F.slice(F.coalesce("_bounds", none), blocks * _BLOCK + 1, _BLOCK))


def value_ranks(long: DataFrame, keys: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """(keys, value) -> rows strictly below, ties, total. Null values are ignored."""
    keys = list(keys)
    present = long.filter(F.col("value").isNotNull())
    hist = present.groupBy(*keys, "value").agg(F.count("*").alias("ties"))
    ranged = _with_range(hist, keys, ranges)
    per_range = ranged.groupBy(*keys, "_range").agg(F.sum("ties").alias("_n"))
    # at most `ranges` rows per key
    w_keys = Window.partitionBy(*keys)
    offsets = per_range.select(
        *keys,
        "_range",
        (F.sum("_n").over(w_keys.orderBy("_range")) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(w_keys).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("value")
    return (
        ranged.withColumn("_before", F.sum("ties").over(inside) - F.col("ties"))
        .join(offsets, [*keys, "_range"])
        .select(*keys, "value", (F.col("_offset") + F.col("_before")).alias("below"), "ties", "total")
    )


def percentile_ranks(long: DataFrame, keys: Sequence[str], direction: Column, ranges: int = RANGES) -> DataFrame:
    """(keys, value) -> average-tie percentile in (0, 1], flipped where direction is negative."""
    counts = value_ranks(long, keys, ranges)
    ascending = F.col("below") + (F.col("ties") + 1) / F.lit(2.0)
    descending = F.col("total") - F.col("below") - F.col("ties") + (F.col("ties") + 1) / F.lit(2.0)
    return counts.select(
        *keys, "value", (F.when(direction > 0, ascending).otherwise(descending) / F.col("total")).alias("pct")
    )


def numbered(df: DataFrame, order: Sequence[Column], alias: str, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with the place, from 1, of every row among those of its ``keys`` in a total ``order``.

    Rows are dealt to ranges of (keys, order) and stored sorted. The boundaries are quantiles of a
    sample of that whole composite, so rows that agree in its first columns are parted by the others;
    whatever the boundaries are, places are exact. What is accumulated is a count for each range and
    key in it: no more than shuffle partitions and keys together.
    """
    keys = list(keys)
    by = [*[F.col(k).asc() for k in keys], *order]
    place = F.monotonically_increasing_id()  # the range in the upper 31 bits, the row within it in the lower 33
    stored = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", place), "numbered")
    stored = stored.withColumns({"_range": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND((1 << 33) - 1)})
    counts = stored.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n") - F.col("_first")
    offsets = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range").alias("_at"), before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_range") == F.col("_at"))
    found = stored.join(offsets, same).withColumn(alias, F.col("_before") + F.col("_row") + 1)
    return found.select(*df.columns, alias)


def ordinal_rank(df: DataFrame, scores: Sequence[str], tie: str, alias: str = "rank", keys: Sequence[str] = ()) -> DataFrame:
    """1..n by ``scores`` descending, then ``tie`` ascending (an id), per key.

    Scores and id are cut into ranges together: equal scores, even on every row, are spread by id.
    """
    return numbered(df, [*[F.col(s).desc() for s in scores], F.col(tie).asc()], alias, keys)
