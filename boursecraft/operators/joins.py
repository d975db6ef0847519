"""Joins of large tables with small ones on keys that may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def attach(rows: DataFrame, small: DataFrame, keys: Sequence[str], spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi join that deals the rows of one key over ``salts`` tasks by a hash of ``spread``.

    ``small`` is repeated once for each salt. Where its measured size allows, the optimizer still
    broadcasts it and nothing is shuffled; the salt only matters where it doesn't.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
