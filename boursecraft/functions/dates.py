"""Period and timestamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boursecraft.functions.values import as_col, to_double


def period_end(label) -> Column:
    """``Mon YYYY`` -> last day of that month; null when it does not parse."""
    return F.last_day(F.try_to_date(as_col(label), "MMM yyyy"))


def prior_year_end(day) -> Column:
    return F.last_day(F.add_months(as_col(day), -12))


def epoch_instant(value) -> Column:
    """Epoch seconds or milliseconds (> 1e10) to a timestamp."""
    v = as_col(value)
    seconds = F.when(v > F.lit(1e10), v / 1000).otherwise(v)
    return F.timestamp_micros((seconds * 1000000).cast("long"))


def quote_instant(*candidates) -> Column:
    """First usable epoch among several text fields."""
    return epoch_instant(F.coalesce(*[to_double(as_col(c).cast("string")) for c in candidates]))
