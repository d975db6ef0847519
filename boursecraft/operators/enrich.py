"""Filling gaps: priority sources, layers, cached fallbacks, before/after coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boursecraft import catalog
from boursecraft.functions import values as V


def _prefixed(df: DataFrame, key: str, prefix: str, fields: Sequence[str]) -> DataFrame:
    """One row per key, upper-cased: of repeated keys each field's greatest value that is not null."""
    known = [f for f in fields if f in df.columns]
    return df.groupBy(F.upper(key).alias("_key")).agg(*[F.max(f).alias(f"{prefix}{f}") for f in known]) if known else df.select(F.upper(key).alias("_key")).distinct()


def gap_fill(primary: DataFrame, supporting: Sequence[DataFrame], fields: Sequence[str], key: str = "ticker") -> DataFrame:
    """Primary values win; supporting sources fill nulls in the order given."""
    merged = primary
    for i, source in enumerate(supporting):
        merged = merged.join(_prefixed(source, key, f"_{i}_", fields), F.upper(key) == F.col("_key"), "left").drop("_key")
    filled = []
    for f in fields:
        candidates = [f] if f in primary.columns else []
        candidates += [f"_{i}_{f}" for i, s in enumerate(supporting) if f in s.columns]
        filled.append(F.coalesce(*[F.col(c) for c in candidates]).alias(f))
    return merged.select(key, *filled)


def fill_blanks(existing: DataFrame, providers: Sequence[tuple[str, DataFrame]], fields: Sequence[str], key: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """(filled, changes): the first provider, in order, with an acceptable value fills a blank cell.

    A filled cell is never overwritten; every change names its provider.
    """
    merged = existing
    for name, source in providers:
        merged = merged.join(_prefixed(source, key, f"_{name}_", fields), F.upper(key) == F.col("_key"), "left").drop("_key")
    filled, changes = [F.col(key)], []
    for f in fields:
        text = f in catalog.TEXT_FIELDS
        own = V.blank_to_null(f) if text else V.finite(f)
        offers = []
        for name, source in providers:
            if f in source.columns:
                v = F.col(f"_{name}_{f}")
                offers.append(F.when(V.valid_value(f, v), F.struct((F.trim(v) if text else v).alias("value"), F.lit(name).alias("provider"))))
        if not offers:
            filled.append(F.col(f))
            continue
        chosen = F.coalesce(*offers)
        filled.append(F.coalesce(own, chosen["value"]).alias(f))
        changes.append(
            F.when(
                own.isNull() & chosen.isNotNull(),
                F.struct(F.lit(f).alias("field"), chosen["value"].cast("string").alias("new_value"), chosen["provider"].alias("provider")),
            )
        )
    log = merged.select(key, F.inline(F.filter(F.array(*changes), lambda c: c.isNotNull())))
    return merged.select(*filled), log


def combine_layers(base: DataFrame, raw: DataFrame, cached: DataFrame, fields: Sequence[str], key: str = "ticker") -> DataFrame:
    """Base rows with raw values first, cached values where raw is missing, ownership total enforced."""
    layered = gap_fill(base.select(key), [raw, cached], fields, key)
    over = F.coalesce(F.col("promoter_pct") + F.col("institutional_pct") > catalog.OWNERSHIP_LIMIT, F.lit(False))
    return layered.withColumn("institutional_pct", F.when(~over, F.col("institutional_pct")))


def with_fallback(base: DataFrame, fresh: DataFrame, cached: DataFrame, fields: Sequence[str], key: str = "ticker") -> DataFrame:
    """Fresh value per field, else the last known one."""
    return gap_fill(base.select(key), [fresh, cached], fields, key)


def coverage_gain(before: DataFrame, after: DataFrame, key: str = "ticker") -> DataFrame:
    """Coverage before and after per stock, with the gain."""
    b = before.select(key, F.col("data_cov").alias("before"))
    return b.join(after.select(key, F.col("data_cov").alias("after")), key).withColumn("gain", F.col("after") - F.col("before"))
