"""Text-typed records to typed columns, and JSON values by type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boursecraft import catalog
from boursecraft.functions import values as V

ISSUES = "array<struct<code:string,field:string>>"


def parse_record(df: DataFrame, numeric: Sequence[str], text: Sequence[str], record: str = "record",
                 booleans: Sequence[str] = catalog.BOOLEAN_FIELDS) -> DataFrame:
    """Declared fields of a text map, typed; blanks are null; quality status from its two columns."""
    raw = lambda f: F.nullif(F.element_at(record, F.lit(f)), F.lit(""))
    issues = F.coalesce(F.from_json(raw("data_quality__issues"), ISSUES), F.array().cast(ISSUES))
    status = F.coalesce(raw("data_quality__status"), F.when(F.size(issues) > 0, "review").otherwise("valid"))
    keep = [c for c in df.columns if c != record]
    return df.select(
        *keep,
        *[V.to_double(raw(f)).alias(f) for f in numeric],
        *[F.when(raw(f).isNotNull(), F.lower(raw(f)) == "true").alias(f) for f in booleans],
        *[raw(f).alias(f) for f in text],
        status.alias("quality_status"),
        F.size(issues).alias("n_issues"),
    )


def json_number(json: Column, path: str) -> Column:
    """The value at ``path`` if it is a JSON number."""
    v = F.parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double"))


def json_text(json: Column, path: str) -> Column:
    """The value at ``path`` if it is a JSON string."""
    v = F.parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))
