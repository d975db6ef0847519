"""Data-quality accounting: why a cell is blank, coverage over obtainable cells, failure tallies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boursecraft import catalog
from boursecraft.functions import values as V
from boursecraft.operators.paging import PageIndex, build_index
from boursecraft.session import materialise

# deciding figure -> its name in either vocabulary
_INPUTS = {
    "trailing_eps": ("trailing_eps", "trailingEps"),
    "earnings_growth": ("earnings_growth", "earningsGrowth"),
    "profit_margin_pct": ("profit_margin_pct", "profitMargins"),
}


def _static_name(field: str) -> str:
    """Canonical name of a column known when the plan is built."""
    key = field.strip()
    return catalog.FIELD_ALIASES.get(key.replace("_", "").lower(), key)


def is_derived_field(field: str) -> bool:
    name = field.strip()
    return name in catalog.DERIVED_FIELDS or name.startswith(catalog.DERIVED_PREFIXES)


def classify(field: Column) -> Column:
    """Static class of a field name column, ignoring any company."""
    name = V.canonical_field(field)
    return (
        F.when(name.isin(*catalog.ANALYST_FIELDS), "analyst")
        .when(name.isin(*catalog.DESCRIPTIVE_FIELDS), "descriptive")
        .otherwise("recoverable")
    )


def _figure(df: DataFrame, canonical: str) -> Column:
    found = [V.finite(F.col(c).cast("double")) for c in _INPUTS[canonical] if c in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def _undefined(df: DataFrame, name: str) -> Column | None:
    """Does the company's own arithmetic void the ratio? Null column: cannot tell. None: never."""
    if name in ("trailing_pe", "forward_pe"):
        eps = _figure(df, "trailing_eps")
        return eps <= 0
    if name == "peg_ratio":
        eps, growth = _figure(df, "trailing_eps"), _figure(df, "earnings_growth")
        bad = F.coalesce(eps <= 0, F.lit(False)) | F.coalesce(growth <= 0, F.lit(False))
        return F.when(bad, True).when(eps.isNotNull() & growth.isNotNull(), False)
    if name in ("earnings_growth", "earnings_quarterly_growth"):
        margin = _figure(df, "profit_margin_pct")
        return margin <= 0
    return None


def gap_reason(df: DataFrame, field: str) -> Column:
    """Reason a cell of ``field`` would be blank: ordered rules, mostly settled by the name alone."""
    if is_derived_field(field):
        return F.lit("derived")
    name = _static_name(field)
    if name in catalog.DESCRIPTIVE_FIELDS:
        return F.lit("descriptive")
    if name in catalog.ANALYST_FIELDS:
        rest: Column = F.lit("analyst")
    else:
        undefined = _undefined(df, name)
        if undefined is None:
            rest = F.lit("recoverable")
        else:
            rest = F.when(undefined.isNull(), "unknown").when(undefined, "undefined").otherwise("recoverable")
    if name in catalog.LENDER_GAP_FIELDS and "sector" in df.columns:
        return F.when(V.is_lender(F.trim("sector")), "not_applicable").otherwise(rest)
    return rest


def blank(df: DataFrame, field: str) -> Column:
    if field not in df.columns:
        return F.lit(True)
    kind = dict(df.dtypes)[field]
    if kind == "string":
        return V.is_blank_text(field)
    return V.is_blank_number(field) if kind in ("double", "float") else F.col(field).isNull()


def gaps(df: DataFrame, fields: Sequence[str], id_columns: Sequence[str] = ("ticker",)) -> DataFrame:
    """One row per blank cell with its reason."""
    cells = F.array(*[F.when(blank(df, f), F.struct(F.lit(f).alias("field"), gap_reason(df, f).alias("reason"))) for f in fields])
    return df.select(*id_columns, F.inline(F.filter(cells, lambda c: c.isNotNull())))


def coverage_summary(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Blank cells by cause and coverage over obtainable cells, one row.

    Counted per row as integers and summed: nothing is exploded or shuffled but one partial sum
    per task. Map columns are bookkeeping, not fields.
    """
    names = fields or [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    listed = [f for f in names if f != "ticker" and not is_derived_field(f)]
    total = lambda flags: reduce(lambda a, b: a + b, [f.cast("long") for f in flags], F.lit(0).cast("long"))
    counters = {
        reason: F.coalesce(F.sum(total([blank(df, f) & (gap_reason(df, f) == reason) for f in listed])), F.lit(0))
        for reason in catalog.GAP_REASONS
    }
    sums = df.agg(F.count("*").alias("stocks"), *[c.alias(r) for r, c in counters.items()])
    blanks = reduce(lambda a, b: a + b, [F.col(r) for r in catalog.GAP_REASONS])
    cells = F.col("stocks") * len(listed)
    unobtainable = reduce(lambda a, b: a + b, [F.col(r) for r in ("analyst", "not_applicable", "undefined", "descriptive", "unknown")])
    obtainable = cells - unobtainable
    return sums.select(
        "stocks",
        cells.alias("cells"),
        (cells - blanks).alias("filled"),
        *[F.col(r).alias(f"gaps_{r}") for r in catalog.GAP_REASONS],
        F.coalesce(V.rounded((1 - F.try_divide(blanks, cells)) * 100, 2), F.lit(0.0)).alias("raw_coverage_pct"),
        obtainable.alias("obtainable_cells"),
        F.when(obtainable > 0, V.rounded((1 - F.try_divide(F.col("recoverable"), obtainable)) * 100, 3)).otherwise(0.0).alias("obtainable_coverage_pct"),
        F.col("unknown").alias("unclassified_gaps"),
    )


def flattened_issues(obs: DataFrame) -> DataFrame:
    """One row per attached issue."""
    return obs.select("id", "instrument_id", "provider", F.inline("issues"))


def issue_index(obs: DataFrame) -> PageIndex:
    """All issues in order of their observations, for any page."""
    return build_index(flattened_issues(obs), [F.col(c).asc() for c in ("id", "code", "field")])


def issue_page(obs: DataFrame, size: int, after: int = 0) -> DataFrame:
    """A page of issues by observation, and on every row the number of all issues."""
    index = issue_index(obs)
    return index.after(after, size).drop("place").withColumn("total", F.lit(index.total).cast("long"))


# ---- failure tally ------------------------------------------------------------------------------------

def failure_tally(events: DataFrame, examples: int = 5) -> DataFrame:
    """Failures folded by (kind, detail): count, first message, first few distinct subjects.

    ``events``: kind, message, subject, seq. Events are read and their details folded once, into
    one stored row per (kind, detail, subject); counts and examples come from those. A group limit
    keeps ``examples`` rows per kind, so no group is ever gathered whole.
    """
    keyed = events.withColumn("detail", V.normalise_detail("message"))
    subjects = materialise(keyed.groupBy("kind", "detail", "subject").agg(F.count("*").alias("n"), F.min_by("message", "seq").alias("message"), F.min("seq").alias("seq")), "failures")
    counts = subjects.groupBy("kind", "detail").agg(
        F.sum("n").alias("n"), F.min_by("message", "seq").alias("first_message"), F.min("seq").alias("first_seq")
    )
    subjects = subjects.filter("subject IS NOT NULL").select("kind", "detail", "subject", "seq")
    w = Window.partitionBy("kind", "detail").orderBy("seq")
    kept = subjects.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= examples)
    shown = kept.groupBy("kind", "detail").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "subject"))), lambda s: s["subject"]), ", ").alias("examples")
    )
    return counts.join(shown, ["kind", "detail"], "left")


def tally_summary(tally: DataFrame, limit: int = 3) -> DataFrame:
    """One line naming the loudest kinds; empty text when nothing failed."""
    loudest = tally.orderBy(F.desc("n"), "first_seq").limit(limit)
    part = F.concat(
        F.col("n").cast("string"), F.lit("x "), F.col("kind"),
        F.when(F.col("detail") != "", F.concat(F.lit(" ("), F.col("detail"), F.lit(")"))).otherwise(""),
    )
    lines = loudest.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "first_seq", part.alias("p")))), lambda s: s["p"]), "; ").alias("line")
    )
    more = tally.agg(F.count("*").alias("kinds"))
    others = F.greatest(more.select("kinds").scalar() - limit, F.lit(0))
    return lines.select(
        F.when(others > 0, F.concat(F.col("line"), F.lit("; and "), others.cast("string"), F.lit(" other kind(s)"))).otherwise(F.col("line")).alias("summary")
    )
