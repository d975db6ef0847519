"""Financial-statement series: latest period, growth, ratios, shareholding (2.10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boursecraft import catalog
from boursecraft.functions import dates as T
from boursecraft.functions import values as V

QUARTERLY_AGE, YEARLY_AGE = 200, 550


def series(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, period, value) to one row per key: the usable history and its newest reading.

    Points are first combined per (key, period), on the map side, so repeats of a hot key never
    travel; what is then collected per key is its reporting periods, a few dozen at most.
    A null newest value voids the series; two values for one period are a conflict.
    """
    per_period = points.groupBy(*keys, "period").agg(F.max("value").alias("value"), (F.min("value") != F.max("value")).alias("clash"))
    usable = F.when(F.col("value").isNotNull(), F.col("period"))
    collected = per_period.groupBy(*keys).agg(
        F.max("period").alias("newest"),
        F.max(usable).alias("newest_usable"),
        F.coalesce(F.bool_or("clash"), F.lit(False)).alias("conflict"),
        F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("period", "value")))).alias("history"),
    )
    current = F.col("newest") == F.col("newest_usable")
    history = F.when(current, F.col("history"))
    return collected.select(
        *keys, "conflict",
        F.when(current, F.col("newest")).alias("period"),
        F.element_at(history, F.col("newest")).alias("value"),
        F.element_at(history, T.prior_year_end("newest")).alias("year_ago"),
        F.coalesce(F.size(history), F.lit(0)).alias("n_periods"),
    )


def duplicate_categories(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Categories that occur more than once in one document (an error)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def yoy_growth(s: DataFrame) -> DataFrame:
    """Latest over the same month a year earlier minus one; a non-positive base gives none."""
    return s.withColumn("growth", F.when(~F.col("conflict") & (F.col("year_ago") > 0), F.col("value") / F.col("year_ago") - 1))


def side_by_side(s: DataFrame, keys: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """Named categories of one company in one row (values and periods)."""
    pick = lambda c, what: F.max(F.when(F.col("category") == c, F.col(what)))
    return s.filter(F.col("category").isin(*categories)).groupBy(*keys).agg(
        *[pick(c, w).alias(f"{c}_{w}") for c in categories for w in ("value", "period", "year_ago")]
    )


def current_ratio(wide: DataFrame, assets: str = "current_assets", liabilities: str = "current_liabilities") -> Column:
    a, b = F.col(f"{assets}_value"), F.col(f"{liabilities}_value")
    same = F.col(f"{assets}_period") == F.col(f"{liabilities}_period")
    return F.when(same & (a >= 0) & (b > 0), a / b)


def net_margin(profit: str = "net_profit", revenue: str = "revenue", explicit: str | None = None) -> Column:
    """Same-period profit over revenue; an explicit revenue line replaces the summary's."""
    rv, rp = F.col(f"{revenue}_value"), F.col(f"{revenue}_period")
    if explicit:
        rv, rp = F.coalesce(F.col(f"{explicit}_value"), rv), F.coalesce(F.col(f"{explicit}_period"), rp)
    return F.when((rp == F.col(f"{profit}_period")) & (rv > 0), F.col(f"{profit}_value") / rv)


def period_issue(period: Column, as_of: Column, max_age: Column) -> Column:
    """Future or outdated reporting period."""
    stale = (period > as_of) | (F.datediff(as_of, period) > max_age)
    return F.when(stale, "stale_reporting_period")


def basis_issue(basis: Column) -> Column:
    return F.when(basis.isNotNull() & (basis != "consolidated"), "mixed_accounting_basis")


# ---- whole statement documents ---------------------------------------------------------------------

_HISTORY = "array<struct<period:string,value:string>>"
STATEMENT = (
    f"struct<status:string,data:struct<type:string,time_period:string,units_in:string,"
    f"full_statement:array<struct<particular:string,history:{_HISTORY}>>,income_statement:array<struct<category:string,history:{_HISTORY}>>>>"
)
HOLDINGS = f"struct<status:string,data:array<struct<category:string,history:{_HISTORY}>>>"


def statement_points(docs: DataFrame) -> DataFrame:
    """(ticker, endpoint, payload) to (ticker, endpoint, basis, quarterly, section, category, period, value).

    Documents that are unsuccessful, not in crore or without a basis are dropped here; see
    ``statement_errors``. The annual section of a quarterly document is ignored.
    """
    parsed = V.settled(docs.withColumn("_p", F.from_json("payload", STATEMENT))).filter(statement_error().isNull())
    quarterly = F.col("_p.data.time_period") == "quarterly"
    entry = "struct<section:string,category:string,history:" + _HISTORY + ">"
    full = F.transform("_p.data.full_statement", lambda r: F.struct(F.lit("line").alias("section"), r["particular"].alias("category"), r["history"].alias("history")))
    summary = F.transform("_p.data.income_statement", lambda r: F.struct(F.lit("summary").alias("section"), r["category"].alias("category"), r["history"].alias("history")))
    empty = F.array().cast(f"array<{entry}>")
    entries = F.concat(F.when(quarterly, empty).otherwise(F.coalesce(full, empty)), F.coalesce(summary, empty))
    rows = parsed.select("ticker", "endpoint", F.col("_p.data.type").alias("basis"), quarterly.alias("quarterly"), F.inline(entries))
    points = rows.select("ticker", "endpoint", "basis", "quarterly", "section", "category", F.inline("history"))
    return points.withColumns({"period": T.period_end("period"), "value": V.finite(V.number("value"))})


def statement_error() -> Column:
    d = F.col("_p.data")
    return (
        F.when(~F.coalesce(F.col("_p.status") == "success", F.lit(False)), "unsuccessful_response")
        .when(~F.coalesce(d["units_in"] == "crore", F.lit(False)), "unexpected_unit")
        .when(~F.coalesce(d["type"].isin("consolidated", "standalone"), F.lit(False)), "missing_basis")
    )


def statement_errors(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_p", F.from_json("payload", STATEMENT)).select("ticker", "endpoint", statement_error().alias("code")).filter("code IS NOT NULL")


def statement_metrics(docs: DataFrame, as_of) -> DataFrame:
    """Statement documents to observations: line items, quarterly levels, ratios, growth, margin."""
    keys = ["ticker", "endpoint", "basis", "quarterly"]
    s = series(statement_points(docs), [*keys, "section", "category"]).filter("NOT conflict AND period IS NOT NULL")
    line_names = V.literal_map(catalog.STATEMENT_LINES)
    pick = lambda section, name, what: F.max(F.when((F.col("section") == section) & (F.col("category") == name), F.col(what)))
    wanted = {
        "revenue": ("summary", "revenue"), "operating_profit": ("summary", "operating_profit"), "net_profit": ("summary", "net_profit"),
        "explicit": ("line", "Revenue"), "assets": ("line", "Current Assets"), "liabilities": ("line", "Current Liabilities"),
    }
    line = F.when(F.col("section") == "line", F.element_at(line_names, F.col("category")))
    wide = s.groupBy(*keys).agg(
        *[pick(sec, name, what).alias(f"{alias}_{what}") for alias, (sec, name) in wanted.items() for what in ("value", "period", "year_ago")],
        # one entry per catalogued statement line: bounded by the catalog
        F.collect_list(F.when(line.isNotNull(), F.struct(line.alias("field"), (F.col("value") * catalog.CRORE).alias("numeric_value"), F.lit("INR").alias("unit"), F.col("period").alias("period_end")))).alias("_lines"),
    )
    q = F.col("quarterly")
    balance = F.col("endpoint").endswith("balance-sheet")
    rev_value = F.when(~q, F.col("explicit_value"))
    rev = {w: F.when(rev_value.isNotNull(), F.col(f"explicit_{w}")).otherwise(F.col(f"revenue_{w}")) for w in ("value", "period", "year_ago")}

    def entry(field: Column, value: Column, unit: str, period: Column) -> Column:
        return F.struct(field.alias("field"), value.alias("numeric_value"), F.lit(unit).alias("unit"), period.alias("period_end"))

    levels = [
        entry(F.lit(f"quarterly_{c}"), F.when(q, F.col(f"{c}_value") * catalog.CRORE), "INR", F.col(f"{c}_period"))
        for c in ("revenue", "operating_profit", "net_profit")
    ]
    ratio = current_ratio(wide, "assets", "liabilities")
    profit_growth = F.when(F.col("net_profit_year_ago") > 0, F.col("net_profit_value") / F.col("net_profit_year_ago") - 1)
    derived = [
        entry(F.lit("current_ratio"), F.when(balance & ~q, ratio), "ratio", F.col("assets_period")),
        entry(F.lit("revenue_growth"), F.when(~q & (rev["year_ago"] > 0), rev["value"] / rev["year_ago"] - 1), "fraction", rev["period"]),
        entry(F.when(q, "earnings_quarterly_growth").otherwise("earnings_growth"), profit_growth, "fraction", F.col("net_profit_period")),
        entry(F.lit("net_profit_margin"), F.when(~q & (rev["period"] == F.col("net_profit_period")) & (rev["value"] > 0), F.col("net_profit_value") / rev["value"]), "fraction", rev["period"]),
    ]
    rows = wide.select("ticker", "endpoint", "basis", "quarterly", F.inline(F.concat(F.col("_lines"), F.array(*levels, *derived))))
    age = F.when(q, QUARTERLY_AGE).otherwise(YEARLY_AGE)
    return rows.filter("numeric_value IS NOT NULL").select(
        "ticker", "endpoint", "basis", "field", "numeric_value", "unit", "period_end",
        period_issue(F.col("period_end"), F.lit(as_of).cast("date"), age).alias("period_issue"), basis_issue(F.col("basis")).alias("basis_issue"),
    )


def shareholding(docs: DataFrame, as_of) -> DataFrame:
    """Five holding categories of one latest quarter to promoter and institutional shares.

    Incomplete or inconsistent documents yield nothing; shares outside 0..100 or a total away from
    100 are kept and marked invalid. A document becomes ten rows or more that are sorted to be aggregated,
    so documents are dealt over tasks first: few large files don't leave all of them to few tasks.
    """
    docs = docs.repartition("ticker", "payload")
    parsed = V.settled(docs.withColumn("_p", F.from_json("payload", HOLDINGS))).filter("_p.status = 'success'")
    rows = parsed.select("ticker", F.inline("_p.data")).select("ticker", "category", F.inline("history"))
    points = rows.withColumns({"period": T.period_end("period"), "value": V.finite(V.number("value"))})
    s = series(points, ["ticker", "category"])
    of = lambda c: F.max(F.when(F.col("category") == c, F.col("value")))
    required = F.col("category").isin(*catalog.HOLDING_CATEGORIES)
    wide = s.filter(required & ~F.col("conflict")).groupBy("ticker").agg(
        *[of(c).alias(c) for c in catalog.HOLDING_CATEGORIES], F.count("period").alias("n"), F.min("period").alias("p0"), F.max("period").alias("period_end")
    ).filter((F.col("n") == len(catalog.HOLDING_CATEGORIES)) & (F.col("p0") == F.col("period_end")))
    total = F.col("promoters") + F.col("fii") + F.col("other_dii") + F.col("mutual_funds") + F.col("retail_and_other")
    inside = F.lit(True)
    for c in catalog.HOLDING_CATEGORIES:
        inside = inside & F.col(c).between(0, 100)
    bad_total = ~(inside & (F.abs(total - 100) <= 0.5))
    stale = period_issue(F.col("period_end"), F.lit(as_of).cast("date"), F.lit(QUARTERLY_AGE))
    entry = lambda name, v: F.struct(F.lit(name).alias("field"), v.alias("numeric_value"))
    cells = F.array(
        entry("promoter_pct", F.col("promoters")), entry("fii_pct", F.col("fii")), entry("other_dii_pct", F.col("other_dii")),
        entry("mutual_funds_pct", F.col("mutual_funds")), entry("institutional_pct", F.col("fii") + F.col("other_dii") + F.col("mutual_funds")),
    )
    return wide.select("ticker", "period_end", (~bad_total & stale.isNull()).alias("is_valid"), F.when(bad_total, "ownership_total_invalid").alias("issue_code"), F.inline(cells))


# ---- older statement series ------------------------------------------------------------------------

def concept_series(rows: DataFrame, concepts: dict[str, Sequence[str]], keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """One array column per concept: the first candidate row name present, newest first, nulls dropped.

    ``rows``: keys, row_name, day, value. All concepts are resolved in one pass over the rows; a
    candidate name may serve one concept only.
    """
    lookup = {}
    for concept, names in concepts.items():
        for order, name in enumerate(names):
            plain = "".join(ch for ch in name.upper() if ch.isalnum())
            lookup.setdefault(plain, F.struct(F.lit(concept).alias("concept"), F.lit(order).alias("order")))
    entries = F.create_map(*[part for name, target in lookup.items() for part in (F.lit(name), target)])
    matched = rows.withColumn("_m", F.element_at(entries, V.normal_symbol("row_name"))).filter("_m IS NOT NULL")
    per_day = matched.groupBy(*keys, "_m", "day").agg(F.max("value").alias("value"))
    # reporting days of one statement row: a few dozen at most
    points = F.reverse(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("day", "value")))))
    per_name = per_day.groupBy(*keys, "_m").agg(F.transform(points, lambda p: p["value"]).alias("_s"))
    of = lambda c: F.min_by("_s", F.when(F.col("_m.concept") == c, F.col("_m.order")))
    return per_name.groupBy(*keys).agg(*[of(c).alias(c) for c in concepts])


def at(name: str, position: int) -> Column:
    return F.get(F.col(name), F.lit(position))


def statement_ratios(s: DataFrame) -> DataFrame:
    """ROE, ROA, margins, leverage and growth from newest-first series columns."""
    quarterly = F.when(F.size("quarterly_net") >= 5, V.safe_growth(at("quarterly_net", 0), at("quarterly_net", 4)))
    return s.select(
        "ticker",
        V.safe_ratio(at("net_income", 0), at("equity", 0)).alias("returnOnEquity"),
        V.safe_ratio(at("net_income", 0), at("assets", 0)).alias("returnOnAssets"),
        V.safe_ratio(at("ebitda", 0), at("revenue", 0)).alias("ebitdaMargins"),
        V.safe_ratio(at("debt", 0), at("equity", 0), 100.0).alias("debtToEquity"),
        V.safe_ratio(at("current_assets", 0), at("current_liabilities", 0)).alias("currentRatio"),
        V.safe_growth(at("net_income", 0), at("net_income", 1)).alias("earningsGrowth"),
        V.safe_growth(at("revenue", 0), at("revenue", 1)).alias("revenueGrowth"),
        quarterly.alias("earningsQuarterlyGrowth"),
    )
