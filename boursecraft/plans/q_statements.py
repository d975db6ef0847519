"""Statement queries (2.10, statement parts of 2.1 and 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boursecraft import catalog as C
from boursecraft.operators import statements as X
from boursecraft.plans import adapters as A
from boursecraft.plans.oracle import with_
from boursecraft.plans.q_sources import YEARLY, yearly_series
from boursecraft.plans.registry import query

AS_OF = "2001-09-30"
CATEGORIES = {
    "revenue": "CASE WHEN n = 3 THEN NULL ELSE CAST(cents % 90000 AS DOUBLE) END",
    "net_profit": "CAST(cents % 5000 - 1000 AS DOUBLE)",
    "current_assets": "CAST(cents % 7000 AS DOUBLE)",
    "current_liabilities": "CASE WHEN n = 2 THEN NULL ELSE CAST(cents % 3000 - 50 AS DOUBLE) END",
}


def points(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, category, period, value); every fiftieth revenue is filed twice with two values."""
    cells = F.array(*[F.struct(F.lit(c).alias("category"), F.expr(e).alias("value")) for c, e in CATEGORIES.items()])
    again = F.expr("CASE WHEN cents % 50 = 7 AND n <> 3 THEN CAST(cents % 90000 AS DOUBLE) + 1 END")
    cells = F.concat(cells, F.when(again.isNotNull(), F.array(F.struct(F.lit("revenue").alias("category"), again.alias("value")))).otherwise(F.array().cast("array<struct<category:string,value:double>>")))
    return yearly_series(spark, d).select(F.col("ck").alias("ticker"), F.expr("make_date(y, 3, 31)").alias("period"), F.inline(cells))


PTS = YEARLY + ",\npts AS (" + " UNION ALL ".join(f"SELECT ck, '{c}' AS category, y, {e} AS value FROM yr" for c, e in CATEGORIES.items()) + """
  UNION ALL SELECT ck, 'revenue', y, CAST(cents % 90000 AS DOUBLE) + 1 FROM yr WHERE cents % 50 = 7 AND n <> 3),
per AS (SELECT ck, category, y, max(value) AS value, min(value) <> max(value) AS clash FROM pts GROUP BY 1, 2, 3),
ends AS (SELECT ck, category, max(y) AS newest, max(y) FILTER (WHERE value IS NOT NULL) AS usable, coalesce(bool_or(clash), false) AS conflict, count(value) AS n_periods FROM per GROUP BY 1, 2),
ser AS (SELECT e.ck, e.category, e.conflict, CASE WHEN newest = usable THEN make_date(newest, 3, 31) END AS period, CASE WHEN newest = usable THEN p.value END AS value, CASE WHEN newest = usable THEN b.value END AS year_ago,
  CASE WHEN newest = usable THEN n_periods ELSE 0 END AS n_periods
  FROM ends e LEFT JOIN per p ON p.ck = e.ck AND p.category = e.category AND p.y = e.newest LEFT JOIN per b ON b.ck = e.ck AND b.category = e.category AND b.y = e.newest - 1)"""


def series(spark: SparkSession, d: str) -> DataFrame:
    return X.series(points(spark, d), ["ticker", "category"])


@query("ts_latest_period", with_(PTS) + "SELECT ck AS ticker, category, conflict, period, value, n_periods FROM ser")
def _(spark, d):
    return series(spark, d).select("ticker", "category", "conflict", "period", "value", F.col("n_periods").cast("long").alias("n_periods"))


@query("ts_category_unique", with_(PTS) + "SELECT ck AS ticker, category, y, count(*) AS n FROM pts GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(spark, d):
    rows = points(spark, d).withColumn("y", F.year("period").cast("long"))
    return X.duplicate_categories(rows, ["ticker", "category", "y"])


@query("ts_yoy_growth", with_(PTS) + "SELECT ck AS ticker, category, CASE WHEN NOT conflict AND year_ago > 0 THEN value / year_ago - 1 END AS growth FROM ser WHERE category IN ('revenue', 'net_profit')")
def _(spark, d):
    s = series(spark, d).filter("category IN ('revenue', 'net_profit')")
    return X.yoy_growth(s).select("ticker", "category", "growth")


_WIDE = """wide AS (SELECT ck AS ticker, """ + ", ".join(f"max({w}) FILTER (WHERE category = '{c}') AS {c}_{w}" for c in CATEGORIES for w in ("value", "period")) + " FROM ser GROUP BY 1)"


@query("ts_current_ratio", with_(PTS, _WIDE) + "SELECT ticker, CASE WHEN current_assets_period = current_liabilities_period AND current_assets_value >= 0 AND current_liabilities_value > 0 THEN current_assets_value / current_liabilities_value END AS current_ratio FROM wide")
def _(spark, d):
    wide = X.side_by_side(series(spark, d), ["ticker"], list(CATEGORIES))
    return wide.select("ticker", X.current_ratio(wide).alias("current_ratio"))


@query("ts_net_margin", with_(PTS, _WIDE) + "SELECT ticker, CASE WHEN revenue_period = net_profit_period AND revenue_value > 0 THEN net_profit_value / revenue_value END AS net_margin FROM wide")
def _(spark, d):
    return X.side_by_side(series(spark, d), ["ticker"], list(CATEGORIES)).select("ticker", X.net_margin().alias("net_margin"))


@query("val_stale_period", with_(PTS) + f"""SELECT ck AS ticker, category, period, CASE WHEN period > DATE '{AS_OF}' OR date_diff('day', period, DATE '{AS_OF}') > 550 THEN 'stale_reporting_period' END AS issue FROM ser WHERE period IS NOT NULL""")
def _(spark, d):
    s = series(spark, d).filter("period IS NOT NULL")
    return s.select("ticker", "category", "period", X.period_issue(F.col("period"), F.lit(AS_OF).cast("date"), F.lit(550)).alias("issue"))


@query("val_basis", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 1 THEN 'mixed_accounting_basis' END AS issue FROM customer")
def _(spark, d):
    basis = F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'standalone' END")
    return A.table(spark, d, "customer").select("c_custkey", X.basis_issue(basis).alias("issue"))


# ---- whole documents -----------------------------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    """A balance sheet and a quarterly income statement per customer, built from its yearly figures."""
    per = yearly_series(spark, d)
    # one point per calendar year and customer
    point = lambda e: F.collect_list(F.struct(F.concat(F.lit("Mar "), F.col("y").cast("string")).alias("period"), F.expr(e).cast("string").alias("value")))
    rows = per.groupBy("ck").agg(*[point(e).alias(c) for c, e in CATEGORIES.items()])
    line = lambda name, c: F.struct(F.lit(name).alias("particular"), F.col(c).alias("history"))
    cat = lambda c: F.struct(F.lit(c).alias("category"), F.col(c).alias("history"))

    def doc(period: str, full, summary):
        data = F.struct(
            F.expr("CASE WHEN ck % 5 = 0 THEN 'standalone' ELSE 'consolidated' END").alias("type"), F.lit(period).alias("time_period"),
            F.expr("CASE WHEN ck % 17 = 3 THEN 'million' ELSE 'crore' END").alias("units_in"), full.alias("full_statement"), summary.alias("income_statement"),
        )
        return F.to_json(F.struct(F.expr("CASE WHEN ck % 13 = 0 THEN 'error' ELSE 'success' END").alias("status"), data.alias("data")))

    lines = F.array(line("Current Assets", "current_assets"), line("Current Liabilities", "current_liabilities"), line("Revenue", "revenue"), line("Unlisted", "revenue"))
    pair = F.array(
        F.struct(F.lit("balance-sheet").alias("endpoint"), doc("yearly", lines, F.array(cat("net_profit"))).alias("payload")),
        F.struct(F.lit("income-statement").alias("endpoint"), doc("quarterly", lines, F.array(cat("revenue"), cat("net_profit"))).alias("payload")),
    )
    return rows.select(F.col("ck").alias("ticker"), F.inline(pair))


# documents state every figure once
_DOC = PTS.replace("\n  UNION ALL SELECT ck, 'revenue', y, CAST(cents % 90000 AS DOUBLE) + 1 FROM yr WHERE cents % 50 = 7 AND n <> 3", "")
_ST = with_(_DOC, f"""ok AS (SELECT *, CASE WHEN ck % 5 = 0 THEN 'standalone' ELSE 'consolidated' END AS basis FROM ser WHERE ck % 13 <> 0 AND ck % 17 <> 3 AND period IS NOT NULL)""",
"""w AS (SELECT ck, basis, """ + ", ".join(f"max({w}) FILTER (WHERE category = '{c}') AS {c}_{w}" for c in CATEGORIES for w in ("value", "period", "year_ago")) + " FROM ok GROUP BY 1, 2)",
"""o AS (
  SELECT ck, 'balance-sheet' AS endpoint, basis, category AS field, value * 10000000 AS numeric_value, 'INR' AS unit, period, 550 AS age FROM ok WHERE category IN ('current_assets', 'current_liabilities', 'revenue')
  UNION ALL SELECT ck, 'balance-sheet', basis, 'current_ratio', current_assets_value / current_liabilities_value, 'ratio', current_assets_period, 550 FROM w WHERE current_assets_period = current_liabilities_period AND current_assets_value >= 0 AND current_liabilities_value > 0
  UNION ALL SELECT ck, 'balance-sheet', basis, 'revenue_growth', revenue_value / revenue_year_ago - 1, 'fraction', revenue_period, 550 FROM w WHERE revenue_year_ago > 0
  UNION ALL SELECT ck, 'balance-sheet', basis, 'earnings_growth', net_profit_value / net_profit_year_ago - 1, 'fraction', net_profit_period, 550 FROM w WHERE net_profit_year_ago > 0
  UNION ALL SELECT ck, 'balance-sheet', basis, 'net_profit_margin', net_profit_value / revenue_value, 'fraction', revenue_period, 550 FROM w WHERE revenue_period = net_profit_period AND revenue_value > 0
  UNION ALL SELECT ck, 'income-statement', basis, concat('quarterly_', category), value * 10000000, 'INR', period, 200 FROM ok WHERE category IN ('revenue', 'net_profit')
  UNION ALL SELECT ck, 'income-statement', basis, 'earnings_quarterly_growth', net_profit_value / net_profit_year_ago - 1, 'fraction', net_profit_period, 200 FROM w WHERE net_profit_year_ago > 0)""")


@query("src_statements", _ST + f"""SELECT ck AS ticker, endpoint, basis, field, numeric_value, unit, period AS period_end, CASE WHEN period > DATE '{AS_OF}' OR date_diff('day', period, DATE '{AS_OF}') > age THEN 'stale_reporting_period' END AS period_issue,
  CASE WHEN basis <> 'consolidated' THEN 'mixed_accounting_basis' END AS basis_issue FROM o WHERE numeric_value IS NOT NULL""")
def _(spark, d):
    return X.statement_metrics(documents(spark, d), AS_OF)


@query("src_statement_errors", with_(_DOC) + """SELECT ck AS ticker, endpoint, CASE WHEN ck % 13 = 0 THEN 'unsuccessful_response' ELSE 'unexpected_unit' END AS code FROM (SELECT DISTINCT ck FROM yr), (VALUES ('balance-sheet'), ('income-statement')) AS t(endpoint) WHERE ck % 13 = 0 OR ck % 17 = 3""")
def _(spark, d):
    return X.statement_errors(documents(spark, d))


_HOLD = {"promoters": "30 + c_custkey % 40", "fii": "CASE WHEN c_custkey % 11 = 5 THEN -1 ELSE c_custkey % 7 END", "other_dii": "c_custkey % 5", "mutual_funds": "c_custkey % 9"}
_SUM = " + ".join(f"({e})" for e in _HOLD.values())
_HOLD["retail_and_other"] = f"CASE WHEN c_custkey % 8 = 1 THEN 3 ELSE 100 - ({_SUM}) END"


@query("src_shareholding", "WITH h AS (SELECT c_custkey AS ticker, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _HOLD.items()) + """, CASE WHEN c_custkey % 4 = 2 THEN DATE '2000-12-31' ELSE DATE '2001-06-30' END AS period_end FROM customer WHERE c_custkey % 10 <> 6 AND c_custkey % 15 <> 4),
  v AS (SELECT *, NOT (promoters BETWEEN 0 AND 100 AND fii BETWEEN 0 AND 100 AND other_dii BETWEEN 0 AND 100 AND mutual_funds BETWEEN 0 AND 100 AND retail_and_other BETWEEN 0 AND 100 AND abs(promoters + fii + other_dii + mutual_funds + retail_and_other - 100) <= 0.5) AS bad FROM h)
  SELECT ticker, period_end, NOT bad AND period_end > DATE '2001-03-01' AS is_valid, CASE WHEN bad THEN 'ownership_total_invalid' END AS issue_code, f AS field, x AS numeric_value FROM v, LATERAL (SELECT * FROM (VALUES ('promoter_pct', promoters), ('fii_pct', fii), ('other_dii_pct', other_dii),
  ('mutual_funds_pct', mutual_funds), ('institutional_pct', fii + other_dii + mutual_funds)) AS t(f, x))""")
def _(spark, d):
    newest = F.expr("CASE WHEN c_custkey % 4 = 2 THEN 'Dec 2000' ELSE 'Jun 2001' END")
    entries = []
    for c, e in _HOLD.items():
        # an incomplete document: retail is missing; an inconsistent one: retail is a quarter behind
        when = F.expr("CASE WHEN c_custkey % 15 = 4 THEN 'Mar 2000' END") if c == "retail_and_other" else F.lit(None).cast("string")
        history = F.array(
            F.struct(F.lit("Mar 1999").alias("period"), F.lit("1").alias("value")),
            F.struct(F.coalesce(when, newest).alias("period"), F.expr(e).cast("string").alias("value")),
        )
        entry = F.struct(F.lit(c).alias("category"), history.alias("history"))
        entries.append(F.when(~((F.col("c_custkey") % 10 == 6) & (F.lit(c) == "retail_and_other")), entry))
    data = F.filter(F.array(*entries), lambda x: x.isNotNull())
    docs = A.table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), F.to_json(F.struct(F.lit("success").alias("status"), data.alias("data"))).alias("payload"))
    return X.shareholding(docs, AS_OF)


# ---- older statement series -------------------------------------------------------------------------------

CONCEPTS = {
    "revenue": ("Total Revenue", "Operating Revenue"), "net_income": ("Net Income", "Net Income Common Stockholders"), "ebitda": ("EBITDA", "Normalized EBITDA"),
    "equity": ("Stockholders Equity",), "assets": ("Total Assets",), "debt": ("Total Debt",), "current_assets": ("Current Assets", "Total Current Assets"),
    "current_liabilities": ("Current Liabilities",), "quarterly_net": ("Quarterly Net Income",),
}
_ROWS = {
    "operating revenue": ("CAST(cents % 90000 AS DOUBLE)", "true"), "Total  Revenue": ("CAST(cents % 80000 AS DOUBLE)", "ck % 3 = 0"), "NetIncome": ("CAST(cents % 5000 - 1000 AS DOUBLE)", "true"),
    "Normalized EBITDA": ("CASE WHEN n = 2 THEN NULL ELSE CAST(cents % 6000 AS DOUBLE) END", "true"), "Stockholders Equity": ("CAST(cents % 9000 - 500 AS DOUBLE)", "true"), "Total Assets": ("CAST(cents % 20000 + 1 AS DOUBLE)", "true"),
    "Total Debt": ("CAST(cents % 4000 AS DOUBLE)", "true"), "Total Current Assets": ("CAST(cents % 7000 AS DOUBLE)", "true"), "Current Liabilities": ("CAST(cents % 3000 AS DOUBLE)", "true"), "Quarterly Net Income": ("CAST(cents % 2500 - 100 AS DOUBLE)", "true"),
}


def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("row_name"), F.expr(e).alias("value"))) for n, (e, c) in _ROWS.items()])
    return yearly_series(spark, d).select(F.col("ck").alias("ticker"), F.expr("make_date(y, 12, 31)").alias("day"), F.inline(F.filter(cells, lambda x: x.isNotNull())))


_LISTS = YEARLY + """,
ls AS (SELECT ck AS ticker, CASE WHEN ck % 3 = 0 THEN list(CAST(cents % 80000 AS DOUBLE) ORDER BY y DESC) ELSE list(CAST(cents % 90000 AS DOUBLE) ORDER BY y DESC) END AS revenue, list(CAST(cents % 5000 - 1000 AS DOUBLE) ORDER BY y DESC) AS net_income,
  list(CAST(cents % 6000 AS DOUBLE) ORDER BY y DESC) FILTER (WHERE n <> 2) AS ebitda, list(CAST(cents % 9000 - 500 AS DOUBLE) ORDER BY y DESC) AS equity, list(CAST(cents % 20000 + 1 AS DOUBLE) ORDER BY y DESC) AS assets,
  list(CAST(cents % 4000 AS DOUBLE) ORDER BY y DESC) AS debt, list(CAST(cents % 7000 AS DOUBLE) ORDER BY y DESC) AS ca, list(CAST(cents % 3000 AS DOUBLE) ORDER BY y DESC) AS cl, list(CAST(cents % 2500 - 100 AS DOUBLE) ORDER BY y DESC) AS q FROM yr GROUP BY 1)"""


@query("src_statement_series", with_(_LISTS) + "SELECT ticker, revenue[1] AS latest, revenue[2] AS previous, len(revenue) AS n, ebitda[1] AS ebitda_latest FROM ls")
def _(spark, d):
    s = X.concept_series(statement_rows(spark, d), CONCEPTS)
    return s.select("ticker", X.at("revenue", 0).alias("latest"), X.at("revenue", 1).alias("previous"), F.size("revenue").cast("long").alias("n"), X.at("ebitda", 0).alias("ebitda_latest"))


def _ratio(a: str, b: str, k: str = "1") -> str:
    return f"CASE WHEN {b}[1] > 0 THEN {a}[1] / {b}[1] * {k} END"


@query("ts_statement_ratios", with_(_LISTS) + f"""SELECT ticker, {_ratio("net_income", "equity")} AS "returnOnEquity", {_ratio("net_income", "assets")} AS "returnOnAssets", {_ratio("ebitda", "revenue")} AS "ebitdaMargins", {_ratio("debt", "equity", "100")} AS "debtToEquity",
  {_ratio("ca", "cl")} AS "currentRatio", CASE WHEN net_income[2] > 0 THEN net_income[1] / net_income[2] - 1 END AS "earningsGrowth", CASE WHEN revenue[2] > 0 THEN revenue[1] / revenue[2] - 1 END AS "revenueGrowth",
  CASE WHEN q[5] > 0 THEN q[1] / q[5] - 1 END AS "earningsQuarterlyGrowth" FROM ls""")
def _(spark, d):
    return X.statement_ratios(X.concept_series(statement_rows(spark, d), CONCEPTS))


assert set(C.HOLDING_CATEGORIES) == set(_HOLD)
