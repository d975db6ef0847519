"""The star-schema test tables as observations, instruments, bars, fundamentals and runs.

Each adapter is one deterministic projection over a whole table. Row-level formulas are plain
SQL text that both Spark and the oracle engine accept, so the two sides start from equal inputs
and every operator above them is written twice, independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boursecraft.operators import reconcile as R
from boursecraft.operators import series as S
from boursecraft.session import materialise

AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- observations: events --------------------------------------------------------------------
OBS_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
OBS_PROVIDER = (
    "CASE WHEN event_type = 'click' AND event_id % 6 = 5 THEN 'upstox_statements' "
    "WHEN event_type = 'signup' AND event_id % 6 = 5 THEN 'upstox_shareholding' "
    "WHEN k < 30 THEN 'nse' WHEN k < 60 THEN 'bse' WHEN k < 94 THEN 'yahoo_roe' "
    "WHEN k < 97 THEN 'screener' ELSE 'upstox_fundamentals' END"
)
OBS_FIELD = (
    "CASE WHEN event_type = 'click' AND event_id % 6 = 5 THEN "
    "CASE event_id % 4 WHEN 0 THEN 'net_profit_margin' WHEN 1 THEN 'earnings_quarterly_growth' "
    "WHEN 2 THEN 'revenue_growth' ELSE 'quarterly_revenue' END "
    "WHEN event_type = 'signup' THEN 'promoter_pct' "
    "WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'book_value_sign' "
    "WHEN event_type = 'error' THEN 'institutional_pct' "
    "WHEN event_type = 'click' THEN 'roe_pct' "
    "WHEN event_type = 'view' AND event_id % 9 = 8 THEN 'trailing_pe_basis' "
    "WHEN event_type = 'view' THEN 'trailing_pe' "
    "WHEN event_id % 6 = 0 THEN 'current_price' WHEN event_id % 6 = 1 THEN 'trailing_eps' "
    "WHEN event_id % 6 = 2 THEN 'market_cap' WHEN event_id % 6 = 3 THEN 'profit_margin_pct' "
    "WHEN event_id % 6 = 4 THEN 'price_to_book' ELSE 'current_ratio' END"
)
OBS_NUMERIC = (
    "CASE WHEN field IN ('book_value_sign', 'trailing_pe_basis') THEN NULL "
    "WHEN field = 'trailing_eps' THEN value - 20 WHEN field = 'market_cap' THEN value * 1000000000 "
    "WHEN unit0 = 'fraction' AND field IN ('promoter_pct', 'institutional_pct', 'roe_pct') THEN value / 50 "
    "ELSE value END"
)
OBS_TEXT = (
    "CASE WHEN field = 'book_value_sign' THEN CASE WHEN value < 20 THEN 'negative' ELSE 'positive' END "
    "WHEN field = 'trailing_pe_basis' THEN CASE WHEN value < 25 THEN 'standalone' ELSE 'consolidated' END END"
)
OBS_UNIT = "CASE event_id % 8 WHEN 0 THEN 'fraction' WHEN 1 THEN 'ratio' ELSE 'percent' END"


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("k", F.expr(OBS_K))
    ev = ev.withColumns({"provider": F.expr(OBS_PROVIDER), "field": F.expr(OBS_FIELD), "unit0": F.expr(OBS_UNIT)})
    filed = F.col("provider").isin("upstox_statements", "upstox_shareholding")
    # emitted through a generator so that filters above do not inline the mapping formulas
    row = F.struct(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("instrument_id"),
        F.col("field"),
        F.expr(OBS_NUMERIC).alias("numeric_value"),
        F.expr(OBS_TEXT).alias("text_value"),
        F.col("unit0").alias("unit"),
        F.col("provider"),
        F.col("ts").alias("observed_at"),
        F.when(filed, F.date_sub(F.to_date("ts"), F.col("k") * 8)).alias("period_end"),
    )
    return ev.select(F.inline(F.array(row)))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.normalise_percent(raw_observations(spark, sf_dir))


# ---- instruments: customer and nation ---------------------------------------------------------
INST_COLUMNS = {
    "instrument_id": "c_custkey",
    "ticker": "upper(replace(c_name, '#', ''))",
    "exchange": "CASE WHEN n_nationkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END",
    "isin": "concat('INE', lpad(CAST(c_custkey AS STRING), 4, '0'), '01', lpad(CAST(c_nationkey AS STRING), 3, '0'))",
    "company_name": "CASE WHEN c_custkey % 11 = 3 THEN '' ELSE c_name END",
    "sector": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'Financial Services' ELSE c_mktsegment END",
    "kind": "CASE WHEN c_custkey % 50 = 49 THEN 'INDEX' ELSE 'EQUITY' END",
    "active": "c_acctbal > 0",
}


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    joined = cust.join(nation, cust.c_nationkey == nation.n_nationkey)
    return joined.select(
        *[F.expr(e).alias(c) for c, e in INST_COLUMNS.items()],
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )


def ticker_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Former symbols: every customer of one nation once traded under OLD<key>."""
    cust = table(spark, sf_dir, "customer")
    return cust.filter("c_nationkey = 7").select(
        F.col("c_custkey").alias("instrument_id"),
        F.expr("concat('OLD', CAST(c_custkey AS STRING))").alias("ticker"),
        F.lit("NSE").alias("exchange"),
    )


# ---- price bars: lineitem ----------------------------------------------------------------------
BAR_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("ticker"),
        F.to_date(F.date_trunc("week", "l_shipdate")).alias("session"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
        *BAR_ORDER,
        "l_quantity",
    )


def closes(spark: SparkSession, sf_dir: str, limit: int | None = S.HISTORY_LIMIT) -> DataFrame:
    return S.daily_closes(bars(spark, sf_dir), limit, BAR_ORDER, F.col("session"))


def closes_and_market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Closes and the benchmark, the same last-trade pick over all tickers of a session, from one scan."""
    picks = materialise(S.day_picks(bars(spark, sf_dir), BAR_ORDER, F.col("session")), "day-picks")
    return S.newest_days(picks.select("ticker", "day", "close"), S.HISTORY_LIMIT), S.newest_days(S.one_series(picks, "^MARKET"), S.HISTORY_LIMIT)


# ---- fundamentals: part and its line items ------------------------------------------------------
# metric -> (formula over integer aggregates, modulus of the keys that lack it)
FUNDAMENTALS = {
    "returnOnEquity": ("CAST((q * 7 + k * 13) % 900 - 150 AS DOUBLE) / 1000", 17),
    "returnOnAssets": ("CAST((disc * 11 + k) % 300 - 50 AS DOUBLE) / 1000", 19),
    "ebitdaMargins": ("CAST((tax * 5 + k * 3) % 500 - 100 AS DOUBLE) / 1000", 13),
    "profitMargins": ("CAST((q * 3 + disc + k) % 400 - 120 AS DOUBLE) / 1000", 23),
    "debtToEquity": ("CAST((rev + k * 7) % 25000 AS DOUBLE) / 100", 11),
    "currentRatio": ("CAST((n * 37 + q) % 350 AS DOUBLE) / 100", 29),
    "heldPercentInsiders": ("CAST((k * 31 + q) % 1100 AS DOUBLE) / 1000", 41),
    "heldPercentInstitutions": ("CAST((k * 17 + tax) % 700 AS DOUBLE) / 1000", 43),
    "promoter_pct": ("CAST((k * 29 + q) % 1030 AS DOUBLE) / 10", 31),
    "institutional_pct": ("CAST((k * 7 + disc) % 700 AS DOUBLE) / 10", 37),
    "institutions_count": ("CAST((n * 13 + k) % 400 AS DOUBLE)", 7),
    "avg_delivery_pct": ("CAST((q * 11 + k) % 900 AS DOUBLE) / 10", 47),
    "delivery_trend": ("CAST((disc * 3 + k * 5) % 300 - 150 AS DOUBLE) / 10", 9),
    "trailingPE": ("CAST((rev + k) % 9000 - 500 AS DOUBLE) / 100", 12),
    "priceToBook": ("CAST((rev + k * 3) % 1500 - 100 AS DOUBLE) / 100", 53),
    "pegRatio": ("CAST((q + k * 19) % 400 - 50 AS DOUBLE) / 100", 5),
    "enterpriseToEbitda": ("CAST((tax * 7 + k * 23) % 3500 - 200 AS DOUBLE) / 100", 8),
    "dividendYield": ("CAST((disc + k) % 60 AS DOUBLE) / 10", 6),
    "earningsGrowth": ("CAST((q * 17 + k) % 900 - 300 AS DOUBLE) / 1000", 15),
    "revenueGrowth": ("CAST((tax * 3 + q + k) % 500 - 150 AS DOUBLE) / 1000", 21),
    "earningsQuarterlyGrowth": ("CAST((disc * 13 + k * 2) % 1200 - 500 AS DOUBLE) / 1000", 16),
    "trailingEps": ("CAST((q * 5 + k * 11) % 8000 - 1500 AS DOUBLE) / 100", 25),
    "forwardEps": ("CAST((q * 5 + k * 11) % 8000 - 1200 AS DOUBLE) / 100", 10),
    "targetMeanPrice": ("price * (100 + q % 60) / 100", 18),
    "recommendationMean": ("CAST(100 + (k * 3 + n) % 400 AS DOUBLE) / 100", 14),
    "numberOfAnalystOpinions": ("CAST((k + n) % 40 AS DOUBLE)", 14),
    "fiftyTwoWeekHigh": ("price * (100 + q % 90) / 100", 59),
    "fiftyTwoWeekLow": ("price * (100 - tax % 45) / 100", 61),
    "fiftyDayAverage": ("price * (90 + disc % 25) / 100", 33),
    "twoHundredDayAverage": ("price * (80 + tax % 45) / 100", 35),
    "fiftyTwoWeekChangePercent": ("CAST((q * 3 + k * 7) % 1400 - 500 AS DOUBLE) / 10", 39),
    "beta": ("CAST((q + disc) % 260 AS DOUBLE) / 100", 20),
    "marketCap": ("CAST(rev AS DOUBLE) * 1000", 67),
    "currentPrice": ("price", 97),
}
# every fortieth part is thinly covered: these stay blank for it
THIN_EXEMPT = ("currentPrice", "fiftyTwoWeekHigh", "fiftyTwoWeekLow", "marketCap", "beta", "promoter_pct")


def fundamental_expr(name: str) -> str:
    formula, modulus = FUNDAMENTALS[name]
    missing = f"k % {modulus} = 0"
    if name not in THIN_EXEMPT:
        missing += " OR k % 40 = 1"
    return f"CASE WHEN {missing} THEN NULL ELSE {formula} END"


FUND_SECTOR = "CASE WHEN p_type = 'ECONOMY' THEN 'Financial Services' ELSE p_type END"


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.rint(F.col(c) * 100).cast("long")
    facts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("l_quantity").cast("long")).alias("q"),
        F.sum(cents("l_extendedprice")).alias("rev"),
        F.sum(cents("l_discount")).alias("disc"),
        F.sum(cents("l_tax")).alias("tax"),
    )
    part = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    return part.join(facts, "k")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide stock record: identity plus the declared fields."""
    base = part_facts(spark, sf_dir).withColumn("price", F.col("p_retailprice"))
    # emitted through a generator so that expressions above do not inline the mapping formulas
    row = F.struct(
        F.col("k").alias("instrument_id"),
        F.expr("concat('T', CAST(k AS STRING))").alias("ticker"),
        F.col("p_name").alias("shortName"),
        F.expr(FUND_SECTOR).alias("sector"),
        *[F.expr(fundamental_expr(m)).alias(m) for m in FUNDAMENTALS],
    )
    return base.select(F.inline(F.array(row)))


# ---- ranking runs: customers by yearly revenue ----------------------------------------------------
def yearly_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, ticker, rank, final_score, price, ...): customers with orders, ranked by revenue per year."""
    from boursecraft.operators.ranks import ordinal_rank

    year = F.year("o_orderdate")
    orders = table(spark, sf_dir, "orders")
    cents = F.rint(F.col("o_totalprice") * 100).cast("long")
    yearly = orders.groupBy(year.alias("year"), F.col("o_custkey").alias("instrument_id")).agg(
        F.sum(cents).alias("cents"), F.count("*").alias("n")
    )
    rated = ordinal_rank(yearly.filter("n >= 2"), ["cents"], "instrument_id", keys=["year"]).select("year", "instrument_id", "rank")
    return yearly.join(rated, ["year", "instrument_id"], "left").select(
        "year",
        "instrument_id",
        F.expr("concat('C', CAST(instrument_id AS STRING))").alias("ticker"),
        "rank",
        F.expr("CASE WHEN n >= 2 THEN CAST(cents % 1000 AS DOUBLE) / 10 END").alias("final_score"),
        F.expr("CASE WHEN n >= 2 THEN 'ranked' ELSE 'insufficient overall coverage' END").alias("score_status"),
        F.expr("CAST(cents % 90000 + 10000 AS DOUBLE) / 100").alias("currentPrice"),
        F.expr("CAST(cents % 600 AS DOUBLE) / 10").alias("pct_below_52w_high"),
        F.expr("CAST(cents % 300 - 150 AS DOUBLE) / 10").alias("delivery_trend"),
    )


def run_id(year: Column) -> Column:
    return F.concat(F.lit("run-"), year.cast("string")).alias("run_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, created_at, n_orders): one run for each calendar year of orders."""
    per_year = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.max("o_orderdate").alias("created_at"), F.count("*").alias("n_orders")
    )
    return per_year.select(run_id(F.col("year")), "created_at", "n_orders")


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked stocks of every run, with their run_id."""
    return yearly_runs(spark, sf_dir).select(run_id(F.col("year")), "*").drop("year")


def ranked_stocks(rows: DataFrame) -> DataFrame:
    """Run rows as the scoring job stores them."""
    return rows.select(
        "run_id", "instrument_id", "rank", F.col("final_score").alias("score"), "score_status",
        F.create_map(F.lit("g_quality"), F.col("currentPrice") / 10, F.lit("g_growth"), F.col("pct_below_52w_high")).alias("factors"),
        F.when(F.col("rank") <= 10, "up").alias("movement"),
        F.col("pct_below_52w_high").alias("data_coverage"),
    )


# ---- archive: customer and part records as string maps -----------------------------------------
def archive_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, rows): two paths; the first has two versions, the newer one wins. One scan per table."""
    versions = (
        ("data/ranking.csv", "v1", "2024-01-05 00:00:00", "c_acctbal > 2000"),
        ("data/ranking.csv", "v2", "2024-01-20 00:00:00", "c_nationkey <> 4"),
        ("data/raw.csv", "v1", "2024-01-10 00:00:00", "true"),
    )
    entries = F.array(
        *[
            F.when(F.expr(condition), F.struct(F.lit(path).alias("source_path"), F.lit(version).alias("content_sha256"), F.lit(modified).cast("timestamp").alias("modified")))
            for path, version, modified, condition in versions
        ]
    )
    ticker = F.expr("CASE WHEN c_nationkey = 7 THEN concat(' old', CAST(c_custkey AS STRING)) ELSE replace(c_name, '#', '') END")
    cust = table(spark, sf_dir, "customer")
    tagged = cust.select("*", F.inline(F.filter(entries, lambda e: e.isNotNull())))
    # column values are data; the record is keyed by header name as the archive stores it
    record = F.create_map(
        F.lit("ticker"), ticker,
        F.lit("currentPrice"), F.expr("CAST(c_nationkey AS STRING)"),
        F.lit("sector"), F.col("c_mktsegment"),
        F.lit("roe_pct"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey % 50 AS STRING) END"),
        F.lit("final_score"), F.lit("50"),
        F.lit("note"), F.col("content_sha256"),
    )
    rows = tagged.select("source_path", "content_sha256", F.col("c_custkey").alias("row_number"), record.alias("record"))
    files = tagged.groupBy("source_path", "content_sha256").agg(
        F.count("*").alias("row_count"), F.max("modified").alias("source_modified_at"), F.max("modified").alias("imported_at")
    )
    return files, rows
