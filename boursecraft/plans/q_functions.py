"""Scalar-function queries (2.9) and record validation, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boursecraft import catalog as C
from boursecraft.functions import dates as T
from boursecraft.functions import finance as N
from boursecraft.functions import values as V
from boursecraft.operators import quality as D
from boursecraft.operators import records as K
from boursecraft.plans import adapters as A
from boursecraft.plans import oracle as O
from boursecraft.plans.oracle import r, with_
from boursecraft.plans.registry import query

PART_TICKER = "concat('T', CAST(p_partkey AS STRING))"


@query("fn_number", """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN CAST(1000 + p_size AS DOUBLE) + 0.5::DOUBLE WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 7 THEN p_retailprice WHEN 8 THEN -1.5::DOUBLE END AS value FROM part""")
def _(spark, d):
    text = F.expr("""CASE p_partkey % 9 WHEN 0 THEN concat(' 1,0', lpad(CAST(p_size AS STRING), 2, '0'), '.5 ') WHEN 1 THEN concat(CAST(p_size AS STRING), '%') WHEN 2 THEN ' - ' WHEN 3 THEN 'N/A'
      WHEN 4 THEN 'NaN' WHEN 5 THEN 'abc' WHEN 6 THEN '' WHEN 7 THEN CAST(p_retailprice AS STRING) ELSE '-1.5' END""")
    return A.table(spark, d, "part").select("p_partkey", V.number(text).alias("value"))


_NUM_TEXT = "CASE p_partkey % 8 WHEN 0 THEN '.5' WHEN 1 THEN '+1' WHEN 2 THEN concat(CAST(p_size AS STRING), '.') WHEN 3 THEN concat(CAST(p_size AS STRING), 'e2') WHEN 4 THEN '-3.4E-2' WHEN 5 THEN 'x1' WHEN 6 THEN '1,5' ELSE CAST(p_size AS STRING) END"


@query("fn_numeric_regex", f"SELECT p_partkey, CASE WHEN regexp_matches(t, '{C.NUMERIC_PATTERN}') THEN TRY_CAST(t AS DOUBLE) END AS value FROM (SELECT p_partkey, {_NUM_TEXT} AS t FROM part)")
def _(spark, d):
    return A.table(spark, d, "part").select("p_partkey", V.numeric_text(F.expr(_NUM_TEXT)).alias("value"))


@query("fn_normal_symbol", "SELECT p_partkey, regexp_replace(upper(concat(p_name, '-', p_brand)), '[^A-Z0-9]', '', 'g') AS symbol FROM part")
def _(spark, d):
    return A.table(spark, d, "part").select("p_partkey", V.normal_symbol(F.expr("concat(p_name, '-', p_brand)")).alias("symbol"))


_SYM = "CASE p_partkey % 3 WHEN 0 THEN concat('^', p_brand) WHEN 1 THEN concat(p_brand, '.BO') ELSE p_brand END"


@query("fn_yahoo_symbol", f"SELECT p_partkey, CASE WHEN contains(s, '.') OR s LIKE '^%' THEN s ELSE concat(s, '.NS') END AS symbol FROM (SELECT p_partkey, {_SYM} AS s FROM part)")
def _(spark, d):
    return A.table(spark, d, "part").select("p_partkey", V.market_symbol(F.expr(_SYM)).alias("symbol"))


@query("fn_ticker_norm", "SELECT c_custkey, upper(c_name) AS ticker FROM customer")
def _(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", V.ticker_norm(F.expr("concat('  ', lower(c_name), ' ')")).alias("ticker"))


@query("fn_blank_to_null", "SELECT c_custkey, CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment END AS value FROM customer")
def _(spark, d):
    text = F.expr("CASE c_nationkey % 6 WHEN 0 THEN '' WHEN 3 THEN '   ' ELSE concat(' ', c_mktsegment) END")
    return A.table(spark, d, "customer").select("c_custkey", V.blank_to_null(text).alias("value"))


_NAMES = ["trailingPE", "trailing_pe", "currentPrice", "returnOnEquity", "roe_pct", " shortName ", "free_cash_flow", "enterpriseToEbitda", "upside_pct", "beta", "TARGETMEANPRICE"]


@query("fn_canonical_field", "SELECT event_id, t.canonical FROM events JOIN (VALUES " + ", ".join(f"({i}, '{D._static_name(n)}')" for i, n in enumerate(_NAMES)) + f") AS t(i, canonical) ON t.i = event_id % {len(_NAMES)}")
def _(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    return A.table(spark, d, "events").select("event_id", V.canonical_field(name).alias("canonical"))


_JSON = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('{\"k\": \"', event_type, '\"}') WHEN 2 THEN '{\"k\": true}' WHEN 3 THEN '{\"k\": null}' ELSE '{\"z\": 1.5}' END"


@query("fn_json_typed_value", f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST({A.OBS_K} AS DOUBLE) END AS numeric_value, CASE WHEN event_id % 5 = 1 THEN event_type END AS text_value FROM events""")
def _(spark, d):
    j = F.expr(_JSON)
    return A.table(spark, d, "events").select("event_id", K.json_number(j, "$.k").alias("numeric_value"), K.json_text(j, "$.k").alias("text_value"))


@query("fn_json_has_key", "SELECT c_custkey, c_custkey % 4 <> 1 AS has_ticker, CASE WHEN c_custkey % 4 <> 1 THEN c_name END AS ticker FROM customer")
def _(spark, d):
    record = F.expr("CASE WHEN c_custkey % 4 = 1 THEN map('name', c_name) ELSE map('ticker', c_name, 'name', c_name) END")
    rows = A.table(spark, d, "customer").withColumn("record", record)
    return rows.select("c_custkey", F.map_contains_key("record", F.lit("ticker")).alias("has_ticker"), F.element_at("record", F.lit("ticker")).alias("ticker"))


@query("fn_basis_suffix", with_(O.RAW_OBS) + "SELECT id, field, CASE WHEN right(field, 6) = '_basis' THEN left(field, length(field) - 6) END AS metric FROM raw_obs")
def _(spark, d):
    return A.raw_observations(spark, d).select("id", "field", V.basis_metric("field").alias("metric"))


@query("fn_greatest_least_ratio", "SELECT p_partkey, greatest(CAST(p_size AS DOUBLE), p_retailprice) / nullif(least(CAST(p_size AS DOUBLE), p_retailprice), 0) AS ratio FROM part")
def _(spark, d):
    return A.table(spark, d, "part").select("p_partkey", V.spread_ratio(F.col("p_size").cast("double"), "p_retailprice").alias("ratio"))


@query("fn_period_end", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN last_day(CAST(o_orderdate AS DATE)) END AS period_end FROM orders")
def _(spark, d):
    label = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "MMM yyyy"))
    return A.table(spark, d, "orders").select("o_orderkey", T.period_end(label).alias("period_end"))


@query("fn_prior_year_end", "SELECT o_orderkey, last_day(CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE)) AS prior FROM orders")
def _(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", T.prior_year_end(F.to_date("o_orderdate")).alias("prior"))


@query("fn_trailing_peg", with_(O.FUND) + f"""SELECT ticker, CASE WHEN "trailingPE" > 0 AND "earningsGrowth" > 0 THEN {r('least("trailingPE" / ("earningsGrowth" * 100), 100.0)', 6)} END AS peg FROM fund""")
def _(spark, d):
    return A.fundamentals(spark, d).select("ticker", N.trailing_peg("trailingPE", "earningsGrowth").alias("peg"))


@query("fn_safe_ratio", with_(O.FUND) + """SELECT ticker, CASE WHEN "earningsGrowth" > 0 THEN "debtToEquity" / "earningsGrowth" * 100 END AS ratio FROM fund""")
def _(spark, d):
    return A.fundamentals(spark, d).select("ticker", V.safe_ratio("debtToEquity", "earningsGrowth", 100.0).alias("ratio"))


@query("fn_safe_growth", with_(O.FUND) + """SELECT ticker, CASE WHEN "trailingEps" > 0 THEN "forwardEps" / "trailingEps" - 1 END AS growth FROM fund""")
def _(spark, d):
    return A.fundamentals(spark, d).select("ticker", V.safe_growth("forwardEps", "trailingEps").alias("growth"))


@query("fn_parse_record", """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS "currentPrice", CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS rank, c_custkey % 2 = 0 AS pat_accum, CAST(NULL AS BOOLEAN) AS pat_trap, CAST(NULL AS BOOLEAN) AS pat_near_low,
  c_mktsegment AS sector, CASE WHEN c_custkey % 4 = 0 THEN 'review' WHEN c_custkey % 4 = 1 THEN 'checked' ELSE 'valid' END AS quality_status, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS n_issues FROM customer""")
def _(spark, d):
    record = F.expr("""map('currentPrice', CASE WHEN c_custkey % 5 = 0 THEN '' ELSE CAST(c_acctbal AS STRING) END, 'rank', CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END,
      'pat_accum', CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END, 'sector', c_mktsegment, 'data_quality__issues', CASE c_custkey % 4 WHEN 0 THEN '[{"code":"x","field":"y"}]' WHEN 2 THEN 'not json' ELSE '' END,
      'data_quality__status', CASE WHEN c_custkey % 4 = 1 THEN 'checked' ELSE '' END)""")
    rows = A.table(spark, d, "customer").select("c_custkey", record.alias("record"))
    return K.parse_record(rows, ["currentPrice", "rank"], ["sector"])


@query("fn_hash", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("fn_redact", "SELECT c_custkey, concat('ApiKey=[redacted],auth_TOKEN=[redacted],symbol=', c_name) AS params FROM customer")
def _(spark, d):
    params = F.expr("map('ApiKey', c_mktsegment, 'symbol', c_name, 'auth_TOKEN', 'abc')")
    safe = F.array_sort(F.transform(F.map_entries(V.redact(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return A.table(spark, d, "customer").select("c_custkey", F.array_join(safe, ",").alias("params"))


_B = 'greatest(0.3::DOUBLE, least(2.5::DOUBLE, coalesce(beta, 1.0::DOUBLE)))'


@query("fn_buy_zone", with_(O.FUND) + f"""SELECT ticker, {_B} AS beta_used, "currentPrice" * (1 - {_B} * 0.15::DOUBLE) AS deep_price, "currentPrice" * (1 - 0.5::DOUBLE * {_B} * 0.15::DOUBLE) AS shallow_price,
  CASE WHEN "currentPrice" IS NOT NULL THEN {_B} * 0.15::DOUBLE * 100 END AS discount_pct FROM fund""")
def _(spark, d):
    return A.fundamentals(spark, d).select("ticker", *[c.alias(n) for n, c in N.buy_zone("currentPrice", "beta", 0.15).items()])


_HI = """coalesce(nullif("fiftyTwoWeekHigh", 0), CASE WHEN "currentPrice" <> 0 AND off <> 0 THEN "currentPrice" / (1 - off / 100) END)"""


@query("fn_range_position", with_(O.FUND, "s AS (SELECT *, CAST(instrument_id % 40 AS DOUBLE) AS off FROM fund)") + f"""SELECT ticker, CASE WHEN "currentPrice" <> 0 AND "fiftyTwoWeekLow" <> 0 AND {_HI} > "fiftyTwoWeekLow"
  THEN {r(f'("currentPrice" - "fiftyTwoWeekLow") / ({_HI} - "fiftyTwoWeekLow") * 100', 1)} END AS position FROM s""")
def _(spark, d):
    off = (F.col("instrument_id") % 40).cast("double")
    return A.fundamentals(spark, d).select("ticker", N.range_position("currentPrice", "fiftyTwoWeekLow", "fiftyTwoWeekHigh", off).alias("position"))


@query("fn_mcap_rescale", with_(O.FUND) + """SELECT ticker, CASE WHEN "marketCap" IS NOT NULL AND "currentPrice" > 0 AND "fiftyDayAverage" IS NOT NULL THEN "marketCap" * "fiftyDayAverage" / "currentPrice" ELSE "marketCap" END AS mcap FROM fund""")
def _(spark, d):
    return A.fundamentals(spark, d).select("ticker", N.rescaled_market_cap("marketCap", "currentPrice", "fiftyDayAverage").alias("mcap"))


@query("fn_clean_number", with_(O.FUND) + f"""SELECT ticker, {r('"trailingPE" / 3', 2)} AS cleaned FROM fund""")
def _(spark, d):
    return A.fundamentals(spark, d).select("ticker", V.clean_number(F.col("trailingPE") / 3, 2).alias("cleaned"))


@query("fn_unit_scale", "SELECT p_partkey, CAST(p_size AS DOUBLE) * 10000000 AS rupees FROM part")
def _(spark, d):
    return A.table(spark, d, "part").select("p_partkey", V.crore(F.col("p_size").cast("double")).alias("rupees"))


@query("fn_split_value", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value END AS numeric_value, CASE event_id % 4 WHEN 1 THEN 'true' WHEN 2 THEN event_type END AS text_value FROM events""")
def _(spark, d):
    from boursecraft.sinks.tables import split_value

    value = F.expr("CASE event_id % 4 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN 'True' WHEN 2 THEN event_type END")
    kind = F.expr("CASE event_id % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' WHEN 2 THEN 'string' ELSE 'none' END")
    return A.table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in split_value(value, kind).items()])


@query("val_is_blank", """SELECT p_partkey, p_partkey % 4 <> 3 AS text_blank, p_partkey % 3 <> 2 AS number_blank FROM part""")
def _(spark, d):
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE p_name END")
    num = F.when(F.col("p_partkey") % 3 == 0, F.lit(float("nan"))).when(F.col("p_partkey") % 3 == 2, F.col("p_retailprice"))
    return A.table(spark, d, "part").select("p_partkey", V.is_blank_text(text).alias("text_blank"), V.is_blank_number(num).alias("number_blank"))


_RANGED = ("trailingPE", "priceToBook", "returnOnEquity", "heldPercentInsiders", "profitMargins", "beta")


@query("val_range", with_(O.FUND) + "SELECT ticker, " + ", ".join(f"""coalesce("{f}" BETWEEN {C.VALUE_BOUNDS.get(f, C.DEFAULT_BOUNDS)[0]} AND {C.VALUE_BOUNDS.get(f, C.DEFAULT_BOUNDS)[1]}, false) AS "{f}" """ for f in _RANGED) + ', trim("shortName") <> \'\' AS "shortName" FROM fund')
def _(spark, d):
    return A.fundamentals(spark, d).select("ticker", *[V.valid_value(f, f).alias(f) for f in _RANGED], V.valid_value("shortName", "shortName").alias("shortName"))
