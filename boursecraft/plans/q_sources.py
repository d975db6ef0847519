"""Source queries (2.1): payload text is built from the tables by Spark, then parsed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from boursecraft import catalog as C
from boursecraft.functions import dates as T
from boursecraft.functions import values as V
from boursecraft.operators import ownership as W
from boursecraft.plans import adapters as A
from boursecraft.plans import oracle as O
from boursecraft.plans.oracle import r, with_
from boursecraft.plans.registry import query
from boursecraft.plans.shared import new_folder
from boursecraft.session import materialise, ship_functions
from boursecraft.sources import csv_archive as Z
from boursecraft.sources import files as E
from boursecraft.sources import payloads as P

ship_functions(__name__)

TODAY = "2001-06-30"


def rows_of(*parts: str) -> str:
    return " UNION ALL ".join(parts)


# ---- envelopes -----------------------------------------------------------------------------------


@F.pandas_udf(BinaryType())
def _gzip(texts: pd.Series) -> pd.Series:
    import gzip

    return texts.map(lambda t: gzip.compress(t.encode("utf-8"), mtime=0))


@query("src_raw_envelopes", "SELECT CAST(doc_id AS VARCHAR) AS request_id, text AS body, length(text) AS chars FROM documents")
def _(spark, d):
    docs = A.table(spark, d, "documents")
    encoded = (
        F.when(F.col("doc_id") % 3 == 0, F.base64(_gzip(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.lit("")))))
        .when(F.col("doc_id") % 3 == 1, F.base64(F.encode("text", "UTF-8")))
    )
    raw = docs.select(
        F.col("doc_id").cast("string").alias("request_id"),
        F.struct(encoded.alias("body_base64"), F.when(F.col("doc_id") % 3 == 2, F.col("text")).alias("text")).alias("payload"),
    )
    return E.with_bodies(raw).select("request_id", "body", F.length("body").cast("long").alias("chars"))


# ---- exchange lists --------------------------------------------------------------------------------

_ISIN = "CASE WHEN c_custkey % 9 = 4 THEN 'IN0020240001' ELSE concat('INE', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '01', lpad(CAST(c_nationkey AS STRING), 3, '0')) END"


@query("src_listing_csv", f"""SELECT concat('S', CAST(c_custkey AS VARCHAR)) AS ticker, 'NSE' AS exchange, {_ISIN} AS isin,
  CASE WHEN c_custkey % 13 = 5 THEN concat('S', CAST(c_custkey AS VARCHAR)) ELSE c_name END AS "shortName" FROM customer WHERE c_custkey % 9 <> 4 AND c_custkey % 17 <> 2""")
def _(spark, d):
    raw = A.table(spark, d, "customer").select(
        F.expr("CASE WHEN c_custkey % 17 = 2 THEN ' ' ELSE concat(' S', CAST(c_custkey AS STRING), ' ') END").alias("﻿SYMBOL"),
        F.expr("CASE WHEN c_custkey % 13 = 5 THEN '' ELSE c_name END").alias("NAME OF COMPANY"),
        F.expr(_ISIN).alias(" ISIN NUMBER"),
    )
    return E.listing(raw)


@query("fn_equity_isin", f"SELECT c_custkey, isin, length(isin) = 12 AND isin LIKE 'INE%' AND substring(isin, 8, 2) = '01' AS is_equity FROM (SELECT *, {_ISIN} AS isin FROM customer)")
def _(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", F.expr(_ISIN).alias("isin")).withColumn("is_equity", V.equity_isin("isin"))


_TYPE = "CASE c_custkey % 8 WHEN 0 THEN 'EQ' WHEN 1 THEN 'BE' WHEN 2 THEN 'FUT' WHEN 3 THEN 'SM' ELSE 'EQ' END"


@query("src_exchange_master", f"""SELECT concat('S', CAST(c_custkey AS VARCHAR)) AS ticker, 'NSE' AS exchange, isin, CASE WHEN c_custkey % 13 = 5 THEN concat('S', CAST(c_custkey AS VARCHAR)) ELSE c_name END AS "shortName",
  'NSE lists unavailable; used Upstox NSE exchange master' AS universe_note FROM (SELECT *, {_ISIN} AS isin, {_TYPE} AS t FROM customer) WHERE c_nationkey % 5 <> 0 AND c_custkey % 9 <> 4 AND t IN ('EQ', 'BE', 'BZ', 'SM', 'ST', 'SZ')""")
def _(spark, d):
    obj = F.struct(
        F.expr("CASE WHEN c_nationkey % 5 = 0 THEN 'BSE_EQ' ELSE 'NSE_EQ' END").alias("segment"), F.expr("concat(' S', CAST(c_custkey AS STRING))").alias("trading_symbol"),
        F.expr(_TYPE).alias("instrument_type"), F.expr(_ISIN).alias("isin"), F.expr("CASE WHEN c_custkey % 13 = 5 THEN NULL ELSE c_name END").alias("name"),
    )
    return E.exchange_master(A.table(spark, d, "customer").select(F.to_json(obj).alias("payload")))


_ADJ = "CASE p_partkey % 5 WHEN 0 THEN -1.5 WHEN 1 THEN NULL ELSE CAST(p_size AS DOUBLE) + 1000.5 END"


@query("src_valuation_csv", """SELECT concat('T', CAST(p_partkey AS VARCHAR)) AS ticker, pe AS trailing_pe FROM (SELECT *, CASE WHEN p_partkey % 5 NOT IN (0, 1) THEN CAST(p_size AS DOUBLE) + 1000.5 WHEN p_partkey % 7 <> 3 THEN CAST(p_size AS DOUBLE) END AS pe FROM part)
  WHERE pe > 0 AND p_size > 10""")
def _(spark, d):
    part = A.table(spark, d, "part")
    raw = part.select(
        F.expr("concat(' t', CAST(p_partkey AS STRING))").alias("SYMBOL "),
        F.expr("CASE p_partkey % 5 WHEN 0 THEN '-1.5' WHEN 1 THEN '-' ELSE concat('1,0', lpad(CAST(p_size AS STRING), 2, '0'), '.5') END").alias("ADJUSTED P/E"),
        F.expr("CASE WHEN p_partkey % 7 = 3 THEN 'n/a' ELSE CAST(p_size AS STRING) END").alias("SYMBOL P/E"),
    )
    wanted = part.filter("p_size > 10").select(F.expr("concat('T', CAST(p_partkey AS STRING))").alias("ticker"))
    return E.valuation(raw, wanted)


@query("src_latest_file", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 100000 AND CAST(o_orderdate AS DATE) = (
  SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_totalprice > 100000 AND isodow(o_orderdate) < 6 AND CAST(o_orderdate AS DATE) <= DATE '{TODAY}' AND CAST(o_orderdate AS DATE) > DATE '{TODAY}' - 12)""")
def _(spark, d):
    rows = A.table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return E.latest_file(rows, "day", F.col("o_totalprice") > 100000, TODAY).select("o_orderkey", "day")


def delivery_raw(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").select(
        F.expr("concat(' S', CAST(l_suppkey AS STRING))").alias("SYMBOL"),
        F.expr("CASE l_returnflag WHEN 'A' THEN ' EQ' WHEN 'R' THEN 'BE' ELSE 'N1' END").alias(" SERIES"),
        F.expr("CASE WHEN l_linenumber = 7 THEN ' -' ELSE concat(' ', CAST(CAST(round(l_discount * 1000) AS BIGINT) AS STRING)) END").alias(" DELIV_PER"),
        F.expr("CASE WHEN l_linenumber = 6 THEN 'bad' ELSE concat(' 1,', lpad(CAST(CAST(l_quantity AS BIGINT) AS STRING), 3, '0')) END").alias(" TTL_TRD_QNTY"),
        F.to_date("l_shipdate").alias("day"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )


DELIVERY = """dlv AS (SELECT concat('S', CAST(l_suppkey AS VARCHAR)) AS symbol, CAST(round(l_discount * 1000) AS DOUBLE) AS delivery_pct,
  CASE WHEN l_linenumber = 6 THEN 0.0::DOUBLE ELSE 1000 + l_quantity END AS volume, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber <> 7)"""


@query("src_delivery_csv", with_(DELIVERY) + "SELECT symbol, day, delivery_pct, volume, l_orderkey, l_linenumber FROM dlv")
def _(spark, d):
    return E.delivery(delivery_raw(spark, d)).select("symbol", "day", "delivery_pct", "volume", "l_orderkey", "l_linenumber")


SESSIONS = f"""sess AS (SELECT DISTINCT day FROM dlv WHERE day <= DATE '{TODAY}' AND day > DATE '{TODAY}' - 120 AND isodow(day) < 6 ORDER BY day DESC LIMIT 60)"""


@query("src_delivery_sessions", with_(DELIVERY, SESSIONS) + "SELECT symbol, day, delivery_pct, volume, l_orderkey, l_linenumber FROM dlv WHERE day IN (SELECT day FROM sess)")
def _(spark, d):
    rows = E.delivery(delivery_raw(spark, d))
    sessions = E.recent_sessions(rows, "day", 60, TODAY, 120)
    # at most 60 dates
    return rows.join(F.broadcast(sessions), "day", "left_semi").select("symbol", "day", "delivery_pct", "volume", "l_orderkey", "l_linenumber")


_TIE = "(volume, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
LIQUID = f"liq AS (SELECT symbol, day, arg_max(delivery_pct, {_TIE}) AS delivery_pct, max(volume) AS volume FROM dlv GROUP BY 1, 2)"


def tie():
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("win_dedupe_liquid", with_(DELIVERY, LIQUID) + "SELECT symbol, day, delivery_pct, volume FROM liq")
def _(spark, d):
    return W.most_liquid(E.delivery(delivery_raw(spark, d)), tie()).select("symbol", "day", "delivery_pct", "volume")


@query("agg_delivery", with_(DELIVERY, SESSIONS, LIQUID) + f"""SELECT symbol, n AS sessions, {r("a", 1)} AS avg_delivery_pct, {r("rc", 1)} AS delivery_recent_pct, {r("rc - pr", 1)} AS delivery_trend FROM (
  SELECT symbol, count(*) AS n, avg(delivery_pct) AS a, avg(delivery_pct) FILTER (WHERE rn <= 5) AS rc,
    CASE WHEN count(*) > 5 THEN avg(delivery_pct) FILTER (WHERE rn > 5) ELSE avg(delivery_pct) FILTER (WHERE rn > 1) END AS pr
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS rn FROM liq WHERE day IN (SELECT day FROM sess)) GROUP BY 1) WHERE n >= 4""")
def _(spark, d):
    rows = E.delivery(delivery_raw(spark, d))
    recent = rows.join(F.broadcast(E.recent_sessions(rows, "day", 60, TODAY, 120)), "day", "left_semi")
    return W.delivery_summary(W.most_liquid(recent, tie()).select("symbol", "day", "delivery_pct"))


# ---- deals ------------------------------------------------------------------------------------------

_INST = "(?i)ring|bolt"


def deals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = A.table(spark, d, "lineitem").join(A.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    rows = li.select(
        F.col("l_suppkey").alias("symbol"), F.expr("concat(p_name, ' ', p_brand)").alias("client"),
        F.expr("CASE l_linestatus WHEN 'O' THEN 'buy' ELSE 'SELL' END").alias("side"),
        F.expr("CASE WHEN l_linenumber = 6 THEN 'x' ELSE concat(' 1,', lpad(CAST(CAST(l_quantity AS BIGINT) AS STRING), 3, '0')) END").alias("quantity"), "l_linenumber",
    )
    return rows.filter("l_linenumber <= 3").drop("l_linenumber"), rows.filter("l_linenumber > 3").drop("l_linenumber")


DEALS = """dl AS (SELECT l_suppkey AS symbol, concat(p_name, ' ', p_brand) AS client, CASE l_linestatus WHEN 'O' THEN 'B' ELSE 'S' END AS side,
  CASE WHEN l_linenumber = 6 THEN 0 ELSE 1000 + CAST(l_quantity AS BIGINT) END AS qty, CASE WHEN l_linenumber <= 3 THEN 'bulk' ELSE 'block' END AS deal_type
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("set_concat_deals", with_(DEALS) + "SELECT deal_type, side, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM dl GROUP BY 1, 2")
def _(spark, d):
    both = W.combine_deals(*deals(spark, d))
    return both.groupBy("deal_type", F.substring(F.upper("side"), 1, 1).alias("side")).agg(F.count("*").alias("n"), F.sum(W.quantity(F.col("quantity"))).alias("qty"))


@query("agg_deals", with_(DEALS) + """SELECT symbol, CAST(coalesce(sum(qty) FILTER (WHERE side = 'B'), 0) AS BIGINT) AS deal_buy_qty, CAST(coalesce(sum(qty) FILTER (WHERE side = 'S'), 0) AS BIGINT) AS deal_sell_qty,
  count(DISTINCT client) FILTER (WHERE side = 'B' AND inst) AS n_inst_buy, count(DISTINCT client) FILTER (WHERE side = 'S' AND inst) AS n_inst_sell,
  substring(coalesce(string_agg(DISTINCT client, ' | ' ORDER BY client) FILTER (WHERE side = 'B' AND inst), ''), 1, 300) AS inst_buyers,
  substring(coalesce(string_agg(DISTINCT client, ' | ' ORDER BY client) FILTER (WHERE side = 'S' AND inst), ''), 1, 300) AS inst_sellers
  FROM (SELECT *, regexp_matches(client, '(?i)ring|bolt') AS inst FROM dl) GROUP BY 1""")
def _(spark, d):
    return W.deal_summary(W.combine_deals(*deals(spark, d)), _INST)


# ---- charts -----------------------------------------------------------------------------------------


def chart_documents(spark: SparkSession, d: str) -> DataFrame:
    """One chart document per ticker and calendar year: at most 53 weekly points each."""
    c = A.closes(spark, d, None)
    points = F.array_sort(F.collect_list(F.struct("day", "close")))
    docs = c.groupBy("ticker", F.year("day").alias("y")).agg(points.alias("p"))
    arr = lambda f: F.transform("p", f)
    ts = arr(lambda x: F.unix_date(x["day"]).cast("long") * 86400)
    close = arr(lambda x: F.when(F.dayofyear(x["day"]) % 9 != 0, x["close"]))
    quote = F.struct(
        arr(lambda x: x["close"] - 1).alias("open"), arr(lambda x: x["close"] + 2).alias("high"), arr(lambda x: x["close"] - 2).alias("low"),
        close.alias("close"), arr(lambda x: F.floor(x["close"])).alias("volume"),
    )
    meta = F.struct(
        F.lit("INR").alias("currency"), F.element_at(ts, -1).alias("regularMarketTime"), F.element_at(F.col("p"), -1)["close"].alias("regularMarketPrice"),
        F.element_at(F.col("p"), 1)["close"].alias("chartPreviousClose"), F.array_max(arr(lambda x: x["close"])).alias("fiftyTwoWeekHigh"),
    )
    chart = F.struct(
        F.struct(
            F.array(
                F.struct(
                    meta.alias("meta"), ts.alias("timestamp"),
                    F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.slice(arr(lambda x: x["close"] / 2), 1, 10).alias("adjclose"))).alias("adjclose")).alias("indicators"),
                )
            ).alias("result")
        ).alias("chart")
    )
    return docs.select("ticker", "y", F.to_json(chart).alias("payload"))


@query("src_chart_bars", with_(O.CLOSES) + """SELECT ticker, CAST(day AS TIMESTAMP) AS ts, close - 1 AS open, close + 2 AS high, close - 2 AS low, close, floor(close) AS volume,
  CASE WHEN pos <= 10 THEN close / 2 END AS adjusted_close FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year(day) ORDER BY day) AS pos FROM day_close) WHERE dayofyear(day) % 9 <> 0""")
def _(spark, d):
    return P.chart_bars(chart_documents(spark, d))


@query("src_chart_meta", with_(O.CLOSES) + """, m AS (SELECT ticker, year(day) AS y, CAST(max(day) AS TIMESTAMP) AS observed_at, arg_max(close, day) AS a, arg_min(close, day) AS b, max(close) AS c FROM day_close GROUP BY 1, 2)
  SELECT ticker, observed_at, 'current_price' AS field, 'INR' AS unit, a AS numeric_value FROM m UNION ALL SELECT ticker, observed_at, 'previous_close', 'INR', b FROM m
  UNION ALL SELECT ticker, observed_at, 'fifty_two_week_high', 'INR', c FROM m""")
def _(spark, d):
    return P.chart_meta(chart_documents(spark, d)).drop("text_value")


@query("src_history_long", """SELECT concat('N', CAST(s_nationkey AS VARCHAR)) AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS day, min(l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_quantity) AS low, max(l_quantity) AS close
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2 HAVING max(l_quantity) > 20""")
def _(spark, d):
    li = A.table(spark, d, "lineitem").join(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    per = li.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("day"), F.expr("concat('N', CAST(s_nationkey AS STRING))").alias("sym")).agg(
        F.min("l_extendedprice").alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("mx")
    )
    bar = F.struct("open", "high", "low", F.when(F.col("mx") > 20, F.col("mx")).alias("close"))
    # one wide row per month: at most 25 symbols (nations)
    wide = per.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct(F.col("sym"), bar))).alias("bars"))
    return P.history_long(wide)


# ---- company header ----------------------------------------------------------------------------------

_H = {  # header key -> number (null = absent)
    "PE": "CASE WHEN k % 7 = 0 THEN NULL ELSE CAST((k * 13) % 9000 - 1000 AS DOUBLE) / 100 END",
    "ConPE": "CASE WHEN k % 3 = 0 THEN CAST((k * 17) % 5000 - 500 AS DOUBLE) / 100 END",
    "PB": "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST((k * 11) % 1000 - 50 AS DOUBLE) / 100 END",
    "ConPB": "CASE WHEN k % 4 = 0 THEN CAST((k * 7) % 800 - 90 AS DOUBLE) / 100 END",
    "ROE": "CAST((k * 19) % 600 - 100 AS DOUBLE) / 10",
    "ConROE": "CASE WHEN k % 6 = 0 THEN CAST((k * 23) % 500 - 60 AS DOUBLE) / 10 END",
    "NPM": "CASE WHEN k % 9 = 0 THEN 0.0 ELSE CAST((k * 29) % 400 - 100 AS DOUBLE) / 10 END",
    "ConNPM": "CASE WHEN k % 8 = 0 THEN CAST((k * 31) % 300 - 50 AS DOUBLE) / 10 END",
    "OPM": "CAST((k * 37) % 450 - 90 AS DOUBLE) / 10",
    "ConOPM": "CASE WHEN k % 10 = 0 THEN CAST((k * 41) % 350 - 40 AS DOUBLE) / 10 END",
    "EPS": "CAST((k * 43) % 9000 - 900 AS DOUBLE) / 100",
    "ConEPS": "CASE WHEN k % 3 = 1 THEN CAST((k * 47) % 7000 - 600 AS DOUBLE) / 100 END",
}


def header_documents(spark: SparkSession, d: str) -> DataFrame:
    part = A.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    # absent numbers arrive as one of the provider's blanks
    text = lambda e: F.coalesce(F.expr(e).cast("string"), F.expr("CASE k % 3 WHEN 0 THEN '-' WHEN 1 THEN '' ELSE 'NA' END"))
    obj = F.struct(
        F.expr("CASE WHEN k % 100 = 99 THEN '' ELSE CAST(k AS STRING) END").alias("SecurityCode"), *[text(e).alias(n) for n, e in _H.items()],
        F.col("p_type").alias("Sector"), F.expr("CASE WHEN k % 2 = 0 THEN '' ELSE p_brand END").alias("ISubGroup"), F.lit(" Other ").alias("Industry"),
    )
    return part.select(F.expr("concat('T', CAST(k AS STRING))").alias("ticker"), F.to_json(obj).alias("payload"), F.expr("concat('1,', lpad(CAST(p_size AS STRING), 3, '0'))").alias("mktcap"))


def _pick(name: str, positive: bool) -> tuple[str, str]:
    ok = (lambda c: f'"{c}" > 0') if positive else (lambda c: f'"{c}" <> 0')
    value = f'CASE WHEN {ok("Con" + name)} THEN "Con{name}" WHEN {ok(name)} THEN "{name}" END'
    basis = f"CASE WHEN {ok('Con' + name)} THEN 'consolidated' WHEN {ok(name)} THEN 'standalone' END"
    return value, basis


def _header_sql() -> str:
    parts = ["""SELECT ticker, 'book_value_sign' AS field, NULL AS unit, CAST(NULL AS DOUBLE) AS numeric_value, CASE WHEN book IS NOT NULL THEN CASE WHEN book <= 0 THEN 'negative' ELSE 'positive' END END AS text_value, true AS is_valid, NULL AS issue_code FROM h"""]
    for field, name, unit, positive in P._HEADER_FIELDS:
        value, basis = _pick(name, positive)
        where = " WHERE NOT coalesce(book <= 0, false)" if field == "roe_pct" else ""
        mixed = f"coalesce(({basis}) = 'standalone', false)" if field in P.MIXED_BASIS else "false"
        parts.append(f"SELECT ticker, '{field}', '{unit}', {value}, NULL, NOT {mixed}, CASE WHEN {mixed} THEN 'mixed_accounting_basis' END FROM h{where}")
        parts.append(f"SELECT ticker, '{field}_basis', NULL, NULL, {basis}, true, NULL FROM h{where}")
    parts += ["SELECT ticker, 'market_cap', 'INR', (1000 + p_size) * 10000000.0::DOUBLE, NULL, true, NULL FROM h", "SELECT ticker, 'sector', NULL, NULL, p_type, true, NULL FROM h",
              "SELECT ticker, 'industry', NULL, NULL, CASE WHEN k % 2 = 0 THEN 'Other' ELSE p_brand END, true, NULL FROM h"]
    cols = ", ".join(f'{e} AS "{n}"' for n, e in _H.items())
    return with_(f"hh AS (SELECT *, concat('T', CAST(k AS VARCHAR)) AS ticker, {cols} FROM (SELECT *, p_partkey AS k FROM part))", 'h AS (SELECT *, coalesce("ConPB", "PB") AS book FROM hh WHERE k % 100 <> 99)') + \
        f"SELECT * FROM ({rows_of(*parts)}) WHERE numeric_value IS NOT NULL OR text_value IS NOT NULL"


@query("src_header_ratios", _header_sql())
def _(spark, d):
    return P.header_ratios(header_documents(spark, d))


_PV, _PB = _pick("PE", True)


@query("fn_preferred_basis", with_("hh AS (SELECT *, concat('T', CAST(k AS VARCHAR)) AS ticker, " + ", ".join(f'{e} AS "{n}"' for n, e in _H.items()) + " FROM (SELECT *, p_partkey AS k FROM part))") + f"SELECT ticker, {_PV} AS value, {_PB} AS basis FROM hh")
def _(spark, d):
    docs = header_documents(spark, d).withColumn("_h", F.from_json("payload", P.HEADER))
    docs = V.settled(V.settled(docs).withColumn("_n", P.header_numbers()))
    return docs.select("ticker", P.header_choice("PE", True).alias("c")).select("ticker", "c.value", "c.basis")


_CAP = "CASE WHEN c_custkey % 12 = 0 THEN -1.0 ELSE abs(c_acctbal) END"


@query("src_master_best_listing", """WITH m AS (SELECT concat('SYM', CAST(c_custkey % 700 AS VARCHAR)) AS symbol, CAST(c_custkey AS VARCHAR) AS code, c_custkey, CASE WHEN c_custkey % 12 = 0 OR c_acctbal = 0 THEN -1 ELSE abs(c_acctbal) END AS cap FROM customer WHERE c_custkey % 31 <> 7),
  best AS (SELECT symbol, arg_max(code, (cap, -c_custkey)) AS code FROM m GROUP BY 1), inst AS (SELECT concat('SYM', CAST(s_suppkey AS VARCHAR)) AS ticker, CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey + 3 AS VARCHAR) END AS bse_code FROM supplier)
  SELECT i.ticker, coalesce(CASE WHEN i.bse_code IN (SELECT code FROM m) THEN i.bse_code END, b.code) AS code FROM inst i LEFT JOIN best b ON b.symbol = i.ticker""")
def _(spark, d):
    master = A.table(spark, d, "customer").select(
        F.expr("concat('sym-', CAST(c_custkey % 700 AS STRING))").alias("scrip_id"), F.expr("CASE WHEN c_custkey % 31 = 7 THEN NULL ELSE CAST(c_custkey AS STRING) END").alias("SCRIP_CD"),
        F.expr("CASE WHEN c_custkey % 12 = 0 THEN '--' ELSE CAST(abs(c_acctbal) AS STRING) END").alias("Mktcap"), F.col("c_custkey").alias("position"),
    )
    inst = A.table(spark, d, "supplier").select(
        F.expr("concat('SYM', CAST(s_suppkey AS STRING))").alias("ticker"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey + 3 AS STRING) END").alias("bse_code")
    )
    return P.map_listings(inst, master)


# ---- results, quotes, ratios -----------------------------------------------------------------------------


@query("src_filed_results", """WITH f AS (SELECT concat('T', CAST(p_partkey AS VARCHAR)) AS ticker, p_partkey AS k, p_size + 1000.5::DOUBLE AS rev, CAST(p_partkey % 90 AS DOUBLE) - 40 AS v1, CAST(p_partkey % 70 AS DOUBLE) - 30 AS v2, CAST(p_size AS DOUBLE) / 4 AS eps FROM part)
  SELECT * FROM (SELECT ticker, 'results_quarterly_revenue' AS field, 'INR' AS unit, rev * 10000000 AS numeric_value, CAST(NULL AS VARCHAR) AS text_value FROM f WHERE k % 6 <> 0
  UNION ALL SELECT ticker, 'results_revenue', 'INR', rev * 10000000, NULL FROM f UNION ALL SELECT ticker, 'results_quarterly_net_profit', 'INR', v1 * 10000000, NULL FROM f
  UNION ALL SELECT ticker, 'results_net_profit', 'INR', v2 * 10000000, NULL FROM f UNION ALL SELECT ticker, 'results_eps', 'INR', eps, NULL FROM f
  UNION ALL SELECT ticker, 'earnings_quarterly_growth', 'fraction', """ + r("(v1 - v2) / abs(v2)", 6) + """, NULL FROM f WHERE v2 <> 0)""")
def _(spark, d):
    row = lambda t, a, b, c: F.struct(F.lit(t).alias("title"), a.cast("string").alias("v1"), b.cast("string").alias("v2"), c.cast("string").alias("v3"))
    rev = F.concat(F.lit("1,0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(".5"))
    v1, v2 = F.expr("CAST(p_partkey % 90 AS DOUBLE) - 40"), F.expr("CAST(p_partkey % 70 AS DOUBLE) - 30")
    body = F.struct(
        F.lit("Mar-26").alias("col2"),
        F.array(
            row("Revenue", F.when(F.col("p_partkey") % 6 == 0, F.lit("--")).otherwise(rev), F.lit(""), rev), row("Net Profit", v1, v2, v2),
            row("EPS", F.lit("--"), F.lit("--"), F.col("p_size") / 4),
        ).alias("resultinCr"),
    )
    # the endpoint answers with a JSON string that contains JSON
    inner = F.to_json(F.array(F.to_json(body)))
    encoded = F.substring(inner, F.lit(2), F.length(inner) - 2)
    return P.filed_results(A.table(spark, d, "part").select(F.expr("concat('T', CAST(p_partkey AS STRING))").alias("ticker"), encoded.alias("payload")))


def instrument_master(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "customer").select(
        F.expr("CASE WHEN c_nationkey % 7 = 0 THEN 'NSE_FO' ELSE 'NSE_EQ' END").alias("segment"), F.expr("concat(' s', CAST(c_custkey % 500 AS STRING))").alias("trading_symbol"),
        F.expr("concat('NSE_EQ|', CAST(c_custkey AS STRING))").alias("instrument_key"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'EQ' ELSE 'BE' END").alias("instrument_type"),
        F.col("c_custkey").alias("position"),
    )


KEYS = """keys AS (SELECT concat('S', CAST(c_custkey % 500 AS VARCHAR)) AS ticker, concat('NSE_EQ|', CAST(arg_max(c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END, -c_custkey)) AS VARCHAR)) AS instrument_key
  FROM customer WHERE c_nationkey % 7 <> 0 GROUP BY 1)"""


@query("src_instrument_key_map", with_(KEYS) + "SELECT ticker, instrument_key FROM keys")
def _(spark, d):
    return P.instrument_keys(instrument_master(spark, d))


def quote_documents(spark: SparkSession, d: str) -> DataFrame:
    """Quote responses of 50 instruments each."""
    c = A.table(spark, d, "customer")
    q = F.struct(
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('NSE_EQ:', CAST(c_custkey AS STRING)) END").alias("instrument_token"),
        F.col("c_acctbal").alias("last_price"), F.expr("CAST(c_nationkey AS DOUBLE)").alias("volume"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE CAST(1700000000000 + c_custkey AS STRING) END").alias("timestamp"), F.expr("CAST(1600000000 + c_custkey AS STRING)").alias("last_trade_time"),
        F.struct((F.col("c_acctbal") - 1).alias("open")).alias("ohlc"),
    )
    entry = F.struct(F.expr("concat('NSE_EQ:S', CAST(c_custkey AS STRING))"), q)
    return c.groupBy(F.floor(F.col("c_custkey") / 50).alias("batch")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("payload"))


@query("src_quotes", with_(KEYS, """q AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN concat('NSE_EQ|', CAST(c_custkey AS VARCHAR)) ELSE '' END AS ik, concat('S', CAST(c_custkey AS VARCHAR)) AS sym,
  CASE WHEN c_custkey % 3 = 0 THEN make_timestamp((1600000000 + c_custkey) * 1000000) ELSE make_timestamp((1700000000000 + c_custkey) * 1000) END AS observed_at FROM customer)""",
  "n AS (SELECT q.*, coalesce(k.ticker, s.ticker) AS ticker FROM q LEFT JOIN keys k ON k.instrument_key = q.ik LEFT JOIN keys s ON s.ticker = q.sym)") + """SELECT ticker, observed_at, field, unit, numeric_value, CAST(NULL AS VARCHAR) AS text_value FROM (
  SELECT ticker, observed_at, 'current_price' AS field, 'INR' AS unit, c_acctbal AS numeric_value FROM n UNION ALL SELECT ticker, observed_at, 'day_open', 'INR', c_acctbal - 1 FROM n
  UNION ALL SELECT ticker, observed_at, 'day_volume', 'shares', CAST(c_nationkey AS DOUBLE) FROM n) WHERE ticker IS NOT NULL""")
def _(spark, d):
    return P.quotes(quote_documents(spark, d), P.instrument_keys(instrument_master(spark, d)))


@query("fn_epoch_guess", """SELECT event_id, make_timestamp(CASE WHEN event_id % 2 = 0 THEN (CAST(epoch(ts) AS BIGINT)) * 1000000 ELSE (CAST(epoch(ts) AS BIGINT) * 1000 + 250) * 1000 END) AS observed_at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def _(spark, d):
    seconds = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 2 == 0, seconds).otherwise(seconds * 1000 + 250)
    return A.table(spark, d, "events").select("event_id", T.epoch_instant(raw.cast("double")).alias("observed_at"))


_KR = """kr AS (SELECT p_partkey AS k, concat('T', CAST(p_partkey AS VARCHAR)) AS ticker, CAST(p_size AS DOUBLE) + 0.5::DOUBLE AS v FROM part)"""


def ratio_documents(spark: SparkSession, d: str) -> DataFrame:
    v = F.expr("CAST(p_size AS DOUBLE) + 0.5D")
    row = lambda n, x: F.struct(F.lit(n).alias("name"), x.cast("string").alias("company_value"), F.lit("99").alias("sector_value"))
    data = F.array(row("p/e ", v), row("ROE", F.concat(v.cast("string"), F.lit("%"))), row("Dividend", v), row("EV/EBITDA", F.when(F.col("p_partkey") % 3 == 0, F.lit("--")).otherwise((v * 2).cast("string"))), row("P/E", v * 3))
    full = F.to_json(F.struct(F.lit("success").alias("status"), data.alias("data")))
    payload = F.when(F.col("p_partkey") % 10 == 0, '{"status":"success","data":[]}').when(F.col("p_partkey") % 10 == 1, '{"status":"error"}').otherwise(full)
    return A.table(spark, d, "part").select(F.expr("concat('T', CAST(p_partkey AS STRING))").alias("ticker"), payload.alias("payload"))


@query("src_key_ratios", with_(_KR) + """SELECT ticker, 'trailing_pe' AS field, 'ratio' AS unit, v * 3 AS numeric_value FROM kr WHERE k % 10 > 1 UNION ALL SELECT ticker, 'roe_pct', 'percent', v FROM kr WHERE k % 10 > 1
  UNION ALL SELECT ticker, 'enterprise_to_ebitda', 'ratio', v * 2 FROM kr WHERE k % 10 > 1 AND k % 3 <> 0""")
def _(spark, d):
    return P.key_ratios(ratio_documents(spark, d))


@query("src_key_ratio_issues", with_(_KR) + """SELECT ticker, CASE WHEN k % 10 = 0 THEN 'provider_empty_payload' ELSE 'provider_schema_invalid' END AS code, CASE WHEN k % 10 = 0 THEN 'warning' ELSE 'error' END AS severity FROM kr WHERE k % 10 <= 1""")
def _(spark, d):
    return P.key_ratio_issues(ratio_documents(spark, d))


@query("src_overview", """WITH o AS (SELECT c_custkey AS k, concat('C', CAST(c_custkey AS VARCHAR)) AS ticker, c_acctbal AS v, c_mktsegment AS s, c_nationkey AS n FROM customer WHERE c_custkey % 20 <> 19)
  SELECT ticker, 'market_cap' AS field, 'USD' AS unit, v * 1000 AS numeric_value, CAST(NULL AS VARCHAR) AS text_value FROM o WHERE k % 4 <> 0 UNION ALL SELECT ticker, 'trailing_pe', 'ratio', CAST(n AS DOUBLE) / 2, NULL FROM o WHERE k % 5 <> 0
  UNION ALL SELECT ticker, 'roe_pct', 'fraction', v / 100000, NULL FROM o UNION ALL SELECT ticker, 'sector', NULL, NULL, s FROM o WHERE k % 6 <> 0""")
def _(spark, d):
    obj = F.create_map(
        F.lit("MarketCapitalization"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'None' ELSE CAST(c_acctbal * 1000 AS STRING) END"), F.lit("Currency"), F.lit("USD"),
        F.lit("PERatio"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN '-' ELSE CAST(CAST(c_nationkey AS DOUBLE) / 2 AS STRING) END"), F.lit("ReturnOnEquityTTM"), F.expr("CAST(c_acctbal / 100000 AS STRING)"),
        F.lit("ProfitMargin"), F.lit("n.a."), F.lit("Sector"), F.expr("CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END"),
        F.lit("Note"), F.expr("CASE WHEN c_custkey % 20 = 19 THEN 'rate limited' ELSE '' END"),
    )
    return P.overview(A.table(spark, d, "customer").select(F.expr("concat('C', CAST(c_custkey AS STRING))").alias("ticker"), F.to_json(obj).alias("payload")))


@query("src_holders", with_(O.FUND) + " UNION ALL ".join(f"""SELECT ticker, '{f}' AS field, '{u}' AS unit, {r(f'"{s}" * {k}', 6)} AS numeric_value FROM fund WHERE "{s}" IS NOT NULL"""
       for s, f, k, u in (("heldPercentInsiders", "promoter_pct", 100, "percent"), ("heldPercentInstitutions", "institutional_pct", 100, "percent"), ("heldPercentInsiders", "heldPercentInsiders", 1, "fraction"), ("heldPercentInstitutions", "heldPercentInstitutions", 1, "fraction"))))
def _(spark, d):
    return P.holders(A.fundamentals(spark, d))


@query("src_holder_text", """SELECT concat('T', CAST(p_partkey AS VARCHAR)) AS ticker, (CAST(p_size AS DOUBLE) + 0.25::DOUBLE) / 100 AS fraction FROM part WHERE p_partkey % 3 <> 2""")
def _(spark, d):
    text = F.expr("""CASE p_partkey % 3 WHEN 0 THEN concat('% of shares held by all INSIDER names: ', CAST(CAST(p_size AS DOUBLE) + 0.25D AS STRING), ' %') WHEN 1 THEN concat(CAST(CAST(p_size AS DOUBLE) + 0.25D AS STRING), '% insider; 3% float') ELSE '5% held by institutions' END""")
    return P.holder_text(A.table(spark, d, "part").select(F.expr("concat('T', CAST(p_partkey AS STRING))").alias("ticker"), text.alias("text")), "Insider")


_HTML = ("concat(html, '<li><span class=\"name\">ROCE</span> <b><span class=\"number\"> ', CAST(page_id % 90 AS {t}), '.5 </span></b></li>', "
         "CASE WHEN page_id % 3 = 0 THEN concat('<span  class=\"name\"> ROE </span>\n<span class=\"number\">1,0', lpad(CAST(page_id % 50 AS {t}), 2, '0'), '</span>') ELSE '' END)")


@query("src_html_ratios", """SELECT page_id, 'roce_pct' AS field, 'percent' AS unit, CAST(page_id % 90 AS DOUBLE) + 0.5::DOUBLE AS numeric_value FROM pages WHERE page_id % 5 <> 4
  UNION ALL SELECT page_id, 'roe_pct', 'percent', 1000 + CAST(page_id % 50 AS DOUBLE) FROM pages WHERE page_id % 3 = 0 AND page_id % 5 <> 4""")
def _(spark, d):
    html = F.expr(f"CASE WHEN page_id % 5 = 4 THEN html ELSE {_HTML.format(t='STRING')} END")
    return P.headline_ratios(A.table(spark, d, "pages").select("page_id", html.alias("html")))


@query("src_html_issues", f"""SELECT page_id, 'provider_schema_changed' AS code FROM pages WHERE page_id % 5 = 4 AND NOT regexp_matches(html, '{C.HEADLINE_RATIO_PATTERN}')""")
def _(spark, d):
    html = F.expr(f"CASE WHEN page_id % 5 = 4 THEN html ELSE {_HTML.format(t='STRING')} END")
    return P.headline_issues(A.table(spark, d, "pages").select("page_id", html.alias("html")))


# ---- annual ROE -----------------------------------------------------------------------------------------


def yearly_series(spark: SparkSession, d: str) -> DataFrame:
    """Per customer and year: income and equity derived from that year's orders."""
    o = A.table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("ck"), F.year("o_orderdate").alias("y")).agg(
        F.sum(F.rint(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n")
    )


YEARLY = """yr AS (SELECT o_custkey AS ck, year(o_orderdate) AS y, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM orders GROUP BY 1, 2)"""


def roe_documents(spark: SparkSession, d: str) -> DataFrame:
    point = lambda v: F.struct(F.concat(F.col("y").cast("string"), F.lit("-03-31")).alias("asOfDate"), F.struct(v.cast("double").alias("raw")).alias("reportedValue"))
    # at most one point per calendar year and customer
    docs = yearly_series(spark, d).groupBy("ck").agg(
        F.collect_list(F.when(F.col("n") != 2, point(F.col("cents") % 5000))).alias("income"), F.collect_list(point(F.col("cents") % 9000 - 500)).alias("equity")
    )
    block = lambda kind, name, points: F.struct(F.struct(F.array(F.lit(kind)).alias("type")).alias("meta"), points.alias(name))
    a = F.to_json(block("annualNetIncome", "annualNetIncome", F.col("income")))
    b = F.to_json(block("annualStockholdersEquity", "annualStockholdersEquity", F.col("equity")))
    payload = F.concat(F.lit('{"timeseries":{"result":['), a, F.lit(","), b, F.lit("]}}"))
    return docs.select(F.expr("concat('C', CAST(ck AS STRING))").alias("ticker"), payload.alias("payload"))


_ROE = with_(YEARLY, """e AS (SELECT ck, y, CAST(cents % 9000 - 500 AS DOUBLE) AS equity, lag(CAST(cents % 9000 - 500 AS DOUBLE)) OVER (PARTITION BY ck ORDER BY y) AS previous, CASE WHEN n <> 2 THEN CAST(cents % 5000 AS DOUBLE) END AS income FROM yr)""",
             "c AS (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY y DESC) AS rn FROM e WHERE income IS NOT NULL AND previous IS NOT NULL)")


@query("src_annual_roe", _ROE + f"""SELECT concat('C', CAST(ck AS VARCHAR)) AS ticker, concat(CAST(y AS VARCHAR), '-03-31') AS period, {r("income / ((equity + previous) / 2) * 100", 6)} AS roe_pct FROM c WHERE rn = 1 AND equity > 0 AND previous > 0""")
def _(spark, d):
    return P.annual_roe(roe_documents(spark, d))


@query("join_asof_equity", with_(YEARLY) + """SELECT ck, y, CAST(cents % 9000 - 500 AS DOUBLE) AS equity, lag(CAST(cents % 9000 - 500 AS DOUBLE)) OVER (PARTITION BY ck ORDER BY y) AS previous FROM yr""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("ck").orderBy("y")
    rows = yearly_series(spark, d).select("ck", F.col("y").cast("long").alias("y"), (F.col("cents") % 9000 - 500).cast("double").alias("equity"))
    return rows.withColumn("previous", F.lag("equity").over(w))


# ---- archive ---------------------------------------------------------------------------------------------


def csv_documents(spark: SparkSession, d: str) -> DataFrame:
    """One CSV file per document: quoted whole text, a repeated header, a surplus and a short row."""
    text = F.expr("""concat('id,text,text\r\n', CAST(doc_id AS STRING), ',"', replace(text, '"', '""'), '",', lang, ',extra\n', CAST(doc_id AS STRING), '\n')""")
    return A.table(spark, d, "documents").select(F.expr("concat('data/', source, '/', CAST(doc_id AS STRING), '.csv')").alias("source_path"), F.encode(text, "UTF-8").alias("content"), "n_chars", "lang")


_CSV_TEXT = """concat('id,text,text', chr(13), chr(10), CAST(doc_id AS VARCHAR), ',"', replace(text, '"', '""'), '",', lang, ',extra', chr(10), CAST(doc_id AS VARCHAR), chr(10))"""


@query("src_csv_lossless", """SELECT concat('data/', source, '/', CAST(doc_id AS VARCHAR), '.csv') AS source_path, 1 AS row_number, 4 AS cells, CAST(doc_id AS VARCHAR) AS id, text AS text, lang AS text_2, 'extra' AS extra FROM documents
  UNION ALL SELECT concat('data/', source, '/', CAST(doc_id AS VARCHAR), '.csv'), 2, 1, CAST(doc_id AS VARCHAR), NULL, NULL, NULL FROM documents""")
def _(spark, d):
    rows = Z.archive_rows(csv_documents(spark, d))
    get = lambda k: F.element_at("record", F.lit(k))
    return rows.select("source_path", F.col("row_number").cast("int").alias("row_number"), F.size("values_array").alias("cells"), get("id").alias("id"), get("text").alias("text"), get("text__duplicate_2").alias("text_2"), get("extra_column_1").alias("extra"))


@query("src_csv_discover", """SELECT path FROM (SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN '/x/node_modules' WHEN 1 THEN '/x/.git' ELSE '/x' END, '/', CAST(page_id AS VARCHAR), CASE WHEN page_id % 5 = 0 THEN '.txt' ELSE '.csv' END) AS path FROM pages) WHERE page_id % 4 > 1 AND page_id % 5 <> 0""")
def _(spark, d):
    path = F.expr("concat(CASE page_id % 4 WHEN 0 THEN '/x/node_modules' WHEN 1 THEN '/x/.git' ELSE '/x' END, '/', CAST(page_id AS STRING), CASE WHEN page_id % 5 = 0 THEN '.txt' ELSE '.csv' END)")
    return A.table(spark, d, "pages").select(path.alias("path")).filter(Z.is_archivable(F.col("path")))


_AUDIT = f"csvs AS (SELECT doc_id, n_chars, lang, concat('data/', source, '/', CAST(doc_id AS VARCHAR), '.csv') AS source_path, {_CSV_TEXT} AS body FROM documents)"


@query("audit_csv_import", with_(_AUDIT) + """SELECT source_path, sha256(body) AS declared_sha256, CASE WHEN doc_id % 10 = 1 THEN sha256(body || 'x') ELSE sha256(body) END AS stored_sha256,
  octet_length(encode(body)) + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS declared_size_bytes, octet_length(encode(body)) + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS stored_size_bytes,
  2 AS declared_row_count, CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 2 END AS stored_row_count, doc_id % 10 > 2 AS verified FROM csvs""")
def _(spark, d):
    docs = csv_documents(spark, d)
    rows = materialise(Z.archive_rows(docs), "archive-rows")
    files = Z.archive_files(docs, rows)
    # of every ten files one declares a wrong size, one is stored with a byte more and one has lost a row
    last = F.regexp_extract("source_path", "([0-9]+)[.]csv$", 1).cast("long") % 10
    damaged = files.withColumns({"size_bytes": F.col("size_bytes") + F.when(last == 0, 1).otherwise(0), "content": F.when(last == 1, F.concat("content", F.lit(b"x"))).otherwise(F.col("content"))})
    return Z.import_audit(damaged, rows.filter(~((last == 2) & (F.col("row_number") == 2))))


@query("src_csv_ranges", "SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, sha256(coalesce(text, '')) AS again FROM documents")
def _(spark, d):
    """Documents written as quoted CSV with line ends in their cells, read back in ranges of files."""
    docs, root = A.table(spark, d, "documents"), new_folder(spark, "csv")
    whole = docs.select(F.col("doc_id").cast("string").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang")])
    whole.withColumn("again", F.sha2("text", 256)).write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(root)
    rows = Z.archive_range_rows(Z.read_csv_ranges(spark, root, 1 << 18))
    return rows.select(*[F.element_at("record", F.lit(c)).alias(c) for c in ("id", "text", "lang", "again")])


_VERIFY = with_(_AUDIT, """ex AS (SELECT doc_id, source_path, sha256(body) AS sha, octet_length(encode(body)) AS size FROM csvs WHERE n_chars > 300)""", """ac AS (SELECT doc_id, source_path, sha256(body) AS sha, octet_length(encode(body)) + CASE WHEN doc_id % 5 = 1 THEN 2 ELSE 0 END AS size FROM csvs WHERE lang <> 'de')""")


@query("audit_verify_import", _VERIFY + """SELECT source_path, 'missing' AS problem, CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS actual FROM ex WHERE doc_id NOT IN (SELECT doc_id FROM ac) UNION ALL SELECT source_path, 'unexpected', NULL, NULL FROM ac WHERE doc_id NOT IN (SELECT doc_id FROM ex)
  UNION ALL SELECT ex.source_path, 'size_bytes', CAST(ex.size AS VARCHAR), CAST(ac.size AS VARCHAR) FROM ex JOIN ac USING (doc_id) WHERE ex.size <> ac.size""")
def _(spark, d):
    docs = csv_documents(spark, d)
    n = F.regexp_extract("source_path", "([0-9]+)[.]csv$", 1).cast("long")
    base = docs.select("source_path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), F.lit(2).alias("row_count"), "n_chars", "lang")
    actual = base.filter("lang <> 'de'").withColumn("size_bytes", F.col("size_bytes") + F.when(n % 5 == 1, 2).otherwise(0))
    return Z.verify_import(base.filter("n_chars > 300"), actual)


@query("audit_manifest", with_(_AUDIT) + """SELECT source_path, sha256(body) AS content_sha256, CAST(1 AS BIGINT) AS file_count, CAST(2 AS BIGINT) AS total_rows, CAST(octet_length(encode(body)) AS BIGINT) AS total_bytes FROM csvs
  UNION ALL SELECT NULL, NULL, count(*), CAST(sum(2) AS BIGINT), CAST(sum(octet_length(encode(body))) AS BIGINT) FROM csvs""")
def _(spark, d):
    docs = csv_documents(spark, d)
    return Z.manifest(Z.archive_files(docs, Z.archive_rows(docs)))


@query("src_flow_report", f"""SELECT CAST(o_orderdate AS DATE) AS report_date, """ + ", ".join(
    r(f"coalesce(CAST(sum(v) FILTER (WHERE {c}) AS DOUBLE), 0)", 1) + f" AS {n}" for n, c in (
        ("fii_equity_net_cr", "p = 0 AND o_orderstatus = 'F'"), ("mf_equity_net_cr", "p = 1 AND o_orderstatus = 'O'"), ("debt_net_cr", "p = 2 AND o_orderstatus = 'F'"))) + """
  FROM (SELECT *, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18, 4)) END AS v, o_orderkey % 3 AS p FROM orders) GROUP BY 1""")
def _(spark, d):
    rows = A.table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("report_date"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Equity' WHEN 1 THEN 'Mutual Funds' ELSE 'Debt-VRR' END").alias("asset_class"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'Sub-total' WHEN 'O' THEN 'Equity schemes' ELSE 'Other' END").alias("route"),
        F.expr("CASE WHEN o_orderkey % 19 = 0 THEN '-' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 4)) AS STRING) END").alias("net"),
    )
    return E.flow_report(rows)


@query("src_instruments", with_(O.INST) + 'SELECT ticker, exchange, isin, company_name AS "shortName", sector FROM active')
def _(spark, d):
    return E.identity_list(A.instruments(spark, d))


_OVERRIDES = {"T3": {"promoter_pct": 51.5}, "T40": {"promoter_pct": 10.0, "institutional_pct": 20.0}, "T77": {"institutions_count": 999.0}}


@query("src_overrides", with_(O.FUND) + """SELECT ticker, CASE ticker WHEN 'T3' THEN 51.5 WHEN 'T40' THEN 10.0 ELSE promoter_pct END AS promoter_pct, CASE ticker WHEN 'T40' THEN 20.0 ELSE institutional_pct END AS institutional_pct,
  CASE ticker WHEN 'T77' THEN 999.0 ELSE institutions_count END AS institutions_count FROM fund""")
def _(spark, d):
    df = A.fundamentals(spark, d).select("ticker", "promoter_pct", "institutional_pct", "institutions_count")
    return E.apply_overrides(df, _OVERRIDES)


@query("src_raw_ownership", with_(O.FUND) + ", s AS (SELECT *, " + ", ".join(f'CASE WHEN "{c}" * 100 BETWEEN 0 AND 100 THEN {r(chr(34) + c + chr(34) + " * 100", 1)} END AS {n}_raw' for c, n in (("heldPercentInsiders", "promoter_pct"), ("heldPercentInstitutions", "institutional_pct"))) + """ FROM fund)
  SELECT ticker, promoter_pct_raw, "heldPercentInsiders" IS NOT NULL AND promoter_pct_raw IS NULL AS promoter_pct_rejected, institutional_pct_raw, "heldPercentInstitutions" IS NOT NULL AND institutional_pct_raw IS NULL AS institutional_pct_rejected FROM s""")
def _(spark, d):
    return E.raw_ownership(A.fundamentals(spark, d))
