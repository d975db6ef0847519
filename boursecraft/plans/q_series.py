"""Price-series queries (2.4, 2.6, 2.8, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from boursecraft.functions import finance as N
from boursecraft.functions import values as V
from boursecraft.operators import series as S
from boursecraft.plans import adapters as A
from boursecraft.plans import oracle as O
from boursecraft.plans.oracle import r, with_
from boursecraft.plans.registry import query

C = with_(O.CLOSES)
CM = with_(O.CLOSES, O.MARKET)


@query("win_close_per_day", C + "SELECT ticker, day, close FROM closes")
def _(spark, d):
    return A.closes(spark, d).select("ticker", "day", "close")


@query("win_moving_average", C + f"""SELECT ticker, CASE WHEN count(*) >= 50 THEN {r("avg(close) FILTER (WHERE rn <= 50)", 4)} END AS ma50,
  CASE WHEN count(*) >= 200 THEN {r("avg(close) FILTER (WHERE rn <= 200)", 4)} END AS ma200 FROM closes GROUP BY 1""")
def _(spark, d):
    return S.summarise(A.closes(spark, d), {"ma50": S.moving_average(50), "ma200": S.moving_average(200)})


@query("win_moving_average_series", C + f"""SELECT ticker, day, CASE WHEN count(*) OVER w >= 20 THEN {r("avg(close) OVER w", 4)} END AS ma
  FROM closes WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return S.moving_average_series(A.closes(spark, d), 20).select("ticker", "day", "ma")


@query("win_high_low", C + f"""SELECT ticker, {r("(hi - last) / hi * 100", 4)} AS below_high, {r("(last - lo) / lo * 100", 4)} AS above_low FROM (
  SELECT ticker, max(close) FILTER (WHERE rn <= 252) AS hi, min(close) FILTER (WHERE rn <= 252) AS lo, arg_max(close, day) AS last FROM closes GROUP BY 1)""")
def _(spark, d):
    return S.summarise(A.closes(spark, d), {"below_high": S.pct_below_high(), "above_low": S.pct_above_low()})


_CHANGE = lambda n: r(f"(arg_max(close, day) / arg_min(close, day) FILTER (WHERE rn <= {n}) - 1) * 100", 4)


@query("win_change", C + f"SELECT ticker, {_CHANGE(252)} AS change_252, {_CHANGE(6)} AS change_6 FROM closes GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return S.summarise(A.closes(spark, d), {"change_252": S.window_change(252), "change_6": S.window_change(6)})


@query("win_daily_return", C + """SELECT ticker, day, close / base - 1 AS ret FROM (
  SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY day) AS base FROM closes) WHERE base > 0""")
def _(spark, d):
    return S.daily_returns(A.closes(spark, d))


_RSI = """
steps AS (SELECT ticker, i, c, c - lag(c) OVER (PARTITION BY ticker ORDER BY i) AS ch FROM (
  SELECT ticker, close AS c, row_number() OVER (PARTITION BY ticker ORDER BY day) AS i FROM closes)),
seed AS (SELECT ticker, list_reduce(list(greatest(ch, 0.0) ORDER BY i), lambda a, x: a + x) / 14 AS g,
  list_reduce(list(greatest(-ch, 0.0) ORDER BY i), lambda a, x: a + x) / 14 AS l FROM steps WHERE i BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14),
fold(ticker, i, g, l) AS (SELECT ticker, CAST(15 AS BIGINT), g, l FROM seed
  UNION ALL SELECT f.ticker, s.i, (f.g * 13 + greatest(s.ch, 0.0)) / 14, (f.l * 13 + greatest(-s.ch, 0.0)) / 14
  FROM fold f JOIN steps s ON s.ticker = f.ticker AND s.i = f.i + 1),
rsis AS (SELECT ticker, CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0::DOUBLE ELSE 50.0::DOUBLE END ELSE """ + r("100 - 100 / (1 + g / l)", 2) + """ END AS rsi_14
  FROM fold WHERE (ticker, i) IN (SELECT (ticker, max(i)) FROM steps GROUP BY ticker))"""


@query("win_rsi_wilder", "WITH RECURSIVE " + O.CLOSES + "," + _RSI + " SELECT ticker, rsi_14 FROM rsis")
def _(spark, d):
    return S.summarise(A.closes(spark, d), {"rsi_14": S.rsi()})


_BETA = f"""
shared AS (SELECT c.ticker, c.day, c.close, m.close AS index_close FROM closes c JOIN market m ON c.day = m.day),
lagged AS (SELECT *, lag(close) OVER w AS p, lag(index_close) OVER w AS ip FROM shared WINDOW w AS (PARTITION BY ticker ORDER BY day)),
stats AS (SELECT ticker, count(*) AS days, count(*) FILTER (WHERE p > 0 AND ip > 0) AS pairs, covar_pop(close / p - 1, index_close / ip - 1) AS cov, var_pop(index_close / ip - 1) AS var
  FROM lagged GROUP BY 1),
betas AS (SELECT ticker, days, pairs, CASE WHEN days >= 121 AND pairs >= 120 AND var <> 0 THEN {r("cov / var", 6)} END AS beta FROM stats)"""


@query("ts_beta", with_(O.CLOSES, O.MARKET, _BETA) + "SELECT ticker, days, pairs, beta FROM betas")
def _(spark, d):
    return S.beta(*A.closes_and_market(spark, d))


@query("join_benchmark", with_(O.CLOSES, O.MARKET, _BETA) + "SELECT ticker, day, close, index_close FROM shared")
def _(spark, d):
    return S.shared_days(*A.closes_and_market(spark, d))


@query("set_shared_days", CM + """SELECT ticker, count(*) AS shared_days, min(day) AS first_day, max(day) AS last_day FROM (
  SELECT ticker, day FROM closes WHERE day IN (SELECT day FROM market)) GROUP BY 1""")
def _(spark, d):
    return S.shared_days(*A.closes_and_market(spark, d)).groupBy("ticker").agg(
        F.count("*").alias("shared_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


_SINCE, _UNTIL = "2000-06-15", "2001-06-15"
_ASOF = f"""ends AS (SELECT ticker, max(day) FILTER (WHERE day <= DATE '{_SINCE}') AS start_day, arg_max(close, day) FILTER (WHERE day <= DATE '{_SINCE}') AS start_price,
  max(day) FILTER (WHERE day <= DATE '{_UNTIL}') AS end_day, arg_max(close, day) FILTER (WHERE day <= DATE '{_UNTIL}') AS end_price FROM closes GROUP BY 1)"""


@query("join_asof_price", with_(O.CLOSES, _ASOF) + "SELECT ticker, start_day, start_price, end_day, end_price FROM ends")
def _(spark, d):
    return S.price_change(A.closes(spark, d), _SINCE, _UNTIL).drop("change_pct")


@query("ts_price_change", with_(O.CLOSES, _ASOF) + f"""SELECT ticker, CASE WHEN start_day <> end_day AND start_price > 0 THEN {r("(end_price / start_price - 1) * 100", 4)} END AS change_pct FROM ends""")
def _(spark, d):
    return S.price_change(A.closes(spark, d), _SINCE, _UNTIL).select("ticker", "change_pct")


@query("ts_derived_metrics", "WITH RECURSIVE " + ",".join([O.CLOSES, O.MARKET, _BETA, _RSI]) + f""",
avgs AS (SELECT ticker, CASE WHEN count(*) >= 50 THEN {r("avg(close) FILTER (WHERE rn <= 50)", 4)} END AS a50, CASE WHEN count(*) >= 200 THEN {r("avg(close) FILTER (WHERE rn <= 200)", 4)} END AS a200,
  {_CHANGE(252)} AS c252, {_CHANGE(6)} AS c6 FROM closes GROUP BY 1),
wide AS (SELECT a.*, r.rsi_14, {r("b.beta", 4)} AS beta FROM avgs a LEFT JOIN rsis r ON a.ticker = r.ticker LEFT JOIN betas b ON b.ticker = a.ticker)
SELECT ticker, field, unit, numeric_value, text_value FROM (
  SELECT ticker, 'beta' AS field, 'ratio' AS unit, beta AS numeric_value, NULL AS text_value FROM wide
  UNION ALL SELECT ticker, 'rsi_14', 'rsi', rsi_14, NULL FROM wide
  UNION ALL SELECT ticker, 'rsi_14_signal', NULL, NULL, CASE WHEN rsi_14 <= 30 THEN 'oversold' WHEN rsi_14 >= 70 THEN 'overbought' WHEN rsi_14 IS NOT NULL THEN 'neutral' END FROM wide
  UNION ALL SELECT ticker, 'fiftyDayAverage', 'INR', a50, NULL FROM wide WHERE rsi_14 IS NOT NULL
  UNION ALL SELECT ticker, 'twoHundredDayAverage', 'INR', a200, NULL FROM wide WHERE rsi_14 IS NOT NULL
  UNION ALL SELECT ticker, 'fiftyTwoWeekChangePercent', 'percent', c252, NULL FROM wide WHERE rsi_14 IS NOT NULL
  UNION ALL SELECT ticker, 'price_chg_pct', 'percent', c6, NULL FROM wide WHERE rsi_14 IS NOT NULL) WHERE numeric_value IS NOT NULL OR text_value IS NOT NULL""")
def _(spark, d):
    observations, _issues = S.derived_metrics(*A.closes_and_market(spark, d))
    return observations


@query("agg_price_metrics", with_(O.CLOSES) + f"""SELECT ticker, arg_max(close, day) AS "currentPrice", max(close * 1.1::DOUBLE) AS "fiftyTwoWeekHigh", min(close / 1.1::DOUBLE) AS "fiftyTwoWeekLow",
  {r("avg(close) FILTER (WHERE rn <= 50)", 6)} AS "fiftyDayAverage", {r("avg(close) FILTER (WHERE rn <= 200)", 6)} AS "twoHundredDayAverage",
  (arg_max(close, day) / arg_min(close, day) - 1) * 100 AS "fiftyTwoWeekChangePercent", max(day) AS price_asof, max(day) >= DATE '2001-10-25' AS is_fresh
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS rn FROM day_close) GROUP BY 1""")
def _(spark, d):
    history = A.closes(spark, d, None).select(
        "ticker", "day", "close", (F.col("close") * 1.1).alias("high"), (F.col("close") / 1.1).alias("low")
    )
    return S.history_metrics(history, "2001-11-04")


@query("fn_rsi_signal", with_(O.CLOSES) + """SELECT ticker, day, CASE WHEN x <= 30 THEN 'oversold' WHEN x >= 70 THEN 'overbought' ELSE 'neutral' END AS signal
  FROM (SELECT ticker, day, CAST(CAST(floor(close) AS BIGINT) % 101 AS DOUBLE) AS x FROM closes)""")
def _(spark, d):
    x = (F.floor("close") % 101).cast("double")
    return A.closes(spark, d).select("ticker", "day", N.rsi_signal(x).alias("signal"))


@query("fn_finite", with_(O.CLOSES) + """SELECT ticker, day, CASE WHEN rn % 5 = 0 OR rn % 7 = 0 THEN NULL ELSE close END AS usable FROM closes""")
def _(spark, d):
    raw = F.when(F.col("rn") % 5 == 0, F.lit(float("nan"))).when(F.col("rn") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("close"))
    return A.closes(spark, d).select("ticker", "day", V.finite(raw).alias("usable"))
