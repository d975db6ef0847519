"""Scoring queries (2.12) and the rank operators under them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boursecraft import catalog as C
from boursecraft.operators import latest as L  # noqa: F401
from boursecraft.operators import reconcile as R
from boursecraft.operators import scoring as S
from boursecraft.operators.ranks import ordinal_rank, percentile_ranks
from boursecraft.plans import adapters as A
from boursecraft.plans import oracle as O
from boursecraft.plans import score_sql as Q
from boursecraft.plans.oracle import r, with_
from boursecraft.plans.registry import query
from boursecraft.session import materialise

GROUP_COLS = [f"g_{g}" for g in C.GROUPS]
SCORED = with_(O.FUND, Q.SCORED)
OUT = ["ticker", "rank", "data_cov", "quality_cov", "valuation_cov", *GROUP_COLS, "model_score", "final_score", "score_status"]
DERIVED = ["roe_pct", "ebitda_margin", "pct_below_52w_high", "px_vs_50dma", "px_vs_200dma", "upside_pct", "fwd_eps_growth",
           "returnOnAssets", "promoter_pct", "institutional_pct", "trailingPE", "priceToBook", "pegRatio", "enterpriseToEbitda"]


def quoted(cols) -> str:
    return ", ".join(f'"{c}"' for c in cols)


def stocks(spark: SparkSession, d: str) -> DataFrame:
    """The stock records, stored: scoring reads them for the ranks and for the result."""
    return materialise(A.fundamentals(spark, d), "stocks")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return S.score_universe(A.fundamentals(spark, d))


@query("sc_derive_factors", with_(O.FUND, Q.derived()) + f"SELECT ticker, {quoted(DERIVED)} FROM der")
def _(spark, d):
    return S.derive_factors(A.fundamentals(spark, d)).select("ticker", *DERIVED)


@query("sc_derive_factors_legacy", with_(O.FUND, Q.derived(legacy=True)) + f"SELECT ticker, {quoted(DERIVED)} FROM der")
def _(spark, d):
    return S.derive_factors(A.fundamentals(spark, d), legacy=True).select("ticker", *DERIVED)


@query("sc_applicability", with_(O.FUND) + "SELECT sector, " + ", ".join(f'bool_and({Q.applicable(m)}) AS "{m}"' for m in C.NOT_APPLICABLE_TO_LENDERS + ("trailingPE",)) + " FROM fund GROUP BY 1")
def _(spark, d):
    metrics = C.NOT_APPLICABLE_TO_LENDERS + ("trailingPE",)
    return A.fundamentals(spark, d).groupBy("sector").agg(*[F.bool_and(S.applicable(m)).alias(m) for m in metrics])


@query("sc_coverage", with_(O.FUND, Q.derived(), Q.coverage()) + "SELECT ticker, data_cov, quality_cov, valuation_cov FROM cov")
def _(spark, d):
    return S.with_coverage(S.derive_factors(A.fundamentals(spark, d))).select("ticker", "data_cov", "quality_cov", "valuation_cov")


@query("sc_coverage_pre", with_(O.FUND, Q.derived(legacy=True), Q.coverage()) + "SELECT ticker, data_cov, quality_cov, valuation_cov FROM cov")
def _(spark, d):
    return S.with_coverage(S.derive_factors(A.fundamentals(spark, d), legacy=True)).select("ticker", "data_cov", "quality_cov", "valuation_cov")


@query("sc_coverage_count", with_(O.FUND) + "SELECT ticker, " + r("CAST(" + " + ".join(f'CAST(("{c}" IS NOT NULL) AS INT)' for c in C.COVERAGE_INPUTS) + f" AS DOUBLE) / {len(C.COVERAGE_INPUTS)} * 100", 0) + " AS coverage FROM fund")
def _(spark, d):
    df = A.fundamentals(spark, d)
    return df.select("ticker", S.input_coverage(df).alias("coverage"))


def _dash_sql() -> str:
    tests = {
        "fwd_eps_growth": '(coalesce("trailingEps" > 0, false) AND "forwardEps" IS NOT NULL)',
        "px_vs_50dma": '("currentPrice" IS NOT NULL AND "fiftyDayAverage" IS NOT NULL)',
        "px_vs_200dma": '("currentPrice" IS NOT NULL AND "twoHundredDayAverage" IS NOT NULL)',
        "upside_pct": '("targetMeanPrice" IS NOT NULL AND "currentPrice" IS NOT NULL)',
        "rsi14": "false", "roe_pct": "false", "pct_below_52w_high": "false",
    }
    shares = {}
    for g, ms in C.COVERAGE_GROUPS.items():
        ok = [f"NOT {Q.LENDER}" if m in C.COVERAGE_NOT_APPLICABLE else "true" for m in ms]
        present = " + ".join(f"CAST(({a} AND {tests.get(m, chr(34) + m + chr(34) + ' IS NOT NULL')}) AS INT)" for a, m in zip(ok, ms))
        possible = " + ".join(f"CAST(({a}) AS INT)" for a in ok)
        shares[g] = f"(CAST({present} AS DOUBLE) / ({possible}) * 100)"
    total = sum(C.WEIGHTS.values())
    weighted = "(" + " + ".join(f"{Q.d(C.WEIGHTS[g])} * {shares[g]}" for g in C.COVERAGE_GROUPS) + f") / {Q.d(total)}"
    return f"SELECT ticker, {r(weighted, 1)} AS data_cov, {r(shares['quality'], 1)} AS quality_cov, {r(shares['valuation'], 1)} AS valuation_cov FROM fund"


@query("sc_coverage_dashboard", with_(O.FUND) + _dash_sql())
def _(spark, d):
    df = A.fundamentals(spark, d)
    return df.select("ticker", *[c.alias(n) for n, c in S.dashboard_coverage(df).items()])


_ARCH = ("CASE WHEN k % 3 = 0 THEN 'archive' ELSE 'observation' END")


@query("flt_fields_by_archive", "WITH " + O.CURRENT + "\nSELECT instrument_id, field, origin FROM current WHERE NOT (origin = 'archive' AND field NOT IN ('sector', 'industry', 'shortName'))")
def _(spark, d):
    from boursecraft.plans.q_reconcile import stored

    return S.drop_archive_values(stored(spark, d)).select("instrument_id", "field", "origin")


@query("win_pct_rank", with_(O.FUND) + f"""SELECT ticker, {Q.pct("trailingPE", -1, value='"trailingPE"')} AS pe_pct, {Q.pct("dividendYield", 1, value='"dividendYield"')} AS yield_pct FROM fund""")
def _(spark, d):
    df = A.fundamentals(spark, d)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(s).alias("sign")) for m, s in (("trailingPE", -1), ("dividendYield", 1))])
    long = materialise(df.select("ticker", F.inline(cells)), "metrics")
    pct = percentile_ranks(long, ["metric", "sign"], F.col("sign"))
    scored = long.join(pct, ["metric", "sign", "value"], "left")
    return scored.groupBy("ticker").agg(
        F.max(F.when(F.col("metric") == "trailingPE", F.col("pct"))).alias("pe_pct"),
        F.max(F.when(F.col("metric") == "dividendYield", F.col("pct"))).alias("yield_pct"),
    )


@query("win_ordinal_rank", with_(O.FUND) + """SELECT ticker, "dividendYield" AS score, CASE WHEN "dividendYield" IS NOT NULL THEN
  row_number() OVER (PARTITION BY "dividendYield" IS NULL ORDER BY "dividendYield" DESC, instrument_id) END AS rank FROM fund""")
def _(spark, d):
    df = A.fundamentals(spark, d).select("instrument_id", "ticker", F.col("dividendYield").alias("score"))
    df = materialise(df, "scores")
    ranks = ordinal_rank(df.filter("score IS NOT NULL"), ["score"], "instrument_id").select("instrument_id", "rank")
    return df.join(ranks, "instrument_id", "left").drop("instrument_id")


@query("sc_group_scores", SCORED + f"SELECT ticker, {quoted(GROUP_COLS)} FROM scored")
def _(spark, d):
    return S.with_groups(S.derive_factors(stocks(spark, d))).select("ticker", *GROUP_COLS)


_OV = {"quality": 4.0, "momentum": 0.0}


@query("sc_model_score", with_(O.FUND, Q.derived(), Q.coverage(overrides=_OV), Q.percentiles(), Q.groups(), Q.final(overrides=_OV)) + "SELECT ticker, model_score FROM scored")
def _(spark, d):
    overrides = S.parse_overrides("quality=4, momentum=0")
    grouped = S.with_groups(S.derive_factors(stocks(spark, d)))
    return grouped.select("ticker", S.model_score(S.normalised_weights(overrides)).alias("model_score"))


@query("sc_final_score", SCORED + "SELECT ticker, final_score, score_status FROM scored")
def _(spark, d):
    return S.score_factors(S.derive_factors(stocks(spark, d))).select("ticker", "final_score", "score_status")


@query("sc_rank", SCORED + "SELECT ticker, final_score, rank FROM scored")
def _(spark, d):
    return scored(spark, d).select("ticker", "final_score", "rank")


@query("sc_score_universe", SCORED + f"SELECT {quoted(OUT)} FROM scored")
def _(spark, d):
    return scored(spark, d).select(*OUT)


@query("sc_score_universe_legacy", with_(O.FUND, Q.SCORED_LEGACY) + f"SELECT {quoted(OUT)} FROM scored")
def _(spark, d):
    return S.score_universe(A.fundamentals(spark, d), legacy=True, min_mcap_cr=1000.0).select(*OUT)


_COLW_SRC = {
    "roce": '"returnOnAssets"', "ret_6m": '"fiftyTwoWeekChangePercent"', "pe": '"trailingPE"', "roe": '"returnOnEquity"',
    "qtr_profit_var": '"earningsQuarterlyGrowth"', "roe_5yr": '"ebitdaMargins"', "qtr_sales_var": '"revenueGrowth"',
    "cmp_bv": '"priceToBook"', "mcap_cr": '"marketCap"', "div_yld": '"dividendYield"',
}


def _colw_sql() -> str:
    src = ", ".join(f"{e} AS {c}" for c, e in _COLW_SRC.items())
    pcts = ", ".join(f"{Q.pct(c, s, value=c)} AS p_{c}" for c, (_, s) in C.COLUMN_WEIGHTS.items())
    score = "(" + " + ".join(f"{Q.d(w)} * p_{c}" for c, (w, _) in C.COLUMN_WEIGHTS.items()) + ") * 100"
    groups = ", ".join(r("(" + " + ".join(f"p_{c}" for c in m) + f") / {len(m)} * 100", 0) + f' AS "s_{g}"' for g, m in C.COLUMN_GROUPS.items())
    return with_(O.FUND, f"src AS (SELECT instrument_id, {src} FROM fund)", f"p AS (SELECT instrument_id, {pcts} FROM src)") + f"SELECT instrument_id, {score} AS final_score, {groups} FROM p"


@query("sc_column_weights", _colw_sql())
def _(spark, d):
    df = A.fundamentals(spark, d).select("instrument_id", *[F.expr(e.replace('"', "`")).alias(c) for c, e in _COLW_SRC.items()])
    return S.column_weight_scores(df, "instrument_id")


def lens_sql() -> str:
    parts = []
    for name, ov in C.LENSES.items():
        parts.append(f"SELECT * REPLACE ({Q.data_cov(ov)} AS data_cov), '{name}' AS lens, {Q.model(ov)} AS model_score FROM grp")
    return ",".join([Q.derived(), Q.coverage(), Q.percentiles(), Q.groups()]) + ",\nlens_m AS (" + "\nUNION ALL ".join(parts) + f""" ),
lens_f AS (SELECT *, {Q.STATUS} AS score_status, CASE WHEN {Q.STATUS} = 'ranked' THEN {r("50 + (model_score - 50) * (data_cov / 100)", 1)} END AS final_score FROM lens_m),
lenses AS (SELECT *, CASE WHEN final_score IS NOT NULL THEN row_number() OVER (PARTITION BY lens, final_score IS NULL ORDER BY final_score DESC, model_score DESC, instrument_id) END AS rank FROM lens_f)"""


def lenses(spark: SparkSession, d: str) -> DataFrame:
    return S.lens_scores(lens_input(spark, d))


def lens_input(spark: SparkSession, d: str) -> DataFrame:
    return S.with_groups(S.with_coverage(S.derive_factors(stocks(spark, d))))


@query("sc_lenses", with_(O.FUND, lens_sql()) + "SELECT lens, ticker, rank, final_score, data_cov FROM lenses")
def _(spark, d):
    return lenses(spark, d).select("lens", "ticker", "rank", "final_score", "data_cov")


@query("topk_per_lens", with_(O.FUND, lens_sql()) + "SELECT lens, ticker, rank, final_score FROM lenses WHERE rank <= 10")
def _(spark, d):
    from boursecraft.operators.explore import top_per_lens

    return top_per_lens(S.lens_values(lens_input(spark, d))).select("lens", "ticker", "rank", "final_score")


def _what_if_sql() -> str:
    rows = ", ".join(f"('{n}', {i}, CAST({'NULL' if a is None else a} AS DOUBLE), CAST({'NULL' if b is None else b} AS DOUBLE))" for i, (n, (a, b)) in enumerate(C.SCENARIOS.items()))
    pcts = ", ".join(f'{Q.pct(m, s, part="scenario", value=chr(34) + m + chr(34))} AS "p_{m}"' for m, s in C.DIRECTIONS.items())
    gs = ", ".join(r("(" + " + ".join(f'coalesce("p_{m}", 0.5::DOUBLE)' for m, _ in ms) + f") / {len(ms)} * 100", 1) + f" AS g_{g}" for g, ms in C.GROUPS.items())
    return with_(O.FUND, Q.derived(out="der0", legacy=True), f"scen(scenario, no, eg, qg) AS (VALUES {rows})",
                 """der AS (SELECT d.* REPLACE (CASE WHEN ticker = 'T5' THEN eg ELSE "earningsGrowth" END AS "earningsGrowth",
                    CASE WHEN ticker = 'T5' THEN qg ELSE "earningsQuarterlyGrowth" END AS "earningsQuarterlyGrowth"), scenario, no FROM der0 d, scen WHERE "currentPrice" IS NOT NULL)""",
                 f"pcts AS (SELECT *, {pcts} FROM der)", f"grp AS (SELECT *, {gs} FROM pcts)",
                 f"m AS (SELECT *, {Q.model()} AS final_score FROM grp)",
                 "rk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY final_score DESC, instrument_id) AS rank FROM m)",
                 "mine AS (SELECT * FROM rk WHERE ticker = 'T5')") + f"""SELECT scenario, g_growth, final_score, rank,
                 {r("final_score - (SELECT final_score FROM mine WHERE no = 0)", 1)} AS d_score, (SELECT rank FROM mine WHERE no = 0) - rank AS d_rank FROM mine"""


@query("sc_what_if", _what_if_sql())
def _(spark, d):
    return S.what_if(A.fundamentals(spark, d), "T5")


def _pts(rules) -> str:
    return "coalesce(CASE " + " ".join(f"WHEN {c} THEN {p}" for c, p in rules) + " END, 0)"


def _why(parts) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in parts) + ")"


def _w(e: str) -> str:
    return f"CAST(CAST(round_even({e}, 0) AS BIGINT) AS VARCHAR)"


_SCREEN = with_(O.FUND, """s AS (SELECT *, ("fiftyTwoWeekHigh" - "currentPrice") / "fiftyTwoWeekHigh" * 100 AS o FROM fund WHERE "currentPrice" IS NOT NULL)""") + "SELECT ticker, CAST(" + " + ".join([
    _pts([("o >= 30", 3), ("o >= 20", 2), ("o >= 12", 1)]),
    _pts([('"returnOnEquity" >= 0.18', 3), ('"returnOnEquity" >= 0.12', 2), ('"returnOnEquity" < 0', -2)]),
    _pts([('"debtToEquity" < 50', 2), ('"debtToEquity" < 100', 1), ('"debtToEquity" > 200', -2)]),
    _pts([('"profitMargins" >= 0.15', 2), ('"profitMargins" > 0', 1), ('"profitMargins" <= 0', -2)]),
    _pts([('"earningsGrowth" >= 0.15', 2), ('"earningsGrowth" > 0', 1), ('"earningsGrowth" < -0.10', -1)]),
    _pts([('"revenueGrowth" >= 0.10', 1)]), _pts([('"trailingPE" > 0 AND "trailingPE" < 18', 1)]), _pts([('"priceToBook" > 0 AND "priceToBook" < 3', 1)]),
]) + " AS BIGINT) AS score, " + _why([
    ("o >= 20", f"concat({_w('o')}, '% below 52w high')"), ('"returnOnEquity" >= 0.18', "concat('ROE ', " + _w('"returnOnEquity" * 100') + ", '%')"),
    ('"debtToEquity" < 50', "concat('low D/E ', " + _w('"debtToEquity"') + ")"), ('"profitMargins" >= 0.15', "concat('margin ', " + _w('"profitMargins" * 100') + ", '%')"),
    ('"earningsGrowth" >= 0.15', "concat('earnings +', " + _w('"earningsGrowth" * 100') + ", '%')"), ('"revenueGrowth" >= 0.10', "concat('rev +', " + _w('"revenueGrowth" * 100') + ", '%')"),
    ('"trailingPE" > 0 AND "trailingPE" < 18', "concat('PE ', " + _w('"trailingPE"') + ")"),
]) + " AS reasons FROM s"


@query("sc_points_screen", _SCREEN)
def _(spark, d):
    return S.points_screen(A.fundamentals(spark, d)).select("ticker", F.col("score").cast("long").alias("score"), "reasons")


_DEALS_SQL = """dl AS (SELECT *, CAST("institutions_count" AS BIGINT) % 5 AS nb, CAST("institutions_count" AS BIGINT) % 3 AS ns, instrument_id % 700 AS bq, instrument_id % 500 AS sq, 7 AS base FROM fund)"""
_OWN = with_(O.FUND, _DEALS_SQL, """own AS (SELECT *, coalesce(nb, 0) > coalesce(ns, 0) AND bq > sq AS buying, coalesce(ns, 0) > coalesce(nb, 0) AND sq > bq AS selling FROM dl)""") + "SELECT ticker, CAST(" + " + ".join([
    _pts([("avg_delivery_pct >= 60", 2), ("avg_delivery_pct >= 45", 1)]), _pts([("delivery_trend >= 5", 2), ("delivery_trend <= -5", -1)]), _pts([("buying", 3), ("selling", -2)])]) + """ AS BIGINT) AS ownership_score,
  CAST(7 + """ + " + ".join([_pts([("avg_delivery_pct >= 60", 2), ("avg_delivery_pct >= 45", 1)]), _pts([("delivery_trend >= 5", 2), ("delivery_trend <= -5", -1)]), _pts([("buying", 3), ("selling", -2)])]) + " AS BIGINT) AS combined_score, " + _why([
    ("avg_delivery_pct >= 60", "concat('high delivery ', CAST(avg_delivery_pct AS VARCHAR), '%')"), ("delivery_trend >= 5", "concat('delivery rising +', CAST(delivery_trend AS VARCHAR))"),
    ("buying", "concat('net institutional BUY (', CAST(nb AS VARCHAR), ' funds)')"), ("NOT buying AND selling", "concat('institutional SELLING (', CAST(ns AS VARCHAR), ' funds)')")]) + " AS ownership_reasons FROM own"


@query("sc_ownership_points", _OWN)
def _(spark, d):
    df = A.fundamentals(spark, d).withColumns(
        {
            "n_inst_buy": F.col("institutions_count").cast("long") % 5, "n_inst_sell": F.col("institutions_count").cast("long") % 3,
            "deal_buy_qty": F.col("instrument_id") % 700, "deal_sell_qty": F.col("instrument_id") % 500, "score": F.lit(7),
        }
    )
    out = S.ownership_points(df)
    return out.select("ticker", F.col("ownership_score").cast("long").alias("ownership_score"), F.col("combined_score").cast("long").alias("combined_score"), "ownership_reasons")


_SHARE = with_(O.FUND) + "SELECT ticker, CAST(" + " + ".join([
    _pts([("promoter_pct >= 50", 2), ("promoter_pct >= 40", 1)]), _pts([("institutional_pct >= 40", 2), ("institutional_pct >= 25", 1)]), _pts([("institutions_count >= 250", 1)])]) + " AS BIGINT) AS shareholding_score, " + _why([
    ("promoter_pct >= 50", "concat('strong promoter ', CAST(promoter_pct AS VARCHAR), '%')"), ("promoter_pct >= 40 AND promoter_pct < 50", "concat('promoter ', CAST(promoter_pct AS VARCHAR), '%')"),
    ("promoter_pct >= 75", "'⚠ very high promoter = low float'"), ("institutional_pct >= 40", "concat('high institutional ', CAST(institutional_pct AS VARCHAR), '%')"),
    ("institutional_pct >= 25 AND institutional_pct < 40", "concat('institutional ', CAST(institutional_pct AS VARCHAR), '%')"),
    ("institutions_count >= 250", "concat(CAST(CAST(floor(institutions_count) AS BIGINT) AS VARCHAR), ' institutions')")]) + " AS shareholding_reasons FROM fund"


@query("sc_shareholding_points", _SHARE)
def _(spark, d):
    out = S.shareholding_points(A.fundamentals(spark, d))
    return out.select("ticker", F.col("shareholding_score").cast("long").alias("shareholding_score"), "shareholding_reasons")
