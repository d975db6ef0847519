"""Filters, summaries, top-k, comparison and quality queries (2.3, 2.5, 2.7, 2.8, 2.13)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boursecraft import catalog as C
from boursecraft.functions import values as V
from boursecraft.operators import compare as M
from boursecraft.operators import explore as X
from boursecraft.operators import latest as L
from boursecraft.operators import quality as D
from boursecraft.operators import reconcile as R
from boursecraft.operators import scoring as S
from boursecraft.operators.postings import build_postings
from boursecraft.plans import adapters as A
from boursecraft.plans import oracle as O
from boursecraft.plans import score_sql as Q
from boursecraft.plans.oracle import r, with_
from boursecraft.plans.registry import query
from boursecraft.plans.shared import published

SC = with_(O.FUND, Q.SCORED)
FL = with_(O.FUND, Q.SCORED, Q.FLAGGED)
MC = '"marketCap" / 10000000.0::DOUBLE'


def ranking(spark: SparkSession, d: str) -> DataFrame:
    """The published ranking run: every scored stock with its inputs and patterns."""
    return published(spark, d, "ranking", lambda: M.pattern_flags(S.score_universe(A.fundamentals(spark, d))))


def prev_cur(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return stored_run(spark, d, 2), stored_run(spark, d, 1)


def stored_run(spark: SparkSession, d: str, age: int) -> DataFrame:
    """A ranking run as stored, 1 for the newest: comparisons read stored runs, they never rank again."""
    rows = published(spark, d, "run_rows", lambda: A.run_rows(spark, d))
    one = L.recent_runs(A.runs(spark, d), age).filter(F.col("age") == age)
    return rows.join(F.broadcast(one), "run_id", "left_semi").drop("run_id")


RUN = with_(O.PREV, O.CUR)

# ---- filters ---------------------------------------------------------------------------------------


@query("flt_search", SC + """SELECT ticker, "shortName", sector, rank FROM scored WHERE (contains(lower(ticker), 'ring') OR contains(lower("shortName"), 'ring'))
  AND sector = 'SMALL' AND coalesce(data_cov, 0) >= 70 ORDER BY rank NULLS LAST, instrument_id LIMIT 100""")
def _(spark, d):
    rows = ranking(spark, d)
    return X.search(rows, "RING", "SMALL", 70.0, 100, build_postings(rows)).select("ticker", "shortName", "sector", "rank")


@query("flt_explorer", SC + """SELECT ticker, "trailingPE" FROM scored WHERE (contains(lower(ticker), 'bolt') OR contains(lower("shortName"), 'bolt'))
  AND coalesce(data_cov, 0) >= 50 ORDER BY "trailingPE" DESC NULLS LAST, instrument_id LIMIT 25 OFFSET 25""")
def _(spark, d):
    return X.explorer(ranking(spark, d), "bolt", min_coverage=50.0, key="trailingPE", descending=True, page=2, page_size=25).select("ticker", "trailingPE")


@query("flt_dashboard", SC + f"""SELECT ticker, final_score FROM scored WHERE contains(lower(concat_ws(' ', ticker, "shortName")), 't1') AND coalesce(final_score, 0) >= 45
  AND coalesce({MC}, 0) >= 2000 AND data_cov >= 60 AND {Q.CHEAP}""")
def _(spark, d):
    rows = ranking(spark, d).withColumn("mcap_cr", F.col("marketCap") / C.CRORE)
    return X.dashboard_filter(rows, "t1", "", 45.0, 2000.0, 60.0, True).select("ticker", "final_score")


@query("flt_fresh_tickers", with_(O.OBS, O.INST) + f"""SELECT ticker FROM inst WHERE instrument_id IN (SELECT instrument_id FROM obs
  WHERE provider = 'screener' AND observed_at > TIMESTAMP '{A.AS_OF}' - INTERVAL 12 DAY)""")
def _(spark, d):
    return X.fresh_tickers(A.raw_observations(spark, d), A.instruments(spark, d), "screener", A.AS_OF, 12)


@query("flt_enrich_targets", with_(O.FUND, Q.derived(), Q.coverage()) + """SELECT ticker, data_cov, quality_cov, valuation_cov FROM cov WHERE data_cov < 80 OR quality_cov < 40 OR valuation_cov < 40
  ORDER BY data_cov, quality_cov, valuation_cov, instrument_id LIMIT 60""")
def _(spark, d):
    cov = S.with_coverage(S.derive_factors(A.fundamentals(spark, d)))
    return X.enrichment_targets(cov, 80.0, 60).select("ticker", "data_cov", "quality_cov", "valuation_cov")


@query("flt_stale_refresh", f"""SELECT count(*) AS cached_rows, CAST(epoch(TIMESTAMP '{A.AS_OF}') - epoch(max(ts)) AS DOUBLE) / 86400 >= 0.5 AS refresh FROM events""")
def _(spark, d):
    return X.needs_refresh(A.table(spark, d, "events"), "ts", A.AS_OF, 0.5).select("cached_rows", "refresh")


@query("flt_min_mcap", with_(O.FUND) + f"""SELECT ticker, {MC} AS mcap_cr FROM fund WHERE {MC} >= 5000 AND "currentPrice" IS NOT NULL""")
def _(spark, d):
    return X.above_market_cap(A.fundamentals(spark, d), 5000.0).select("ticker", "mcap_cr")


_SCREEN_SRC = {
    "mcap_cr": '"marketCap" / 10000000', "roe": '"returnOnEquity" * 100', "roe_5y": '"returnOnEquity" * 90', "roce": '"ebitdaMargins" * 120',
    "debt_to_equity": '"debtToEquity" / 300', "interest_cover": '"currentRatio" * 5', "opm": '"ebitdaMargins" * 100',
    "profit_growth_5y": '"earningsGrowth" * 100', "profit_growth_3y": '"earningsGrowth" * 90', "sales_growth_5y": '"revenueGrowth" * 100',
    "promoter": '"promoter_pct"', "pledged": 'CAST("instrument_id" % 6 AS DOUBLE)', "promoter_change_3y": '"delivery_trend"',
    "price": '"currentPrice"', "high": '"fiftyTwoWeekHigh" * 1.3', "low": '"fiftyTwoWeekLow"', "pe": '"trailingPE"', "industry_pe": "CAST(30 AS DOUBLE)",
    "pb": '"priceToBook"', "dividend_yield": '"dividendYield"',
}


def _preset_sql() -> str:
    src = ", ".join(f"{e.replace(' * 1.3', ' * 1.3::DOUBLE')} AS {n}" for n, e in _SCREEN_SRC.items())
    fixed = {n: e.replace("D *", "::DOUBLE *") for n, e in X.SCREEN_PRESETS.items()}
    flags = ", ".join(f"coalesce({e}, false) AS passes_{n}" for n, e in fixed.items())
    return with_(O.FUND, f"s AS (SELECT ticker, {src} FROM fund)") + f"SELECT ticker, {flags} FROM s"


@query("flt_screen_presets", _preset_sql())
def _(spark, d):
    src = A.fundamentals(spark, d).select("ticker", *[F.expr(e.replace('"', "`").replace("1.3", "1.3D")).alias(n) for n, e in _SCREEN_SRC.items()])
    return X.screen_flags(src).select("ticker", *[f"passes_{n}" for n in X.SCREEN_PRESETS])


# ---- summaries ---------------------------------------------------------------------------------------


def mean(col: str, digits: int = 1) -> str:
    return f"CAST(sum(CAST(round_even({col} * {10 ** digits}, 0) AS BIGINT)) AS DOUBLE) / {float(10 ** digits)} / count({col})"


@query("agg_sector_summary", SC + f"""SELECT sector, count(*) AS n, {mean("final_score")} AS avg_score, arg_min(ticker, (coalesce(rank, 4611686018427387904), instrument_id)) AS top FROM scored WHERE sector IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""")
def _(spark, d):
    return X.sector_summary(ranking(spark, d))


@query("agg_sector_scores", SC + f"SELECT sector, {mean('final_score')} AS avg_score, count(*) AS n FROM scored WHERE sector <> '' AND final_score IS NOT NULL GROUP BY 1")
def _(spark, d):
    return X.sector_scores(ranking(spark, d))


@query("agg_sector_concentration", SC + f"""SELECT sector, cs_count, total, {r("CAST(cs_count AS DOUBLE) / total * 100", 0)} AS pct FROM (
  SELECT coalesce(nullif(sector, ''), 'Unknown') AS sector, count(*) FILTER (WHERE {Q.CHEAP}) AS cs_count, count(*) AS total FROM scored GROUP BY 1)""")
def _(spark, d):
    return X.sector_concentration(ranking(spark, d))


_CHG = f"""chg AS (SELECT c.*, p.rank - c.rank AS rank_chg, CASE WHEN p."currentPrice" > 0 AND c."currentPrice" <> 0 THEN
  {r('(c."currentPrice" - p."currentPrice") / p."currentPrice" * 100', 1)} END AS price_chg_pct FROM cur c LEFT JOIN prev p ON p.ticker = c.ticker)"""
CHG = with_(O.PREV, O.CUR, _CHG)


def changes(spark: SparkSession, d: str) -> DataFrame:
    return M.rank_and_price_change(*prev_cur(spark, d))


@query("cmp_rank_change", CHG + "SELECT ticker, rank_chg, price_chg_pct FROM chg")
def _(spark, d):
    return changes(spark, d).select("ticker", "rank_chg", "price_chg_pct")


@query("agg_sector_weekly", CHG + f"""SELECT coalesce(nullif(c_mktsegment, ''), 'Unknown') AS sector, {mean("price_chg_pct")} AS avg_chg, count(*) AS n FROM chg JOIN customer ON c_custkey = instrument_id
  WHERE price_chg_pct IS NOT NULL GROUP BY 1""")
def _(spark, d):
    named = A.table(spark, d, "customer").select(F.col("c_custkey").alias("instrument_id"), F.col("c_mktsegment").alias("sector"))
    return X.sector_weekly(changes(spark, d).join(named, "instrument_id"))


@query("topk_movers", CHG + """SELECT ticker, price_chg_pct, direction, position FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY abs(price_chg_pct) DESC, instrument_id) AS position FROM (
  SELECT *, CASE WHEN price_chg_pct > 5 THEN 'gainer' WHEN price_chg_pct < -5 THEN 'faller' END AS direction FROM chg) WHERE direction IS NOT NULL) WHERE position <= 10""")
def _(spark, d):
    return X.top_movers(changes(spark, d)).select("ticker", "price_chg_pct", "direction", F.col("position").cast("long").alias("position"))


def _bands_sql(bands) -> str:
    rows = []
    for label, low, high in bands:
        cond = ["final_score IS NOT NULL"] + ([f"final_score >= {low}"] if low is not None else []) + ([f"final_score < {high}"] if high is not None else [])
        rows.append(f"SELECT '{label}' AS band, count(*) FILTER (WHERE {' AND '.join(cond)}) AS n FROM scored")
    return SC + " UNION ALL ".join(rows)


@query("agg_score_bands", _bands_sql(X.LEGACY_BANDS))
def _(spark, d):
    return X.score_bands(ranking(spark, d), X.LEGACY_BANDS)


@query("agg_score_bands_web", _bands_sql(X.WEB_BANDS))
def _(spark, d):
    return X.score_bands(ranking(spark, d), X.WEB_BANDS)


@query("agg_median", SC + "SELECT median(data_cov) AS median_coverage FROM scored")
def _(spark, d):
    return X.median_coverage(ranking(spark, d))


@query("agg_stats", FL + f"""SELECT count(final_score) AS ranked, count(*) AS total, count(*) FILTER (WHERE {Q.CHEAP}) AS cheap_strong, {r(mean("final_score"), 1)} AS avg_score,
  count(*) FILTER (WHERE pat_accum) AS accum, count(*) FILTER (WHERE pat_near_low) AS near_low, count(*) FILTER (WHERE pat_trap) AS traps,
  arg_min(ticker, (rank, instrument_id)) FILTER (WHERE final_score IS NOT NULL) AS top_pick FROM flagged""")
def _(spark, d):
    return X.headline_stats(ranking(spark, d))


@query("agg_review_count", with_(O.FUND) + """SELECT count(*) FILTER (WHERE promoter_pct NOT BETWEEN 0 AND 100 OR "heldPercentInsiders" NOT BETWEEN 0 AND 1 OR "heldPercentInstitutions" NOT BETWEEN 0 AND 1
  OR CASE WHEN promoter_pct BETWEEN 0 AND 100 THEN promoter_pct END + institutional_pct > 100.5) AS review_count FROM fund""")
def _(spark, d):
    return R.clean_record(A.fundamentals(spark, d)).agg(F.count_if(F.col("quality_status") == "review").alias("review_count"))


_MOVE = """CASE WHEN o.ticker IS NULL AND n.ticker IS NOT NULL THEN 'added' WHEN o.ticker IS NOT NULL AND n.ticker IS NULL THEN 'removed'
  WHEN o.rank IS NULL AND n.rank IS NOT NULL THEN 'newly ranked' WHEN o.rank IS NOT NULL AND n.rank IS NULL THEN 'became unranked'
  WHEN o.rank IS NULL AND n.rank IS NULL THEN 'unranked' WHEN o.rank > n.rank THEN 'up' WHEN o.rank < n.rank THEN 'down' ELSE 'unchanged' END"""
_CMP = with_(O.PREV, O.CUR, f"""cmp AS (SELECT n.ticker, o.rank - n.rank AS rank_vs_staged, {r("n.final_score - o.final_score", 1)} AS score_vs_staged, {_MOVE} AS movement_vs_staged
  FROM cur n LEFT JOIN prev o ON o.ticker = n.ticker)""")


@query("cmp_movement", _CMP + "SELECT * FROM cmp")
def _(spark, d):
    return M.movement(*prev_cur(spark, d))


@query("agg_movement_counts", _CMP + "SELECT movement_vs_staged, count(*) AS n FROM cmp GROUP BY 1")
def _(spark, d):
    return M.movement(*prev_cur(spark, d)).groupBy("movement_vs_staged").agg(F.count("*").alias("n"))


@query("join_run_diff", RUN + "SELECT n.ticker, n.rank AS new_rank, o.rank AS old_rank, o.ticker IS NOT NULL AS had_previous FROM cur n LEFT JOIN prev o ON o.ticker = n.ticker")
def _(spark, d):
    prev, cur = prev_cur(spark, d)
    old = prev.select("ticker", F.col("rank").alias("old_rank"), F.lit(True).alias("seen"))
    return cur.join(old, "ticker", "left").select("ticker", F.col("rank").alias("new_rank"), "old_rank", F.col("seen").isNotNull().alias("had_previous"))


_PUSH = O.run_cte("push", 2)
R3 = with_(O.PREV, O.CUR, _PUSH)


def _pair(o: str, n: str, suffix: str) -> str:
    label = _MOVE.replace("o.", f"{o}.").replace("n.", f"{n}.")
    score = r(f"{n}.final_score - {o}.final_score", 2)
    return f"{o}.rank - {n}.rank AS rank_{suffix}, {score} AS score_{suffix}, {label} AS movement_{suffix}"


@query("cmp_three_snapshots", R3 + f"""SELECT coalesce(cur.ticker, prev.ticker, push.ticker) AS ticker, {_pair("prev", "cur", "vs_staged")}, {_pair("push", "prev", "staged_vs_pushed")}, {_pair("push", "cur", "vs_pushed")}
  FROM cur FULL JOIN prev ON prev.ticker = cur.ticker FULL JOIN push ON push.ticker = coalesce(cur.ticker, prev.ticker)""")
def _(spark, d):
    prev, cur = prev_cur(spark, d)
    return M.three_snapshots(cur, prev, stored_run(spark, d, 3))


@query("join_three_way", R3 + """SELECT coalesce(cur.ticker, prev.ticker, push.ticker) AS ticker, cur.rank AS current_rank, prev.rank AS staged_rank, push.rank AS pushed_rank
  FROM cur FULL JOIN prev ON prev.ticker = cur.ticker FULL JOIN push ON push.ticker = coalesce(cur.ticker, prev.ticker)""")
def _(spark, d):
    prev, cur = prev_cur(spark, d)
    sides = [df.select("ticker", F.col("rank").alias(n)) for df, n in ((cur, "current_rank"), (prev, "staged_rank"), (stored_run(spark, d, 3), "pushed_rank"))]
    return sides[0].join(sides[1], "ticker", "full").join(sides[2], "ticker", "full")


@query("sort_keyed_order", R3 + """SELECT coalesce(cur.ticker, prev.ticker, push.ticker) AS ticker, coalesce(CAST(cur.rank AS DOUBLE), prev.rank + 1e9, push.rank + 2e9) AS sort_key
  FROM cur FULL JOIN prev ON prev.ticker = cur.ticker FULL JOIN push ON push.ticker = coalesce(cur.ticker, prev.ticker)""")
def _(spark, d):
    prev, cur = prev_cur(spark, d)
    return M.keyed_order(cur, prev, stored_run(spark, d, 3))


_SNAP = f"""snap AS (SELECT coalesce(n.ticker, o.ticker) AS ticker, CASE WHEN o.ticker IS NULL THEN 'new_only' WHEN n.ticker IS NULL THEN 'prev_only' ELSE 'both' END AS side,
  n.rank AS nr, o.rank AS pr, o.rank - n.rank AS d_rank, n.final_score - o.final_score AS d_score, (n."currentPrice" / o."currentPrice" - 1) * 100 AS d_price_pct,
  n.pct_below_52w_high - o.pct_below_52w_high AS d_draw, n.delivery_trend AS nd, o.delivery_trend AS pd FROM cur n FULL JOIN prev o ON o.ticker = n.ticker)"""
SNAP = with_(O.PREV, O.CUR, _SNAP)


@query("join_snapshot_full", SNAP + "SELECT ticker, side, d_rank, d_score, d_price_pct, d_draw FROM snap")
def _(spark, d):
    return M.snapshot_join(*prev_cur(spark, d)).select("ticker", "side", "d_rank", "d_score", "d_price_pct", "d_draw")


_SECT = f"""sect AS (
  SELECT 'new_top' AS section, ticker, CAST(nr AS DOUBLE) AS sort_value, false AS capped FROM snap WHERE nr <= 25 AND (pr > 25 OR pr IS NULL)
  UNION ALL SELECT 'dropped_top', ticker, CAST(pr AS DOUBLE), false FROM snap WHERE pr <= 25 AND (nr > 25 OR nr IS NULL)
  UNION ALL SELECT 'price_moves', ticker, -abs(d_price_pct), true FROM snap WHERE side = 'both' AND abs(d_price_pct) >= 15
  UNION ALL SELECT 'rank_up', ticker, CAST(-d_rank AS DOUBLE), true FROM snap WHERE side = 'both' AND d_rank >= 25
  UNION ALL SELECT 'rank_down', ticker, CAST(d_rank AS DOUBLE), true FROM snap WHERE side = 'both' AND d_rank <= -25
  UNION ALL SELECT 'drawdown', ticker, -d_draw, true FROM snap WHERE side = 'both' AND d_draw >= 10
  UNION ALL SELECT 'delivery_flips', ticker, -abs(nd), true FROM snap WHERE side = 'both' AND ((pd < 0 AND nd >= 5) OR (pd > 0 AND nd <= -5))
  UNION ALL SELECT 'added', ticker, coalesce(CAST(nr AS DOUBLE), 1e18), true FROM snap WHERE side = 'new_only'
  UNION ALL SELECT 'removed', ticker, coalesce(CAST(pr AS DOUBLE), 1e18), true FROM snap WHERE side = 'prev_only'),
posed AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY sort_value, ticker) AS position FROM sect)"""


@query("cmp_sections", with_(O.PREV, O.CUR, _SNAP, _SECT) + "SELECT section, ticker, sort_value, position FROM posed WHERE NOT capped OR position <= 15")
def _(spark, d):
    return M.change_sections(*prev_cur(spark, d)).withColumn("position", F.col("position").cast("long"))


@query("topk_sections", with_(O.PREV, O.CUR, _SNAP, _SECT) + "SELECT section, count(*) AS n FROM posed WHERE NOT capped OR position <= 15 GROUP BY 1")
def _(spark, d):
    return M.change_sections(*prev_cur(spark, d)).groupBy("section").agg(F.count("*").alias("n"))


@query("set_added_removed", RUN + """SELECT ticker, 'added' AS change FROM cur WHERE ticker NOT IN (SELECT ticker FROM prev)
  UNION ALL SELECT ticker, 'removed' FROM prev WHERE ticker NOT IN (SELECT ticker FROM cur)""")
def _(spark, d):
    prev, cur = prev_cur(spark, d)
    added = cur.join(prev.select("ticker"), "ticker", "left_anti").select("ticker", F.lit("added").alias("change"))
    removed = prev.join(cur.select("ticker"), "ticker", "left_anti").select("ticker", F.lit("removed").alias("change"))
    return added.unionByName(removed)


@query("agg_run_summary", SC + "SELECT count(*) AS universe, count(rank) AS ranked, count(*) - count(rank) AS unranked FROM scored")
def _(spark, d):
    return ranking(spark, d).agg(F.count("*").alias("universe"), F.count("rank").alias("ranked"), (F.count("*") - F.count("rank")).alias("unranked"))


@query("set_distinct_sectors", with_(O.FUND) + "SELECT DISTINCT sector FROM fund WHERE sector IS NOT NULL ORDER BY 1")
def _(spark, d):
    return A.fundamentals(spark, d).select("sector").filter("sector IS NOT NULL").distinct().orderBy("sector")


# ---- top-k ------------------------------------------------------------------------------------------


@query("topk_ranked", SC + "SELECT ticker, rank, final_score FROM scored WHERE rank IS NOT NULL ORDER BY rank LIMIT 20")
def _(spark, d):
    return X.top_ranked(ranking(spark, d), 20).select("ticker", "rank", "final_score")


@query("pat_flags", FL + "SELECT ticker, range_position_pct, pat_accum, pat_trap, pat_near_low FROM flagged")
def _(spark, d):
    return M.pattern_flags(S.score_universe(A.fundamentals(spark, d))).select("ticker", "range_position_pct", "pat_accum", "pat_trap", "pat_near_low")


@query("pat_cheap_strong", SC + f"SELECT ticker, {Q.CHEAP} AS cheap_strong FROM scored")
def _(spark, d):
    return ranking(spark, d).select("ticker", M.cheap_and_strong().alias("cheap_strong"))


_PATTERNS = """pats AS (SELECT ticker, final_score, pattern, row_number() OVER (PARTITION BY pattern ORDER BY ov, instrument_id) AS position FROM (
  SELECT *, 'accum' AS pattern, -coalesce(final_score, 0) AS ov FROM flagged WHERE pat_accum UNION ALL SELECT *, 'near_low', -coalesce(final_score, 0) FROM flagged WHERE pat_near_low
  UNION ALL SELECT *, 'trap', coalesce(final_score, 100) FROM flagged WHERE pat_trap))"""


@query("topk_patterns", with_(O.FUND, Q.SCORED, Q.FLAGGED, _PATTERNS) + "SELECT ticker, final_score, pattern, position FROM pats WHERE position <= 10")
def _(spark, d):
    return X.top_patterns(ranking(spark, d)).select("ticker", "final_score", "pattern", F.col("position").cast("long").alias("position"))


@query("topk_value_traps", SC + "SELECT ticker, pct_below_52w_high, g_quality, delivery_trend FROM scored WHERE pct_below_52w_high >= 40 AND g_quality <= 35 ORDER BY delivery_trend NULLS LAST, instrument_id LIMIT 15")
def _(spark, d):
    return X.value_trap_watch(ranking(spark, d)).select("ticker", "pct_below_52w_high", "g_quality", "delivery_trend")


@query("sort_nulls_last", SC + """SELECT ticker, "pegRatio", row_number() OVER (ORDER BY "pegRatio" DESC NULLS LAST, instrument_id) AS position FROM scored""")
def _(spark, d):
    rows = ranking(spark, d).select("instrument_id", "ticker", "pegRatio")
    return X.positions(rows, [F.desc_nulls_last("pegRatio"), F.asc("instrument_id")]).select("ticker", "pegRatio", "position")


@query("topk_issue_page", with_(O.OBS) + "SELECT id, issue_code AS code, field, (SELECT count(*) FROM obs WHERE issue_code IS NOT NULL) AS total FROM obs WHERE issue_code IS NOT NULL ORDER BY id LIMIT 200")
def _(spark, d):
    return D.issue_page(A.observations(spark, d), 200).select("id", "code", "field", "total")


@query("dq_issues", with_(O.OBS) + "SELECT id, instrument_id, provider, issue_code AS code, field FROM obs WHERE issue_code IS NOT NULL")
def _(spark, d):
    return D.flattened_issues(A.observations(spark, d)).select("id", "instrument_id", "provider", "code", "field")


@query("rep_insights", with_(O.FUND, Q.SCORED, Q.FLAGGED, _PATTERNS, O.PREV, O.CUR, _CHG) + f"""SELECT 'mover:' || direction AS item, least(count(*), 10) AS n FROM (
    SELECT CASE WHEN price_chg_pct > 5 THEN 'gainer' WHEN price_chg_pct < -5 THEN 'faller' END AS direction FROM chg JOIN customer ON c_custkey = instrument_id) WHERE direction IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'week:' || coalesce(nullif(c_mktsegment, ''), 'Unknown'), count(*) FROM chg JOIN customer ON c_custkey = instrument_id WHERE price_chg_pct IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'pattern:' || pattern AS item, count(*) AS n FROM pats WHERE position <= 10 GROUP BY 1
  UNION ALL SELECT 'sector:' || sector, count(*) FILTER (WHERE {Q.CHEAP}) FROM scored GROUP BY 1
  UNION ALL """ + " UNION ALL ".join(f"SELECT 'band:{label}', count(*) FILTER (WHERE final_score >= {lo} AND final_score < {hi}) FROM scored" for label, lo, hi in X.LEGACY_BANDS))
def _(spark, d):
    named = A.table(spark, d, "customer").select(F.col("c_custkey").alias("instrument_id"), F.col("c_mktsegment").alias("sector"))
    bundle = X.insights(ranking(spark, d), changes(spark, d).join(named, "instrument_id"))
    parts = [
        bundle["patterns"].groupBy(F.concat(F.lit("pattern:"), "pattern").alias("item")).agg(F.count("*").alias("n")),
        bundle["concentration"].select(F.concat(F.lit("sector:"), "sector").alias("item"), F.col("cs_count").alias("n")),
        bundle["bands"].select(F.concat(F.lit("band:"), "band").alias("item"), "n"),
        bundle["movers"].groupBy(F.concat(F.lit("mover:"), "direction").alias("item")).agg(F.count("*").alias("n")),
        bundle["sector_weekly"].select(F.concat(F.lit("week:"), "sector").alias("item"), "n"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


# ---- quality ------------------------------------------------------------------------------------------

GAP_FIELDS = ["shortName", "sector", "trailingPE", "pegRatio", "earningsGrowth", "earningsQuarterlyGrowth", "debtToEquity", "currentRatio", "ebitdaMargins",
              "targetMeanPrice", "recommendationMean", "forwardEps", "dividendYield", "beta", "institutions_count", "returnOnEquity", "priceToBook"]


def _reason_sql(f: str) -> str:
    name = D._static_name(f)
    lender = "coalesce(lower(trim(sector)) = 'financial services', false)"
    if name in C.DESCRIPTIVE_FIELDS:
        return "'descriptive'"
    if name in ("trailing_pe", "forward_pe"):
        rest = """CASE WHEN "trailingEps" IS NULL THEN 'unknown' WHEN "trailingEps" <= 0 THEN 'undefined' ELSE 'recoverable' END"""
    elif name == "peg_ratio":
        rest = """CASE WHEN "trailingEps" <= 0 OR "earningsGrowth" <= 0 THEN 'undefined' WHEN "trailingEps" IS NULL OR "earningsGrowth" IS NULL THEN 'unknown' ELSE 'recoverable' END"""
    elif name in ("earnings_growth", "earnings_quarterly_growth"):
        rest = """CASE WHEN "profitMargins" IS NULL THEN 'unknown' WHEN "profitMargins" <= 0 THEN 'undefined' ELSE 'recoverable' END"""
    else:
        rest = "'recoverable'"
    if name in C.ANALYST_FIELDS:
        rest = "'analyst'"
    return f"CASE WHEN {lender} THEN 'not_applicable' ELSE {rest} END" if name in C.LENDER_GAP_FIELDS else rest


_GAPS = "gaps AS (" + " UNION ALL ".join(f"""SELECT ticker, '{f}' AS field, {_reason_sql(f)} AS reason FROM fund WHERE "{f}" IS NULL{" OR trim(" + chr(34) + f + chr(34) + ") = ''" if f in ("shortName", "sector") else ""}""" for f in GAP_FIELDS) + ")"
GAPS = with_(O.FUND, _GAPS)


@query("dq_explain_gap", GAPS + "SELECT ticker, field, reason FROM gaps")
def _(spark, d):
    return D.gaps(A.fundamentals(spark, d), GAP_FIELDS)


@query("dq_gaps_for_ticker", GAPS + "SELECT field, reason FROM gaps WHERE ticker = 'T41'")
def _(spark, d):
    return D.gaps(A.fundamentals(spark, d).filter("ticker = 'T41'"), GAP_FIELDS).select("field", "reason")


_NAMED = ("recommendationMean", "shortName", "upside_pct", "trailingPE", "sector", "numberOfAnalystOpinions", "forwardEps", "ticker")
_NAMED_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMED) + "]"


@query("dq_classify_field", with_(O.OBS) + f""", n AS (SELECT field FROM obs UNION ALL SELECT {_NAMED_SQL}[c_custkey % 8 + 1] FROM customer),
  known(field, reason) AS (VALUES ('recommendationMean', 'analyst'), ('shortName', 'descriptive'), ('upside_pct', 'analyst'), ('sector', 'descriptive'), ('numberOfAnalystOpinions', 'analyst'), ('forwardEps', 'analyst'), ('ticker', 'descriptive'))
  SELECT field, coalesce(reason, 'recoverable') AS reason, count(*) AS n FROM n LEFT JOIN known USING (field) GROUP BY 1, 2""")
def _(spark, d):
    names = F.array(*map(F.lit, _NAMED))
    named = A.table(spark, d, "customer").select(F.get(names, (F.col("c_custkey") % 8).cast("int")).alias("field"))
    counted = A.raw_observations(spark, d).select("field").unionByName(named).groupBy("field").agg(F.count("*").alias("n"))
    return counted.select("field", D.classify(F.col("field")).alias("reason"), "n")


_SUMMARY = GAPS + f"""SELECT stocks, stocks * {len(GAP_FIELDS)} AS cells, stocks * {len(GAP_FIELDS)} - blanks AS filled, {", ".join(f"gaps_{x}" for x in C.GAP_REASONS)},
  {r(f"(1 - CAST(blanks AS DOUBLE) / (stocks * {len(GAP_FIELDS)})) * 100", 2)} AS raw_coverage_pct, ob AS obtainable_cells, {r("(1 - CAST(gaps_recoverable AS DOUBLE) / ob) * 100", 3)} AS obtainable_coverage_pct, gaps_unknown AS unclassified_gaps
  FROM (SELECT *, stocks * {len(GAP_FIELDS)} - gaps_analyst - gaps_not_applicable - gaps_undefined - gaps_descriptive - gaps_unknown AS ob FROM (
    SELECT (SELECT count(*) FROM fund) AS stocks, count(*) AS blanks, {", ".join(f"count(*) FILTER (WHERE reason = '{x}') AS gaps_{x}" for x in C.GAP_REASONS)} FROM gaps))"""


@query("dq_coverage_summary", _SUMMARY)
def _(spark, d):
    return D.coverage_summary(A.fundamentals(spark, d), GAP_FIELDS)


@query("agg_coverage_summary", GAPS + "SELECT reason, count(*) AS n FROM gaps GROUP BY 1")
def _(spark, d):
    return D.gaps(A.fundamentals(spark, d), GAP_FIELDS).groupBy("reason").agg(F.count("*").alias("n"))


def detail_sql(column: str) -> str:
    e = f"coalesce({column}, '')"
    for pattern, token in V.DETAIL_FOLDS:
        e = f"regexp_replace({e}, '{pattern}', '{token}', 'g')"
    return f"substring(trim({e}), 1, {V.DETAIL_LENGTH})"


@query("fn_normalise_detail", f"SELECT doc_id, {detail_sql('text')} AS detail FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", V.normalise_detail("text").alias("detail"))


_TALLY = f"""keyed AS (SELECT source AS kind, {detail_sql("text")} AS detail, text AS message, CAST(doc_id AS VARCHAR) AS subject, doc_id AS seq FROM documents
  UNION ALL SELECT concat('http_', event_type), {detail_sql("concat('timed out after ', CAST(CAST(floor(value) AS INT) AS VARCHAR), 's at http://host/', CAST(user_id AS VARCHAR))")},
    concat('timed out after ', CAST(CAST(floor(value) AS INT) AS VARCHAR), 's at http://host/', CAST(user_id AS VARCHAR)), CAST(user_id AS VARCHAR), event_id FROM events),
counts AS (SELECT kind, detail, count(*) AS n, arg_min(message, seq) AS first_message, min(seq) AS first_seq FROM keyed GROUP BY 1, 2),
ex AS (SELECT kind, detail, string_agg(subject, ', ' ORDER BY seq) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY kind, detail ORDER BY seq) AS p FROM (
  SELECT kind, detail, subject, min(seq) AS seq FROM keyed GROUP BY 1, 2, 3)) WHERE p <= 5 GROUP BY 1, 2)"""


def tally(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").select(
        F.col("source").alias("kind"), F.col("text").alias("message"), F.col("doc_id").cast("string").alias("subject"), F.col("doc_id").alias("seq")
    )
    ev = A.table(spark, d, "events").select(
        F.concat(F.lit("http_"), "event_type").alias("kind"),
        F.concat(F.lit("timed out after "), F.floor("value").cast("string"), F.lit("s at http://host/"), F.col("user_id").cast("string")).alias("message"),
        F.col("user_id").cast("string").alias("subject"), F.col("event_id").alias("seq"),
    )
    return D.failure_tally(docs.unionByName(ev))


@query("agg_failure_tally", with_(_TALLY) + "SELECT c.kind, c.detail, n, first_message, first_seq, examples FROM counts c LEFT JOIN ex e ON e.kind = c.kind AND e.detail = c.detail")
def _(spark, d):
    return tally(spark, d)


@query("agg_failure_summary", with_(_TALLY, """loud AS (SELECT * FROM counts ORDER BY n DESC, first_seq LIMIT 3)""") + """SELECT concat((SELECT string_agg(concat(CAST(n AS VARCHAR), 'x ', kind, CASE WHEN detail <> '' THEN concat(' (', detail, ')') ELSE '' END), '; ' ORDER BY n DESC, first_seq) FROM loud),
  CASE WHEN (SELECT count(*) FROM counts) > 3 THEN concat('; and ', CAST((SELECT count(*) FROM counts) - 3 AS VARCHAR), ' other kind(s)') ELSE '' END) AS summary""")
def _(spark, d):
    return D.tally_summary(tally(spark, d))


@query("agg_enrich_summary", with_(O.FUND, Q.derived(), Q.coverage()) + f"SELECT {mean('data_cov')} AS mean_coverage, min(data_cov) AS min_coverage, count(*) FILTER (WHERE data_cov < 60) AS below_60, count(*) AS n FROM cov")
def _(spark, d):
    return X.coverage_stats(S.with_coverage(S.derive_factors(A.fundamentals(spark, d))))
