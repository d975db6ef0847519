"""Reconciliation: validation, latest picks, conflict rules, current values (2.3, 2.4, 2.6, 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boursecraft import catalog as C
from boursecraft.functions import values as V
from boursecraft.operators import latest as L
from boursecraft.operators import maintain as T
from boursecraft.operators import reconcile as R
from boursecraft.operators.joins import attach
from boursecraft.plans import adapters as A
from boursecraft.plans import oracle as O
from boursecraft.plans.oracle import with_
from boursecraft.plans.registry import query
from boursecraft.plans.shared import new_folder, published


def run_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ranking runs as stored by the scoring job, all of them."""
    rows = published(spark, sf_dir, "run_rows", lambda: A.run_rows(spark, sf_dir))
    return A.runs(spark, sf_dir), A.ranked_stocks(rows)


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, ranked = run_tables(spark, sf_dir)
    files, rows = A.archive_tables(spark, sf_dir)
    return R.current_metrics(
        A.observations(spark, sf_dir), A.instruments(spark, sf_dir), A.AS_OF, runs, ranked, files, rows,
        A.ticker_aliases(spark, sf_dir),
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current metrics as published for readers."""
    return published(spark, sf_dir, "current_metrics", lambda: current(spark, sf_dir))


@query("flt_active_equities", with_(O.INST) + "SELECT instrument_id, ticker, exchange, isin, sector, kind FROM active")
def _(spark, d):
    return R.active_equities(A.instruments(spark, d)).select("instrument_id", "ticker", "exchange", "isin", "sector", "kind")


@query("val_normalise_percent", with_(O.OBS) + """SELECT id, field, numeric_value, text_value, unit, is_valid, issue_code FROM obs""")
def _(spark, d):
    obs = A.observations(spark, d)
    return obs.select("id", "field", "numeric_value", "text_value", "unit", "is_valid", F.get("issues", F.lit(0))["code"].alias("issue_code"))


@query("win_latest_per_provider", with_(O.OBS) + """SELECT instrument_id, field, provider, id, numeric_value, text_value, observed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument_id, field, provider ORDER BY observed_at DESC, id DESC) AS rn FROM obs) WHERE rn = 1 AND is_valid""")
def _(spark, d):
    cols = ["instrument_id", "field", "provider", "id", "numeric_value", "text_value", "observed_at", "is_valid"]
    return L.newest(A.observations(spark, d).select(*cols), ["instrument_id", "field", "provider"], valid="after").drop("is_valid")


@query("win_latest_valid", with_(O.OBS) + """SELECT instrument_id, field, provider, arg_max(numeric_value, (observed_at, id)) AS numeric_value,
  arg_max(id, (observed_at, id)) AS id FROM obs WHERE is_valid AND numeric_value IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    cols = ["instrument_id", "field", "provider", "id", "numeric_value", "observed_at", "is_valid"]
    rows = A.observations(spark, d).select(*cols).filter("numeric_value IS NOT NULL")
    return L.newest(rows, ["instrument_id", "field", "provider"], valid="before").drop("is_valid", "observed_at")


@query("win_latest_pe_eps", with_(O.OBS, O.CONFLICTS) + """SELECT instrument_id, pe_b AS bse_pe, pe_n AS nse_pe, eps FROM evidence
  WHERE pe_b IS NOT NULL OR pe_n IS NOT NULL OR eps_rows > 0""")
def _(spark, d):
    rows = R.evidence(A.observations(spark, d)).select("instrument_id", "bse_pe", "nse_pe", "eps")
    return rows.filter("bse_pe IS NOT NULL OR nse_pe IS NOT NULL OR eps IS NOT NULL")


@query("agg_filtered_max", with_(O.OBS, O.CONFLICTS) + "SELECT instrument_id, pe_b AS bse_pe, pe_n AS nse_pe FROM evidence WHERE pe_b IS NOT NULL OR pe_n IS NOT NULL")
def _(spark, d):
    return R.newest_multiples(A.observations(spark, d))


@query("rec_pe_unusable", with_(O.OBS, O.CONFLICTS) + "SELECT instrument_id FROM pe_out")
def _(spark, d):
    return R.pe_unusable(A.observations(spark, d))


@query("set_union_distinct", with_(O.OBS) + """SELECT DISTINCT instrument_id FROM obs WHERE (field = 'trailing_eps' AND numeric_value < 0)
  OR (field = 'book_value_sign' AND text_value = 'negative')""")
def _(spark, d):
    obs = A.observations(spark, d)
    losses = obs.filter("field = 'trailing_eps' AND numeric_value < 0").select("instrument_id")
    negative = obs.filter("field = 'book_value_sign' AND text_value = 'negative'").select("instrument_id")
    return losses.union(negative).distinct()


@query("rec_negative_equity", with_(O.OBS, O.CONFLICTS) + "SELECT instrument_id FROM findings WHERE insolvent")
def _(spark, d):
    return R.negative_equity(A.observations(spark, d))


@query("join_roe_pair", with_(O.OBS, O.CONFLICTS) + "SELECT instrument_id, roe_b AS bse_roe, roe_y AS yahoo_roe FROM findings WHERE roe_split")
def _(spark, d):
    return R.roe_pairs(A.observations(spark, d)).filter(R.disagrees(10.0, 2.0))


@query("rec_roe_conflict", with_(O.OBS, O.CONFLICTS) + "SELECT instrument_id FROM roe_disputed")
def _(spark, d):
    return R.roe_conflict(A.observations(spark, d))


@query("rec_roe_unusable", with_(O.OBS, O.CONFLICTS) + "SELECT instrument_id FROM roe_out")
def _(spark, d):
    return R.roe_unusable(A.observations(spark, d))


@query("join_not_exists", with_(O.OBS, O.CONFLICTS) + """SELECT instrument_id FROM findings n WHERE insolvent AND NOT EXISTS (
  SELECT 1 FROM obs o WHERE o.instrument_id = n.instrument_id AND o.provider = 'screener' AND o.field = 'roe_pct' AND o.is_valid)""")
def _(spark, d):
    obs = A.observations(spark, d)
    decided = obs.filter("provider = 'screener' AND field = 'roe_pct' AND is_valid").select("instrument_id")
    return R.negative_equity(obs).join(decided, "instrument_id", "left_anti")


@query("rec_roe_review", with_(O.OBS, O.CONFLICTS, O.INST) + """SELECT a.ticker, roe_b AS bse_roe, roe_y AS yahoo_roe, sign FROM active a JOIN evidence USING (instrument_id)
  WHERE sign = 'negative' OR (abs(roe_b) >= 3 AND abs(roe_y) >= 3 AND greatest(abs(roe_b), abs(roe_y)) / least(abs(roe_b), abs(roe_y)) > 4)""")
def _(spark, d):
    return R.roe_review(A.observations(spark, d), A.instruments(spark, d), ratio=4.0, minimum=3.0)


@query("flt_reporting_freshness", with_(O.OBS) + f"""SELECT id, field, provider, period_end FROM obs
  WHERE provider IN ('upstox_statements', 'upstox_shareholding') AND period_end <= DATE '{A.AS_OF}'
    AND date_diff('day', period_end, DATE '{A.AS_OF}') <= CASE WHEN provider = 'upstox_shareholding' OR field = 'earnings_quarterly_growth' OR field LIKE 'quarterly_%' THEN 200 ELSE 550 END""")
def _(spark, d):
    obs = A.observations(spark, d).filter(R.reporting_fresh(A.AS_OF))
    return obs.filter("provider IN ('upstox_statements', 'upstox_shareholding')").select("id", "field", "provider", "period_end")


@query("join_basis", with_(O.OBS, O.LIVE) + """SELECT u.instrument_id, u.provider, u.field, u.id, b.basis FROM usable u
  LEFT JOIN basis b ON b.instrument_id = u.instrument_id AND b.provider = u.provider AND b.metric = u.field WHERE right(u.field, 6) <> '_basis'""")
def _(spark, d):
    usable = R.newest_usable(A.observations(spark, d), A.AS_OF)
    return R.with_basis(usable).select("instrument_id", "provider", "field", "id", "basis")


@query("flt_live_eligibility", with_(O.OBS, O.LIVE) + "SELECT instrument_id, field, provider, id, numeric_value FROM eligible")
def _(spark, d):
    return R.eligible(A.observations(spark, d), A.AS_OF).select("instrument_id", "field", "provider", "id", "numeric_value")


_CANON = """SELECT instrument_id, field, numeric_value, text_value, unit, provider, observed_at FROM live"""


@query("win_canonical_priority", with_(O.OBS) + """SELECT instrument_id, field, provider, id, numeric_value FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, field ORDER BY
    CASE WHEN provider IN ('upstox_shareholding', 'upstox_statements') THEN 0 WHEN field = 'current_price' AND provider = 'upstox' THEN 0
         WHEN field IN ('roe_pct', 'roce_pct') AND provider = 'screener' THEN 0 WHEN field IN ('roe_pct', 'roce_pct') AND provider = 'upstox_fundamentals' THEN 1
         WHEN field = 'roe_pct' AND provider = 'bse' THEN 2 WHEN field = 'roe_pct' AND provider = 'yahoo_roe' THEN 3 ELSE 4 END, observed_at DESC, id DESC) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, field, provider ORDER BY observed_at DESC, id DESC) AS rn FROM obs) WHERE rn = 1 AND is_valid) WHERE pos = 1""")
def _(spark, d):
    cols = ["instrument_id", "field", "provider", "id", "numeric_value", "observed_at", "is_valid"]
    newest = L.newest(A.observations(spark, d).select(*cols), ["instrument_id", "field", "provider"], valid="after")
    return L.best_priority(newest, ["instrument_id", "field"], R.source_priority()).drop("observed_at", "is_valid")


@query("rec_live_metrics", with_(O.OBS, O.LIVE) + _CANON)
def _(spark, d):
    return R.live_metrics(A.observations(spark, d), A.AS_OF)


@query("prj_legacy_alias", with_(O.OBS, O.LIVE, O.ALIASED) + "SELECT * FROM aliased")
def _(spark, d):
    return R.legacy_aliases(R.live_metrics(A.observations(spark, d), A.AS_OF))


@query("win_latest_metric_global", with_(O.OBS) + """SELECT instrument_id, field, provider, id, numeric_value FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, field
  ORDER BY CASE provider WHEN 'nse' THEN 10 WHEN 'bse' THEN 10 WHEN 'upstox' THEN 30 WHEN 'alpha_vantage' THEN 40 WHEN 'fmp' THEN 50 WHEN 'yahoo' THEN 80 ELSE 1000 END,
  observed_at DESC, id DESC) AS rn FROM obs WHERE is_valid) WHERE rn = 1""")
def _(spark, d):
    rows = A.observations(spark, d).filter("is_valid").select("instrument_id", "field", "provider", "id", "numeric_value", "observed_at")
    order = L.lookup_priority("provider", C.LISTING_PRIORITY, C.DEFAULT_PRIORITY)
    return L.best_priority(rows, ["instrument_id", "field"], order).drop("observed_at")


_PRIO = "CASE provider " + " ".join(f"WHEN '{p}' THEN {n}" for p, n in C.PROVIDER_PRIORITY.items()) + " ELSE 1000 END"
_SELECTED = f"""sel AS (SELECT *, {_PRIO} AS priority FROM obs WHERE is_valid),
canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, field ORDER BY priority, observed_at DESC, id) AS rn FROM sel) WHERE rn = 1),
sides AS (SELECT instrument_id, max(numeric_value) FILTER (WHERE field = 'promoter_pct') AS promoter, max(numeric_value) FILTER (WHERE field = 'institutional_pct') AS institutional,
  max(priority) FILTER (WHERE field = 'promoter_pct') AS pp, max(priority) FILTER (WHERE field = 'institutional_pct') AS ip,
  max(id) FILTER (WHERE field = 'promoter_pct') AS pid, max(id) FILTER (WHERE field = 'institutional_pct') AS iid FROM canon GROUP BY 1),
rejected AS (SELECT instrument_id, promoter + institutional AS ownership_total, CASE WHEN pp > ip THEN 'promoter_pct' ELSE 'institutional_pct' END AS rejected_field,
  CASE WHEN pp > ip THEN pid ELSE iid END AS rejected_id FROM sides WHERE promoter + institutional > 100.5)"""


@query("win_select_canonical", with_(O.OBS, _SELECTED) + "SELECT instrument_id, field, provider, id, numeric_value, text_value FROM canon")
def _(spark, d):
    return R.select_canonical(A.observations(spark, d)).select("instrument_id", "field", "provider", "id", "numeric_value", "text_value")


@query("val_ownership_total", with_(O.OBS, _SELECTED) + """SELECT o.id, o.instrument_id, o.field, r.ownership_total, o.is_valid AND r.rejected_id IS NULL AS is_valid
  FROM obs o LEFT JOIN rejected r ON r.rejected_id = o.id WHERE o.field IN ('promoter_pct', 'institutional_pct')""")
def _(spark, d):
    obs = A.observations(spark, d)
    rejections = R.ownership_rejections(R.select_canonical(obs))
    marked = R.apply_ownership_rejections(obs, rejections).filter("field IN ('promoter_pct', 'institutional_pct')")
    totals = rejections.select(F.col("rejected_id").alias("id"), "ownership_total")
    return marked.join(totals, "id", "left").select("id", "instrument_id", "field", "ownership_total", "is_valid")


@query("join_in_view", with_(O.OBS, O.CONFLICTS, O.INST) + """SELECT id, instrument_id, field FROM obs WHERE instrument_id IN (SELECT instrument_id FROM active)
  AND instrument_id NOT IN (SELECT instrument_id FROM pe_out)""")
def _(spark, d):
    obs = A.observations(spark, d)
    return (
        obs.select("id", "instrument_id", "field")
        .join(R.active_equities(A.instruments(spark, d)).select("instrument_id"), "instrument_id", "left_semi")
        .join(R.pe_unusable(obs), "instrument_id", "left_anti")
    )


_SYM = with_(O.INST, O.ALIASES)


@query("set_union_symbols", _SYM + """SELECT instrument_id, ticker, exchange FROM active
  UNION ALL SELECT h.instrument_id, h.ticker, h.exchange FROM hist h JOIN active a ON a.instrument_id = h.instrument_id""")
def _(spark, d):
    return R.symbol_directory(A.instruments(spark, d), A.ticker_aliases(spark, d))


@query("join_alias_symbols", with_(O.INST, O.ALIASES, O.ARCHIVE) + """SELECT s.instrument_id, s.ticker, count(*) AS archived_rows
  FROM arows a JOIN symbols s ON s.ticker = upper(trim(a.a_ticker)) GROUP BY 1, 2""")
def _(spark, d):
    _files, rows = A.archive_tables(spark, d)
    symbols = R.symbol_directory(A.instruments(spark, d), A.ticker_aliases(spark, d)).select("ticker", "instrument_id")
    named = rows.select(V.ticker_norm(F.element_at("record", "ticker")).alias("ticker"))
    # counted per symbol before the join: one row per symbol is shuffled
    return named.groupBy("ticker").agg(F.count("*").alias("archived_rows")).join(symbols, "ticker").select("instrument_id", "ticker", "archived_rows")


@query("win_latest_file", with_(O.INST, O.ALIASES, O.ARCHIVE) + "SELECT source_path, content_sha256, modified AS source_modified_at FROM newest_files")
def _(spark, d):
    files, _rows = A.archive_tables(spark, d)
    return L.newest_files(files).select("source_path", "content_sha256", "source_modified_at")


@query("join_latest_source", with_(O.INST, O.ALIASES, O.ARCHIVE) + """SELECT a.source_path, a.content_sha256, a.row_number, a.a_price AS price
  FROM arows a JOIN newest_files f ON a.source_path = f.source_path AND a.content_sha256 = f.content_sha256""")
def _(spark, d):
    files, rows = A.archive_tables(spark, d)
    current_files = L.newest_files(files).select("source_path", "content_sha256")
    return attach(rows, current_files, ["source_path", "content_sha256"], "row_number").select(
        "source_path", "content_sha256", "row_number", F.element_at("record", "currentPrice").alias("price")
    )


_ARCHIVED = with_(O.INST, O.ALIASES, O.ARCHIVE)


@query("rec_archived", _ARCHIVED + "SELECT * FROM archived")
def _(spark, d):
    files, rows = A.archive_tables(spark, d)
    return R.archived_cells(files, rows, R.symbol_directory(A.instruments(spark, d), A.ticker_aliases(spark, d)))


@query("win_archive_newest", _ARCHIVED + "SELECT instrument_id, field, text_value, observed_at FROM archived WHERE field = 'note'")
def _(spark, d):
    files, rows = A.archive_tables(spark, d)
    cells = R.archived_cells(files, rows, R.symbol_directory(A.instruments(spark, d), A.ticker_aliases(spark, d)))
    return cells.filter("field = 'note'").select("instrument_id", "field", "text_value", "observed_at")


@query("rec_identity", with_(O.INST, O.IDENTITY) + "SELECT * FROM identity")
def _(spark, d):
    return R.identity_rows(A.instruments(spark, d))


@query("win_latest_run", with_(O.RUNS) + "SELECT run_id, n_orders FROM runs ORDER BY created_at DESC LIMIT 1")
def _(spark, d):
    runs = A.runs(spark, d)
    return runs.join(F.broadcast(L.newest_run(runs)), "run_id", "left_semi").select("run_id", "n_orders")


@query("win_prev_run", with_(O.RUNS) + "SELECT instrument_id, rank, score FROM ranked WHERE run_id = (SELECT run_id FROM runs ORDER BY created_at DESC LIMIT 1 OFFSET 1)")
def _(spark, d):
    runs, ranked = run_tables(spark, d)
    previous = L.recent_runs(runs, 2).filter("age = 2")
    return ranked.join(F.broadcast(previous), "run_id", "left_semi").select("instrument_id", "rank", "score")


@query("rec_ranked_kv", with_(O.RUNS, O.RANKED_KV) + "SELECT * FROM ranked_kv")
def _(spark, d):
    return R.ranked_rows(*run_tables(spark, d))


@query("join_lateral_kv", with_(O.RUNS, O.RANKED_KV) + "SELECT instrument_id, field, numeric_value FROM ranked_kv WHERE field IN ('g_quality', 'g_growth')")
def _(spark, d):
    runs, ranked = run_tables(spark, d)
    newest = ranked.join(F.broadcast(L.newest_run(runs)), "run_id", "left_semi")
    return newest.select("instrument_id", F.explode("factors").alias("field", "numeric_value"))


@query("set_union_all_layers", "WITH " + O.CURRENT + "\nSELECT origin, priority, field, count(*) AS cells, count(numeric_value) AS numeric_cells FROM layers GROUP BY 1, 2, 3")
def _(spark, d):
    runs, ranked = run_tables(spark, d)
    files, rows = A.archive_tables(spark, d)
    layers = R.all_layers(A.observations(spark, d), A.instruments(spark, d), A.AS_OF, runs, ranked, files, rows, A.ticker_aliases(spark, d))
    return layers.groupBy("origin", F.col("priority").cast("long").alias("priority"), "field").agg(
        F.count("*").alias("cells"), F.count("numeric_value").alias("numeric_cells")
    )


@query("win_merge_priority", "WITH " + O.CURRENT + "\nSELECT instrument_id, field, provider, origin FROM current")
def _(spark, d):
    return current(spark, d).select("instrument_id", "field", "provider", "origin")


@query("rec_current_metrics", "WITH " + O.CURRENT + "\nSELECT * FROM current")
def _(spark, d):
    return current(spark, d)


@query("rec_current_incremental", "WITH " + O.CURRENT + "\nSELECT * FROM current")
def _(spark, d):
    """The last week's observations applied to the stored result of all others."""
    runs, ranked = run_tables(spark, d)
    files, rows = A.archive_tables(spark, d)
    obs, root = A.observations(spark, d), new_folder(spark, "current")
    last = F.col("observed_at") >= F.lit(A.AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(7))
    others = (A.instruments(spark, d), A.AS_OF, runs, ranked, files, rows, A.ticker_aliases(spark, d))
    T.build(root, obs.filter(~F.coalesce(last, F.lit(False))), *others, buckets=16)
    T.apply(root, obs.filter(last), *others, buckets=16)
    return T.read_current(spark, root)


@query("join_pivot_observations", "WITH " + O.CURRENT + "\nSELECT a.ticker, c.field, c.numeric_value, c.text_value, c.origin FROM current c JOIN active a USING (instrument_id)")
def _(spark, d):
    named = R.active_equities(A.instruments(spark, d)).select("instrument_id", "ticker")
    return stored(spark, d).join(named, "instrument_id").select("ticker", "field", "numeric_value", "text_value", "origin")


_PIVOT_NUM = ("current_price", "currentPrice", "roe_pct", "returnOnEquity", "trailing_pe", "promoter_pct", "rank", "final_score")
_PIVOT_TEXT = ("shortName", "sector", "score_status")


@query("rec_pivot_stocks", "WITH " + O.CURRENT + """\nSELECT a.ticker, """
       + ", ".join(f"max(numeric_value) FILTER (WHERE field = '{f}') AS \"{f}\"" for f in _PIVOT_NUM) + ", "
       + ", ".join(f"max(coalesce(CAST(numeric_value AS VARCHAR), text_value)) FILTER (WHERE field = '{f}') AS \"{f}\"" for f in _PIVOT_TEXT)
       + f""", string_agg(concat(field, '=', origin), ',' ORDER BY field) AS origins
  FROM current c JOIN active a USING (instrument_id) WHERE field IN ({O.sql_list(_PIVOT_NUM + _PIVOT_TEXT)})
  AND (numeric_value IS NOT NULL OR text_value IS NOT NULL) GROUP BY 1""")
def _(spark, d):
    wide = R.pivot_stocks(stored(spark, d), A.instruments(spark, d), _PIVOT_NUM, _PIVOT_TEXT)
    pairs = F.transform(F.map_entries("field_origins"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return wide.withColumn("origins", F.array_join(pairs, ",")).drop("field_origins")


@query("rec_field_timestamps", "WITH " + O.CURRENT + "\nSELECT a.ticker, c.field, c.observed_at FROM current c JOIN active a USING (instrument_id) WHERE a.ticker = 'CUSTOMER000000002'")
def _(spark, d):
    return R.field_timestamps(stored(spark, d), R.active_equities(A.instruments(spark, d)), "CUSTOMER000000002")


@query("agg_origin_counts", "WITH " + O.CURRENT + "\nSELECT origin, count(*) AS cells, count(DISTINCT field) AS fields FROM current GROUP BY 1")
def _(spark, d):
    return stored(spark, d).groupBy("origin").agg(F.count("*").alias("cells"), F.count_distinct("field").alias("fields"))


@query("agg_payload_meta", "WITH " + O.CURRENT + """\nSELECT max(observed_at) AS latest_source_at, count(DISTINCT instrument_id) AS stocks, count(DISTINCT field) AS fields,
  string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM current""")
def _(spark, d):
    return stored(spark, d).agg(
        F.max("observed_at").alias("latest_source_at"),
        F.count_distinct("instrument_id").alias("stocks"),
        F.count_distinct("field").alias("fields"),
        F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"),
    )


@query("agg_provider_freshness", with_(O.OBS) + """SELECT provider, max(observed_at) AS last_observed, count(*) FILTER (WHERE is_valid) AS valid_rows, count(*) AS n_rows FROM obs GROUP BY 1""")
def _(spark, d):
    return A.observations(spark, d).groupBy("provider").agg(
        F.max("observed_at").alias("last_observed"), F.count_if("is_valid").alias("valid_rows"), F.count("*").alias("n_rows")
    )


@query("val_ownership_record", with_(O.FUND) + """SELECT ticker, CASE WHEN promoter_pct BETWEEN 0 AND 100 THEN promoter_pct END AS promoter_pct,
  CASE WHEN coalesce(p + institutional_pct > 100.5, false) THEN NULL ELSE institutional_pct END AS institutional_pct,
  CASE WHEN n_issues > 0 THEN 'review' ELSE 'valid' END AS quality_status, n_issues
  FROM (SELECT *, CAST((CASE WHEN promoter_pct NOT BETWEEN 0 AND 100 THEN 1 ELSE 0 END) + (CASE WHEN "heldPercentInsiders" NOT BETWEEN 0 AND 1 THEN 1 ELSE 0 END)
     + (CASE WHEN "heldPercentInstitutions" NOT BETWEEN 0 AND 1 THEN 1 ELSE 0 END) + (CASE WHEN p + institutional_pct > 100.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_issues
    FROM (SELECT *, CASE WHEN promoter_pct BETWEEN 0 AND 100 THEN promoter_pct END AS p FROM fund))""")
def _(spark, d):
    cleaned = R.clean_record(A.fundamentals(spark, d))
    return cleaned.select("ticker", "promoter_pct", "institutional_pct", "quality_status", F.size("quality_issues").cast("long").alias("n_issues"))
