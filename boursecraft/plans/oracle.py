"""The same adapters as SQL, for the engine that checks the results."""

from __future__ import annotations

from boursecraft import catalog as C
from boursecraft.plans import adapters as A


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def r(expr: str, digits: int) -> str:
    """Half-even rounding on the scaled double."""
    return f"(round_even(({expr}) * {10**digits}, 0) / {float(10**digits)})"


RAW_OBS = f"""
raw_obs AS (
  SELECT event_id AS id, user_id AS instrument_id, field, {A.OBS_NUMERIC} AS numeric_value,
         {A.OBS_TEXT} AS text_value, unit0 AS unit, provider, ts AS observed_at,
         CASE WHEN provider IN ('upstox_statements', 'upstox_shareholding')
              THEN CAST(CAST(ts AS DATE) - CAST(k * 8 AS INT) AS DATE) END AS period_end, k
  FROM (SELECT *, {A.OBS_PROVIDER} AS provider, {A.OBS_FIELD} AS field, {A.OBS_UNIT} AS unit0
        FROM (SELECT *, {A.OBS_K} AS k FROM events)))"""

OBS = RAW_OBS + f""",
obs AS (
  SELECT id, instrument_id, field,
         CASE WHEN pct AND ok THEN {r("scaled", 6)} ELSE numeric_value END AS numeric_value,
         CASE WHEN pct AND ok THEN NULL ELSE text_value END AS text_value,
         CASE WHEN pct AND ok THEN 'percent' ELSE unit END AS unit,
         provider, observed_at, period_end,
         NOT (pct AND (NOT ok OR (field IN ({sql_list(C.OWNERSHIP_FIELDS)}) AND (scaled < 0 OR scaled > 100)))) AS is_valid,
         CASE WHEN pct AND numeric_value IS NULL THEN 'not_numeric'
              WHEN pct AND NOT ok THEN 'unexpected_unit'
              WHEN pct AND field IN ({sql_list(C.OWNERSHIP_FIELDS)}) AND (scaled < 0 OR scaled > 100) THEN 'percent_out_of_range'
         END AS issue_code
  FROM (SELECT *, field IN ({sql_list(C.PERCENT_FIELDS)}) AS pct,
               numeric_value IS NOT NULL AND unit IN ('fraction', 'percent') AS ok,
               CASE WHEN unit = 'fraction' THEN numeric_value * 100 ELSE numeric_value END AS scaled
        FROM raw_obs))"""

INST = "inst AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in A.INST_COLUMNS.items()) + """,
         TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
active AS (SELECT * FROM inst WHERE kind = 'EQUITY' AND active)"""

ALIASES = """hist AS (SELECT c_custkey AS instrument_id, concat('OLD', CAST(c_custkey AS VARCHAR)) AS ticker,
  'NSE' AS exchange FROM customer WHERE c_nationkey = 7)"""

_ORD = "(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
CLOSES = f"""
day_close AS (
  SELECT l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS day,
         arg_max(l_extendedprice / l_quantity, {_ORD}) AS close
  FROM lineitem GROUP BY 1, 2),
closes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day DESC) AS rn FROM day_close) WHERE rn <= 260)"""
MARKET = f"""
market AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY day DESC) AS rn FROM (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS day,
         arg_max(l_extendedprice / l_quantity, {_ORD}) AS close
  FROM lineitem GROUP BY 1)) WHERE rn <= 260)"""

FACTS = """
facts AS (
  SELECT p.*, p_partkey AS k, p_retailprice AS price, f.n, f.q, f.rev, f.disc, f.tax
  FROM part p JOIN (
    SELECT l_partkey, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS rev,
           CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS disc,
           CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax
    FROM lineitem GROUP BY 1) f ON p_partkey = f.l_partkey)"""
FUND = FACTS + f""",
fund AS (SELECT k AS instrument_id, concat('T', CAST(k AS VARCHAR)) AS ticker, p_name AS "shortName",
  {A.FUND_SECTOR} AS sector, """ + ", ".join(f'{A.fundamental_expr(m)} AS "{m}"' for m in A.FUNDAMENTALS) + " FROM facts)"


_RUN_ROWS = """
  SELECT year, y.instrument_id, concat('C', CAST(y.instrument_id AS VARCHAR)) AS ticker,
         CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY year, n >= 2 ORDER BY cents DESC, y.instrument_id) END AS rank,
         CASE WHEN n >= 2 THEN CAST(cents % 1000 AS DOUBLE) / 10 END AS final_score,
         CASE WHEN n >= 2 THEN 'ranked' ELSE 'insufficient overall coverage' END AS score_status,
         CAST(cents % 90000 + 10000 AS DOUBLE) / 100 AS "currentPrice",
         CAST(cents % 600 AS DOUBLE) / 10 AS pct_below_52w_high,
         CAST(cents % 300 - 150 AS DOUBLE) / 10 AS delivery_trend
  FROM (SELECT year(o_orderdate) AS year, o_custkey AS instrument_id, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n
        FROM orders GROUP BY 1, 2) y"""


def run_cte(name: str, age: int) -> str:
    """The rows of one run: age 0 is the newest."""
    return f"""
{name} AS (SELECT * EXCLUDE (year) FROM ({_RUN_ROWS})
  WHERE year = (SELECT DISTINCT year(o_orderdate) AS y FROM orders ORDER BY y DESC LIMIT 1 OFFSET {age}))"""


PREV = run_cte("prev", 1)
CUR = run_cte("cur", 0)
RUNS = f"""
runs AS (SELECT concat('run-', CAST(year(o_orderdate) AS VARCHAR)) AS run_id, max(o_orderdate) AS created_at, count(*) AS n_orders FROM orders GROUP BY 1),
ranked AS (
  SELECT concat('run-', CAST(year AS VARCHAR)) AS run_id, instrument_id, rank, final_score AS score, score_status, "currentPrice" / 10 AS g_quality,
         pct_below_52w_high AS g_growth, CASE WHEN rank <= 10 THEN 'up' END AS movement, pct_below_52w_high AS data_coverage
  FROM ({_RUN_ROWS}))"""

_ARCH_COLS = """CASE WHEN c_nationkey = 7 THEN concat(' old', CAST(c_custkey AS VARCHAR)) ELSE replace(c_name, '#', '') END AS a_ticker,
  CAST(c_nationkey AS VARCHAR) AS a_price, c_mktsegment AS a_sector,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_custkey % 50 AS VARCHAR) END AS a_roe, c_custkey AS row_number"""
ARCHIVE = f"""
arows AS (
  SELECT 'data/ranking.csv' AS source_path, 'v1' AS content_sha256, TIMESTAMP '2024-01-05' AS modified, {_ARCH_COLS} FROM customer WHERE c_acctbal > 2000
  UNION ALL SELECT 'data/ranking.csv', 'v2', TIMESTAMP '2024-01-20', {_ARCH_COLS} FROM customer WHERE c_nationkey <> 4
  UNION ALL SELECT 'data/raw.csv', 'v1', TIMESTAMP '2024-01-10', {_ARCH_COLS} FROM customer),
afiles AS (SELECT source_path, content_sha256, max(modified) AS modified, count(*) AS row_count FROM arows GROUP BY 1, 2),
newest_files AS (SELECT source_path, arg_max(content_sha256, modified) AS content_sha256, max(modified) AS modified FROM afiles GROUP BY 1),
symbols AS (SELECT ticker, instrument_id, exchange FROM active UNION ALL
            SELECT h.ticker, h.instrument_id, h.exchange FROM hist h JOIN active a ON a.instrument_id = h.instrument_id),
acells AS (
  SELECT s.instrument_id, kv.field, kv.text, a.modified, a.source_path, a.content_sha256, a.row_number
  FROM arows a JOIN newest_files f ON a.source_path = f.source_path AND a.content_sha256 = f.content_sha256
  JOIN symbols s ON s.ticker = upper(trim(a.a_ticker)),
  LATERAL (SELECT * FROM (VALUES ('currentPrice', a.a_price), ('sector', a.a_sector), ('roe_pct', a.a_roe), ('note', a.content_sha256)) AS t(field, text)) AS kv
  WHERE kv.text IS NOT NULL AND kv.text <> ''),
archived AS (
  SELECT instrument_id, field,
         CASE WHEN regexp_matches(text, '{C.NUMERIC_PATTERN}') THEN TRY_CAST(text AS DOUBLE) END AS numeric_value,
         text AS text_value, modified AS observed_at
  FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, field ORDER BY modified DESC, source_path DESC, content_sha256 DESC, row_number DESC) AS rn FROM acells)
  WHERE rn = 1)"""

def _last(value: str, condition: str) -> str:
    return f"arg_max({value}, (observed_at, id)) FILTER (WHERE {condition})"


#: All evidence about an instrument in one aggregation, and what follows from it row by row.
CONFLICTS = f"""
evidence AS (
  SELECT instrument_id,
         {_last("numeric_value", "field = 'trailing_pe' AND provider = 'bse' AND numeric_value > 0")} AS pe_b,
         {_last("numeric_value", "field = 'trailing_pe' AND provider = 'nse' AND numeric_value > 0")} AS pe_n,
         {_last("numeric_value", "field = 'trailing_eps'")} AS eps,
         count(*) FILTER (WHERE field = 'trailing_eps') AS eps_rows,
         {_last("text_value", "field = 'book_value_sign' AND provider = 'bse' AND is_valid")} AS sign,
         {_last("numeric_value", "field = 'roe_pct' AND provider = 'bse' AND is_valid")} AS roe_b,
         {_last("numeric_value", "field = 'roe_pct' AND provider = 'yahoo_roe' AND is_valid")} AS roe_y,
         count(*) FILTER (WHERE field = 'roe_pct' AND provider IN ('screener', 'upstox_fundamentals') AND is_valid) AS adjudications
  FROM obs GROUP BY 1),
findings AS (
  SELECT *, coalesce(greatest(pe_b, pe_n) / least(pe_b, pe_n) > 3.0 AND pe_b IS NOT NULL AND pe_n IS NOT NULL, false) OR coalesce(eps < 0, false) AS pe_bad,
         coalesce(sign = 'negative', false) AS insolvent,
         coalesce(abs(roe_b) >= 2 AND abs(roe_y) >= 2 AND greatest(abs(roe_b), abs(roe_y)) / least(abs(roe_b), abs(roe_y)) > 10, false) AS roe_split
  FROM evidence),
pe_out AS (SELECT instrument_id FROM findings WHERE pe_bad),
roe_disputed AS (SELECT instrument_id, adjudications FROM findings WHERE insolvent OR roe_split),
roe_out AS (SELECT instrument_id FROM roe_disputed WHERE adjudications = 0)"""

_EACH = [(p if f is None else f"{p}:{f}", f is None, n) for (p, f), n in C.LIVE_PRIORITY.items()]
LIVE_ORDER = "coalesce(" + ", ".join(
    f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {n}" for k, whole, n in _EACH if whole == alone) + " END" for key, alone in (("provider", True), ("concat(provider, ':', field)", False))
) + f", {C.LIVE_DEFAULT})"

LIVE = CONFLICTS + f""",
newest_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, field, provider ORDER BY observed_at DESC, id DESC) AS rn FROM obs) WHERE rn = 1),
usable AS (SELECT * FROM newest_rows WHERE is_valid AND (provider NOT IN ('upstox_statements', 'upstox_shareholding')
   OR (period_end <= DATE '{A.AS_OF}' AND date_diff('day', period_end, DATE '{A.AS_OF}') <=
       CASE WHEN provider = 'upstox_shareholding' OR field = 'earnings_quarterly_growth' OR field LIKE 'quarterly_%' THEN 200 ELSE 550 END))),
basis AS (SELECT instrument_id, provider, left(field, length(field) - 6) AS metric, arg_max(text_value, (observed_at, id)) AS basis
  FROM usable WHERE right(field, 6) = '_basis' GROUP BY 1, 2, 3),
eligible AS (SELECT u.* FROM usable u LEFT JOIN basis b ON b.instrument_id = u.instrument_id AND b.provider = u.provider AND b.metric = u.field
  WHERE right(u.field, 6) <> '_basis'
    AND NOT (u.field IN ('trailing_pe', 'trailing_eps') AND coalesce(b.basis, '') = 'standalone')
    AND NOT (u.provider = 'upstox_fundamentals' AND u.field NOT IN ('roe_pct', 'roce_pct'))
    AND NOT (u.field = 'trailing_pe' AND u.instrument_id IN (SELECT instrument_id FROM pe_out))
    AND NOT (u.field = 'roe_pct' AND u.provider NOT IN ('screener', 'upstox_fundamentals') AND u.instrument_id IN (SELECT instrument_id FROM roe_disputed))),
live AS (SELECT instrument_id, field, numeric_value, text_value, unit, provider, observed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument_id, field ORDER BY
    """ + LIVE_ORDER + """, observed_at DESC, id DESC) AS pos
  FROM eligible) WHERE pos = 1)"""

ALIASED = """
mapping(live_field, legacy_field, factor) AS (VALUES """ + ", ".join(f"('{a}', '{b}', CAST({f!r} AS DOUBLE))" for a, b, f in C.ALIAS_MAPPING) + """),
aliased AS (SELECT l.instrument_id, m.legacy_field AS field, l.numeric_value * m.factor AS numeric_value, l.text_value, l.provider, l.observed_at
  FROM live l JOIN mapping m ON m.live_field = l.field
  WHERE l.numeric_value IS NOT NULL AND NOT (l.field = 'profit_margin_pct' AND m.legacy_field = 'profitMargins'
    AND EXISTS (SELECT 1 FROM live x WHERE x.instrument_id = l.instrument_id AND x.field = 'net_profit_margin')))"""

RANKED_KV = """
latest_run AS (SELECT run_id, created_at FROM runs ORDER BY created_at DESC LIMIT 1),
ranked_kv AS (SELECT rk.instrument_id, kv.field, kv.numeric_value, kv.text_value, lr.created_at AS observed_at
  FROM ranked rk JOIN latest_run lr ON lr.run_id = rk.run_id,
  LATERAL (SELECT * FROM (VALUES ('rank', CAST(rk.rank AS DOUBLE), NULL), ('final_score', rk.score, NULL), ('data_cov', rk.data_coverage, NULL),
    ('score_status', NULL, rk.score_status), ('movement_vs_staged', NULL, rk.movement), ('g_quality', rk.g_quality, NULL), ('g_growth', rk.g_growth, NULL)) AS t(field, numeric_value, text_value)) kv
  WHERE kv.numeric_value IS NOT NULL OR kv.text_value IS NOT NULL)"""

IDENTITY = """
identity AS (SELECT instrument_id, 'shortName' AS field, CAST(NULL AS DOUBLE) AS numeric_value, company_name AS text_value, updated_at AS observed_at
  FROM active WHERE company_name IS NOT NULL AND trim(company_name) <> '')"""

CURRENT = ",".join([OBS, INST, ALIASES, RUNS, ARCHIVE, LIVE, ALIASED, RANKED_KV, IDENTITY]) + """,
layers AS (
  SELECT instrument_id, field, numeric_value, text_value, NULL AS unit, 'instruments' AS provider, observed_at, 'observation' AS origin, 2 AS priority FROM identity
  UNION ALL SELECT instrument_id, field, numeric_value, text_value, NULL, 'scoring', observed_at, 'ranking', 1 FROM ranked_kv
  UNION ALL SELECT instrument_id, field, numeric_value, text_value, unit, provider, observed_at, 'observation', 2 FROM live
  UNION ALL SELECT instrument_id, field, numeric_value, text_value, NULL, provider, observed_at, 'observation', 3 FROM aliased
  UNION ALL SELECT instrument_id, field, numeric_value, text_value, NULL, 'legacy_csv', observed_at, 'archive', 4 FROM archived),
current AS (SELECT instrument_id, field, numeric_value, text_value, unit, provider, observed_at, origin FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument_id, field ORDER BY priority, observed_at DESC, provider DESC, numeric_value DESC, text_value DESC) AS pos
  FROM layers WHERE instrument_id IN (SELECT instrument_id FROM active)
    AND NOT (field IN ('trailingPE', 'trailing_pe') AND instrument_id IN (SELECT instrument_id FROM pe_out))
    AND NOT (field IN ('roe_pct', 'returnOnEquity') AND instrument_id IN (SELECT instrument_id FROM roe_out))) WHERE pos = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
