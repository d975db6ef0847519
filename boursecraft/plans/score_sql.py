"""SQL twin of the scorer, written as wide window expressions."""

from __future__ import annotations

from boursecraft import catalog as C
from boursecraft.plans.oracle import r


def d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


LENDER = "coalesce(lower(sector) = 'financial services', false)"


def applicable(m: str) -> str:
    return f"NOT {LENDER}" if m in C.NOT_APPLICABLE_TO_LENDERS else "true"


def derived(src: str = "fund", out: str = "der", legacy: bool = False) -> str:
    roe = '"returnOnEquity" * 100'
    roa = '"returnOnAssets"'
    margin = '"ebitdaMargins" * 100'
    if legacy:
        roe = 'CASE WHEN "returnOnEquity" IS NOT NULL THEN greatest(-100.0::DOUBLE, least(150.0::DOUBLE, "returnOnEquity" * 100)) END'
        roa = 'CASE WHEN "returnOnAssets" IS NOT NULL THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, "returnOnAssets")) END'
        margin = ('CASE WHEN coalesce("ebitdaMargins", "profitMargins") IS NOT NULL THEN '
                  'greatest(-100.0::DOUBLE, least(100.0::DOUBLE, coalesce("ebitdaMargins", "profitMargins") * 100)) END')
    ratios = ", ".join(f'CASE WHEN "{c}" > 0 THEN "{c}" END AS "{c}"' for c in ("trailingPE", "priceToBook", "pegRatio", "enterpriseToEbitda"))
    below = '("fiftyTwoWeekHigh" - "currentPrice") / "fiftyTwoWeekHigh" * 100'
    return f"""
{out} AS (SELECT * REPLACE (CASE WHEN coalesce(promoter_pct + institutional_pct > 100.5, false) THEN NULL ELSE institutional_pct END AS institutional_pct) FROM (
 SELECT * REPLACE ({ratios}, {roa} AS "returnOnAssets", CASE WHEN promoter_pct BETWEEN 0 AND 100 THEN promoter_pct END AS promoter_pct,
   CASE WHEN institutional_pct BETWEEN 0 AND 100 THEN institutional_pct END AS institutional_pct),
  CASE WHEN coalesce("profitMargins" < 0 AND ({roe}) > 50, false) THEN NULL ELSE {roe} END AS roe_pct,
  {margin} AS ebitda_margin,
  CASE WHEN {below} IS NOT NULL THEN least({below}, 55.0::DOUBLE) END AS pct_below_52w_high,
  ("currentPrice" / "fiftyDayAverage" - 1) * 100 AS px_vs_50dma,
  ("currentPrice" / "twoHundredDayAverage" - 1) * 100 AS px_vs_200dma,
  ("targetMeanPrice" / "currentPrice" - 1) * 100 AS upside_pct,
  CASE WHEN "trailingEps" > 0 THEN ("forwardEps" / "trailingEps" - 1) * 100 END AS fwd_eps_growth
 FROM {src}))"""


def share(group: str) -> str:
    ms = [m for m, _ in C.GROUPS[group]]
    present = " + ".join(f'CAST(({applicable(m)} AND "{m}" IS NOT NULL) AS INT)' for m in ms)
    possible = " + ".join(f"CAST(({applicable(m)}) AS INT)" for m in ms)
    return f"(CAST({present} AS DOUBLE) / ({possible}))"


def weights(overrides=None) -> dict[str, float]:
    w = {**C.WEIGHTS, **(overrides or {})}
    t = sum(w.values())
    return {g: v / t for g, v in w.items()}


def data_cov(overrides=None) -> str:
    w = weights(overrides)
    return r("(" + " + ".join(f"{d(w[g])} * {share(g)}" for g in C.GROUPS) + ") * 100", 1)


def coverage(src: str = "der", out: str = "cov", overrides=None) -> str:
    return f"""
{out} AS (SELECT *, {data_cov(overrides)} AS data_cov, {r(share("quality") + " * 100", 1)} AS quality_cov,
  {r(share("valuation") + " * 100", 1)} AS valuation_cov FROM {src})"""


def pct(m: str, sign: int, part: str = "", value: str | None = None) -> str:
    v = value or f'(CASE WHEN {applicable(m)} THEN "{m}" END)'
    p = f"{part}, " if part else ""
    order = "" if sign > 0 else " DESC"
    total = f"count({v}) OVER (PARTITION BY {part})" if part else f"count({v}) OVER ()"
    return (f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY {p}{v} IS NULL ORDER BY {v}{order}) "
            f"+ (count(*) OVER (PARTITION BY {p}{v}) - 1) / 2.0::DOUBLE) / {total} END")


def percentiles(src: str = "cov", out: str = "pcts") -> str:
    return f"\n{out} AS (SELECT *, " + ", ".join(f'{pct(m, s)} AS "p_{m}"' for m, s in C.DIRECTIONS.items()) + f" FROM {src})"


def groups(src: str = "pcts", out: str = "grp") -> str:
    cols = []
    for g, ms in C.GROUPS.items():
        parts = " + ".join(f'CASE WHEN {applicable(m)} THEN coalesce("p_{m}", 0.5::DOUBLE) ELSE 0.0::DOUBLE END' for m, _ in ms)
        count = " + ".join(f"CAST(({applicable(m)}) AS INT)" for m, _ in ms)
        cols.append(r(f"({parts}) / ({count}) * 100", 1) + f" AS g_{g}")
    return f"\n{out} AS (SELECT *, " + ", ".join(cols) + f" FROM {src})"


def model(overrides=None) -> str:
    w = weights(overrides)
    return r("(" + " + ".join(f"{d(w[g])} * (g_{g} / 100)" for g in C.GROUPS) + ") * 100", 1)


STATUS = """CASE WHEN data_cov < 60 THEN 'insufficient overall coverage' WHEN quality_cov < 40 THEN 'insufficient quality data'
  WHEN valuation_cov < 40 THEN 'insufficient valuation data' ELSE 'ranked' END"""


def final(src: str = "grp", out: str = "scored", overrides=None, part: str = "") -> str:
    p = f"{part}, " if part else ""
    return f"""
{out}_m AS (SELECT *, {model(overrides)} AS model_score FROM {src}),
{out}_f AS (SELECT *, {STATUS} AS score_status, CASE WHEN {STATUS} = 'ranked' THEN {r("50 + (model_score - 50) * (data_cov / 100)", 1)} END AS final_score FROM {out}_m),
{out} AS (SELECT *, CASE WHEN final_score IS NOT NULL THEN row_number() OVER (PARTITION BY {p}final_score IS NULL ORDER BY final_score DESC, model_score DESC, instrument_id) END AS rank FROM {out}_f)"""


SCORED = ",".join([derived(), coverage(), percentiles(), groups(), final()])
SCORED_LEGACY = ",".join([derived(out="der0", legacy=True), "\nder AS (SELECT * FROM der0 WHERE \"currentPrice\" IS NOT NULL AND \"marketCap\" / 10000000.0::DOUBLE >= 1000)", coverage(), percentiles(), groups(), final()])
CHEAP = "coalesce(final_score IS NOT NULL AND g_valuation >= 55 AND g_quality >= 55 AND pct_below_52w_high >= 10, false)"
_HI = """coalesce(nullif("fiftyTwoWeekHigh", 0), CASE WHEN "currentPrice" <> 0 AND pct_below_52w_high <> 0 THEN "currentPrice" / (1 - pct_below_52w_high / 100) END)"""
RANGE_POS = f"""CASE WHEN "currentPrice" <> 0 AND "fiftyTwoWeekLow" <> 0 AND {_HI} > "fiftyTwoWeekLow" THEN {r(f'("currentPrice" - "fiftyTwoWeekLow") / ({_HI} - "fiftyTwoWeekLow") * 100', 1)} END"""
FLAGGED = f"""
ranged AS (SELECT *, {RANGE_POS} AS range_position_pct FROM scored),
flagged AS (SELECT *, coalesce(delivery_trend >= 5 AND institutional_pct >= 30 AND final_score >= 55, false) AS pat_accum,
  coalesce(pct_below_52w_high >= 30 AND g_quality < 40 AND delivery_trend <= -5, false) AS pat_trap,
  coalesce(final_score IS NOT NULL AND range_position_pct < 20 AND g_quality >= 60, false) AS pat_near_low FROM ranged)"""
