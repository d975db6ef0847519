"""Fixed values of the data model: groups, weights, directions, bounds, priorities, names.

These are data, not logic. They have to equal the published model for results to agree, so
they are stated plainly here and nowhere else.
"""

from __future__ import annotations

# --- fixed values: scoring model ------------------------------------------------------------
WEIGHTS = {
    "quality": 2.5,
    "smart_money": 2.0,
    "valuation": 2.0,
    "growth": 1.75,
    "price_setup": 1.5,
    "analyst": 1.25,
    "momentum": 0.75,
}
# group -> ((metric, direction), ...): +1 higher is better, -1 lower is better
GROUPS = {
    "quality": (
        ("roe_pct", 1),
        ("returnOnAssets", 1),
        ("ebitda_margin", 1),
        ("debtToEquity", -1),
        ("currentRatio", 1),
    ),
    "smart_money": (
        ("institutional_pct", 1),
        ("institutions_count", 1),
        ("promoter_pct", 1),
        ("delivery_trend", 1),
        ("avg_delivery_pct", 1),
    ),
    "valuation": (
        ("trailingPE", -1),
        ("priceToBook", -1),
        ("pegRatio", -1),
        ("enterpriseToEbitda", -1),
        ("dividendYield", 1),
    ),
    "growth": (
        ("earningsGrowth", 1),
        ("revenueGrowth", 1),
        ("earningsQuarterlyGrowth", 1),
        ("fwd_eps_growth", 1),
    ),
    "price_setup": (("pct_below_52w_high", 1), ("px_vs_50dma", 1)),
    "analyst": (
        ("upside_pct", 1),
        ("recommendationMean", -1),
        ("numberOfAnalystOpinions", 1),
    ),
    "momentum": (("fiftyTwoWeekChangePercent", 1), ("px_vs_200dma", 1)),
}
DIRECTIONS = {metric: sign for metrics in GROUPS.values() for metric, sign in metrics}
NOT_APPLICABLE_TO_LENDERS = ("ebitda_margin", "debtToEquity", "currentRatio", "enterpriseToEbitda")
LENDER_SECTOR = "financial services"
DRAWDOWN_CAP = 55.0
MIN_COVERAGE = 60.0
MIN_CORE_COVERAGE = 40.0
OWNERSHIP_LIMIT = 100.5
MODEL_VERSION = "live_verified_v2"

LENSES = {
    "Balanced (default)": {},
    "Deep value": {"valuation": 4.0, "price_setup": 2.5, "growth": 0.5, "momentum": 0.0},
    "Quality compounder": {"quality": 4.0, "growth": 2.5, "smart_money": 2.0, "valuation": 1.0},
    "Smart-money": {"smart_money": 4.0, "quality": 2.0, "valuation": 1.5},
    "Growth": {"growth": 4.0, "quality": 2.0, "momentum": 1.5, "valuation": 1.0},
}
# single-level scorer: column -> (weight, direction)
COLUMN_WEIGHTS = {
    "roce": (0.15, 1),
    "ret_6m": (0.13, -1),
    "pe": (0.12, -1),
    "roe": (0.12, 1),
    "qtr_profit_var": (0.12, 1),
    "roe_5yr": (0.10, 1),
    "qtr_sales_var": (0.10, 1),
    "cmp_bv": (0.08, -1),
    "mcap_cr": (0.05, 1),
    "div_yld": (0.03, 1),
}
COLUMN_GROUPS = {
    "Quality": ("roce", "roe", "roe_5yr"),
    "Valuation": ("pe", "cmp_bv", "div_yld"),
    "Growth": ("qtr_profit_var", "qtr_sales_var"),
    "BeatenDown": ("ret_6m",),
    "Size": ("mcap_cr",),
}
SCENARIOS = {
    "baseline": (-0.727, -0.727),
    "neutralize": (None, None),
    "adjusted_flat": (0.0, 0.0),
    "adjusted_5": (0.05, 0.05),
    "adjusted_8": (0.08, 0.08),
}
# the raw inputs counted by the 24-metric coverage share
COVERAGE_INPUTS = (
    "returnOnEquity", "returnOnAssets", "ebitdaMargins", "debtToEquity", "currentRatio",
    "trailingPE", "priceToBook", "pegRatio", "enterpriseToEbitda", "dividendYield",
    "earningsGrowth", "revenueGrowth", "earningsQuarterlyGrowth", "forwardEps",
    "targetMeanPrice", "recommendationMean", "numberOfAnalystOpinions",
    "fiftyTwoWeekChangePercent", "twoHundredDayAverage",
    "institutional_pct", "institutions_count", "promoter_pct", "avg_delivery_pct", "delivery_trend",
)
# dashboard coverage reads inputs instead of derived factors, and adds the RSI
COVERAGE_GROUPS = {
    "quality": ("roe_pct", "returnOnAssets", "ebitdaMargins", "debtToEquity", "currentRatio"),
    "smart_money": ("institutional_pct", "institutions_count", "promoter_pct", "delivery_trend", "avg_delivery_pct"),
    "valuation": ("trailingPE", "priceToBook", "pegRatio", "enterpriseToEbitda", "dividendYield"),
    "growth": ("earningsGrowth", "revenueGrowth", "earningsQuarterlyGrowth", "fwd_eps_growth"),
    "price_setup": ("pct_below_52w_high", "px_vs_50dma"),
    "analyst": ("upside_pct", "recommendationMean", "numberOfAnalystOpinions"),
    "momentum": ("fiftyTwoWeekChangePercent", "px_vs_200dma", "rsi14"),
}
COVERAGE_NOT_APPLICABLE = ("ebitdaMargins", "debtToEquity", "currentRatio", "enterpriseToEbitda")

# --- fixed values: observations ---------------------------------------------------------------
PERCENT_FIELDS = (
    "promoter_pct", "institutional_pct", "fii_pct", "other_dii_pct", "mutual_funds_pct",
    "roe_pct", "roce_pct", "return_on_assets_pct", "profit_margin_pct",
)
OWNERSHIP_FIELDS = ("promoter_pct", "institutional_pct", "fii_pct", "other_dii_pct", "mutual_funds_pct")
PROVIDER_PRIORITY = {
    "exchange_filing": 10,
    "screener": 12,
    "upstox_fundamentals": 12,
    "upstox_statements": 10,
    "upstox_shareholding": 10,
    "nse": 15,
    "bse": 15,
    "company_filing": 20,
    "upstox": 35,
    "alpha_vantage": 40,
    "fmp": 50,
    "yahoo": 80,
    "yahoo_roe": 25,
    "legacy_dashboard": 90,
}
DEFAULT_PRIORITY = 1000
# provider order of the "latest metric, one per field" listing
# live value per field: (provider, field or None for all its fields) to its place, smaller wins
LIVE_PRIORITY = {
    ("upstox_shareholding", None): 0, ("upstox_statements", None): 0, ("upstox", "current_price"): 0,
    ("screener", "roe_pct"): 0, ("screener", "roce_pct"): 0, ("upstox_fundamentals", "roe_pct"): 1, ("upstox_fundamentals", "roce_pct"): 1,
    ("bse", "roe_pct"): 2, ("yahoo_roe", "roe_pct"): 3,
}
LIVE_DEFAULT = 4

LISTING_PRIORITY = {
    "nse": 10,
    "bse": 10,
    "upstox": 30,
    "alpha_vantage": 40,
    "fmp": 50,
    "yahoo": 80,
}
# live field, dashboard field, factor
ALIAS_MAPPING = (
    ("current_ratio", "currentRatio", 1.0),
    ("revenue_growth", "revenueGrowth", 1.0),
    ("earnings_growth", "earningsGrowth", 1.0),
    ("earnings_quarterly_growth", "earningsQuarterlyGrowth", 1.0),
    ("net_profit_margin", "profitMargins", 1.0),
    ("current_price", "currentPrice", 1.0),
    ("market_cap", "marketCap", 1.0),
    ("fifty_two_week_high", "fiftyTwoWeekHigh", 1.0),
    ("fifty_two_week_low", "fiftyTwoWeekLow", 1.0),
    ("price_to_book", "priceToBook", 1.0),
    ("trailing_pe", "trailingPE", 1.0),
    ("trailing_eps", "trailingEps", 1.0),
    ("roe_pct", "returnOnEquity", 0.01),
    ("profit_margin_pct", "profitMargins", 0.01),
    ("profit_margin_pct", "margin_pct", 1.0),
    ("operating_margin_pct", "operatingMargins", 0.01),
    ("market_cap", "mcap_cr", 0.0000001),
)
# archive columns that are our own bookkeeping, never source data
ARCHIVE_BOOKKEEPING = (
    "current_rank", "current_score", "current_score_status",
    "staged_rank", "staged_score", "staged_score_status",
    "pushed_rank", "pushed_score", "pushed_score_status",
    "rank_vs_pushed", "score_vs_pushed",
    "staged_rank_vs_pushed", "staged_score_vs_pushed",
    "movement_vs_pushed", "staged_movement_vs_pushed",
    "ownership_score", "shareholding_score", "reasons", "shareholding_reasons",
    "score", "rank", "final_score", "model_score", "score_status",
    "data_cov", "quality_cov", "valuation_cov",
    "g_quality", "g_smart_money", "g_valuation", "g_growth",
    "g_price_setup", "g_analyst", "g_momentum",
)
NUMERIC_PATTERN = r"^-?[0-9]+\.?[0-9]*([eE][-+]?[0-9]+)?$"
SECRET_FRAGMENTS = ("key", "token", "secret", "password", "authorization", "cookie")
NUMBER_SENTINELS = ("", "-", "--", "NA", "N/A", "null", "None")
LIVE_EQUITY_TYPES = ("EQ", "BE", "BZ", "SM", "ST", "SZ")

# --- fixed values: field vocabulary and gap reasons -------------------------------------------
FIELD_ALIASES = {
    "trailingpe": "trailing_pe",
    "forwardpe": "forward_pe",
    "forwardeps": "forward_eps",
    "trailingeps": "trailing_eps",
    "pegratio": "peg_ratio",
    "pricetobook": "price_to_book",
    "marketcap": "market_cap",
    "currentprice": "current_price",
    "recommendationmean": "recommendation_mean",
    "numberofanalystopinions": "number_of_analyst_opinions",
    "targetmeanprice": "target_mean_price",
    "targethighprice": "target_high_price",
    "targetlowprice": "target_low_price",
    "returnonequity": "roe_pct",
    "returnonassets": "return_on_assets_pct",
    "profitmargins": "profit_margin_pct",
    "currentratio": "current_ratio",
    "quickratio": "quick_ratio",
    "debttoequity": "debt_to_equity",
    "freecashflow": "free_cash_flow",
    "enterprisetoebitda": "enterprise_to_ebitda",
    "enterprisevalue": "enterprise_value",
    "earningsgrowth": "earnings_growth",
    "revenuegrowth": "revenue_growth",
    "earningsquarterlygrowth": "earnings_quarterly_growth",
    "ebitdamargins": "ebitda_margin_pct",
    "shortname": "name",
}
ANALYST_FIELDS = (
    "recommendation_mean", "number_of_analyst_opinions", "target_mean_price",
    "target_high_price", "target_low_price", "forward_pe", "forward_eps", "upside_pct",
)
DESCRIPTIVE_FIELDS = ("name", "sector", "industry", "ticker")
LENDER_GAP_FIELDS = (
    "current_ratio", "quick_ratio", "debt_to_equity", "enterprise_to_ebitda",
    "enterprise_value", "ebitda_margin_pct", "free_cash_flow",
)
DERIVED_PREFIXES = ("g_", "staged_", "pushed_", "pat_", "movement_")
DERIVED_FIELDS = (
    "rank", "rank_chg", "final_score", "model_score", "score_status", "data_cov",
    "quality_cov", "valuation_cov", "data_quality", "price_chg_pct", "rank_vs_staged",
    "rank_vs_pushed", "score_vs_staged", "score_vs_pushed", "current_rank",
    "current_score", "current_score_status",
)
GAP_REASONS = ("recoverable", "analyst", "undefined", "not_applicable", "descriptive", "derived", "unknown")

# --- fixed values: accepted ranges when filling blanks ----------------------------------------
VALUE_BOUNDS = {
    "trailingPE": (0.0, 5000.0),
    "priceToBook": (0.0, 1000.0),
    "marketCap": (0.0, 1e16),
    "returnOnEquity": (-5.0, 5.0),
    "returnOnAssets": (-5.0, 5.0),
    "debtToEquity": (0.0, 10000.0),
    "currentRatio": (0.0, 1000.0),
    "profitMargins": (-10.0, 10.0),
    "ebitdaMargins": (-10.0, 10.0),
    "earningsGrowth": (-100.0, 100.0),
    "revenueGrowth": (-100.0, 100.0),
    "earningsQuarterlyGrowth": (-100.0, 100.0),
    "heldPercentInsiders": (0.0, 1.0),
    "heldPercentInstitutions": (0.0, 1.0),
}
DEFAULT_BOUNDS = (-1e18, 1e18)
TEXT_FIELDS = ("shortName", "sector", "industry")

# --- fixed values: provider payload vocabularies ----------------------------------------------
KEY_RATIOS = {
    "P/E": ("trailing_pe", "ratio"),
    "P/B": ("price_to_book", "ratio"),
    "ROA": ("return_on_assets_pct", "percent"),
    "ROE": ("roe_pct", "percent"),
    "ROCE": ("roce_pct", "percent"),
    "EV/EBITDA": ("enterprise_to_ebitda", "ratio"),
}
STATEMENT_LINES = {
    "Total Assets": "total_assets",
    "Current Assets": "current_assets",
    "Current Liabilities": "current_liabilities",
    "Non-Current Liabilities": "noncurrent_liabilities",
    "Total Revenue": "total_revenue",
    "Revenue": "revenue",
    "Profit After Tax": "net_profit",
    "Profit Before Tax": "profit_before_tax",
    "Tax": "tax_expense",
    "Cash flow from Operations": "operating_cash_flow",
    "Cash flow from Investing": "investing_cash_flow",
    "Cash flow from Financing": "financing_cash_flow",
    "Cash (End of the year)": "cash_and_equivalents",
}
HOLDING_CATEGORIES = ("promoters", "fii", "other_dii", "mutual_funds", "retail_and_other")
HEADLINE_RATIO_PATTERN = (
    r'(?s)<span\s+class="name">\s*(ROCE|ROE)\s*</span>.*?<span\s+class="number">\s*([^<]+?)\s*</span>'
)
CRORE = 1e7
INSTITUTION_PATTERN = (
    r"(?i)FUND|MUTUAL|LIFE INSURANCE|INSURANCE|\bLIC\b|PENSION|FPI|FII|FOREIGN|ASSET MANAGE|\bAMC\b|"
    r"INVESTMENT|CAPITAL|PORTFOLIO|PMS|VENTURES?|HOLDINGS?|TRUST|SOVEREIGN|GOVERNMENT|ABU DHABI|"
    r"SINGAPORE|MORGAN|GOLDMAN|NOMURA|SOCIETE|BNP|CITIGROUP|VANGUARD|BLACKROCK|SMALLCAP|MIDCAP|"
    r"MULTICAP|FLEXI|EQUITY"
)

# --- fixed values: dashboard records --------------------------------------------------------
BOOLEAN_FIELDS = ("pat_accum", "pat_trap", "pat_near_low")
SCORE_BANDS_WEB = (("65+", 65, None), ("55-65", 55, 65), ("45-55", 45, 55), ("35-45", 35, 45), ("<35", None, 35))
SCORE_BANDS_LEGACY = ((0, 40), (40, 45), (45, 50), (50, 55), (55, 60), (60, 65), (65, 100))
