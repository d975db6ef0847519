"""Search, filter, sort, top-k and summary operators over scored stock records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boursecraft import catalog
from boursecraft.functions import values as V
from boursecraft.operators.compare import cheap_and_strong
from boursecraft.operators.paging import PageIndex, build_index
from boursecraft.operators.postings import Postings
from boursecraft.operators.ranks import numbered

# fixed values: the four documented screens
SCREEN_PRESETS = {
    "main": "mcap_cr > 1000 AND roe > 15 AND roe_5y > 15 AND roce > 15 AND debt_to_equity < 0.5 AND opm > 12 "
    "AND profit_growth_5y > 12 AND sales_growth_5y > 10 AND promoter > 40 AND pledged < 5 AND price < 0.7D * high",
    "strict": "mcap_cr > 2000 AND roe > 18 AND roe_5y > 18 AND roce > 18 AND debt_to_equity < 0.3 AND interest_cover > 5 "
    "AND opm > 15 AND profit_growth_5y > 15 AND sales_growth_5y > 12 AND profit_growth_3y > 10 AND promoter > 45 "
    "AND pledged < 2 AND price < 0.65D * high AND price < 1.4D * low",
    "deep_value": "mcap_cr > 1000 AND pe < industry_pe AND pe < 20 AND pb < 4 AND roce > 15 AND debt_to_equity < 0.6 "
    "AND profit_growth_5y > 10 AND promoter > 40 AND pledged < 5 AND price < 0.7D * high AND dividend_yield > 0.5",
    "smart_money": "mcap_cr > 1000 AND roe > 15 AND debt_to_equity < 0.6 AND profit_growth_5y > 12 AND promoter > 45 "
    "AND promoter_change_3y >= 0 AND pledged < 3 AND price < 0.7D * high",
}


def matches_text(needle: str, *columns: str) -> Column:
    """Case-insensitive substring on any of the columns; an empty needle matches everything."""
    text = needle.strip().lower()
    if not text:
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text))
    return found


def search(stocks: DataFrame, needle: str | None = None, sector: str | None = None, min_coverage: float = 0.0,
           limit: int | None = 100, postings: Postings | None = None) -> DataFrame:
    """API search: text, sector, coverage; by rank with unranked last; a page of ``limit`` rows.

    With ``postings`` of the stocks only rows that they name are compared with the needle.
    """
    rows = stocks.filter(matches_text(needle or "", "ticker", "shortName")) if postings is None else postings.search(stocks, needle or "")
    if sector:
        rows = rows.filter(F.col("sector") == sector)
    rows = rows.filter(F.coalesce(F.col("data_cov"), F.lit(0.0)) >= min_coverage)
    ordered = rows.orderBy(F.asc_nulls_last("rank"), "instrument_id")
    return ordered.limit(limit) if limit else ordered


def sorted_blanks_last(df: DataFrame, key: str, descending: bool = False, tie: str = "instrument_id") -> DataFrame:
    """Sort by any column; null and empty text go last in both directions; text ignores case."""
    return df.orderBy(*blanks_last(df, key, descending, tie))


def blanks_last(df: DataFrame, key: str, descending: bool = False, tie: str = "instrument_id") -> list[Column]:
    column = F.col(key)
    if dict(df.dtypes)[key] == "string":
        column = F.lower(F.nullif(column, F.lit("")))
    return [column.desc_nulls_last() if descending else column.asc_nulls_last(), F.col(tie).asc()]


def positions(df: DataFrame, order: list[Column], alias: str = "position") -> DataFrame:
    """Every row with its place, from 1, in a total order of the whole table."""
    return numbered(df, order, alias)


def explorer_rows(stocks: DataFrame, needle: str = "", sector: str = "all", min_coverage: float = 0.0) -> DataFrame:
    """The rows that the explorer's filters leave."""
    rows = stocks.filter(matches_text(needle, "ticker", "shortName"))
    if sector != "all":
        rows = rows.filter(F.col("sector") == sector)
    return rows.filter(F.coalesce(F.col("data_cov"), F.lit(0.0)) >= min_coverage)


def explorer_index(stocks: DataFrame, needle: str = "", sector: str = "all", min_coverage: float = 0.0, key: str = "rank",
                   descending: bool = False, ranges: int | None = None) -> PageIndex:
    """The filtered grid sorted once, for any number of its pages and their total."""
    rows = explorer_rows(stocks, needle, sector, min_coverage)
    return build_index(rows, blanks_last(rows, key, descending), ranges)


def explorer(stocks: DataFrame, needle: str = "", sector: str = "all", min_coverage: float = 0.0, key: str = "rank",
             descending: bool = False, page: int = 1, page_size: int = 25) -> DataFrame:
    """Explorer grid: filter, sort on any column, one page (``page_size`` 0 shows everything)."""
    if page_size == 0:
        return sorted_blanks_last(explorer_rows(stocks, needle, sector, min_coverage), key, descending)
    return explorer_index(stocks, needle, sector, min_coverage, key, descending).page(page, page_size).drop("place")


def dashboard_filter(stocks: DataFrame, needle: str = "", sector: str = "", min_score: float = 0.0, min_mcap_cr: float = 0.0,
                     min_coverage: float = 0.0, only_cheap_strong: bool = False) -> DataFrame:
    """Dashboard filter. A missing score counts as zero against the score threshold."""
    both = F.concat_ws(" ", "ticker", "shortName")
    rows = stocks.withColumn("_text", both).filter(matches_text(needle, "_text")).drop("_text")
    if sector:
        rows = rows.filter(F.col("sector") == sector)
    rows = rows.filter(F.coalesce(F.col("final_score"), F.lit(0.0)) >= min_score)
    rows = rows.filter(F.coalesce(F.col("mcap_cr"), F.lit(0.0)) >= min_mcap_cr)
    if min_coverage:
        rows = rows.filter(F.col("data_cov") >= min_coverage)
    return rows.filter(cheap_and_strong()) if only_cheap_strong else rows


def fresh_tickers(obs: DataFrame, instruments: DataFrame, provider: str, as_of, days: int) -> DataFrame:
    """Tickers the provider covered within ``days``; de-duplicated before the join."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    recent = obs.filter((F.col("provider") == provider) & (F.col("observed_at") > cutoff)).select("instrument_id").distinct()
    return instruments.select("instrument_id", "ticker").join(recent, "instrument_id", "left_semi").select("ticker")


def enrichment_targets(coverage: DataFrame, target: float, limit: int) -> DataFrame:
    """Stocks below the coverage target or a core-group minimum, worst first."""
    weak = (
        (F.col("data_cov") < target)
        | (F.col("quality_cov") < catalog.MIN_CORE_COVERAGE)
        | (F.col("valuation_cov") < catalog.MIN_CORE_COVERAGE)
    )
    return coverage.filter(weak).orderBy("data_cov", "quality_cov", "valuation_cov", "instrument_id").limit(limit)


def needs_refresh(cached: DataFrame, stamp: str, as_of, max_days: float) -> DataFrame:
    """One row: age in days of the newest cached record and whether a full refresh is due."""
    newest = F.max(F.col(stamp).cast("timestamp"))
    age = (F.lit(as_of).cast("timestamp").cast("double") - newest.cast("double")) / 86400
    return cached.agg(F.count("*").alias("cached_rows"), age.alias("age_days")).withColumn(
        "refresh", (F.col("cached_rows") == 0) | (F.col("age_days") >= max_days)
    )


def above_market_cap(stocks: DataFrame, crore: float) -> DataFrame:
    return stocks.withColumn("mcap_cr", F.col("marketCap") / catalog.CRORE).filter(
        (F.col("mcap_cr") >= crore) & F.col("currentPrice").isNotNull()
    )


def screen_flags(df: DataFrame, presets: Mapping[str, str] | None = None) -> DataFrame:
    """One boolean column per named screen; a missing input fails the screen."""
    presets = presets or SCREEN_PRESETS
    return df.withColumns({f"passes_{n}": F.coalesce(F.expr(e), F.lit(False)) for n, e in presets.items()})


# ---- summaries ------------------------------------------------------------------------------------

def exact_mean(column: str | Column, digits: int = 1) -> Column:
    """Mean of values with ``digits`` decimals, summed as integers: independent of row order."""
    c = F.col(column) if isinstance(column, str) else column
    scale = 10**digits
    return F.try_divide(F.sum(F.rint(c * scale).cast("long")) / float(scale), F.count(c))


def sector_summary(ranked: DataFrame, minimum: int = 3) -> DataFrame:
    """Per sector: size, mean score and best-ranked ticker; small sectors dropped."""
    return (
        ranked.filter("sector IS NOT NULL")
        .groupBy("sector")
        .agg(F.count("*").alias("n"), exact_mean("final_score").alias("avg_score"),
             F.min_by("ticker", F.struct(F.coalesce(F.col("rank"), F.lit(2**62)), F.col("instrument_id"))).alias("top"))
        .filter(F.col("n") >= minimum)
    )


def sector_scores(ranked: DataFrame) -> DataFrame:
    rated = ranked.filter("sector IS NOT NULL AND sector <> '' AND final_score IS NOT NULL")
    return rated.groupBy("sector").agg(exact_mean("final_score").alias("avg_score"), F.count("*").alias("n"))


def sector_concentration(ranked: DataFrame) -> DataFrame:
    sector = F.coalesce(F.nullif(F.col("sector"), F.lit("")), F.lit("Unknown")).alias("sector")
    counts = ranked.groupBy(sector).agg(F.count_if(cheap_and_strong()).alias("cs_count"), F.count("*").alias("total"))
    return counts.withColumn("pct", V.rounded(F.col("cs_count") / F.col("total") * 100, 0))


def sector_weekly(changes: DataFrame) -> DataFrame:
    sector = F.coalesce(F.nullif(F.col("sector"), F.lit("")), F.lit("Unknown")).alias("sector")
    rows = changes.filter("price_chg_pct IS NOT NULL").groupBy(sector)
    return rows.agg(exact_mean("price_chg_pct").alias("avg_chg"), F.count("*").alias("n"))


def score_bands(ranked: DataFrame, bands) -> DataFrame:
    """Histogram over half-open bands [low, high); empty bands are listed with zero.

    One aggregation with one counter per band, unpivoted: no join with a band list.
    """
    def inside(low, high) -> Column:
        s = F.col("final_score")
        condition = s.isNotNull()
        if low is not None:
            condition = condition & (s >= low)
        return condition & (s < high) if high is not None else condition

    counters = ranked.agg(*[F.count_if(inside(low, high)).alias(f"b{i}") for i, (_, low, high) in enumerate(bands)])
    rows = F.array(*[F.struct(F.lit(label).alias("band"), F.col(f"b{i}").alias("n")) for i, (label, _, _) in enumerate(bands)])
    return counters.select(F.inline(rows))


LEGACY_BANDS = tuple((f"{a}-{b}", a, b) for a, b in catalog.SCORE_BANDS_LEGACY)
WEB_BANDS = catalog.SCORE_BANDS_WEB


def median_coverage(stocks: DataFrame) -> DataFrame:
    """Exact median. Coverage has one decimal, so the aggregation state is at most 1001 counters."""
    return stocks.agg(F.coalesce(F.median("data_cov"), F.lit(0.0)).alias("median_coverage"))


def headline_stats(ranked: DataFrame) -> DataFrame:
    rated = F.col("final_score").isNotNull()
    top = F.min_by("ticker", F.when(rated, F.struct(F.coalesce(F.col("rank"), F.lit(2**62)), F.col("instrument_id"))))
    return ranked.agg(
        F.count_if(rated).alias("ranked"),
        F.count("*").alias("total"),
        F.count_if(cheap_and_strong()).alias("cheap_strong"),
        V.rounded(F.coalesce(exact_mean("final_score"), F.lit(0.0)), 1).alias("avg_score"),
        F.count_if("pat_accum").alias("accum"),
        F.count_if("pat_near_low").alias("near_low"),
        F.count_if("pat_trap").alias("traps"),
        top.alias("top_pick"),
    )


def coverage_stats(df: DataFrame, column: str = "data_cov") -> DataFrame:
    return df.agg(
        exact_mean(column).alias("mean_coverage"), F.min(column).alias("min_coverage"),
        F.count_if(F.col(column) < 60).alias("below_60"), F.count("*").alias("n"),
    )


# ---- top-k --------------------------------------------------------------------------------------------

def top_ranked(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.filter("rank IS NOT NULL").orderBy("rank").limit(n)


def top_patterns(flagged: DataFrame, n: int = 10) -> DataFrame:
    """Best accumulation and near-low rows, worst traps: n each, one pass, capped per task first."""
    score = F.col("final_score")
    entries = F.array(
        F.when(F.col("pat_accum"), F.struct(F.lit("accum").alias("pattern"), (-F.coalesce(score, F.lit(0.0))).alias("order_value"))),
        F.when(F.col("pat_near_low"), F.struct(F.lit("near_low").alias("pattern"), (-F.coalesce(score, F.lit(0.0))).alias("order_value"))),
        F.when(F.col("pat_trap"), F.struct(F.lit("trap").alias("pattern"), F.coalesce(score, F.lit(100.0)).alias("order_value"))),
    )
    rows = flagged.select("instrument_id", "ticker", "final_score", F.inline(F.filter(entries, lambda e: e.isNotNull())))
    return top_per(rows, "pattern", [F.col("order_value"), F.col("instrument_id")], n).drop("order_value")


def top_per(df: DataFrame, key: str, order, n: int) -> DataFrame:
    """n rows per key. Planned as a group limit: each task keeps n rows per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def top_movers(changes: DataFrame, threshold: float = 5.0, n: int = 10) -> DataFrame:
    """Largest gainers above and fallers below the threshold."""
    chg = F.col("price_chg_pct")
    rows = changes.select(
        "instrument_id", "ticker", "price_chg_pct",
        F.when(chg > threshold, "gainer").when(chg < -threshold, "faller").alias("direction"),
    ).filter("direction IS NOT NULL")
    return top_per(rows, "direction", [-F.abs("price_chg_pct"), F.col("instrument_id")], n)


def value_trap_watch(ranked: DataFrame, n: int = 15) -> DataFrame:
    deep = ranked.filter((F.col("pct_below_52w_high") >= 40) & (F.col("g_quality") <= 35))
    return deep.orderBy(F.asc_nulls_last("delivery_trend"), "instrument_id").limit(n)


def top_per_lens(values: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` of every lens, from unranked scores: a group limit before the shuffle."""
    order = Window.partitionBy("lens").orderBy(F.desc("final_score"), F.desc("model_score"), "instrument_id")
    scored = values.filter("final_score IS NOT NULL").withColumn("rank", F.row_number().over(order).cast("long"))
    return scored.filter(F.col("rank") <= n)


def insights(flagged: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """The report bundle: small frames, each built lazily from the same scored input."""
    return {
        "patterns": top_patterns(flagged),
        "bands": score_bands(flagged, LEGACY_BANDS),
        "concentration": sector_concentration(flagged),
        "movers": top_movers(changes),
        "sector_weekly": sector_weekly(changes),
    }
