"""Provider payloads to observations and bars.

Each parser takes a DataFrame with one archived document per row (``ticker``, ``payload`` as JSON
text) and is a row-local expression: ``from_json`` with a fixed schema, an array of cells, one
``inline``. Nothing is shuffled, so a directory of any size parses as one narrow stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boursecraft import catalog
from boursecraft.functions import dates as T
from boursecraft.functions import values as V
from boursecraft.operators import latest as L

CELL = ("field", "unit", "numeric_value", "text_value", "is_valid", "issue_code")


def cell(field: str | Column, unit: str | Column | None, numeric: Column | None = None, text: Column | None = None,
         valid: Column | None = None, issue_code: Column | None = None) -> Column:
    as_lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_lit(field).alias("field"),
        as_lit(unit).cast("string").alias("unit"),
        (numeric if numeric is not None else F.lit(None)).cast("double").alias("numeric_value"),
        (text if text is not None else F.lit(None)).cast("string").alias("text_value"),
        (valid if valid is not None else F.lit(True)).alias("is_valid"),
        (issue_code if issue_code is not None else F.lit(None)).cast("string").alias("issue_code"),
    )


def emit(df: DataFrame, keys: Sequence[str | Column], cells: Sequence[Column]) -> DataFrame:
    """One row per cell that has a value."""
    rows = df.select(*keys, F.inline(F.array(*cells)))
    return rows.filter("numeric_value IS NOT NULL OR text_value IS NOT NULL")


# ---- price charts --------------------------------------------------------------------------------

CHART = (
    "struct<chart:struct<result:array<struct<meta:struct<currency:string,regularMarketTime:bigint,regularMarketPrice:double,"
    "chartPreviousClose:double,fiftyTwoWeekHigh:double,fiftyTwoWeekLow:double>,timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,"
    "adjclose:array<struct<adjclose:array<double>>>>>>>>"
)


def _chart(df: DataFrame) -> DataFrame:
    parsed = F.from_json("payload", CHART)
    return df.withColumn("_chart", F.get(parsed["chart"]["result"], F.lit(0)))


def chart_bars(df: DataFrame) -> DataFrame:
    """Parallel arrays to bars; positions past the end of a shorter array are null; no close, no bar."""
    quote = F.get(F.col("_chart.indicators.quote"), F.lit(0))
    adjusted = F.get(F.col("_chart.indicators.adjclose"), F.lit(0))["adjclose"]
    zipped = F.arrays_zip(
        F.col("_chart.timestamp").alias("ts"), quote["open"].alias("open"), quote["high"].alias("high"),
        quote["low"].alias("low"), quote["close"].alias("close"), quote["volume"].alias("volume"), adjusted.alias("adjusted_close"),
    )
    rows = _chart(df).select("ticker", F.inline(zipped))
    return rows.filter("ts IS NOT NULL AND close IS NOT NULL").withColumn("ts", F.timestamp_seconds("ts"))


def chart_meta(df: DataFrame) -> DataFrame:
    meta, currency = "_chart.meta.", F.col("_chart.meta.currency")
    cells = [
        cell(field, currency, F.col(meta + source))
        for field, source in (
            ("current_price", "regularMarketPrice"), ("previous_close", "chartPreviousClose"),
            ("fifty_two_week_high", "fiftyTwoWeekHigh"), ("fifty_two_week_low", "fiftyTwoWeekLow"),
        )
    ]
    observed = F.timestamp_seconds(F.col(meta + "regularMarketTime")).alias("observed_at")
    return emit(_chart(df), ["ticker", observed], cells).drop("is_valid", "issue_code")


def history_long(df: DataFrame) -> DataFrame:
    """Wide history (day, bars: map<symbol, struct<open,high,low,close>>) to long rows."""
    rows = df.select("day", F.explode("bars").alias("ticker", "bar")).select("ticker", "day", "bar.*")
    return rows.filter("day IS NOT NULL AND close IS NOT NULL")


# ---- company header -------------------------------------------------------------------------------

HEADER = (
    "struct<SecurityCode:string,PE:string,ConPE:string,PB:string,ConPB:string,ROE:string,ConROE:string,NPM:string,ConNPM:string,"
    "OPM:string,ConOPM:string,EPS:string,ConEPS:string,Sector:string,ISubGroup:string,Industry:string>"
)
_HEADER_FIELDS = (
    ("trailing_pe", "PE", "ratio", True), ("price_to_book", "PB", "ratio", True), ("roe_pct", "ROE", "percent", False),
    ("profit_margin_pct", "NPM", "percent", False), ("operating_margin_pct", "OPM", "percent", False), ("trailing_eps", "EPS", "INR", False),
)
MIXED_BASIS = ("trailing_pe", "trailing_eps")


def header_numbers() -> Column:
    """The cleaned ratios of the parsed header ``_h``, both bases of each, and the master's market cap."""
    names = [n for _f, name, _u, _p in _HEADER_FIELDS for n in (name, f"Con{name}")]
    return F.struct(*[V.number(F.col(f"_h.{n}")).alias(n) for n in names], V.number("mktcap").alias("mktcap"))


def header_choice(name: str, positive: bool) -> Column:
    """(value, basis) for one ratio of the parsed header, from its cleaned numbers ``_n``."""
    return V.preferred_basis(F.col(f"_n.Con{name}"), F.col(f"_n.{name}"), positive=positive, nonzero=not positive)


def header_ratios(df: DataFrame) -> DataFrame:
    """Company header plus its master market cap (crore) to ratios, basis markers and identity.

    ROE is suppressed where book value is not positive; standalone P/E and EPS are kept but marked
    invalid, because the rest of the universe reports them consolidated.
    """
    parsed = V.settled(df.withColumn("_h", F.from_json("payload", HEADER))).filter("_h.SecurityCode IS NOT NULL AND _h.SecurityCode <> ''")
    parsed = V.settled(parsed.withColumn("_n", header_numbers()))
    parsed = V.settled(parsed.withColumns({f"_{f}": header_choice(name, positive) for f, name, _u, positive in _HEADER_FIELDS}))
    book = F.coalesce(F.col("_n.ConPB"), F.col("_n.PB"))
    negative = F.coalesce(book <= 0, F.lit(False))
    cells = [cell("book_value_sign", None, text=F.when(book.isNotNull(), F.when(book <= 0, "negative").otherwise("positive")))]
    for field, _name, unit, _positive in _HEADER_FIELDS:
        pair = F.col(f"_{field}")
        if field == "roe_pct":
            pair = F.when(~negative, pair)
        mixed = F.coalesce(pair["basis"] == "standalone", F.lit(False)) if field in MIXED_BASIS else F.lit(False)
        cells.append(cell(field, unit, pair["value"], valid=~mixed, issue_code=F.when(mixed, "mixed_accounting_basis")))
        cells.append(cell(f"{field}_basis", None, text=pair["basis"]))
    cells += [
        cell("market_cap", "INR", V.crore(F.col("_n.mktcap"))),
        cell("sector", None, text=V.blank_to_null("_h.Sector")),
        cell("industry", None, text=V.blank_to_null(F.coalesce(F.nullif(F.col("_h.ISubGroup"), F.lit("")), F.col("_h.Industry")))),
    ]
    return emit(parsed, ["ticker"], cells)


def best_listing(master: DataFrame) -> DataFrame:
    """Largest market cap per normalised symbol (first row on ties); rows without a code are skipped."""
    rows = master.withColumns({"symbol": V.normal_symbol("scrip_id"), "cap": F.coalesce(V.number("Mktcap"), F.lit(-1.0))})
    rows = rows.filter("symbol <> '' AND SCRIP_CD IS NOT NULL AND SCRIP_CD <> ''")
    return L.pick(rows.select("symbol", "SCRIP_CD", "cap", "position"), ["symbol"], [F.when(F.col("cap") == 0, -1.0).otherwise(F.col("cap")), -F.col("position")])


def map_listings(instruments: DataFrame, master: DataFrame) -> DataFrame:
    """Ticker to exchange code: an explicit code on the instrument wins over the symbol match."""
    by_symbol = best_listing(master).select("symbol", F.col("SCRIP_CD").alias("matched_code"))
    codes = master.select(F.col("SCRIP_CD").alias("bse_code")).distinct().withColumn("_known", F.lit(True))
    return (
        instruments.select("ticker", "bse_code", V.normal_symbol("ticker").alias("symbol"))
        .join(by_symbol, "symbol", "left").join(codes, "bse_code", "left")
        .select("ticker", F.coalesce(F.when(F.col("_known"), F.col("bse_code")), F.col("matched_code")).alias("code"))
    )


# ---- filed results --------------------------------------------------------------------------------

RESULTS = "struct<col2:string,col3:string,col4:string,resultinCr:array<struct<title:string,v1:string,v2:string,v3:string>>>"


def filed_results(df: DataFrame) -> DataFrame:
    """Double-encoded JSON of titled rows to revenue, profit and EPS; quarter-on-quarter growth."""
    body = F.coalesce(F.get(F.from_json(F.concat(F.lit("["), F.col("payload"), F.lit("]")), "array<string>"), F.lit(0)), F.col("payload"))
    rows = F.from_json(body, RESULTS)["resultinCr"]
    parsed = V.settled(df.withColumn("_rows", rows))

    def figure(title: str, column: str) -> Column:
        return V.number(F.try_element_at(F.filter("_rows", lambda r: r["title"] == title), F.lit(-1))[column])

    scaled = lambda title, column: V.rounded(V.crore(figure(title, column)), 2)
    latest, previous = figure("Net Profit", "v1"), figure("Net Profit", "v2")
    cells = [
        cell("results_quarterly_revenue", "INR", scaled("Revenue", "v1")),
        cell("results_quarterly_net_profit", "INR", scaled("Net Profit", "v1")),
        cell("results_revenue", "INR", scaled("Revenue", "v3")),
        cell("results_net_profit", "INR", scaled("Net Profit", "v3")),
        cell("results_eps", "INR", figure("EPS", "v3")),
        cell("results_quarterly_eps", "INR", figure("EPS", "v1")),
        cell("earnings_quarterly_growth", "fraction", V.rounded(F.try_divide(latest - previous, F.abs(previous)), 6)),
    ]
    return emit(parsed, ["ticker"], cells).drop("is_valid", "issue_code")


# ---- quotes and instrument keys -----------------------------------------------------------------

QUOTES = (
    "map<string,struct<instrument_token:string,symbol:string,last_price:double,volume:double,timestamp:string,last_trade_time:string,"
    "ohlc:struct<open:double,high:double,low:double>>>"
)


def instrument_keys(master: DataFrame) -> DataFrame:
    """Ticker to instrument key: equity segment only, EQ type first, then file order."""
    rows = master.filter("segment = 'NSE_EQ'").select(
        V.ticker_norm("trading_symbol").alias("ticker"), F.trim("instrument_key").alias("instrument_key"), "instrument_type", "position"
    ).filter("ticker <> '' AND instrument_key <> ''")
    preferred = F.when(F.col("instrument_type") == "EQ", 1).otherwise(0)
    return L.pick(rows, ["ticker"], [preferred, -F.col("position")]).select("ticker", "instrument_key")


def quotes(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Quote maps to price observations; matched by instrument token, else by symbol."""
    rows = df.select(F.explode(F.from_json("payload", QUOTES)).alias("response_key", "q"))
    rows = rows.withColumns(
        {
            "instrument_key": F.replace(F.coalesce("q.instrument_token", F.lit("")), F.lit(":"), F.lit("|")),
            "symbol": V.ticker_norm(F.coalesce("q.symbol", F.element_at(F.split("response_key", ":"), -1))),
        }
    )
    by_key = keys.select("instrument_key", F.col("ticker").alias("by_key"))
    by_symbol = keys.select(F.col("ticker").alias("symbol"), F.lit(True).alias("known"))
    named = rows.join(by_key, "instrument_key", "left").join(by_symbol, "symbol", "left")
    named = named.withColumn("ticker", F.coalesce("by_key", F.when(F.col("known"), F.col("symbol")))).filter("ticker IS NOT NULL")
    cells = [
        cell("current_price", "INR", F.col("q.last_price")), cell("day_open", "INR", F.col("q.ohlc.open")),
        cell("day_high", "INR", F.col("q.ohlc.high")), cell("day_low", "INR", F.col("q.ohlc.low")), cell("day_volume", "shares", F.col("q.volume")),
    ]
    observed = T.quote_instant("q.timestamp", "q.last_trade_time").alias("observed_at")
    return emit(named, ["ticker", observed], cells).drop("is_valid", "issue_code")


# ---- ratios, overviews, holders --------------------------------------------------------------------

KEY_RATIOS = "struct<status:string,data:array<struct<name:string,company_value:string,sector_value:string>>>"


def _key_ratio_cells() -> Column:
    fields = V.literal_map({k: f for k, (f, _) in catalog.KEY_RATIOS.items()})
    units = V.literal_map({k: u for k, (_, u) in catalog.KEY_RATIOS.items()})
    name = lambda r: F.upper(F.trim(r["name"]))
    rows = F.when(F.col("_p.status") == "success", F.col("_p.data"))
    cells = F.transform(
        F.coalesce(rows, F.array().cast("array<struct<name:string,company_value:string,sector_value:string>>")),
        lambda r: F.struct(
            F.element_at(fields, name(r)).alias("field"), F.element_at(units, name(r)).alias("unit"), V.number(r["company_value"]).alias("numeric_value")
        ),
    )
    return F.filter(cells, lambda c: c["field"].isNotNull() & c["numeric_value"].isNotNull())


def key_ratios(df: DataFrame) -> DataFrame:
    """Named company ratios to canonical fields; sector benchmarks are ignored; a repeat overrides."""
    parsed = V.settled(V.settled(df.withColumn("_p", F.from_json("payload", KEY_RATIOS))).withColumn("_cells", _key_ratio_cells()))
    last = F.filter("_cells", lambda c, i: ~F.exists(F.slice("_cells", i + 2, F.size("_cells")), lambda later: later["field"] == c["field"]))
    return parsed.select("ticker", F.inline(last))


def key_ratio_issues(df: DataFrame) -> DataFrame:
    """Documents without any usable ratio: empty coverage is a warning, anything else a schema error."""
    parsed = df.withColumn("_p", F.from_json("payload", KEY_RATIOS)).withColumn("_n", F.size(_key_ratio_cells())).filter("_n = 0")
    empty = F.coalesce((F.col("_p.status") == "success") & (F.size("_p.data") == 0), F.lit(False))
    return parsed.select(
        "ticker",
        F.when(empty, "provider_empty_payload").otherwise("provider_schema_invalid").alias("code"),
        F.when(empty, "warning").otherwise("error").alias("severity"),
    )


OVERVIEW = "map<string,string>"


def overview(df: DataFrame) -> DataFrame:
    """Company overview to six metrics; sentinel texts are dropped; throttling notes yield nothing."""
    parsed = V.settled(df.withColumn("_o", F.from_json("payload", OVERVIEW))).filter(
        "coalesce(_o['Note'], '') = '' AND coalesce(_o['Information'], '') = ''"
    )
    text = lambda k: F.when(~F.col("_o")[k].isin("", "None", "-"), F.col("_o")[k])
    value = lambda k: V.to_double(text(k))
    cells = [
        cell("market_cap", F.col("_o")["Currency"], value("MarketCapitalization")), cell("trailing_pe", "ratio", value("PERatio")),
        cell("price_to_book", "ratio", value("PriceToBookRatio")), cell("roe_pct", "fraction", value("ReturnOnEquityTTM")),
        cell("profit_margin_pct", "fraction", value("ProfitMargin")), cell("sector", None, text=text("Sector")),
    ]
    return emit(parsed, ["ticker"], cells).drop("is_valid", "issue_code")


def holders(df: DataFrame) -> DataFrame:
    """Holder fractions as percent (what scoring reads) and as the fraction itself."""
    cells = [
        cell(field, unit, V.rounded(F.col(source) * factor, 6))
        for source, field, factor, unit in (
            ("heldPercentInsiders", "promoter_pct", 100.0, "percent"), ("heldPercentInstitutions", "institutional_pct", 100.0, "percent"),
            ("heldPercentInsiders", "heldPercentInsiders", 1.0, "fraction"), ("heldPercentInstitutions", "heldPercentInstitutions", 1.0, "fraction"),
        )
    ]
    return emit(df, ["ticker"], cells).drop("is_valid", "issue_code", "text_value")


def holder_text(df: DataFrame, label: str) -> DataFrame:
    """Fraction from the free-text row that mentions the label: the first percentage in it."""
    hit = F.contains(F.lower("text"), F.lit(label.lower()))
    found = F.regexp_extract("text", r"(-?[0-9]+(?:\.[0-9]+)?)\s*%", 1)
    return df.filter(hit).select("ticker", (V.to_double(F.nullif(found, F.lit(""))) / 100).alias("fraction")).filter("fraction IS NOT NULL")


def headline_ratios(df: DataFrame) -> DataFrame:
    """Named headline ratios from whole HTML pages; the last mention of a name wins."""
    labels = F.regexp_extract_all("html", F.lit(catalog.HEADLINE_RATIO_PATTERN), F.lit(1))
    numbers = F.regexp_extract_all("html", F.lit(catalog.HEADLINE_RATIO_PATTERN), F.lit(2))
    pairs = F.arrays_zip(labels.alias("label"), numbers.alias("raw"))
    value = lambda p: V.to_double(F.trim(F.replace(p["raw"], F.lit(","), F.lit(""))))
    rows = df.withColumn("_pairs", F.transform(pairs, lambda p: F.struct(p["label"].alias("label"), value(p).alias("value"))))
    last = lambda name: F.try_element_at(F.filter("_pairs", lambda p: (p["label"] == name) & p["value"].isNotNull()), F.lit(-1))["value"]
    cells = [cell("roe_pct", "percent", last("ROE")), cell("roce_pct", "percent", last("ROCE"))]
    return emit(rows, ["page_id"], cells).drop("is_valid", "issue_code", "text_value")


def headline_issues(df: DataFrame) -> DataFrame:
    """Pages on which no headline ratio could be found."""
    return df.filter(~F.col("html").rlike(catalog.HEADLINE_RATIO_PATTERN)).select("page_id", F.lit("provider_schema_changed").alias("code"))


# ---- annual return on equity ------------------------------------------------------------------------

_POINTS = "array<struct<asOfDate:string,reportedValue:struct<raw:double>>>"
_INCOME = ("annualNetIncomeCommonStockholders", "annualNetIncome")
_EQUITY = ("annualStockholdersEquity", "annualCommonStockEquity")
TIMESERIES = (
    "struct<timeseries:struct<result:array<struct<meta:struct<type:array<string>>,"
    + ",".join(f"{name}:{_POINTS}" for name in (*_INCOME, *_EQUITY)) + ">>>>"
)


def _series(names: Sequence[str]) -> Column:
    """Points of the first preferred series that has any."""
    def of(name: str) -> Column:
        blocks = F.transform(
            F.filter("_blocks", lambda b: F.get(b["meta"]["type"], F.lit(0)) == name),
            lambda b: F.filter(b[name], lambda p: p["asOfDate"].isNotNull() & V.finite(p["reportedValue"]["raw"]).isNotNull()),
        )
        usable = F.filter(blocks, lambda s: F.size(s) > 0)
        return F.try_element_at(usable, F.lit(-1))

    points = F.coalesce(*[of(n) for n in names])
    return F.array_sort(F.transform(points, lambda p: F.struct(p["asOfDate"].alias("day"), p["reportedValue"]["raw"].alias("value"))))


def annual_roe(df: DataFrame) -> DataFrame:
    """Net income over the mean of current and previous equity, newest common period, percent.

    The newest period that has an earlier equity decides; non-positive equity there means no value.
    All within one document: sorted arrays of at most a few years.
    """
    parsed = V.settled(df.withColumn("_blocks", F.from_json("payload", TIMESERIES)["timeseries"]["result"]))
    parsed = V.settled(parsed.withColumns({"_income": _series(_INCOME), "_equity": _series(_EQUITY)}))
    candidates = F.transform(
        "_income",
        lambda i: F.struct(
            i["day"].alias("day"), i["value"].alias("income"),
            F.try_element_at(F.filter("_equity", lambda e: e["day"] == i["day"]), F.lit(-1))["value"].alias("equity"),
            F.try_element_at(F.filter("_equity", lambda e: e["day"] < i["day"]), F.lit(-1))["value"].alias("previous"),
        ),
    )
    newest = F.try_element_at(F.filter(candidates, lambda c: c["equity"].isNotNull() & c["previous"].isNotNull()), F.lit(-1))
    rows = V.settled(parsed.withColumn("_c", newest)).filter("_c IS NOT NULL AND _c.equity > 0 AND _c.previous > 0")
    value = F.col("_c.income") / ((F.col("_c.equity") + F.col("_c.previous")) / 2) * 100
    return rows.select("ticker", F.col("_c.day").alias("period"), V.rounded(value, 6).alias("roe_pct"))
