"""Readers for archived envelopes, exchange CSV files and identity lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from boursecraft import catalog
from boursecraft.functions import values as V
from boursecraft.operators.reconcile import active_equities
from boursecraft.session import ship_functions

ship_functions(__name__)

ENVELOPE = (
    "request_id string, provider string, endpoint string, requested_at timestamp, received_at timestamp, status_code int, "
    "request_params map<string,string>, payload struct<body_base64:string,text:string>, content_sha256 string"
)


def read_envelopes(spark: SparkSession, root: str) -> DataFrame:
    """Archived envelopes under ``<root>/<provider>/<date>/<id>.json`` with decoded bodies."""
    raw = spark.read.schema(ENVELOPE).option("multiLine", True).option("recursiveFileLookup", True).json(root)
    return with_bodies(raw)


@F.pandas_udf(StringType())
def _gunzip(bodies: pd.Series) -> pd.Series:
    import gzip

    return bodies.map(lambda b: None if b is None else gzip.decompress(b).decode("utf-8"))


def with_bodies(raw: DataFrame) -> DataFrame:
    """Add ``body``: the archived text, the decoded bytes, or the decompressed bytes.

    Only compressed bodies go through Python (Arrow batches); the rest decodes in the JVM.
    """
    blob = F.unbase64("payload.body_base64")
    zipped = F.coalesce(F.hex(F.substring(blob, 1, 2)) == "1F8B", F.lit(False))
    opened = _gunzip(F.when(zipped, blob))
    body = F.coalesce(F.col("payload.text"), F.when(zipped, opened).otherwise(F.decode(blob, "UTF-8")))
    return raw.withColumn("body", body)


def clean_headers(df: DataFrame, alnum: bool = False) -> DataFrame:
    """Column names without BOM and padding; ``alnum`` also uppercases and keeps only A-Z0-9."""
    def clean(name: str) -> str:
        text = name.lstrip("﻿").strip()
        return "".join(ch for ch in text.upper() if ch.isalnum()) if alnum else text

    return df.toDF(*[clean(c) for c in df.columns])


def read_exchange_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column as text: nothing is inferred from a sample."""
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail before anything is replaced when a source turns out empty (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_columns(df: DataFrame, names: Sequence[str], message: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{message}: missing {', '.join(missing)}")
    return df


def listing(raw: DataFrame) -> DataFrame:
    """Exchange equity list: valid equity ISIN and a symbol; the name defaults to the symbol."""
    df = require_columns(clean_headers(raw), ["SYMBOL"], "equity list schema is invalid")
    isin_column = "ISIN NUMBER" if "ISIN NUMBER" in df.columns else "ISIN"
    isin, symbol = F.trim(F.col(f"`{isin_column}`")), V.blank_to_null("SYMBOL")
    name = V.blank_to_null(F.col("`NAME OF COMPANY`")) if "NAME OF COMPANY" in df.columns else F.lit(None)
    return df.filter(V.equity_isin(isin) & symbol.isNotNull()).select(
        symbol.alias("ticker"), F.lit("NSE").alias("exchange"), isin.alias("isin"), F.coalesce(name, symbol).alias("shortName")
    )


MASTER = "struct<segment:string,trading_symbol:string,instrument_key:string,instrument_type:string,isin:string,name:string>"


def exchange_master(df: DataFrame) -> DataFrame:
    """Broker instrument master (one JSON object per row) to equities, tagged as the fallback."""
    m = df.select(F.from_json("payload", MASTER).alias("m")).select("m.*")
    symbol = V.blank_to_null("trading_symbol")
    kept = (F.col("segment") == "NSE_EQ") & V.equity_isin("isin") & F.col("instrument_type").isin(*catalog.LIVE_EQUITY_TYPES)
    return m.filter(kept & symbol.isNotNull()).select(
        symbol.alias("ticker"), F.lit("NSE").alias("exchange"), "isin", F.coalesce(F.nullif("name", F.lit("")), symbol).alias("shortName"),
        F.lit("NSE lists unavailable; used Upstox NSE exchange master").alias("universe_note"),
    )


def valuation(raw: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Daily P/E file: adjusted then plain P/E, the first positive one."""
    df = require_columns(clean_headers(raw, alnum=True), ["SYMBOL"], "valuation file schema is invalid")
    candidates = [V.to_double(F.replace(F.col(c), F.lit(","), F.lit(""))) for c in ("ADJUSTEDPE", "SYMBOLPE") if c in df.columns]
    if not candidates:
        raise ValueError("valuation file has no P/E column")
    value = F.coalesce(*[F.when(c > 0, c) for c in candidates])
    rest = [c for c in ("TRADEDATE",) if c in df.columns]
    rows = df.select(V.ticker_norm("SYMBOL").alias("ticker"), value.alias("trailing_pe"), *rest).filter("trailing_pe IS NOT NULL")
    return rows if tickers is None else rows.join(tickers.select("ticker"), "ticker", "left_semi")


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def latest_file(rows: DataFrame, day: str, usable: Column, today, lookback: int = 12) -> DataFrame:
    """Rows of the newest weekday file within the lookback that has at least one usable row."""
    d = F.col(day)
    recent = (d <= F.lit(today).cast("date")) & (d > F.date_sub(F.lit(today).cast("date"), lookback)) & is_weekday(d)
    newest = rows.filter(recent & usable).agg(F.max(d).alias("day"))
    return rows.filter(usable & (d == newest.scalar()))


def recent_sessions(rows: DataFrame, day: str, sessions: int, today, lookback: int = 45) -> DataFrame:
    """The newest ``sessions`` weekday dates within the lookback that have rows (at most that many rows)."""
    d = F.col(day)
    recent = (d <= F.lit(today).cast("date")) & (d > F.date_sub(F.lit(today).cast("date"), lookback)) & is_weekday(d)
    return rows.filter(recent).select(d.alias("day")).distinct().orderBy(F.desc("day")).limit(sessions)


def delivery(raw: DataFrame) -> DataFrame:
    """Whole-market delivery file: EQ and BE series; no figure means no row; bad volume is zero."""
    df = require_columns(clean_headers(raw), ["SYMBOL", "DELIV_PER"], "delivery file schema is invalid")
    pct = V.to_double(F.trim("DELIV_PER"))
    volume = V.to_double(F.trim(F.replace("TTL_TRD_QNTY", F.lit(","), F.lit("")))) if "TTL_TRD_QNTY" in df.columns else F.lit(None)
    if "SERIES" in df.columns:
        df = df.filter(V.ticker_norm("SERIES").isin("EQ", "BE"))
    rest = [c for c in df.columns if c not in ("SYMBOL", "DELIV_PER", "TTL_TRD_QNTY", "SERIES")]
    rows = df.select(V.ticker_norm("SYMBOL").alias("symbol"), pct.alias("delivery_pct"), F.coalesce(volume, F.lit(0.0)).alias("volume"), *rest)
    return rows.filter("delivery_pct IS NOT NULL")


def flow_report(df: DataFrame) -> DataFrame:
    """Fund-flow report: net equity, mutual-fund and debt flows per report date (crore, 1 decimal).

    Summed as decimals, so the result does not depend on row order.
    """
    value = F.col("net").try_cast("decimal(18,4)")
    asset, route = F.col("asset_class"), F.col("route")

    def net(condition: Column) -> Column:
        return V.rounded(F.coalesce(F.sum(F.when(condition, value)).cast("double"), F.lit(0.0)), 1)

    return df.groupBy("report_date").agg(
        net((asset == "Equity") & (route == "Sub-total")).alias("fii_equity_net_cr"),
        net((asset == "Mutual Funds") & (route == "Equity schemes")).alias("mf_equity_net_cr"),
        net(asset.startswith("Debt") & (route == "Sub-total")).alias("debt_net_cr"),
    )


def identity_list(instruments: DataFrame) -> DataFrame:
    """Active equities as other jobs read them, by ticker."""
    return active_equities(instruments).select("ticker", "exchange", "isin", F.col("company_name").alias("shortName"), "sector").orderBy("ticker")


def apply_overrides(df: DataFrame, overrides: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Versioned per-ticker overrides win; an out-of-range override is an error before any row is read."""
    for ticker, fields in overrides.items():
        for field, value in fields.items():
            if value is None or (field != "institutions_count" and not 0 <= value <= 100):
                raise ValueError(f"invalid {field} override for {ticker}: {value}")
    columns = {}
    for field in ("promoter_pct", "institutional_pct", "institutions_count"):
        chosen = {t: float(f[field]) for t, f in overrides.items() if field in f}
        if chosen:
            # the override file is a hand-kept configuration, stated in the plan as a map literal
            columns[field] = F.coalesce(F.element_at(V.literal_map(chosen), F.col("ticker")), F.col(field))
    return df.withColumns(columns)


def raw_ownership(df: DataFrame) -> DataFrame:
    """Fractions to valid percents (1 decimal) plus a flag where a reading was impossible."""
    columns = {}
    for source, target in (("heldPercentInsiders", "promoter_pct"), ("heldPercentInstitutions", "institutional_pct")):
        value = V.rounded(V.valid_percent(F.col(source) * 100), 1)
        columns[f"{target}_raw"] = value
        columns[f"{target}_rejected"] = F.col(source).isNotNull() & value.isNull()
    return df.select("ticker", *[c.alias(n) for n, c in columns.items()])
