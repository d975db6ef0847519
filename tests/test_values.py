"""Column functions on literal rows."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from boursecraft.functions import dates as T
from boursecraft.functions import finance as N
from boursecraft.functions import values as V


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("1,234.5", 1234.5), ("12%", 12.0), (" - ", None), ("NA", None), ("", None), ("abc", None), ("NaN", None), ("-3", -3.0), ("1d", None), ("2f", None), ("1e3", 1000.0), (".5", 0.5), (None, None)],
)
def test_number(spark, text, expected):
    assert one(spark, V.number(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize(("text", "expected"), [(".5", None), ("+1", None), ("12.", 12.0), ("1e5", 1e5), ("x", None)])
def test_archive_numeric_pattern_is_kept(spark, text, expected):
    assert one(spark, V.numeric_text(F.lit(text))) == expected


def test_finite_drops_nan_and_infinities(spark):
    assert one(spark, V.finite(F.lit(math.nan))) is None
    assert one(spark, V.finite(F.lit(math.inf))) is None
    assert one(spark, V.finite(F.lit(-2.5))) == -2.5


@pytest.mark.parametrize(("value", "digits", "expected"), [(0.25, 1, 0.2), (0.35, 1, 0.4), (2.5, 0, 2.0), (-0.25, 1, -0.2), (88.64999, 1, 88.6)])
def test_rounding_is_half_even_on_the_scaled_value(spark, value, digits, expected):
    assert one(spark, V.rounded(F.lit(value), digits)) == expected


def test_symbols(spark):
    assert one(spark, V.market_symbol(F.lit("RELIANCE"))) == "RELIANCE.NS"
    assert one(spark, V.market_symbol(F.lit("500325.BO"))) == "500325.BO"
    assert one(spark, V.market_symbol(F.lit("^NSEI"))) == "^NSEI"
    assert one(spark, V.normal_symbol(F.lit("m&m-fin"))) == "MMFIN"


def test_equity_isin(spark):
    assert one(spark, V.equity_isin(F.lit("INE002A01018")))
    assert not one(spark, V.equity_isin(F.lit("INE002A04018")))
    assert not one(spark, V.equity_isin(F.lit("INF002A01018")))


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("timed out after 30s at https://x.y/z?a=1", "timed out after #s at <url>"),
        ("object at 0xDEADBEEF in /usr/lib/x.py", "object at <addr> in <path>"),
        ("  a \n\t b  ", "a b"),
    ],
)
def test_detail_folding(spark, raw, expected):
    assert one(spark, V.normalise_detail(F.lit(raw))) == expected


def test_detail_is_cut(spark):
    assert len(one(spark, V.normalise_detail(F.lit("x" * 500)))) == 160


def test_canonical_field(spark):
    for raw, name in (("trailingPE", "trailing_pe"), ("trailing_pe", "trailing_pe"), ("returnOnEquity", "roe_pct"), ("current_ratio", "current_ratio")):
        assert one(spark, V.canonical_field(F.lit(raw))) == name


def test_preferred_basis(spark):
    con, sa = F.lit(-1.0), F.lit(12.0)
    assert tuple(one(spark, V.preferred_basis(con, sa, positive=True))) == (12.0, "standalone")
    assert tuple(one(spark, V.preferred_basis(con, sa, nonzero=True))) == (-1.0, "consolidated")


def test_periods(spark):
    assert one(spark, T.period_end(F.lit("Feb 2024"))) == dt.date(2024, 2, 29)
    assert one(spark, T.period_end(F.lit("bad"))) is None
    assert one(spark, T.prior_year_end(F.lit(dt.date(2024, 2, 29)))) == dt.date(2023, 2, 28)


def test_epoch_in_seconds_or_milliseconds(spark):
    seconds, millis = T.epoch_instant(F.lit(1700000000.0)), T.epoch_instant(F.lit(1700000000000.0))
    assert one(spark, seconds) == one(spark, millis)


def test_peg_needs_profit_and_growth_and_is_capped(spark):
    peg = lambda pe, g, **k: one(spark, N.trailing_peg(F.lit(pe), F.lit(g), **k))
    assert peg(22.0, 0.11) == 2.0
    assert peg(22.0, 11.0, growth_is_fraction=False) == 2.0
    assert peg(-5.0, 0.1) is None
    assert peg(20.0, -0.1) is None
    assert peg(5000.0, 0.0001) == 100.0


def test_buy_zone_clamps_beta(spark):
    zone = lambda beta: {k: one(spark, c) for k, c in N.buy_zone(F.lit(100.0), F.lit(beta).cast("double"), 0.2).items()}
    assert zone(None)["deep_price"] == pytest.approx(80.0)
    assert zone(9.0)["beta_used"] == 2.5
    assert zone(0.1)["shallow_price"] == pytest.approx(97.0)


def test_redaction(spark):
    params = F.create_map(F.lit("ApiKey"), F.lit("s"), F.lit("symbol"), F.lit("X"))
    assert one(spark, V.redact(params)) == {"ApiKey": "[redacted]", "symbol": "X"}
