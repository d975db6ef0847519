"""Ratios and signals computed from one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boursecraft.functions.values import as_col, finite, rounded


def trailing_peg(pe, growth, *, growth_is_fraction: bool = True, cap: float = 100.0) -> Column:
    """P/E over growth percent; both must be positive; capped; 6 decimals."""
    p, g = finite(pe), finite(growth)
    growth_pct = g * 100 if growth_is_fraction else g
    return F.when((p > 0) & (growth_pct > 0), rounded(F.least(p / growth_pct, F.lit(cap)), 6))


def rsi_signal(value, low: float = 30.0, high: float = 70.0) -> Column:
    v = as_col(value)
    return (
        F.when(v <= low, "oversold").when(v >= high, "overbought").when(v.isNotNull(), "neutral")
    )


def buy_zone(price, beta, drawdown: float) -> dict[str, Column]:
    """Beta-scaled entry prices: beta defaults to 1 and is held within 0.3 .. 2.5."""
    p = as_col(price)
    b = F.greatest(F.lit(0.3), F.least(F.lit(2.5), F.coalesce(F.nanvl(as_col(beta), F.lit(1.0)), F.lit(1.0))))
    return {
        "beta_used": b,
        "deep_price": p * (1 - b * drawdown),
        "shallow_price": p * (1 - 0.5 * b * drawdown),
        "discount_pct": F.when(p.isNotNull(), b * drawdown * 100),
    }


def range_position(price, low, high, pct_below_high) -> Column:
    """Position within the 52-week range; a missing high is inferred from % below high."""
    p, lo, off = as_col(price), as_col(low), as_col(pct_below_high)
    known_high = F.when(as_col(high) != 0, as_col(high))
    inferred = F.when((p != 0) & (off != 0), F.try_divide(p, 1 - off / 100))
    hi = F.coalesce(known_high, inferred)
    return F.when((p != 0) & (lo != 0) & (hi > lo), rounded((p - lo) / (hi - lo) * 100, 1))


def rescaled_market_cap(market_cap, old_price, new_price) -> Column:
    """Market cap carried to a new price; unchanged without a usable old price."""
    cap, old, new = as_col(market_cap), as_col(old_price), as_col(new_price)
    return F.when(cap.isNotNull() & (old > 0) & new.isNotNull(), cap * new / old).otherwise(cap)
