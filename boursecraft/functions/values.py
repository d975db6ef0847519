"""Number, text and identity expressions: Column in, Column out, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boursecraft import catalog


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def literal_map(mapping: dict) -> Column:
    """A map literal from a Python dict (small, fixed vocabularies only)."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.create_map(*pairs)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, each expression worked out once: projections above are not merged into those
    below, so a parsed document is not parsed again for every cell that reads it."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def rounded(value, digits: int) -> Column:
    """Half-even rounding on the scaled double: the rule numpy and pandas apply."""
    scale = float(10**digits)
    return F.rint(as_col(value) * F.lit(scale)) / F.lit(scale)


#: What counts as a number's text. The cast alone also takes type suffixes ('1d', '2f').
DOUBLE_TEXT = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?|nan)\s*$"


def to_double(text) -> Column:
    """Text to double where it is a number and nothing else; null otherwise."""
    t = as_col(text)
    return F.when(t.rlike(DOUBLE_TEXT), t.try_cast("double"))


def number(text) -> Column:
    """Parse provider text: commas and % stripped, sentinels, NaN and garbage become null."""
    cleaned = F.regexp_replace(F.trim(as_col(text)), "[,%]", "")
    parsed = to_double(cleaned)
    return F.when(~cleaned.isin(*catalog.NUMBER_SENTINELS) & ~F.isnan(parsed), parsed)


def finite(value) -> Column:
    """Null for NaN and the infinities."""
    v = as_col(value)
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def numeric_text(text) -> Column:
    """Text that matches the archive's numeric pattern, as a double."""
    t = as_col(text)
    return F.when(t.rlike(catalog.NUMERIC_PATTERN), t.try_cast("double"))


def blank_to_null(text) -> Column:
    return F.nullif(F.trim(as_col(text)), F.lit(""))


def is_blank_text(text) -> Column:
    t = as_col(text)
    return t.isNull() | (F.trim(t) == "")


def is_blank_number(value) -> Column:
    v = as_col(value)
    return v.isNull() | F.isnan(v)


def normal_symbol(symbol) -> Column:
    return F.regexp_replace(F.upper(as_col(symbol)), "[^A-Z0-9]", "")


def market_symbol(ticker) -> Column:
    """Exchange-suffixed symbol: dotted and caret symbols stay, the rest get ``.NS``."""
    t = as_col(ticker)
    return F.when(F.contains(t, F.lit(".")) | t.startswith("^"), t).otherwise(F.concat(t, F.lit(".NS")))


def ticker_norm(ticker) -> Column:
    return F.upper(F.trim(as_col(ticker)))


def equity_isin(isin) -> Column:
    c = as_col(isin)
    return (F.length(c) == 12) & c.startswith("INE") & (F.substring(c, 8, 2) == "01")


def canonical_field(field) -> Column:
    """Both vocabularies onto one name; unknown names pass through trimmed."""
    key = F.trim(as_col(field))
    lookup = F.lower(F.replace(key, F.lit("_"), F.lit("")))
    return F.coalesce(F.element_at(literal_map(catalog.FIELD_ALIASES), lookup), key)


# Unicode-aware character classes, spelled out so that no engine default matters
SPACE = r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DETAIL_FOLDS = (
    (rf"https?://[^{SPACE}]+", "<url>"),
    (r"0x[0-9a-fA-F]+", "<addr>"),
    (r"(/[\p{L}\p{N}_.\-]+){2,}", "<path>"),
    (r"\p{Nd}+", "#"),
    (rf"[{SPACE}]+", " "),
)
DETAIL_LENGTH = 160


def normalise_detail(detail) -> Column:
    """Fold URLs, addresses, paths, digits and whitespace so alike messages group."""
    text = F.coalesce(as_col(detail), F.lit(""))
    for pattern, token in DETAIL_FOLDS:
        text = F.regexp_replace(text, pattern, token)
    return F.substring(F.trim(text), 1, DETAIL_LENGTH)


def basis_metric(field) -> Column:
    """``x_basis`` -> ``x``; null for any other field."""
    f = as_col(field)
    return F.when(F.right(f, F.lit(6)) == "_basis", F.left(f, F.length(f) - 6))


def spread_ratio(left, right) -> Column:
    """Larger over smaller of two values; null when the smaller is zero."""
    a, b = as_col(left), as_col(right)
    return F.try_divide(F.greatest(a, b), F.least(a, b))


def safe_ratio(numerator, denominator, multiplier: float = 1.0) -> Column:
    n, d = as_col(numerator), as_col(denominator)
    return F.when(d > 0, n / d * F.lit(multiplier))


def safe_growth(latest, previous) -> Column:
    a, b = as_col(latest), as_col(previous)
    return F.when(b > 0, a / b - 1)


def preferred_basis(consolidated, standalone, *, positive: bool = False, nonzero: bool = False) -> Column:
    """First acceptable of (consolidated, standalone) as struct(value, basis)."""

    def usable(v: Column) -> Column:
        ok = v.isNotNull()
        if positive:
            ok = ok & (v > 0)
        if nonzero:
            ok = ok & (v != 0)
        return ok

    picks = [
        F.when(usable(v), F.struct(v.alias("value"), F.lit(basis).alias("basis")))
        for v, basis in ((as_col(consolidated), "consolidated"), (as_col(standalone), "standalone"))
    ]
    return F.coalesce(*picks)


def crore(value) -> Column:
    return as_col(value) * F.lit(catalog.CRORE)


def redact(params) -> Column:
    """Hide map values whose key names a secret."""
    pattern = "(?i)" + "|".join(catalog.SECRET_FRAGMENTS)
    return F.transform_values(as_col(params), lambda k, v: F.when(k.rlike(pattern), F.lit("[redacted]")).otherwise(v))


def clean_number(value, digits: int = 2) -> Column:
    v = as_col(value)
    return F.when(~F.isnan(v), rounded(v, digits))


def valid_value(field: str, value) -> Column:
    """Acceptance rule used before a blank may be filled."""
    v = as_col(value)
    if field in catalog.TEXT_FIELDS:
        return ~is_blank_text(v)
    low, high = catalog.VALUE_BOUNDS.get(field, catalog.DEFAULT_BOUNDS)
    return F.coalesce(v.between(low, high) & ~F.isnan(v), F.lit(False))


def valid_percent(value) -> Column:
    v = as_col(value)
    return F.when(v.between(0, 100), v)


def is_lender(sector) -> Column:
    return F.coalesce(F.lower(as_col(sector)) == catalog.LENDER_SECTOR, F.lit(False))
