"""Cross-sectional scoring: derived factors, coverage, percentile groups, shrunken final score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boursecraft import catalog
from boursecraft.functions import values as V
from boursecraft.operators.ranks import ordinal_rank, percentile_ranks, value_ranks
from boursecraft.session import materialise

METRICS = tuple(catalog.DIRECTIONS)
_RATIOS = ("trailingPE", "priceToBook", "pegRatio", "enterpriseToEbitda")


def _num(df: DataFrame, name: str) -> Column:
    return V.finite(F.col(name).cast("double")) if name in df.columns else F.lit(None).cast("double")


def drop_archive_values(current: DataFrame) -> DataFrame:
    """Archive-only values must not score; descriptive fields may stay. Applied on the long form."""
    return current.filter(~((F.col("origin") == "archive") & ~F.col("field").isin("sector", "industry", "shortName")))


def _ownership(df: DataFrame) -> dict[str, Column]:
    """Reported ownership; the fraction fallback only where a column is null for everyone.

    Whether anyone has a value is a scalar subquery: one counter, no join.
    """
    out: dict[str, Column] = {}
    for field, fallback in (("institutional_pct", "heldPercentInstitutions"), ("promoter_pct", "heldPercentInsiders")):
        spare = _num(df, fallback) * 100
        if field in df.columns:
            anyone = df.agg(F.count(F.col(field))).scalar()
            value = F.when(anyone > 0, _num(df, field)).otherwise(spare)
        else:
            value = spare
        out[field] = V.valid_percent(value)
    return out


def derive_factors(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Add the scored columns that no source supplies directly.

    ``legacy`` clips returns and margins and lets the net margin stand in for EBITDA.
    Zero denominators give null (never an infinity that would rank at an extreme).
    """
    n = lambda c: _num(df, c)
    roe = n("returnOnEquity") * 100
    roa = n("returnOnAssets")
    margin = n("ebitdaMargins") * 100
    if legacy:
        roe = F.greatest(F.lit(-100.0), F.least(F.lit(150.0), roe))
        roe = F.when(n("returnOnEquity").isNotNull(), roe)
        roa = F.when(roa.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), roa)))
        margin = F.coalesce(n("ebitdaMargins"), n("profitMargins")) * 100
        margin = F.when(margin.isNotNull(), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), margin)))
    below_high = F.try_divide(n("fiftyTwoWeekHigh") - n("currentPrice"), n("fiftyTwoWeekHigh")) * 100
    owners = _ownership(df)
    over = F.coalesce(owners["promoter_pct"] + owners["institutional_pct"] > catalog.OWNERSHIP_LIMIT, F.lit(False))
    derived = {
        "roe_pct": F.when(~F.coalesce((n("profitMargins") < 0) & (roe > 50), F.lit(False)), roe),
        "ebitda_margin": margin,
        "pct_below_52w_high": F.when(below_high.isNotNull(), F.least(below_high, F.lit(catalog.DRAWDOWN_CAP))),
        "px_vs_50dma": (F.try_divide(n("currentPrice"), n("fiftyDayAverage")) - 1) * 100,
        "px_vs_200dma": (F.try_divide(n("currentPrice"), n("twoHundredDayAverage")) - 1) * 100,
        "upside_pct": (F.try_divide(n("targetMeanPrice"), n("currentPrice")) - 1) * 100,
        "fwd_eps_growth": F.when(n("trailingEps") > 0, (n("forwardEps") / n("trailingEps") - 1) * 100),
        "returnOnAssets": roa,
        "promoter_pct": owners["promoter_pct"],
        "institutional_pct": F.when(~over, owners["institutional_pct"]),
    }
    derived.update({c: F.when(n(c) > 0, n(c)) for c in _RATIOS if c in df.columns})
    return df.withColumns(derived)


def applicable(metric: str) -> Column:
    if metric in catalog.NOT_APPLICABLE_TO_LENDERS:
        return ~V.is_lender("sector")
    return F.lit(True)


def normalised_weights(overrides: Mapping[str, float] | None = None) -> dict[str, float]:
    weights = {**catalog.WEIGHTS, **(overrides or {})}
    unknown = set(weights) - set(catalog.WEIGHTS)
    if unknown:
        raise ValueError(f"Unknown weight {sorted(unknown)}; valid: {', '.join(catalog.WEIGHTS)}")
    total = sum(weights.values())
    return {g: w / total for g, w in weights.items()}


def parse_overrides(text: str | None) -> dict[str, float]:
    """``quality=4,growth=2`` -> weights."""
    pairs = [item.partition("=") for item in (text or "").split(",") if item.strip()]
    parsed = {name.strip(): float(value) for name, _, value in pairs}
    normalised_weights(parsed)
    return parsed


def _total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def group_coverage(df: DataFrame, group: str) -> Column:
    """Share of the group's applicable metrics that are present."""
    flags = [(applicable(m), F.col(m).isNotNull() if m in df.columns else F.lit(False)) for m, _ in catalog.GROUPS[group]]
    present = _total([(a & p).cast("int") for a, p in flags])
    possible = _total([a.cast("int") for a, _ in flags])
    return F.coalesce(F.try_divide(present, possible), F.lit(0.0))


def with_coverage(df: DataFrame, overrides: Mapping[str, float] | None = None) -> DataFrame:
    weights = normalised_weights(overrides)
    shares = {g: group_coverage(df, g) for g in catalog.GROUPS}
    weighted = _total([F.lit(weights[g]) * shares[g] for g in catalog.GROUPS])
    return df.withColumns(
        {
            "data_cov": V.rounded(weighted * 100, 1),
            "quality_cov": V.rounded(shares["quality"] * 100, 1),
            "valuation_cov": V.rounded(shares["valuation"] * 100, 1),
        }
    )


def metric_percentiles(df: DataFrame, id_column: str = "instrument_id", keys: Sequence[str] = ()) -> DataFrame:
    """Wide percentiles ``p_<metric>`` per stock: one unpivot, one exact rank pass, one pivot.

    Null readings have no percentile here; they get the neutral 0.5 in the group mean.
    """
    keys = list(keys)
    present = [m for m in METRICS if m in df.columns]
    values = [F.when(applicable(m), F.col(m)).cast("double") for m in present]
    return _wide_percentiles(df, id_column, keys, present, values, [catalog.DIRECTIONS[m] for m in present])


def _wide_percentiles(df: DataFrame, id_column: str, keys: list[str], names: Sequence[str], values: Sequence[Column],
                      signs: Sequence[int]) -> DataFrame:
    """Unpivot to (id, metric number, value), rank per metric, pivot back to ``p_<name>``.

    Metrics travel as small integers: four bytes per cell in the shuffles instead of a name.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("metric"), v.alias("value")) for i, v in enumerate(values)])
    long = df.select(id_column, *keys, F.inline(cells)).filter("value IS NOT NULL")
    direction = F.get(F.array(*[F.lit(s) for s in signs]), F.col("metric"))
    pct = percentile_ranks(long, [*keys, "metric"], direction)
    return long.join(pct, [*keys, "metric", "value"]).groupBy(id_column, *keys).agg(
        *[F.max(F.when(F.col("metric") == i, F.col("pct"))).alias(f"p_{n}") for i, n in enumerate(names)]
    )


def group_mean(group: str, present: Sequence[str]) -> Column:
    """Mean percentile over applicable metrics (missing counts as 0.5), 0..1."""
    metrics = [m for m, _ in catalog.GROUPS[group] if m in present]
    if not metrics:
        return F.lit(0.5)
    parts = [F.when(applicable(m), F.coalesce(F.col(f"p_{m}"), F.lit(0.5))).otherwise(0.0) for m in metrics]
    count = _total([applicable(m).cast("int") for m in metrics])
    return F.coalesce(F.try_divide(_total(parts), count), F.lit(0.5))


def with_groups(df: DataFrame, id_column: str = "instrument_id", keys: Sequence[str] = ()) -> DataFrame:
    """Add ``g_<group>`` scores, 0..100 with one decimal.

    What ranking reads again and again (histogram, boundary sketch, lookup) is a stored narrow table of
    the metrics; the record itself is joined once, with its scores.
    """
    keys, present = list(keys), [m for m in METRICS if m in df.columns]
    narrow = materialise(df.select(id_column, *keys, "sector", *present), "factors")
    ranked = narrow.join(metric_percentiles(narrow, id_column, keys), [id_column, *keys], "left")
    scores = {f"g_{g}": V.rounded(group_mean(g, present) * 100, 1) for g in catalog.GROUPS}
    return df.join(ranked.select(id_column, *keys, *[c.alias(n) for n, c in scores.items()]), [id_column, *keys], "left")


def model_score(weights: Mapping[str, float]) -> Column:
    return V.rounded(_total([F.lit(weights[g]) * (F.col(f"g_{g}") / 100) for g in catalog.GROUPS]) * 100, 1)


def score_status() -> Column:
    return (
        F.when(F.col("data_cov") < catalog.MIN_COVERAGE, "insufficient overall coverage")
        .when(F.col("quality_cov") < catalog.MIN_CORE_COVERAGE, "insufficient quality data")
        .when(F.col("valuation_cov") < catalog.MIN_CORE_COVERAGE, "insufficient valuation data")
        .otherwise("ranked")
    )


def with_final_score(df: DataFrame) -> DataFrame:
    """Shrink toward 50 by coverage; below the gates the score is withheld, the row is kept."""
    adjusted = V.rounded(50 + (F.col("model_score") - 50) * (F.col("data_cov") / 100), 1)
    rated = df.withColumn("score_status", score_status())
    return rated.withColumn("final_score", F.when(F.col("score_status") == "ranked", adjusted))


def with_rank(df: DataFrame, id_column: str = "instrument_id", keys: Sequence[str] = ()) -> DataFrame:
    """1..n over scored rows by final then model score, then id; unranked rows keep a null rank.

    ``df`` is read twice: a stored table.
    """
    keys = list(keys)
    scored = df.filter("final_score IS NOT NULL").select(id_column, *keys, "final_score", "model_score")
    ranks = ordinal_rank(scored, ["final_score", "model_score"], id_column, keys=keys).select(id_column, *keys, "rank")
    return df.join(ranks, [id_column, *keys], "left")


def score_factors(df: DataFrame, overrides: Mapping[str, float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Everything after factor derivation, except the rank."""
    weights = normalised_weights(overrides)
    grouped = with_groups(with_coverage(df, overrides), keys=keys)
    return with_final_score(grouped.withColumn("model_score", model_score(weights)))


def score_universe(stocks: DataFrame, overrides: Mapping[str, float] | None = None, legacy: bool = False,
                   min_mcap_cr: float | None = None) -> DataFrame:
    """The whole scorer. ``legacy`` adds the clips, the price filter and the market-cap filter.

    Scores and ranks are worked out on the columns that they need; the wide record is stored once and
    joined once, with its result.
    """
    df = derive_factors(materialise(stocks, "stocks"), legacy)
    if legacy:
        df = df.filter("currentPrice IS NOT NULL")
        if min_mcap_cr is not None:
            df = df.filter(F.col("marketCap") / catalog.CRORE >= min_mcap_cr)
    narrow = df.select("instrument_id", "sector", *[m for m in METRICS if m in df.columns])
    scores = score_factors(narrow, overrides)
    scores = materialise(scores.select("instrument_id", *[c for c in scores.columns if c not in narrow.columns]), "scores")
    return df.join(with_rank(scores), "instrument_id")


# ---- alternative weightings ---------------------------------------------------------------------

_LENS_KEEPS = ("instrument_id", "ticker", "shortName", "sector", "quality_cov", "valuation_cov")


def lens_values(df: DataFrame, lenses: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Scores under named lenses, unranked: a fixed array of lenses exploded per stock.

    Groups are computed once; coverage depends on the weights, so it is redone per lens. Only the
    identity, the group scores and the two gates are exploded, not the record's inputs.
    """
    lenses = lenses or catalog.LENSES
    shares = {g: group_coverage(df, g) for g in catalog.GROUPS}
    rows = []
    for name, overrides in lenses.items():
        w = normalised_weights(overrides)
        rows.append(
            F.struct(
                F.lit(name).alias("lens"),
                V.rounded(_total([F.lit(w[g]) * shares[g] for g in catalog.GROUPS]) * 100, 1).alias("data_cov"),
                model_score(w).alias("model_score"),
            )
        )
    kept = [c for c in df.columns if c in _LENS_KEEPS or c.startswith("g_")]
    narrow = df.select(*kept, F.array(*rows).alias("_lenses"))
    return with_final_score(narrow.select(*kept, F.inline("_lenses")))


def lens_scores(df: DataFrame, lenses: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The universe re-weighted and ranked under every lens."""
    return with_rank(materialise(lens_values(df, lenses), "lenses"), keys=["lens"])


def column_weight_scores(df: DataFrame, id_column: str) -> DataFrame:
    """Single-level weighted percentile over ten columns; a missing column voids the score."""
    columns = list(catalog.COLUMN_WEIGHTS)
    df = materialise(df.select(id_column, *columns), "columns")
    values = [F.col(c).cast("double") for c in columns]
    wide = _wide_percentiles(df, id_column, [], columns, values, [sign for _, sign in catalog.COLUMN_WEIGHTS.values()])
    score = _total([F.lit(w) * F.col(f"p_{c}") for c, (w, _) in catalog.COLUMN_WEIGHTS.items()]) * 100
    groups = {
        f"s_{g}": V.rounded(_total([F.col(f"p_{c}") for c in members]) / len(members) * 100, 0)
        for g, members in catalog.COLUMN_GROUPS.items()
    }
    every = df.select(id_column).join(wide, id_column, "left")
    return every.select(id_column, score.alias("final_score"), *[c.alias(k) for k, c in groups.items()])


#: The two inputs that a scenario overrides.
VARIED = ("earningsGrowth", "earningsQuarterlyGrowth")


def _percentile(below: Column, ties: Column, total: Column, sign: int) -> Column:
    """Average-tie percentile of a value from the rows below it, those that share it and all."""
    ahead = below if sign > 0 else total - below - ties
    return (ahead + (ties + 1) / F.lit(2.0)) / total


def value_histogram(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, value, below, ties, total): how many rows are below each value and share it.

    Stored: a value that is put in or taken out moves the counts of the values above it by one.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("metric"), F.col(m).cast("double").alias("value")) for i, m in enumerate(metrics)])
    return materialise(value_ranks(df.select(F.inline(cells)), ["metric"]), "histogram")


def what_if(stocks: DataFrame, ticker: str, scenarios: Mapping[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Override two growth inputs of one ticker per scenario, rescore the universe, report deltas.

    The universe is ranked once: percentiles of the other inputs as they are, and the counts around each
    value of the two without the stock. A scenario puts one value in, which moves a count by one for the
    values above it: per stock and scenario that is arithmetic on two looked-up counts. The stock's rank is
    the number of stocks ahead of it. ``ticker`` names one stock; without it there are no rows.
    """
    scenarios = scenarios or catalog.SCENARIOS
    names = list(scenarios)
    hit = F.col("ticker") == ticker
    # this scorer predates coverage: plain group means, no gates, no lender exemption
    base = derive_factors(stocks, legacy=True).filter("currentPrice IS NOT NULL").withColumn("sector", F.lit(None).cast("string"))
    base = base.select("instrument_id", "ticker", "sector", *[m for m in METRICS if m in base.columns])
    base = materialise(base.withColumns({m: F.when(~F.coalesce(hit, F.lit(False)), F.col(m)) for m in VARIED}), "universe")
    present = [m for m in METRICS if m in base.columns]
    fixed = metric_percentiles(base.drop(*VARIED), "instrument_id")
    counts = value_histogram(base, VARIED)
    wide = base.select("instrument_id", "ticker", *VARIED).join(fixed, "instrument_id", "left")
    for i, m in enumerate(VARIED):
        found = counts.filter(F.col("metric") == i).select(F.col("value").alias(m), F.col("below").alias(f"{m}_below"), F.col("ties").alias(f"{m}_ties"))
        wide = wide.join(found, m, "left")
    # what the scenarios' values meet: a dozen sums over the histogram
    value = {(k, i): None if scenarios[n][i] is None else float(scenarios[n][i]) for k, n in enumerate(names) for i in range(2)}
    sums = [F.max(F.when(F.col("metric") == i, F.col("total"))).alias(f"total_{i}") for i in range(2)]
    for (k, i), v in value.items():
        mine = F.col("metric") == i
        sums += [F.sum(F.when(mine & (F.col("value") < v), F.col("ties"))).alias(f"below_{k}_{i}"), F.sum(F.when(mine & (F.col("value") == v), F.col("ties"))).alias(f"ties_{k}_{i}")] if v is not None else []
    met = {k: v or 0 for k, v in counts.agg(*sums).first().asDict().items()}

    def percentile(k: int, i: int) -> Column:
        """Of one varied input in one scenario, for the stock itself and for all others."""
        m, v, sign = VARIED[i], value[k, i], catalog.DIRECTIONS[VARIED[i]]
        total = F.lit(met[f"total_{i}"] + (v is not None))
        own = F.lit(None).cast("double") if v is None else _percentile(F.lit(met[f"below_{k}_{i}"]), F.lit(met[f"ties_{k}_{i}"] + 1), total, sign)
        above, same = (F.lit(0), F.lit(0)) if v is None else ((F.col(m) > v).cast("long"), (F.col(m) == v).cast("long"))
        other = F.when(F.col(m).isNotNull(), _percentile(F.col(f"{m}_below") + above, F.col(f"{m}_ties") + same, total, sign))
        return F.when(hit, own).otherwise(other)

    def group(name: str, k: int) -> Column:
        metrics = [m for m, _ in catalog.GROUPS[name] if m in present]
        parts = [F.coalesce(percentile(k, VARIED.index(m)) if m in VARIED else F.col(f"p_{m}"), F.lit(0.5)) for m in metrics]
        return V.rounded(_total(parts) / len(metrics) * 100, 1)

    weights = normalised_weights()
    columns = {}
    for k in range(len(names)):
        groups = {g: group(g, k) for g in catalog.GROUPS}
        columns[f"growth_{k}"] = groups["growth"]
        columns[f"score_{k}"] = V.rounded(_total([F.lit(weights[g]) * (groups[g] / 100) for g in catalog.GROUPS]) * 100, 1)
    scored = materialise(wide.select("instrument_id", "ticker", *[c.alias(n) for n, c in columns.items()]), "scenario_scores")
    rows = scored.filter(hit).limit(2).collect()
    schema = "scenario string, g_growth double, final_score double, rank long, d_score double, d_rank long"
    if not rows:
        return stocks.sparkSession.createDataFrame([], schema)
    if len(rows) > 1:
        raise ValueError(f"{ticker} names several stocks")
    own = rows[0]
    ahead = lambda k: (F.col(f"score_{k}") > own[f"score_{k}"]) | ((F.col(f"score_{k}") == own[f"score_{k}"]) & (F.col("instrument_id") < own["instrument_id"]))
    ranks = scored.agg(*[(F.count_if(ahead(k)) + 1).alias(f"r_{k}") for k in range(len(names))])
    cells = [
        F.struct(
            F.lit(n).alias("scenario"), F.lit(own[f"growth_{k}"]).alias("g_growth"), F.lit(own[f"score_{k}"]).alias("final_score"), F.col(f"r_{k}").cast("long").alias("rank"),
            V.rounded(F.lit(own[f"score_{k}"]) - F.lit(own["score_0"]), 1).alias("d_score"), (F.col("r_0") - F.col(f"r_{k}")).cast("long").alias("d_rank"),
        )
        for k, n in enumerate(names)
    ]
    return ranks.select(F.inline(F.array(*cells)))


# ---- other coverage definitions -------------------------------------------------------------------

def input_coverage(df: DataFrame) -> Column:
    """Share of the 24 raw inputs present, whole percent."""
    present = _total([(F.col(c).isNotNull() if c in df.columns else F.lit(False)).cast("int") for c in catalog.COVERAGE_INPUTS])
    return V.rounded(present / len(catalog.COVERAGE_INPUTS) * 100, 0)


def dashboard_coverage(df: DataFrame) -> dict[str, Column]:
    """Coverage from displayed inputs: input-based presence tests, RSI counted under momentum."""
    has = lambda *names: reduce(lambda a, b: a & b, [_num(df, c).isNotNull() for c in names])
    tests = {
        "fwd_eps_growth": F.coalesce(_num(df, "trailingEps") > 0, F.lit(False)) & has("forwardEps"),
        "px_vs_50dma": has("currentPrice", "fiftyDayAverage"),
        "px_vs_200dma": has("currentPrice", "twoHundredDayAverage"),
        "upside_pct": has("targetMeanPrice", "currentPrice"),
    }
    shares: dict[str, Column] = {}
    for group, metrics in catalog.COVERAGE_GROUPS.items():
        ok = [~V.is_lender("sector") if m in catalog.COVERAGE_NOT_APPLICABLE else F.lit(True) for m in metrics]
        present = _total([(a & tests.get(m, has(m))).cast("int") for a, m in zip(ok, metrics)])
        possible = _total([a.cast("int") for a in ok])
        shares[group] = F.coalesce(F.try_divide(present, possible) * 100, F.lit(0.0))
    total = sum(catalog.WEIGHTS.values())
    weighted = _total([F.lit(catalog.WEIGHTS[g]) * shares[g] for g in catalog.COVERAGE_GROUPS]) / total
    return {
        "data_cov": V.rounded(weighted, 1),
        "quality_cov": V.rounded(shares["quality"], 1),
        "valuation_cov": V.rounded(shares["valuation"], 1),
    }


# ---- additive point screens --------------------------------------------------------------------------

def _points(rules: Sequence[tuple[Column, int]]) -> Column:
    """First matching rule of one input; no match or a null input gives 0."""
    expr = F.when(rules[0][0], rules[0][1])
    for condition, points in rules[1:]:
        expr = expr.when(condition, points)
    return F.coalesce(expr, F.lit(0))


def _reasons(parts: Sequence[tuple[Column, Column]]) -> Column:
    """Texts whose condition holds, joined with '; '."""
    return F.array_join(F.filter(F.array(*[F.when(c, t) for c, t in parts]), lambda x: x.isNotNull()), "; ")


def _whole(value: Column) -> Column:
    return F.rint(value).cast("long").cast("string")


def points_screen(df: DataFrame) -> DataFrame:
    """Beaten-down but fundamentally strong: additive points and their reasons."""
    c = F.col
    off = (c("fiftyTwoWeekHigh") - c("currentPrice")) / c("fiftyTwoWeekHigh") * 100
    above = (c("currentPrice") - c("fiftyTwoWeekLow")) / c("fiftyTwoWeekLow") * 100
    roe, debt, margin = c("returnOnEquity"), c("debtToEquity"), c("profitMargins")
    eg, rg, pe, pb = c("earningsGrowth"), c("revenueGrowth"), c("trailingPE"), c("priceToBook")
    o = c("pct_below_52w_high")
    base = df.filter("currentPrice IS NOT NULL").withColumns({"pct_below_52w_high": off, "pct_above_52w_low": above})
    score = (
        _points([(o >= 30, 3), (o >= 20, 2), (o >= 12, 1)])
        + _points([(roe >= 0.18, 3), (roe >= 0.12, 2), (roe < 0, -2)])
        + _points([(debt < 50, 2), (debt < 100, 1), (debt > 200, -2)])
        + _points([(margin >= 0.15, 2), (margin > 0, 1), (margin <= 0, -2)])
        + _points([(eg >= 0.15, 2), (eg > 0, 1), (eg < -0.10, -1)])
        + _points([(rg >= 0.10, 1)])
        + _points([((pe > 0) & (pe < 18), 1)])
        + _points([((pb > 0) & (pb < 3), 1)])
    )
    reasons = _reasons(
        [
            (o >= 20, F.concat(_whole(o), F.lit("% below 52w high"))),
            (roe >= 0.18, F.concat(F.lit("ROE "), _whole(roe * 100), F.lit("%"))),
            (debt < 50, F.concat(F.lit("low D/E "), _whole(debt))),
            (margin >= 0.15, F.concat(F.lit("margin "), _whole(margin * 100), F.lit("%"))),
            (eg >= 0.15, F.concat(F.lit("earnings +"), _whole(eg * 100), F.lit("%"))),
            (rg >= 0.10, F.concat(F.lit("rev +"), _whole(rg * 100), F.lit("%"))),
            ((pe > 0) & (pe < 18), F.concat(F.lit("PE "), _whole(pe))),
        ]
    )
    return base.withColumns({"score": score, "reasons": reasons})


def ownership_points(df: DataFrame) -> DataFrame:
    """Delivery level and trend plus net institutional deals."""
    avg, trend = F.col("avg_delivery_pct"), F.col("delivery_trend")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    buying = (zero("n_inst_buy") > zero("n_inst_sell")) & (zero("deal_buy_qty") > zero("deal_sell_qty"))
    selling = (zero("n_inst_sell") > zero("n_inst_buy")) & (zero("deal_sell_qty") > zero("deal_buy_qty"))
    score = (
        _points([(avg >= 60, 2), (avg >= 45, 1)])
        + _points([(trend >= 5, 2), (trend <= -5, -1)])
        + _points([(buying, 3), (selling, -2)])
    )
    reasons = _reasons(
        [
            (avg >= 60, F.concat(F.lit("high delivery "), avg.cast("string"), F.lit("%"))),
            (trend >= 5, F.concat(F.lit("delivery rising +"), trend.cast("string"))),
            (buying, F.concat(F.lit("net institutional BUY ("), F.col("n_inst_buy").cast("string"), F.lit(" funds)"))),
            (~buying & selling, F.concat(F.lit("institutional SELLING ("), F.col("n_inst_sell").cast("string"), F.lit(" funds)"))),
        ]
    )
    return df.withColumns({"ownership_score": score, "ownership_reasons": reasons}).withColumn(
        "combined_score", F.coalesce(F.col("score"), F.lit(0)) + F.col("ownership_score")
    )


def shareholding_points(df: DataFrame) -> DataFrame:
    """Promoter, institutional and holder-count thresholds."""
    p, i, n = F.col("promoter_pct"), F.col("institutional_pct"), F.col("institutions_count")
    pct = lambda label, v: F.concat(F.lit(label), v.cast("string"), F.lit("%"))
    score = _points([(p >= 50, 2), (p >= 40, 1)]) + _points([(i >= 40, 2), (i >= 25, 1)]) + _points([(n >= 250, 1)])
    reasons = _reasons(
        [
            (p >= 50, pct("strong promoter ", p)),
            ((p >= 40) & (p < 50), pct("promoter ", p)),
            (p >= 75, F.lit("⚠ very high promoter = low float")),
            (i >= 40, pct("high institutional ", i)),
            ((i >= 25) & (i < 40), pct("institutional ", i)),
            (n >= 250, F.concat(F.floor(n).cast("string"), F.lit(" institutions"))),
        ]
    )
    return df.withColumns({"shareholding_score": score, "shareholding_reasons": reasons})
