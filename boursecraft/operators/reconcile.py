"""Validation, conflict rules and resolution of one current value per (instrument, field)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boursecraft import catalog
from boursecraft.functions import values as V
from boursecraft.operators import latest as L
from boursecraft.operators.joins import attach
from boursecraft.session import materialise

ISSUE_TYPE = "array<struct<code:string,message:string,severity:string,field:string,raw_value:string>>"


def issue(code: str, message: Column, field: Column, raw: Column, severity: str = "error") -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        message.alias("message"),
        F.lit(severity).alias("severity"),
        field.alias("field"),
        raw.cast("string").alias("raw_value"),
    )


def append_issue(condition: Column, entry: Column) -> Column:
    existing = F.coalesce(F.col("issues"), F.array().cast(ISSUE_TYPE))
    return F.when(condition, F.concat(existing, F.array(entry))).otherwise(existing)


def with_issue_columns(obs: DataFrame) -> DataFrame:
    """Add ``is_valid`` and ``issues`` where a source table lacks them."""
    if "is_valid" not in obs.columns:
        obs = obs.withColumn("is_valid", F.lit(True))
    if "issues" not in obs.columns:
        obs = obs.withColumn("issues", F.array().cast(ISSUE_TYPE))
    return obs


def normalise_percent(obs: DataFrame) -> DataFrame:
    """Percent fields to percent units. Bad rows are marked, never dropped or clamped."""
    obs = with_issue_columns(obs)
    field, unit, raw = F.col("field"), F.col("unit"), F.coalesce(F.col("numeric_value").cast("string"), F.col("text_value"))
    percent = field.isin(*catalog.PERCENT_FIELDS)
    numeric = F.coalesce(F.col("numeric_value"), V.to_double("text_value"))
    scaled = F.when(unit == "fraction", numeric * 100).otherwise(numeric)
    not_numeric = percent & numeric.isNull()
    bad_unit = percent & numeric.isNotNull() & unit.isNotNull() & ~unit.isin("fraction", "percent")
    accepted = percent & numeric.isNotNull() & ~bad_unit
    bad_unit, accepted = F.coalesce(bad_unit, F.lit(False)), F.coalesce(accepted, F.lit(False))
    out_of_range = accepted & field.isin(*catalog.OWNERSHIP_FIELDS) & ~scaled.between(0, 100)
    entry = (
        F.when(not_numeric, issue("not_numeric", F.concat(field, F.lit(" must be numeric")), field, raw))
        .when(bad_unit, issue("unexpected_unit", F.concat(F.lit("Expected percent or fraction, received "), unit), field, raw))
        .when(
            out_of_range,
            issue(
                "percent_out_of_range",
                F.concat(field, F.lit(" resolved to "), F.format_number(scaled, 3), F.lit("%; expected 0-100%")),
                field,
                raw,
            ),
        )
    )
    rejected = not_numeric | bad_unit | out_of_range
    return obs.withColumns(
        {
            "numeric_value": F.when(accepted, V.rounded(scaled, 6)).otherwise(F.col("numeric_value")),
            "text_value": F.when(accepted, F.lit(None)).otherwise(F.col("text_value")),
            "unit": F.when(accepted, F.lit("percent")).otherwise(unit),
            "is_valid": F.col("is_valid") & ~rejected,
            "issues": append_issue(rejected, entry),
        }
    )


# ---- conflict rules ------------------------------------------------------------------------

EVIDENCE_FIELDS = ("trailing_pe", "trailing_eps", "book_value_sign", "roe_pct")
BAD_PE, CONTESTED_ROE, BAD_ROE = 1, 2, 4


def evidence(obs: DataFrame) -> DataFrame:
    """One row per instrument with every reading the conflict rules look at.

    A single conditional aggregation: one filtered scan, combined on the map side, one shuffle.
    P/E ignores validity but needs a positive value, EPS ignores validity, ROE and the equity
    sign consider valid rows only.
    """
    order = F.struct("observed_at", "id")
    field, provider, value = F.col("field"), F.col("provider"), F.col("numeric_value")

    def newest_where(condition: Column, what: str = "numeric_value") -> Column:
        return F.max_by(what, F.when(condition, order))

    priced = (field == "trailing_pe") & (value > 0)
    valid_roe = (field == "roe_pct") & F.col("is_valid")
    return obs.filter(field.isin(*EVIDENCE_FIELDS)).groupBy("instrument_id").agg(
        newest_where(priced & (provider == "bse")).alias("bse_pe"),
        newest_where(priced & (provider == "nse")).alias("nse_pe"),
        newest_where(field == "trailing_eps").alias("eps"),
        newest_where((field == "book_value_sign") & (provider == "bse") & F.col("is_valid"), "text_value").alias("sign"),
        newest_where(valid_roe & (provider == "bse")).alias("bse_roe"),
        newest_where(valid_roe & (provider == "yahoo_roe")).alias("yahoo_roe"),
        F.coalesce(F.bool_or(valid_roe & provider.isin("screener", "upstox_fundamentals")), F.lit(False)).alias("decided"),
    )


def multiples_unusable(ratio: float = 3.0) -> Column:
    """Exchange P/E readings more than ``ratio`` apart, or newest EPS negative."""
    both = F.col("bse_pe").isNotNull() & F.col("nse_pe").isNotNull()
    apart = both & (V.spread_ratio("bse_pe", "nse_pe") > ratio)
    return F.coalesce(apart, F.lit(False)) | F.coalesce(F.col("eps") < 0, F.lit(False))


def disagrees(ratio: float, minimum: float) -> Column:
    a, b = F.abs("bse_roe"), F.abs("yahoo_roe")
    return F.coalesce((a >= minimum) & (b >= minimum) & (V.spread_ratio(a, b) > ratio), F.lit(False))


def returns_contested(ratio: float = 10.0, minimum: float = 2.0) -> Column:
    return F.coalesce(F.col("sign") == "negative", F.lit(False)) | disagrees(ratio, minimum)


def newest_multiples(obs: DataFrame) -> DataFrame:
    """Newest positive exchange P/E per provider, side by side (validity ignored)."""
    return evidence(obs).select("instrument_id", "bse_pe", "nse_pe").filter("bse_pe IS NOT NULL OR nse_pe IS NOT NULL")


def pe_unusable(obs: DataFrame, ratio: float = 3.0) -> DataFrame:
    return evidence(obs).filter(multiples_unusable(ratio)).select("instrument_id")


def negative_equity(obs: DataFrame) -> DataFrame:
    return evidence(obs).filter("sign = 'negative'").select("instrument_id")


def roe_pairs(obs: DataFrame) -> DataFrame:
    return evidence(obs).filter("bse_roe IS NOT NULL AND yahoo_roe IS NOT NULL").select("instrument_id", "bse_roe", "yahoo_roe")


def roe_conflict(obs: DataFrame, ratio: float = 10.0, minimum: float = 2.0) -> DataFrame:
    return evidence(obs).filter(returns_contested(ratio, minimum)).select("instrument_id")


def roe_unusable(obs: DataFrame) -> DataFrame:
    """Contested returns without an adjudicating source."""
    return evidence(obs).filter(returns_contested() & ~F.col("decided")).select("instrument_id")


def newest_state(obs: DataFrame) -> DataFrame:
    """All that resolution needs of observations, one row per (instrument, field, provider): the newest
    row, the newest positive P/E and the newest valid reading of the other evidence.

    Every part is a greatest struct, so states of two sets of observations merge (``merge_states``).
    """
    field, value = F.col("field"), F.col("numeric_value")
    when = ["observed_at", "id"]
    judged = field.isin("roe_pct", "book_value_sign") & F.col("is_valid")
    return obs.groupBy("instrument_id", "field", "provider").agg(
        F.max(F.struct(*when, "numeric_value", "text_value", "unit", "is_valid", "period_end")).alias("newest"),
        F.max(F.when((field == "trailing_pe") & (value > 0), F.struct(*when, "numeric_value"))).alias("positive"),
        F.max(F.when(judged, F.struct(*when, "numeric_value", "text_value"))).alias("valid"),
    )


def merge_states(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The state of both sets of observations. Merging one twice changes nothing."""
    parts = ("newest", "positive", "valid")
    return stored.unionByName(new).groupBy("instrument_id", "field", "provider").agg(*[F.max(p).alias(p) for p in parts])


def evidence_of(state: DataFrame) -> DataFrame:
    """``evidence`` from a state: at most one row per field and provider of an instrument is left."""
    field, provider = F.col("field"), F.col("provider")

    def only(name: str, source: str, what: str) -> Column:
        return F.max(F.when((field == name) & (provider == source), F.col(what)))

    return state.filter(field.isin(*EVIDENCE_FIELDS)).groupBy("instrument_id").agg(
        only("trailing_pe", "bse", "positive.numeric_value").alias("bse_pe"),
        only("trailing_pe", "nse", "positive.numeric_value").alias("nse_pe"),
        F.max_by("newest.numeric_value", F.when(field == "trailing_eps", F.struct("newest.observed_at", "newest.id"))).alias("eps"),
        only("book_value_sign", "bse", "valid.text_value").alias("sign"),
        only("roe_pct", "bse", "valid.numeric_value").alias("bse_roe"),
        only("roe_pct", "yahoo_roe", "valid.numeric_value").alias("yahoo_roe"),
        F.coalesce(F.bool_or((field == "roe_pct") & provider.isin("screener", "upstox_fundamentals") & F.col("valid").isNotNull()), F.lit(False)).alias("decided"),
    )


def conflict_flags(obs: DataFrame) -> DataFrame:
    """(instrument_id, flags) for instruments with any conflict: one bit per rule."""
    return flags_of(evidence(obs))


def flags_of(found: DataFrame) -> DataFrame:
    """``conflict_flags`` from evidence."""
    contested = returns_contested()
    bits = (
        F.when(multiples_unusable(), BAD_PE).otherwise(0)
        + F.when(contested, CONTESTED_ROE).otherwise(0)
        + F.when(contested & ~F.col("decided"), BAD_ROE).otherwise(0)
    )
    return found.select("instrument_id", bits.alias("flags")).filter("flags > 0")


def flagged(bit: int) -> Column:
    return F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(bit) > 0


def roe_review(obs: DataFrame, instruments: DataFrame, ratio: float = 10.0, minimum: float = 2.0) -> DataFrame:
    """Active equities whose exchange ROE needs a third opinion; thresholds are arguments."""
    return (
        active_equities(instruments).select("instrument_id", "ticker")
        .join(evidence(obs).filter(returns_contested(ratio, minimum)), "instrument_id")
        .select("ticker", "bse_roe", "yahoo_roe", "sign")
    )


# ---- live resolution -------------------------------------------------------------------------

def active_equities(instruments: DataFrame) -> DataFrame:
    return instruments.filter((F.col("kind") == "EQUITY") & F.col("active"))


def reporting_fresh(as_of) -> Column:
    """Statement and filing rows must describe a recent period; other providers always pass."""
    filed = F.col("provider").isin("upstox_statements", "upstox_shareholding")
    quarterly = (
        (F.col("provider") == "upstox_shareholding")
        | (F.col("field") == "earnings_quarterly_growth")
        | F.col("field").like("quarterly_%")
    )
    age_limit = F.when(quarterly, 200).otherwise(550)
    day = F.lit(as_of).cast("date")
    return ~filed | F.coalesce((F.col("period_end") <= day) & (F.datediff(day, F.col("period_end")) <= age_limit), F.lit(False))


def source_priority() -> Column:
    """Canonical source order per field (smaller wins)."""
    everywhere = {p: n for (p, f), n in catalog.LIVE_PRIORITY.items() if f is None}
    single = {f"{p}:{f}": n for (p, f), n in catalog.LIVE_PRIORITY.items() if f is not None}
    place = lambda values, key: F.element_at(V.literal_map(values), key)
    return F.coalesce(place(everywhere, F.col("provider")), place(single, F.concat("provider", F.lit(":"), "field")), F.lit(catalog.LIVE_DEFAULT))


def newest_usable(obs: DataFrame, as_of) -> DataFrame:
    """Newest row per (instrument, field, provider); validity and freshness tested afterwards."""
    columns = ["instrument_id", "field", "provider", "id", "observed_at", "numeric_value", "text_value", "unit", "is_valid", "period_end"]
    return L.newest(obs.select(*columns), ["instrument_id", "field", "provider"], valid="after").filter(reporting_fresh(as_of))


def usable_of(state: DataFrame, as_of) -> DataFrame:
    """``newest_usable`` from a state."""
    return state.select("instrument_id", "field", "provider", "newest.*").filter("is_valid").filter(reporting_fresh(as_of))


def expired(state: DataFrame, was, now) -> DataFrame:
    """Instruments with a row that is fresh on one of two days only."""
    changed = reporting_fresh(was) != reporting_fresh(now)
    return state.select("instrument_id", "field", "provider", "newest.*").filter("is_valid").filter(changed).select("instrument_id").distinct()


def with_basis(usable: DataFrame) -> DataFrame:
    """Attach the basis of ``<metric>_basis`` rows to the metric of the same provider.

    A window over (instrument, provider, metric) instead of a self-join; each group is one metric
    row and its basis row.
    """
    metric = F.coalesce(V.basis_metric("field"), F.col("field"))
    w = Window.partitionBy("instrument_id", "provider", "_metric")
    marker = F.when(V.basis_metric("field").isNotNull(), F.col("text_value"))
    return (
        usable.withColumn("_metric", metric)
        .withColumn("basis", F.max(marker).over(w))
        .filter(V.basis_metric("field").isNull())
        .drop("_metric")
    )


def eligible(obs: DataFrame, as_of) -> DataFrame:
    """Usable rows minus standalone multiples, audit-only fields, unusable P/E and contested ROE.

    Partitioned by instrument once: the flag join and every window that follows (basis, canonical
    pick, alias suppression) work within an instrument and reuse it. After the newest-row pick an
    instrument holds at most one row per field and provider.
    """
    return _eligible(newest_usable(obs, as_of), conflict_flags(obs))


def _eligible(usable: DataFrame, flags: DataFrame) -> DataFrame:
    rows = usable.repartition("instrument_id").join(flags, "instrument_id", "left")
    field, provider = F.col("field"), F.col("provider")
    standalone = field.isin("trailing_pe", "trailing_eps") & (F.coalesce(F.col("basis"), F.lit("")) == "standalone")
    audit_only = (provider == "upstox_fundamentals") & ~field.isin("roe_pct", "roce_pct")
    pe_out = (field == "trailing_pe") & flagged(BAD_PE)
    roe_out = (field == "roe_pct") & flagged(CONTESTED_ROE) & ~provider.isin("screener", "upstox_fundamentals")
    return with_basis(rows).filter(~standalone & ~audit_only & ~pe_out & ~roe_out)


def live_rows(obs: DataFrame, as_of) -> DataFrame:
    """One live row per (instrument, field)."""
    return _live(eligible(obs, as_of))


def _live(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("instrument_id", "field").orderBy(source_priority(), F.desc("observed_at"), F.desc("id"))
    return rows.withColumn("_pos", F.row_number().over(w)).filter("_pos = 1").select(*_LIVE)


_LIVE = ("instrument_id", "field", "numeric_value", "text_value", "unit", "provider", "observed_at")
live_metrics = live_rows


def alias_entries() -> Column:
    """live field -> array of (dashboard field, factor) as a map literal."""
    pairs: dict[str, list[Column]] = {}
    for source, target, factor in catalog.ALIAS_MAPPING:
        pairs.setdefault(source, []).append(F.struct(F.lit(target).alias("target"), F.lit(factor).alias("factor")))
    return F.create_map(*[part for source, items in pairs.items() for part in (F.lit(source), F.array(*items))])


def with_aliases(live: DataFrame) -> DataFrame:
    """Live rows (priority 2) and their dashboard names, scaled (priority 3), in one pass.

    A reported net margin suppresses the profit-margin alias; whether an instrument has one is a
    window over its own rows.
    """
    reported = F.max(F.col("field") == "net_profit_margin").over(Window.partitionBy("instrument_id"))
    own = F.struct(
        F.col("field").alias("field"), F.col("numeric_value").alias("numeric_value"),
        F.col("unit").alias("unit"), F.lit(2).alias("priority"),
    )
    entries = F.when(F.col("numeric_value").isNotNull(), F.element_at(alias_entries(), F.col("field")))
    kept = F.filter(
        entries, lambda e: ~((F.col("field") == "profit_margin_pct") & (e["target"] == "profitMargins") & F.col("_reported"))
    )
    renamed = F.transform(
        kept,
        lambda e: F.struct(
            e["target"].alias("field"), (F.col("numeric_value") * e["factor"]).alias("numeric_value"),
            F.lit(None).cast("string").alias("unit"), F.lit(3).alias("priority"),
        ),
    )
    rows = F.concat(F.array(own), F.coalesce(renamed, F.array().cast(_EMITTED)))
    return (
        live.withColumn("_reported", reported)
        .withColumn("_row", F.explode(rows))
        .select("instrument_id", "_row.*", "text_value", "provider", "observed_at")
    )


_EMITTED = "array<struct<field:string,numeric_value:double,unit:string,priority:int>>"


def legacy_aliases(live: DataFrame) -> DataFrame:
    return with_aliases(live).filter("priority = 3").drop("priority", "unit")


# ---- layers of the current value -------------------------------------------------------------

def symbol_directory(instruments: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Current and historical symbols of active equities."""
    active = active_equities(instruments)
    current = active.select("instrument_id", "ticker", "exchange")
    if aliases is None:
        return current
    historical = aliases.join(active.select("instrument_id"), "instrument_id", "left_semi")
    return current.unionByName(historical.select("instrument_id", "ticker", "exchange"))


def archived_cells(files: DataFrame, rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Newest archived cell per (instrument, column) with a complete tie-break.

    Picked per ticker before the join and per instrument after it: where a ticker is in many records and
    names many instruments, the join pairs cells with instruments, not records with instruments.
    """
    current = L.newest_files(files).select("source_path", "content_sha256", "source_modified_at", "imported_at")
    order = ["source_modified_at", "imported_at", "source_path", "content_sha256", "row_number"]
    # known symbols are matched per record, before a record becomes one row per cell
    known = (
        rows.filter(F.map_contains_key("record", F.lit("ticker")))
        .withColumn("ticker", V.ticker_norm(F.element_at("record", F.lit("ticker"))))
        .join(symbols.select("ticker"), "ticker", "left_semi")
    )
    known = attach(known, current, ["source_path", "content_sha256"], "row_number")  # one file may hold most rows
    kept = F.map_filter(
        "record", lambda k, v: (k != "ticker") & ~k.isin(*catalog.ARCHIVE_BOOKKEEPING) & v.isNotNull() & (v != "")
    )
    cells = known.select("ticker", *order, F.explode(kept).alias("field", "text"))
    newest = L.pick(cells, ["ticker", "field"], order).join(symbols.select("ticker", "instrument_id"), "ticker")
    picked = L.pick(newest.drop("ticker"), ["instrument_id", "field"], order)
    return picked.select(
        "instrument_id",
        "field",
        V.numeric_text("text").alias("numeric_value"),
        F.col("text").alias("text_value"),
        F.col("source_modified_at").alias("observed_at"),
    )


def identity_rows(instruments: DataFrame) -> DataFrame:
    return active_equities(instruments).filter(~V.is_blank_text("company_name")).select(
        "instrument_id",
        F.lit("shortName").alias("field"),
        F.lit(None).cast("double").alias("numeric_value"),
        F.col("company_name").alias("text_value"),
        F.col("updated_at").alias("observed_at"),
    )


def ranked_rows(runs: DataFrame, ranked: DataFrame) -> DataFrame:
    """Latest run as long rows: four columns, the numeric factors and the one text factor."""
    rows = ranked.join(F.broadcast(L.newest_run(runs)), "run_id")  # one row
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")

    def cell(name: str, numeric: Column, string: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), numeric.cast("double").alias("numeric_value"), string.alias("text_value"))

    fixed = F.array(
        cell("rank", F.col("rank"), text),
        cell("final_score", F.col("score"), text),
        cell("data_cov", F.col("data_coverage"), text),
        cell("score_status", number, F.col("score_status")),
        cell("movement_vs_staged", number, F.col("movement")),
    )
    factors = F.transform(
        F.map_entries(F.coalesce("factors", F.create_map().cast("map<string,double>"))),
        lambda e: F.struct(e["key"].alias("field"), e["value"].alias("numeric_value"), text.alias("text_value")),
    )
    return (
        rows.select("instrument_id", F.col("created_at").alias("observed_at"), F.inline(F.concat(fixed, factors)))
        .filter("numeric_value IS NOT NULL OR text_value IS NOT NULL")
        .select("instrument_id", "field", "numeric_value", "text_value", "observed_at")
    )


def layer(rows: DataFrame, origin: str, priority: int, provider: str | None = None) -> DataFrame:
    return rows.select(
        "instrument_id", "field", "numeric_value", "text_value",
        F.lit(None).cast("string").alias("unit"),
        (F.lit(provider) if provider else F.col("provider")).alias("provider"),
        "observed_at", F.lit(origin).alias("origin"), F.lit(priority).alias("priority"),
    )


def all_layers(obs: DataFrame, instruments: DataFrame, as_of, runs: DataFrame, ranked: DataFrame,
               files: DataFrame, rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    return _layers(live_rows(obs, as_of), instruments, runs, ranked, files, rows, aliases)


def _layers(live: DataFrame, instruments: DataFrame, runs: DataFrame, ranked: DataFrame, files: DataFrame, rows: DataFrame, aliases: DataFrame | None) -> DataFrame:
    live = with_aliases(live).withColumn("origin", F.lit("observation"))
    symbols = materialise(symbol_directory(instruments, aliases), "symbols")  # read twice
    layers: Sequence[DataFrame] = (
        layer(identity_rows(instruments), "observation", 2, "instruments"),
        layer(ranked_rows(runs, ranked), "ranking", 1, "scoring"),
        live.select("instrument_id", "field", "numeric_value", "text_value", "unit", "provider", "observed_at", "origin", "priority"),
        layer(archived_cells(files, rows, symbols), "archive", 4, "legacy_csv"),
    )
    merged = layers[0]
    for part in layers[1:]:
        merged = merged.unionByName(part)
    return merged


def merge_layers(layers: DataFrame, flags: DataFrame, instruments: DataFrame) -> DataFrame:
    """One row per (instrument, field) by layer priority, failing closed on unusable ratios."""
    w = Window.partitionBy("instrument_id", "field").orderBy(
        "priority", F.desc("observed_at"), F.desc("provider"), F.desc("numeric_value"), F.desc("text_value")
    )
    pe, roe = F.col("field").isin("trailingPE", "trailing_pe"), F.col("field").isin("roe_pct", "returnOnEquity")
    return (
        layers.join(active_equities(instruments).select("instrument_id"), "instrument_id", "left_semi")
        .join(flags, "instrument_id", "left")
        .filter(~(pe & flagged(BAD_PE)) & ~(roe & flagged(BAD_ROE)))
        .withColumn("_pos", F.row_number().over(w))
        .filter("_pos = 1")
        .select("instrument_id", "field", "numeric_value", "text_value", "unit", "provider", "observed_at", "origin")
    )


def current_metrics(obs: DataFrame, instruments: DataFrame, as_of, runs: DataFrame, ranked: DataFrame,
                    files: DataFrame, rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """The current value of every field of every active equity, with its source and layer.

    Observations are scanned once, into the stored state that evidence and live values both read.
    """
    return resolve(materialise(newest_state(obs), "newest"), instruments, as_of, runs, ranked, files, rows, aliases)


def resolve(state: DataFrame, instruments: DataFrame, as_of, runs: DataFrame, ranked: DataFrame,
            files: DataFrame, rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``current_metrics`` from a stored state; instruments and conflict flags are stored for their readers."""
    active = materialise(active_equities(instruments), "active-equities")
    flags = materialise(flags_of(evidence_of(state)), "conflict-flags")
    live = _live(_eligible(usable_of(state, as_of), flags))
    return merge_layers(_layers(live, active, runs, ranked, files, rows, aliases), flags, active)


# ---- consumers -------------------------------------------------------------------------------

def pivot_stocks(current: DataFrame, instruments: DataFrame, numeric_fields: Sequence[str], text_fields: Sequence[str]) -> DataFrame:
    """Wide record per ticker: declared fields as columns, plus the origin of each field.

    A ticker of several instruments has one value per field, the newest (equal times: the smallest
    instrument, then the greatest value), and its origin is that value's.
    """
    named = current.join(instruments.select("instrument_id", F.upper("ticker").alias("ticker")), "instrument_id")
    # the map holds one entry per declared field: bounded by the field catalog, not by the data
    origins = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "origin")))).alias("field_origins")
    declared = named.filter(F.col("field").isin(*numeric_fields, *text_fields)).filter("numeric_value IS NOT NULL OR text_value IS NOT NULL")
    columns = ["instrument_id", "observed_at", "numeric_value", "text_value", "origin"]
    single = L.pick(declared.select("ticker", "field", *columns), ["ticker", "field"], ["observed_at", -F.col("instrument_id"), "numeric_value", "text_value", "origin"])
    aggregates = [F.max(F.when(F.col("field") == f, F.col("numeric_value"))).alias(f) for f in numeric_fields]
    text = F.coalesce(F.col("numeric_value").cast("string"), F.col("text_value"))
    aggregates += [F.max(F.when(F.col("field") == f, text)).alias(f) for f in text_fields]
    return single.groupBy("ticker").agg(*aggregates, origins)


def field_timestamps(current: DataFrame, instruments: DataFrame, ticker: str) -> DataFrame:
    one = instruments.filter(F.col("ticker") == ticker).select("instrument_id", "ticker")
    return current.join(F.broadcast(one), "instrument_id").select("ticker", "field", "observed_at")


def select_canonical(obs: DataFrame, priorities: dict[str, int] | None = None) -> DataFrame:
    """Valid candidates by provider priority, newest first, per (ticker, field)."""
    order = L.lookup_priority("provider", priorities or catalog.PROVIDER_PRIORITY, catalog.DEFAULT_PRIORITY)
    rows = obs.filter("is_valid").withColumn("priority", order)
    return L.best_priority(
        rows.select("instrument_id", "field", "numeric_value", "text_value", "unit", "provider", "observed_at", "id", "priority"),
        ["instrument_id", "field"], F.col("priority"), [F.col("observed_at"), -F.col("id")],
    )


def ownership_rejections(canonical: DataFrame) -> DataFrame:
    """Canonical promoter + institutional above the limit: the lower-priority side is rejected."""
    sides = canonical.filter(F.col("field").isin("promoter_pct", "institutional_pct"))

    def side(name: str, value: str) -> Column:
        return F.max(F.when(F.col("field") == name, F.col(value)))

    pairs = sides.groupBy("instrument_id").agg(
        side("promoter_pct", "numeric_value").alias("promoter"),
        side("institutional_pct", "numeric_value").alias("institutional"),
        side("promoter_pct", "priority").alias("promoter_priority"),
        side("institutional_pct", "priority").alias("institutional_priority"),
        side("promoter_pct", "id").alias("promoter_id"),
        side("institutional_pct", "id").alias("institutional_id"),
    ).withColumn("ownership_total", F.col("promoter") + F.col("institutional"))
    drop_promoter = F.col("promoter_priority") > F.col("institutional_priority")
    return pairs.filter(F.col("ownership_total") > catalog.OWNERSHIP_LIMIT).select(
        "instrument_id",
        "ownership_total",
        F.when(drop_promoter, "promoter_pct").otherwise("institutional_pct").alias("rejected_field"),
        F.when(drop_promoter, F.col("promoter_id")).otherwise(F.col("institutional_id")).alias("rejected_id"),
    )


def apply_ownership_rejections(obs: DataFrame, rejections: DataFrame) -> DataFrame:
    """Mark the rejected observations invalid with an issue; all rows are kept."""
    marks = rejections.select(F.col("rejected_id").alias("id"), "ownership_total")
    joined = obs.join(marks, "id", "left")
    hit = F.col("ownership_total").isNotNull()
    entry = issue(
        "ownership_total_exceeds_100",
        F.concat(F.lit("Promoter and institutional ownership total "), F.format_number("ownership_total", 3), F.lit("%")),
        F.col("field"), F.col("numeric_value"),
    )
    return joined.withColumns(
        {"is_valid": F.col("is_valid") & ~hit, "issues": append_issue(hit, entry)}
    ).drop("ownership_total")


def clean_record(stocks: DataFrame) -> DataFrame:
    """Record-level ownership rules: out-of-range percents to null, fraction issues, total limit."""
    lit_issue = lambda code, field: F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.col(field).cast("string").alias("raw_value"))
    checks: list[Column] = []
    cleaned: dict[str, Column] = {}
    for field in ("promoter_pct", "institutional_pct"):
        v = F.col(field)
        bad = v.isNotNull() & ~v.between(0, 100)
        checks.append(F.when(bad, lit_issue("percent_out_of_range", field)))
        cleaned[field] = F.when(v.between(0, 100), v)
    for field in ("heldPercentInsiders", "heldPercentInstitutions"):
        if field in stocks.columns:
            v = F.col(field)
            checks.append(F.when(v.isNotNull() & ~v.between(0, 1), lit_issue("provider_fraction_out_of_range", field)))
    over = F.coalesce(cleaned["promoter_pct"] + cleaned["institutional_pct"] > catalog.OWNERSHIP_LIMIT, F.lit(False))
    checks.append(F.when(over, lit_issue("ownership_total_exceeds_100", "institutional_pct")))
    issues = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return stocks.withColumns(
        {
            "promoter_pct": cleaned["promoter_pct"],
            "institutional_pct": F.when(~over, cleaned["institutional_pct"]),
            "quality_issues": issues,
            "quality_status": F.when(F.size(issues) > 0, "review").otherwise("valid"),
        }
    )
