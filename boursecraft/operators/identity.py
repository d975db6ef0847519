"""Instrument identity: dual listings, universe snapshots, renames and suspensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boursecraft.functions import values as V
from boursecraft.operators.lifecycle import apply_events
from boursecraft.session import materialise

SHRINK_LIMIT = 0.9


def dual_listing_conflicts(first: DataFrame, second: DataFrame) -> DataFrame:
    """ISINs with more than one symbol on the first exchange or more than one code on the second."""
    a = first.groupBy("isin").agg(F.min("ticker").alias("lo"), F.max("ticker").alias("hi")).filter("lo <> hi").select("isin", F.lit("ambiguous_symbol").alias("code"))
    b = second.groupBy("isin").agg(F.min("bse_code").alias("lo"), F.max("bse_code").alias("hi")).filter("lo <> hi").select("isin", F.lit("ambiguous_listing").alias("code"))
    return a.unionByName(b)


def active_listings(raw: DataFrame) -> DataFrame:
    """Second-exchange rows that are active equities with a numeric code."""
    isin, code = F.trim(F.coalesce("ISIN_NUMBER", F.lit(""))), F.trim(F.coalesce("SCRIP_CD", F.lit("")))
    rows = raw.filter(V.equity_isin(isin) & code.rlike("^[0-9]+$") & (F.col("Status") == "Active"))
    name = F.coalesce(F.nullif("Scrip_Name", F.lit("")), F.nullif("scrip_id", F.lit("")), code)
    return rows.select(isin.alias("isin"), code.alias("bse_code"), name.alias("bse_name"))


def combine_listings(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer merge by ISIN: the first exchange names the stock, the second adds its code."""
    merged = first.select("isin", "ticker", "shortName").join(second, "isin", "full")
    both = F.col("ticker").isNotNull()
    return merged.select(
        "isin",
        F.coalesce("ticker", F.concat("bse_code", F.lit(".BO"))).alias("ticker"),
        F.when(both, "NSE").otherwise("BSE").alias("exchange"),
        F.coalesce("shortName", "bse_name").alias("shortName"),
        "bse_code",
    )


def match_identity(instruments: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Snapshot rows to stored equities by ISIN or by (ticker, exchange).

    Two equi joins united: an OR condition would pair every row with every other one.
    """
    stored = instruments.filter("kind = 'EQUITY'").select(
        "instrument_id", F.col("ticker").alias("old_ticker"), F.col("exchange").alias("old_exchange"), F.col("isin").alias("old_isin")
    )
    s = snapshot.select("ticker", "exchange", "isin")
    by_isin = s.join(stored, s["isin"] == stored["old_isin"])
    by_symbol = s.join(stored, (s["ticker"] == stored["old_ticker"]) & (s["exchange"] == stored["old_exchange"]))
    return by_isin.unionByName(by_symbol).distinct()


def identity_conflicts(matches: DataFrame) -> DataFrame:
    """Snapshot rows that fit several instruments or share one with another row, or whose ISIN changed."""
    several = matches.groupBy("ticker", "exchange", "isin").agg(F.count("*").alias("n")).filter("n > 1").select("ticker", F.lit("conflicting_identity").alias("code"))
    shared = matches.groupBy("instrument_id").agg(F.count_distinct("ticker", "exchange", F.coalesce("isin", F.lit(""))).alias("rows")).filter("rows > 1")
    claimed = matches.join(shared, "instrument_id", "left_semi").select("ticker", F.lit("instrument_claimed_twice").alias("code"))
    # a listing without an ISIN doesn't confirm a stored one
    changed = matches.filter(F.col("old_isin").isNotNull() & ~F.col("old_isin").eqNullSafe(F.col("isin"))).select("ticker", F.lit("isin_changed").alias("code"))
    return several.unionByName(claimed).unionByName(changed).distinct()


def sync_universe(instruments: DataFrame, snapshot: DataFrame, as_of, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Apply a complete snapshot: (instruments with their action, new aliases).

    Refuses an empty or shrunken snapshot and, when ``strict``, any identity conflict - all before a
    row is produced. Non-strict leaves conflicting snapshot rows out.
    """
    size = snapshot.count()
    if size == 0:
        raise ValueError("The snapshot holds no instrument")
    existing = instruments.filter("kind = 'EQUITY' AND active").count()
    if size < existing * SHRINK_LIMIT:
        raise ValueError("The snapshot holds under nine tenths of the active equities")
    key = ["ticker", "exchange", "isin"]
    snapshot = snapshot.groupBy(*key).agg(F.max("shortName").alias("shortName"))  # a listing given twice is one
    # one row per snapshot row; read by the conflict check, the updates, the inserts and the aliases
    matches = materialise(match_identity(instruments, snapshot), "matches")
    conflicts = identity_conflicts(matches)
    if strict:
        if not conflicts.isEmpty():
            raise ValueError("Some listings fit no single stored instrument; see identity_conflicts")
    else:
        bad = conflicts.select("ticker").distinct()
        snapshot = snapshot.join(bad, "ticker", "left_anti")
        matches = matches.join(bad, "ticker", "left_anti")
    matched = matches.select("instrument_id", *[F.col(c).alias(f"_{c}") for c in key])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])  # a listing without an ISIN is matched by its symbol
    new = snapshot.join(matched, same, "left")
    incoming = new.select("instrument_id", *[F.col(c).alias(f"s_{c}") for c in ("ticker", "exchange", "isin", "shortName")])
    known = incoming.filter("instrument_id IS NOT NULL").withColumn("_seen", F.lit(True))
    updated = instruments.join(known, "instrument_id", "left")
    seen = F.col("_seen").isNotNull()
    leaving = (F.col("kind") == "EQUITY") & F.col("active") & ~seen
    kept = updated.select(
        "instrument_id",
        F.coalesce("s_ticker", "ticker").alias("ticker"), F.coalesce("s_exchange", "exchange").alias("exchange"), F.coalesce("s_isin", "isin").alias("isin"),
        F.coalesce("s_shortName", "company_name").alias("company_name"), "kind",
        (seen | (F.col("active") & ~leaving)).alias("active"),
        F.when(leaving, F.lit(as_of).cast("date")).alias("inactive_at"),
        F.when(seen, "updated").when(leaving, "deactivated").otherwise("untouched").alias("action"),
    )
    added = incoming.filter("instrument_id IS NULL").select(
        F.lit(None).cast("long").alias("instrument_id"), F.col("s_ticker").alias("ticker"), F.col("s_exchange").alias("exchange"), F.col("s_isin").alias("isin"),
        F.col("s_shortName").alias("company_name"), F.lit("EQUITY").alias("kind"), F.lit(True).alias("active"), F.lit(None).cast("date").alias("inactive_at"), F.lit("inserted").alias("action"),
    )
    renamed = (F.col("old_ticker") != F.col("ticker")) | (F.col("old_exchange") != F.col("exchange"))
    aliases = matches.filter(renamed).select("instrument_id", F.col("old_ticker").alias("ticker"), F.col("old_exchange").alias("exchange"))
    return kept.unionByName(added), aliases


def apply_lifecycle(instruments: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Renames and suspensions from an events table: (instruments, aliases, conflicts).

    See ``lifecycle.apply_events``; aliases are the symbols that instruments no longer hold.
    """
    after, intervals, conflicts = apply_events(instruments, events)
    return after, intervals.filter("valid_until IS NOT NULL"), conflicts
