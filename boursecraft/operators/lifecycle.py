"""Symbol changes and suspensions of a batch of dated events, in whatever order they depend on each other.

An event acts on the instrument that holds a symbol on its day; who that is may follow from earlier
events of the batch. Events of one day happen together, so symbols may be swapped. A rename counts when

* somebody holds the old symbol at the day's beginning, and it is that symbol's only rename of the day
  (of several the least new symbol counts) and the only claim to the new one (of several the least old
  symbol counts), and
* the new symbol is free at the day's beginning, or becomes free by a rename of that day that counts.

Within a day renames form chains and rings; whether a chain's end is free is carried to its beginning by
pointer doubling. Across days, who holds what is worked out for all events at once under the decisions so
far, and again until no decision changes: a day is right at the latest when all days before it are. The
holder of each event is then found by pointer doubling along arrivals. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boursecraft.session import materialise

_START = -(1 << 30)  # the day before all events
_SYMBOL = ["exchange", "ticker"]
_BEFORE = (Window.unboundedPreceding, -1)


def _events(events: DataFrame) -> DataFrame:
    """Events with a number and a day number; those without a day or symbol are reported as unknown."""
    isin = F.col("new_isin") if "new_isin" in events.columns else F.lit(None)
    rows = events.select("ticker", "exchange", "action", "new_ticker", "new_name", isin.cast("string").alias("new_isin"), F.unix_date(F.col("effective").cast("date")).alias("day"))
    return materialise(rows.withColumn("event", F.monotonically_increasing_id()), "lifecycle")


def _moves(holdings: DataFrame, renames: DataFrame) -> DataFrame:
    """Arrivals (+1) and departures (-1) at symbols."""
    out = holdings.select(*_SYMBOL, F.lit(_START).alias("day"), F.lit(1).alias("delta"))
    out = out.unionByName(renames.select("exchange", F.col("new_ticker").alias("ticker"), "day", F.lit(1).alias("delta")))
    return out.unionByName(renames.select(*_SYMBOL, "day", F.lit(-1).alias("delta")))


def _held(events: DataFrame, holdings: DataFrame, renames: DataFrame) -> DataFrame:
    """``events`` with ``old_held`` and ``new_held``: is the symbol held at the beginning of the day."""
    none = F.lit(None).cast("long")
    asked = events.select(*_SYMBOL, "day", "event", F.lit(True).alias("old"))
    asked = asked.unionByName(events.filter("new_ticker IS NOT NULL").select("exchange", F.col("new_ticker").alias("ticker"), "day", "event", F.lit(False).alias("old")))
    rows = _moves(holdings, renames).withColumns({"event": none, "old": F.lit(None).cast("boolean")}).unionByName(asked.withColumn("delta", F.lit(0)))
    before = F.sum("delta").over(Window.partitionBy(*_SYMBOL).orderBy("day").rangeBetween(*_BEFORE))
    found = rows.withColumn("held", F.coalesce(before, F.lit(0)) > 0).filter("event IS NOT NULL").groupBy("event").agg(
        F.coalesce(F.bool_or(F.col("old") & F.col("held")), F.lit(False)).alias("old_held"), F.coalesce(F.bool_or(~F.col("old") & F.col("held")), F.lit(False)).alias("new_held")
    )
    return events.join(found, "event")


def _least(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One event per key: the least ``by``, then the least number."""
    return rows.groupBy(*keys).agg(F.min(F.struct(by, "event")).alias("m")).select(F.col("m.event").alias("event"))


def _doubled(links: DataFrame, value: str) -> DataFrame:
    """(event, value) where following ``up`` leads to a known value; rings and what has none are left out.

    ``links``: event, up (the next event or null), value (null while unknown). Every round doubles the
    distance that a pointer spans, and stops when a round settles nothing.
    """
    links, open_before = materialise(links, "links"), -1
    while True:
        left = links.filter(F.col(value).isNull() & F.col("up").isNotNull()).count()
        if left in (0, open_before):
            return links.filter(F.col(value).isNotNull()).select("event", value)
        open_before = left
        ahead = links.select(F.col("event").alias("up"), F.col("up").alias("_up"), F.col(value).alias("_value"))
        links = materialise(links.join(ahead, "up", "left").select("event", F.when(F.coalesce(value, "_value").isNull(), F.col("_up")).alias("up"), F.coalesce(value, "_value").alias(value)), "links")


def _decided(events: DataFrame, holdings: DataFrame, renames: DataFrame) -> DataFrame:
    """The renames that count if those given do on all earlier days."""
    known = _held(events, holdings, renames).filter("action = 'rename' AND new_ticker IS NOT NULL AND old_held")
    first = known.join(_least(known, [*_SYMBOL, "day"], "new_ticker"), "event", "left_semi")
    claims = materialise(first.join(_least(first, ["exchange", "new_ticker", "day"], "ticker"), "event", "left_semi"), "claims")
    leaving = claims.select("exchange", F.col("ticker").alias("new_ticker"), "day", F.col("event").alias("up"))
    chained = claims.join(leaving, ["exchange", "new_ticker", "day"], "left")
    counts = _doubled(chained.select("event", "up", F.when(F.col("up").isNull(), ~F.col("new_held")).alias("counts")), "counts")
    # claims that never reach an end are rings: everybody in them moves on
    return materialise(claims.join(counts, "event", "left").filter(F.coalesce("counts", F.lit(True))).drop("counts", "old_held", "new_held"), "renames")


def _settled(events: DataFrame, holdings: DataFrame) -> DataFrame:
    """The renames that count."""
    renames = events.filter("action = 'rename' AND new_ticker IS NOT NULL")
    while True:
        again = _decided(events, holdings, renames)
        ids = lambda rows: rows.select("event")
        same = ids(again).join(ids(renames), "event", "left_anti").isEmpty() and ids(renames).join(ids(again), "event", "left_anti").isEmpty()
        renames = again
        if same:
            return renames


def holdings_of(instruments: DataFrame) -> DataFrame:
    return instruments.filter("ticker IS NOT NULL AND exchange IS NOT NULL").select("instrument_id", *_SYMBOL)


def apply_events(instruments: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply dated events: (instruments, intervals, conflicts).

    ``events``: ticker, exchange, action (rename or suspend), new_ticker, new_name, effective and, if
    there, new_isin. ``instruments`` come back one row each: symbol after their last rename, the last name and ISIN given,
    active unless their last event is a suspension (on one day a suspension comes after a rename and
    names the old symbol). ``intervals`` tell who held which symbol from and until when (null: open).
    ``conflicts`` are renames that don't count (``taken``) and events whose symbol nobody holds or that
    lack a day (``unknown``). A symbol of an exchange is held by one instrument.
    """
    every, holders = _events(events), materialise(holdings_of(instruments), "holdings")
    dated = every.filter("day IS NOT NULL AND ticker IS NOT NULL AND exchange IS NOT NULL")
    renames = _settled(dated, holders)
    acting = _held(dated, holders, renames)
    suspensions = acting.filter("action = 'suspend' AND old_held").drop("old_held", "new_held")
    acted = materialise(renames.unionByName(suspensions.select(*renames.columns)), "acted")

    # arrivals at symbols: instruments from the start, and renames; each event belongs to the last one before it
    arrivals = holders.select(*_SYMBOL, F.lit(_START).alias("day"), F.struct(F.col("instrument_id"), F.lit(None).cast("long").alias("event")).alias("arrival"))
    arrivals = arrivals.unionByName(renames.select("exchange", F.col("new_ticker").alias("ticker"), "day", F.struct(F.lit(None).cast(instruments.schema["instrument_id"].dataType).alias("instrument_id"), F.col("event")).alias("arrival")))
    rows = arrivals.withColumns({"event": F.lit(None).cast("long"), "leaves": F.lit(False)})
    rows = rows.unionByName(acted.select(*_SYMBOL, "day", F.lit(None).cast(arrivals.schema["arrival"].dataType).alias("arrival"), "event", (F.col("action") == "rename").alias("leaves")))
    line = Window.partitionBy(*_SYMBOL).orderBy("day")
    placed = materialise(rows.withColumns({
        "holder": F.last("arrival", ignorenulls=True).over(line.rangeBetween(*_BEFORE)),
        "until": F.min(F.when(F.col("leaves"), F.col("day"))).over(line.rangeBetween(1, Window.unboundedFollowing)),
    }), "placed")
    links = placed.filter("event IS NOT NULL").select("event", F.col("holder.event").alias("up"), F.col("holder.instrument_id").alias("instrument_id"))
    owner = _doubled(links, "instrument_id")

    date = lambda c: F.date_from_unix_date(c)
    held = placed.filter("arrival IS NOT NULL").select(*_SYMBOL, F.col("arrival.instrument_id").alias("_first"), F.col("arrival.event").alias("event"), "day", "until")
    intervals = held.join(owner, "event", "left").select(
        F.coalesce("_first", "instrument_id").alias("instrument_id"), *_SYMBOL, F.when(F.col("day") > _START, date(F.col("day"))).alias("valid_from"), date(F.col("until") - 1).alias("valid_until")
    )
    intervals = materialise(intervals, "intervals")

    done = acted.join(owner, "event").groupBy("instrument_id").agg(
        *[F.max(F.when((F.col("action") == "rename") & F.col(c).isNotNull(), F.struct("day", c))).alias(f"last_{c}") for c in ("new_name", "new_isin")],
        F.max(F.struct("day", (F.col("action") == "suspend").alias("out"))).alias("last")
    )
    now = intervals.filter("valid_until IS NULL").select("instrument_id", F.col("ticker").alias("_ticker"))
    joined = instruments.join(now, "instrument_id", "left").join(done, "instrument_id", "left")
    return joined.select(*_after(instruments.columns)), intervals, _conflicts(every, acted, acting)


def _after(columns: list[str]) -> list[Column]:
    out = F.col("last.out")
    changed = {
        "ticker": F.coalesce("_ticker", "ticker"), "company_name": F.coalesce("last_new_name.new_name", "company_name"),
        "active": F.when(out.isNull(), F.col("active")).otherwise(~out),
        "inactive_at": F.when(out, F.date_from_unix_date("last.day")).when(out.isNull(), F.col("inactive_at") if "inactive_at" in columns else F.lit(None).cast("date")),
    }
    if "isin" in columns:
        changed["isin"] = F.coalesce("last_new_isin.new_isin", "isin")
    kept = [F.col(c) for c in columns if c not in changed]
    return [*kept, *[value.alias(name) for name, value in changed.items()]]


def _conflicts(every: DataFrame, acted: DataFrame, acting: DataFrame) -> DataFrame:
    rest = every.join(acted.select("event"), "event", "left_anti").join(acting.select("event", "old_held"), "event", "left")
    reason = F.when(F.coalesce("old_held", F.lit(False)), F.lit("taken")).otherwise(F.lit("unknown"))
    return rest.select("ticker", "exchange", "new_ticker", F.date_from_unix_date("day").alias("effective"), reason.alias("reason"))
