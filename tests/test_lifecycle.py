"""Dated renames and suspensions against a loop over days, and the identity defects that were found."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest

from boursecraft.operators import identity as I
from boursecraft.operators import lifecycle as Y
from boursecraft.sinks import tables as B

INST = "instrument_id long, ticker string, exchange string, isin string, company_name string, active boolean, inactive_at date"
EVENTS = "ticker string, exchange string, action string, new_ticker string, new_name string, new_isin string, effective date"


def loop(instruments, events):
    """Day after day; within a day, renames fall away until the rest can happen together."""
    state = {i: {"ticker": t, "company_name": n, "isin": s, "active": a, "inactive_at": o} for i, t, _, s, n, a, o in instruments}
    holder = {(e, t): i for i, t, e, *_ in instruments if t is not None}
    since, intervals = {k: None for k in holder}, []
    days, conflicts = defaultdict(list), 0
    for e in events:
        days[e[6]].append(e)
    conflicts += len(days.pop(None, []))
    for day in sorted(days):
        start = dict(holder)
        old = lambda e: (e[1], e[0])
        new = lambda e: (e[1], e[3])
        conflicts += sum(old(e) not in start for e in days[day])
        renames = [e for e in days[day] if e[2] == "rename" and e[3] is not None and old(e) in start]
        one = {}
        for e in sorted(renames, key=lambda e: e[3]):
            one.setdefault(old(e), e)
        claim = {}
        for e in sorted(one.values(), key=lambda e: e[0]):
            claim.setdefault(new(e), e)
        good = list(claim.values())
        while True:
            leaving = {old(e) for e in good}
            left = [e for e in good if new(e) not in start or new(e) in leaving]
            if len(left) == len(good):
                break
            good = left
        conflicts += sum(e[2] == "rename" and old(e) in start for e in days[day]) - len(good)
        for e in good:
            intervals.append((start[old(e)], e[1], e[0], since[old(e)], day - dt.timedelta(1)))
            holder.pop(old(e))
        for e in good:
            holder[new(e)], since[new(e)] = start[old(e)], day
            mine = state[start[old(e)]]
            mine.update(ticker=e[3], active=True, inactive_at=None, company_name=e[4] if e[4] is not None else mine["company_name"], isin=e[5] if e[5] is not None else mine["isin"])
        for e in days[day]:
            if e[2] == "suspend" and old(e) in start:
                state[start[old(e)]].update(active=False, inactive_at=day)
    intervals += [(i, *k, since[k], None) for k, i in holder.items()]
    return sorted((i, s["ticker"], s["isin"], s["company_name"], s["active"], s["inactive_at"]) for i, s in state.items()), sorted(intervals, key=repr), conflicts


@pytest.mark.parametrize("seed", range(6))
def test_random_batches_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    names = [f"T{k}" for k in range(14)]
    instruments = [(i, names[i], "NSE", f"I{i}", f"n{i}", rng.random() < 0.8, None) for i in range(9)] + [(100, None, "NSE", None, "nameless", True, None), (101, "T3", "BSE", None, "other", True, dt.date(2020, 1, 1))]
    events = []
    for k in range(60):
        day = dt.date(2024, 1, rng.randrange(1, 7)) if rng.random() < 0.97 else None
        rename = rng.random() < 0.85
        events.append((rng.choice(names), "NSE" if rng.random() < 0.9 else "BSE", "rename" if rename else "suspend", rng.choice(names) if rename else None, f"e{k}" if rng.random() < 0.7 else None, f"X{k}" if rng.random() < 0.3 else None, day))
    # the loop takes equal (old, new, day) renames in order; their names must not differ
    seen, unique = set(), []
    for e in events:
        if e[:4] + e[6:] not in seen:
            seen.add(e[:4] + e[6:])
            unique.append(e)
    after, intervals, conflicts = Y.apply_events(spark.createDataFrame(instruments, INST), spark.createDataFrame(unique, EVENTS))
    want, spans, refused = loop(instruments, unique)
    assert sorted(tuple(r) for r in after.select("instrument_id", "ticker", "isin", "company_name", "active", "inactive_at").collect()) == want
    assert sorted((tuple(r) for r in intervals.select("instrument_id", "exchange", "ticker", "valid_from", "valid_until").collect()), key=repr) == spans
    assert conflicts.count() == refused


def frame(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], INST)


def event(old, action, new=None, day=1):
    return (old, "NSE", action, new, new and f"name of {new}", None, dt.date(2024, 1, day))


@pytest.mark.parametrize("events,want", [
    ([event("A", "rename", "B", 2), event("B", "rename", "C", 5)], {1: "C", 2: "C2"}),  # A to B to C in one batch
    ([event("A", "rename", "C2"), event("C2", "rename", "A")], {1: "C2", 2: "A"}),  # a swap
    ([event("A", "rename", "B"), event("C2", "rename", "B")], {1: "B", 2: "C2"}),  # two claims
    ([event("A", "rename", "C2")], {1: "A", 2: "C2"}),  # taken
    ([event("A", "rename", "C2", 3), event("C2", "rename", "D", 2)], {1: "C2", 2: "D"}),  # freed the day before
])
def test_chains_swaps_and_claims(spark, events, want):
    inst = frame(spark, [(1, "A", "NSE", None, "a", True), (2, "C2", "NSE", None, "c", True)])
    after, _, conflicts = I.apply_lifecycle(inst, spark.createDataFrame(events, EVENTS))
    assert {r.instrument_id: r.ticker for r in after.collect()} == want
    moved = sum({1: "A", 2: "C2"}[i] != t for i, t in want.items())
    assert conflicts.count() == len(events) - (2 if events[0][3] == "B" and len(events) == 2 and events[1][0] == "B" else moved)


def test_rename_and_suspension_of_one_ticker_keep_one_row(spark):
    inst = frame(spark, [(2, "B", "NSE", None, "b", True)])
    after, aliases, conflicts = I.apply_lifecycle(inst, spark.createDataFrame([event("B", "rename", "C"), event("B", "suspend")], EVENTS))
    assert [(r.instrument_id, r.ticker, r.active, r.inactive_at) for r in after.collect()] == [(2, "C", False, dt.date(2024, 1, 1))]
    assert [(r.ticker, r.valid_until) for r in aliases.collect()] == [("B", dt.date(2023, 12, 31))] and conflicts.count() == 0


def test_a_long_chain_is_followed_to_its_end(spark):
    inst = frame(spark, [(1, "T0", "NSE", None, "a", True), *[(k, f"U{k}", "NSE", None, "u", True) for k in range(100, 140)]])
    by_day = [event(f"T{k}", "rename", f"T{k + 1}", k + 1) for k in range(25)]
    one_day = [event(f"U{k}", "rename", f"U{k + 1}", 9) for k in range(100, 140)]
    after, intervals, conflicts = I.apply_lifecycle(inst, spark.createDataFrame(by_day + one_day, EVENTS))
    assert {r.instrument_id: r.ticker for r in after.collect()} == {1: "T25", **{k: f"U{k + 1}" for k in range(100, 140)}}
    assert conflicts.count() == 0 and intervals.filter("instrument_id = 1").count() == 25


def test_no_events_change_nothing(spark):
    inst = frame(spark, [(1, "A", "NSE", None, "a", True)])
    after, aliases, conflicts = I.apply_lifecycle(inst, spark.createDataFrame([], EVENTS))
    assert [tuple(r) for r in after.select(*inst.columns).collect()] == [tuple(r) for r in inst.collect()]
    assert aliases.count() == conflicts.count() == 0


def test_listings_without_an_isin_are_recognised_by_symbol(spark):
    inst = spark.createDataFrame([(1, "A", "NSE", None, "a", "EQUITY", True), (2, "B", "NSE", "INE2", "b", "EQUITY", True)], "instrument_id long, ticker string, exchange string, isin string, company_name string, kind string, active boolean")
    snap = lambda rows: spark.createDataFrame(rows, "ticker string, exchange string, isin string, shortName string")
    out, aliases = I.sync_universe(inst, snap([("A", "NSE", None, "a"), ("A", "NSE", None, "a2"), ("B", "NSE", "INE2", "b")]), "2024-01-01")
    assert sorted((r.instrument_id, r.action, r.active, r.company_name) for r in out.collect()) == [(1, "updated", True, "a2"), (2, "updated", True, "b")]
    assert aliases.count() == 0
    with pytest.raises(ValueError, match="no single stored instrument"):  # a stored ISIN that the listing doesn't confirm
        I.sync_universe(inst, snap([("A", "NSE", None, "a"), ("B", "NSE", None, "b")]), "2024-01-01")


def test_two_spellings_of_one_ticker_are_one_instrument(spark):
    stored = spark.createDataFrame([("B", "NSE", "old b", None)], "ticker string, exchange string, company_name string, sector string")
    rows = [("a", "NSE", "one", "x"), (" A", None, "two", None), ("b", "NSE", "", "y"), ("", "NSE", "n", None), (None, "NSE", "n", None)]
    out = B.upsert_instruments(stored, spark.createDataFrame(rows, "ticker string, exchange string, shortName string, sector string"))
    assert sorted(tuple(r) for r in out.collect()) == [("A", "NSE", "two", "x"), ("B", "NSE", "b", "y")]
