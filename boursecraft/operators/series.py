"""Price-series derivations over dated closes (ticker, day, close).

A series is worked on in blocks of days: rows are grouped by (ticker, block), so one ticker's days are
spread like any others. What crosses blocks goes through a short summary of each (count, first and last
close, moments), brought together per ticker in order and handed back to the blocks; no window gathers
a series. Rows without a ticker or day belong to no series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boursecraft.functions import finance as N
from boursecraft.functions import values as V
from boursecraft.session import materialise

HISTORY_LIMIT = 260
MIN_BETA_PAIRS = 120
RSI_PERIOD = 14


#: Calendar days of a block.
BLOCK_DAYS = 256


def in_blocks(rows: DataFrame, *columns: str) -> DataFrame:
    """(ticker, block, days): the rows of a block as one array in order of days, at most one a day."""
    block = F.floor(F.unix_date("day") / BLOCK_DAYS)
    known = rows.filter(F.col("ticker").isNotNull() & F.col("day").isNotNull())
    return known.groupBy("ticker", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("day", *columns))).alias("days"))


def _along(blocks: DataFrame, summary: Column, given: Callable[[Column, Column], Column]) -> DataFrame:
    """(ticker, block, given): what a block gets from the summaries of its ticker's blocks, in order.

    ``given`` sees all of them and the place of its own: one summary for every ``BLOCK_DAYS`` days.
    """
    each = blocks.select("ticker", F.struct(F.col("block"), summary.alias("s")).alias("x")).groupBy("ticker").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = F.transform("xs", lambda x, i: F.struct(x["block"].alias("block"), given(F.col("xs"), i).alias("given")))
    return each.select("ticker", F.inline(rows))


def day_picks(bars: DataFrame, order: tuple[str, ...] = ("ts",), day: Column | None = None, price: str = "close") -> DataFrame:
    """(ticker, day, at, close): the last bar of each day wins; ``at`` is its place in the order.

    The pick is an aggregation with map-side combine: one row per task, ticker and day is shuffled.
    """
    session = F.to_date("ts") if day is None else day
    last = F.max(F.struct(F.struct(*order).alias("at"), F.col(price).alias("close")))  # of equal places the greatest price
    picked = bars.filter(F.col(price).isNotNull()).groupBy("ticker", session.alias("day")).agg(last.alias("p"))
    return picked.select("ticker", "day", "p.at", "p.close")


def one_series(picks: DataFrame, ticker: str) -> DataFrame:
    """The last pick of each day over all tickers, as one series: a benchmark without another scan."""
    return picks.groupBy("day").agg(F.max_by("close", "at").alias("close")).select(F.lit(ticker).alias("ticker"), "day", "close")


def newest_days(closes: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` days per ticker; ``rn`` = 1 for the newest."""
    blocks = materialise(in_blocks(closes, "close"), "close-blocks")
    later = _along(blocks, F.size("days"), lambda xs, i: F.aggregate(F.slice(xs, i + 2, F.size(xs)), F.lit(0), lambda n, x: n + x["s"]))
    placed = blocks.join(later.filter(F.col("given") < limit), ["ticker", "block"])
    rows = F.transform("days", lambda d, i: F.struct(d["day"].alias("day"), d["close"].alias("close"), (F.col("given") + F.size("days") - i).alias("rn")))
    return placed.select("ticker", F.inline(F.filter(rows, lambda r: r["rn"] <= limit)))


def daily_closes(bars: DataFrame, limit: int | None = HISTORY_LIMIT, order: tuple[str, ...] = ("ts",),
                 day: Column | None = None, price: str = "close") -> DataFrame:
    """Last bar of each day wins; newest ``limit`` days per ticker, ``rn`` = 1 for the newest.

    ``limit=None`` gives every day, and no ``rn``: nothing has to be ordered within a ticker.
    """
    per_day = day_picks(bars, order, day, price).select("ticker", "day", "close")
    return per_day if limit is None else newest_days(per_day, limit)


def _windowed(n: int, value: Column) -> Column:
    return F.when(F.col("rn") <= n, value)


def moving_average(n: int, digits: int = 4) -> Column:
    closes = F.count("close")
    return F.when(closes >= n, V.rounded(F.avg(_windowed(n, F.col("close"))), digits))


def last_close() -> Column:
    return F.max_by("close", "day")


def pct_below_high(n: int = 252) -> Column:
    peak = F.max(_windowed(n, F.col("close")))
    return F.when(peak > 0, V.rounded((peak - last_close()) / peak * 100, 4))


def pct_above_low(n: int = 252) -> Column:
    trough = F.min(_windowed(n, F.col("close")))
    return F.when(trough > 0, V.rounded((last_close() - trough) / trough * 100, 4))


def window_change(n: int = 252) -> Column:
    """% change across the newest n closes; needs two closes and a positive first one."""
    first = F.min_by("close", _windowed(n, F.col("day")))
    return F.when((F.count(_windowed(n, F.col("close"))) >= 2) & (first > 0), V.rounded((last_close() / first - 1) * 100, 4))


def summarise(closes: DataFrame, measures: dict[str, Column]) -> DataFrame:
    return closes.groupBy("ticker").agg(*[c.alias(name) for name, c in measures.items()])


def moving_average_series(closes: DataFrame, n: int) -> DataFrame:
    """Moving average at every day (null until n closes exist)."""
    w = Window.partitionBy("ticker").orderBy("day").rowsBetween(-(n - 1), 0)
    return closes.withColumn("ma", F.when(F.count("close").over(w) >= n, V.rounded(F.avg("close").over(w), 4)))


def daily_returns(closes: DataFrame) -> DataFrame:
    """Close over previous close minus one, skipping non-positive or unusable bases.

    Inside a block days follow each other in its array; its first day follows the last close of the
    block before.
    """
    blocks = materialise(in_blocks(closes, "close"), "return-blocks")
    before = _along(blocks, F.element_at("days", -1)["close"], lambda xs, i: F.get(xs, i - 1)["s"])
    base = lambda i: F.when(i > 0, F.get("days", i - 1)["close"]).otherwise(F.col("given"))
    steps = F.transform("days", lambda d, i: F.struct(d["day"].alias("day"), V.finite(d["close"]).alias("close"), V.finite(base(i)).alias("base")))
    rows = blocks.join(before, ["ticker", "block"]).select("ticker", F.inline(F.filter(steps, lambda r: (r["base"] > 0) & r["close"].isNotNull())))
    return rows.select("ticker", "day", (F.col("close") / F.col("base") - 1).alias("ret"))


def rsi(period: int = RSI_PERIOD) -> Column:
    """Wilder RSI as an aggregate over (day, close): an ordered fold inside the JVM.

    The array holds at most ``HISTORY_LIMIT`` closes per ticker.
    """
    return rsi_of(ordered_closes(), period)


def rsi_of(closes: Column, period: int = RSI_PERIOD) -> Column:
    """Wilder RSI of one ordered array: SMA-seeded, then smoothed over the full history."""
    zero = F.lit(0.0)

    def smoothed(steps: Column) -> Column:
        seed = F.slice(steps, 1, period)
        rest = F.slice(steps, period + 1, F.size(steps) + 1)
        gain = F.aggregate(seed, zero, lambda acc, c: acc + F.greatest(c, zero)) / period
        loss = F.aggregate(seed, zero, lambda acc, c: acc + F.greatest(-c, zero)) / period
        return F.aggregate(
            rest,
            F.struct(gain.alias("g"), loss.alias("l")),
            lambda acc, c: F.struct(
                ((acc["g"] * (period - 1) + F.greatest(c, zero)) / period).alias("g"),
                ((acc["l"] * (period - 1) + F.greatest(-c, zero)) / period).alias("l"),
            ),
        )

    def index(avg: Column) -> Column:
        moving = V.rounded(100 - 100 / (1 + F.try_divide(avg["g"], avg["l"])), 2)
        return F.when(avg["l"] == 0, F.when(avg["g"] > 0, 100.0).otherwise(50.0)).otherwise(moving)

    def from_closes(series: Column) -> Column:
        steps = F.zip_with(F.slice(series, 2, F.size(series)), F.slice(series, 1, F.size(series) - 1), lambda b, a: b - a)
        return F.when(F.size(series) >= period + 1, _let(steps, lambda s: _let(smoothed(s), index)))

    return _let(closes, from_closes)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_days(closes: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Stock and benchmark closes on the days both have.

    The benchmark is one series of at most ``HISTORY_LIMIT`` days, so broadcasting it is bounded.
    """
    index = benchmark.filter(F.col("rn") <= HISTORY_LIMIT).select("day", F.col("close").alias("index_close"))
    return closes.join(F.broadcast(index), "day").select("ticker", "day", "close", "index_close")


_MOMENTS = "struct<n:bigint,s:double,i:double,c:double,v:double>"


def _step(before: Column, after: Column) -> Column:
    """The pair of returns between two days of a stock and its index; null without usable bases."""
    good = (V.finite(before["close"]) > 0) & (V.finite(before["index_close"]) > 0) & V.finite(after["close"]).isNotNull() & V.finite(after["index_close"]).isNotNull()
    return F.when(good, F.struct((after["close"] / before["close"] - 1).alias("s"), (after["index_close"] / before["index_close"] - 1).alias("i")))


def _moments(pairs: Column) -> Column:
    """Count, means, co-moment and index moment of an array of pairs; pairs without values don't count."""
    zero = F.lit(0.0)

    def of(used: Column) -> Column:
        n = F.size(used).cast("long")
        mean = lambda k: F.coalesce(F.try_divide(F.aggregate(used, zero, lambda a, p: a + p[k]), n), zero)
        means = F.struct(mean("s").alias("s"), mean("i").alias("i"))
        return _let(means, lambda m: F.struct(
            n.alias("n"), m["s"].alias("s"), m["i"].alias("i"),
            F.aggregate(used, zero, lambda a, p: a + (p["s"] - m["s"]) * (p["i"] - m["i"])).alias("c"),
            F.aggregate(used, zero, lambda a, p: a + (p["i"] - m["i"]) * (p["i"] - m["i"])).alias("v"),
        ))

    return _let(F.filter(pairs, lambda p: p["s"].isNotNull() & p["i"].isNotNull()), of)


def _merged(a: Column, b: Column) -> Column:
    """Moments of two sets of pairs put together."""
    n = a["n"] + b["n"]
    ds, di = b["s"] - a["s"], b["i"] - a["i"]
    share = F.coalesce(F.try_divide(b["n"], n), F.lit(0.0))
    return F.struct(
        n.alias("n"), (a["s"] + ds * share).alias("s"), (a["i"] + di * share).alias("i"),
        (a["c"] + b["c"] + ds * di * a["n"] * share).alias("c"), (a["v"] + b["v"] + di * di * a["n"] * share).alias("v"),
    )


def beta(closes: DataFrame, benchmark: DataFrame, min_pairs: int = MIN_BETA_PAIRS, digits: int = 6) -> DataFrame:
    """Covariance over variance of aligned returns; null below ``min_pairs`` or without variance.

    A block's state is its days, its first and last pair of closes and the moments of the returns inside;
    a ticker's states are merged in order, with the return from each block into the next.
    """
    blocks = in_blocks(shared_days(closes, benchmark), "close", "index_close")
    inside = F.zip_with(F.slice("days", 1, F.size("days") - 1), F.slice("days", 2, F.size("days")), _step)
    ends = [F.struct(F.get("days", at)["close"].alias("close"), F.get("days", at)["index_close"].alias("index_close")) for at in (F.lit(0), F.size("days") - 1)]
    state = F.struct("block", F.size("days").cast("long").alias("days"), ends[0].alias("first"), ends[1].alias("last"), _moments(inside).cast(_MOMENTS).alias("m"))
    none = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(k) for k in ("s", "i", "c", "v")])
    pair_type = "struct<close:double,index_close:double>"
    start = F.struct(F.lit(0).cast("long").alias("days"), F.lit(None).cast(pair_type).alias("last"), none.cast(_MOMENTS).alias("m"))

    def add(acc: Column, x: Column) -> Column:
        one = lambda p: F.when(p["s"].isNotNull() & p["i"].isNotNull(), F.struct(F.lit(1).cast("long").alias("n"), p["s"].alias("s"), p["i"].alias("i"), F.lit(0.0).alias("c"), F.lit(0.0).alias("v"))).otherwise(none)
        border = _let(_step(acc["last"], x["first"]), one)
        # each value that is used several times is worked out once
        moments = _let(_let(border, lambda b: _merged(acc["m"], b)), lambda m: _merged(m, x["m"]))
        return F.struct((acc["days"] + x["days"]).alias("days"), x["last"].cast(pair_type).alias("last"), moments.cast(_MOMENTS).alias("m"))

    states = blocks.select("ticker", state.alias("x")).groupBy("ticker").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    total = states.select("ticker", F.aggregate("xs", start, add).alias("t")).select("ticker", "t.days", "t.m.n", "t.m.c", "t.m.v")
    usable = (F.col("days") >= min_pairs + 1) & (F.col("n") >= min_pairs) & (F.col("v") != 0)
    return total.select("ticker", "days", F.col("n").alias("pairs"), F.when(usable, V.rounded(F.col("c") / F.col("v"), digits)).alias("beta"))


def price_change(closes: DataFrame, since, until) -> DataFrame:
    """As-of change of one series between two dates: last close on or before each of them."""
    def at(target) -> tuple[Column, Column]:
        key = F.when(F.col("day") <= F.lit(target).cast("date"), F.col("day"))
        return F.max(key), F.max_by("close", key)

    (d0, p0), (d1, p1) = at(since), at(until)
    ends = closes.groupBy("ticker").agg(d0.alias("start_day"), p0.alias("start_price"), d1.alias("end_day"), p1.alias("end_price"))
    change = F.when(
        (F.col("start_day") != F.col("end_day")) & (F.col("start_price") > 0),
        V.rounded((F.col("end_price") / F.col("start_price") - 1) * 100, 4),
    )
    return ends.withColumn("change_pct", change)


# ---- registered measures ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Measure:
    """A number of one series: ``sql`` is an expression over ``closes``, an array in order of days."""

    field: str
    unit: str | None
    sql: str


MEASURES: dict[str, Measure] = {}


def register_measure(field: str, unit: str | None, sql: str) -> Measure:
    """Add a measure under a name of its own: ``derived_metrics`` reports it, and ``install_measures``
    makes it a function of SQL. A name that is taken is refused."""
    if field in MEASURES or field in _OWN_FIELDS:
        raise ValueError(f"{field} is registered already")
    MEASURES[field] = Measure(field, unit, sql)
    return MEASURES[field]


def install_measures(spark: SparkSession) -> list[str]:
    """Make every measure a function of this session: ``SELECT fiftyDayAverage(closes) FROM ...``."""
    for measure in MEASURES.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION `{measure.field}`(closes ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {measure.sql}")
    return list(MEASURES)


def ordered_closes() -> Column:
    """Aggregate: a ticker's closes in order of days, ``HISTORY_LIMIT`` at most."""
    return F.transform(F.array_sort(F.collect_list(F.struct("day", "close"))), lambda s: s["close"])


def _rounded_sql(value: str, digits: int) -> str:
    return f"rint({value} * 1e{digits}) / 1e{digits}"


def average_sql(n: int) -> str:
    total = f"aggregate(slice(closes, -{n}, {n}), 0D, (a, c) -> a + c)"
    return f"CASE WHEN size(closes) >= {n} THEN {_rounded_sql(f'({total} / {n})', 4)} END"


def change_sql(n: int) -> str:
    first = f"element_at(closes, -least({n}, size(closes)))"
    return f"CASE WHEN size(closes) >= 2 AND {first} > 0 THEN {_rounded_sql(f'((element_at(closes, -1) / {first} - 1) * 100)', 4)} END"


_OWN_FIELDS = ("beta", "rsi_14", "rsi_14_signal")
register_measure("fiftyDayAverage", "INR", average_sql(50))
register_measure("twoHundredDayAverage", "INR", average_sql(200))
register_measure("fiftyTwoWeekChangePercent", "percent", change_sql(252))
register_measure("price_chg_pct", "percent", change_sql(6))


def derived_metrics(closes: DataFrame, benchmark: DataFrame, benchmark_ticker: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations, issues): beta, RSI and its signal, and all registered measures, from one pass.

    A ticker below the RSI minimum yields at most its beta and one issue.
    """
    if benchmark_ticker is not None:
        closes = closes.filter(F.col("ticker") != benchmark_ticker)
    ordered = closes.groupBy("ticker").agg(ordered_closes().alias("closes"))
    wide = ordered.withColumns({"_n": F.size("closes").cast("long"), "rsi_14": rsi_of(F.col("closes"))})
    wide = wide.withColumns({m.field: F.expr(m.sql) for m in MEASURES.values()}).drop("closes")
    wide = wide.join(beta(closes, benchmark).select("ticker", V.rounded("beta", 4).alias("beta")), "ticker", "left")
    long_enough = F.col("rsi_14").isNotNull()

    def cell(field: str, unit: str | None, numeric: Column, text: Column | None = None) -> Column:
        return F.struct(
            F.lit(field).alias("field"), F.lit(unit).cast("string").alias("unit"),
            numeric.cast("double").alias("numeric_value"),
            (text if text is not None else F.lit(None)).cast("string").alias("text_value"),
        )

    cells = [
        cell("beta", "ratio", F.col("beta")),
        cell("rsi_14", "rsi", F.col("rsi_14")),
        cell("rsi_14_signal", None, F.lit(None), N.rsi_signal("rsi_14")),
    ] + [cell(m.field, m.unit, F.when(long_enough, F.col(m.field))) for m in MEASURES.values()]
    observations = wide.select("ticker", F.inline(F.array(*cells))).filter("numeric_value IS NOT NULL OR text_value IS NOT NULL")
    issues = wide.filter(~long_enough).select(
        "ticker", F.lit("insufficient_price_history").alias("code"), F.col("_n").alias("raw_value")
    )
    return observations, issues


def history_metrics(history: DataFrame, as_of, stale_days: int = 10) -> DataFrame:
    """Full-history price summary: last close, extremes, tail means, first-to-last change."""
    newest = Window.partitionBy("ticker").orderBy(F.col("day").desc())
    ranked = history.filter(F.col("close").isNotNull()).withColumn("rn", F.row_number().over(newest))
    first = F.min_by("close", "day")
    return ranked.groupBy("ticker").agg(
        last_close().alias("currentPrice"),
        F.max("high").alias("fiftyTwoWeekHigh"),
        F.min("low").alias("fiftyTwoWeekLow"),
        V.rounded(F.avg(_windowed(50, F.col("close"))), 6).alias("fiftyDayAverage"),
        V.rounded(F.avg(_windowed(200, F.col("close"))), 6).alias("twoHundredDayAverage"),
        F.when(first != 0, (last_close() / first - 1) * 100).alias("fiftyTwoWeekChangePercent"),
        F.max("day").alias("price_asof"),
        (F.max("day") >= F.date_sub(F.lit(as_of).cast("date"), stale_days)).alias("is_fresh"),
    )
