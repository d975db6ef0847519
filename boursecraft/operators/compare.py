"""Run comparison, change sections and pattern flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boursecraft.functions import finance as N
from boursecraft.functions import values as V

TOP_N, RANK_MOVE, PRICE_MOVE, DRAWDOWN_MOVE, DELIVERY_FLIP, SECTION_ROWS = 25, 25, 15.0, 10.0, 5.0, 15


def movement_label(old_rank: Column, new_rank: Column, old_exists: Column, new_exists: Column) -> Column:
    return (
        F.when(~old_exists & new_exists, "added")
        .when(old_exists & ~new_exists, "removed")
        .when(old_rank.isNull() & new_rank.isNotNull(), "newly ranked")
        .when(old_rank.isNotNull() & new_rank.isNull(), "became unranked")
        .when(old_rank.isNull() & new_rank.isNull(), "unranked")
        .when(old_rank > new_rank, "up")
        .when(old_rank < new_rank, "down")
        .otherwise("unchanged")
    )


def _side(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return df.select("ticker", F.lit(True).alias(f"{prefix}_in"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def movement(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Per current ticker: rank delta old - new, score delta new - old (1 decimal), label."""
    both = _side(current, "new", ["rank", "final_score"]).join(_side(previous, "old", ["rank", "final_score"]), "ticker", "left")
    return both.select(
        "ticker",
        (F.col("old_rank") - F.col("new_rank")).alias("rank_vs_staged"),
        V.rounded(F.col("new_final_score") - F.col("old_final_score"), 1).alias("score_vs_staged"),
        movement_label(F.col("old_rank"), F.col("new_rank"), F.col("old_in").isNotNull(), F.lit(True)).alias("movement_vs_staged"),
    )


def three_snapshots(current: DataFrame, staged: DataFrame, pushed: DataFrame) -> DataFrame:
    """Three pairwise movements over the union of tickers."""
    cols = ["rank", "final_score"]
    merged = (
        _side(current, "c", cols).join(_side(staged, "s", cols), "ticker", "full").join(_side(pushed, "p", cols), "ticker", "full")
    )

    def pair(old: str, new: str, suffix: str) -> list[Column]:
        label = movement_label(
            F.col(f"{old}_rank"), F.col(f"{new}_rank"), F.col(f"{old}_in").isNotNull(), F.col(f"{new}_in").isNotNull()
        )
        return [
            (F.col(f"{old}_rank") - F.col(f"{new}_rank")).alias(f"rank_{suffix}"),
            V.rounded(F.col(f"{new}_final_score") - F.col(f"{old}_final_score"), 2).alias(f"score_{suffix}"),
            label.alias(f"movement_{suffix}"),
        ]

    return merged.select(
        "ticker", *pair("s", "c", "vs_staged"), *pair("p", "s", "staged_vs_pushed"), *pair("p", "c", "vs_pushed")
    )


def keyed_order(current: DataFrame, staged: DataFrame, pushed: DataFrame, position: str = "rank") -> DataFrame:
    """Sort key that keeps current order and appends tickers only older snapshots have."""
    def at(df: DataFrame, name: str) -> DataFrame:
        return df.select("ticker", F.col(position).cast("double").alias(name))

    merged = at(current, "c").join(at(staged, "s"), "ticker", "full").join(at(pushed, "p"), "ticker", "full")
    return merged.select("ticker", F.coalesce(F.col("c"), F.col("s") + 1e9, F.col("p") + 2e9).alias("sort_key"))


_COMPARED = ["rank", "final_score", "currentPrice", "pct_below_52w_high", "delivery_trend"]


def snapshot_join(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Full outer join of two snapshots with deltas and a side indicator."""
    m = _side(current, "new", _COMPARED).join(_side(previous, "prev", _COMPARED), "ticker", "full")
    return m.withColumns(
        {
            "side": F.when(F.col("prev_in").isNull(), "new_only").when(F.col("new_in").isNull(), "prev_only").otherwise("both"),
            "d_rank": F.col("prev_rank") - F.col("new_rank"),
            "d_score": F.col("new_final_score") - F.col("prev_final_score"),
            "d_price_pct": (F.try_divide(F.col("new_currentPrice"), F.col("prev_currentPrice")) - 1) * 100,
            "d_draw": F.col("new_pct_below_52w_high") - F.col("prev_pct_below_52w_high"),
        }
    )


def change_sections(previous: DataFrame, current: DataFrame, top_n: int = TOP_N, cap: int = SECTION_ROWS) -> DataFrame:
    """Nine change sections as (section, ticker, sort value); capped as the report prints them.

    Top-list entrants and drop-outs are naturally bounded by ``top_n``; the cap is the report's.
    """
    m = snapshot_join(previous, current)
    c = F.col
    both = c("side") == "both"
    newr, prevr = c("new_rank"), c("prev_rank")
    accum = both & (c("prev_delivery_trend") < 0) & (c("new_delivery_trend") >= DELIVERY_FLIP)
    distr = both & (c("prev_delivery_trend") > 0) & (c("new_delivery_trend") <= -DELIVERY_FLIP)

    def entry(name: str, condition: Column, order: Column, capped: bool = True) -> Column:
        return F.when(
            condition,
            F.struct(F.lit(name).alias("section"), order.cast("double").alias("sort_value"), F.lit(capped).alias("capped")),
        )

    entries = F.array(
        entry("new_top", (newr <= top_n) & ((prevr > top_n) | prevr.isNull()), newr, False),
        entry("dropped_top", (prevr <= top_n) & ((newr > top_n) | newr.isNull()), prevr, False),
        entry("price_moves", both & (F.abs("d_price_pct") >= PRICE_MOVE), -F.abs("d_price_pct")),
        entry("rank_up", both & (c("d_rank") >= RANK_MOVE), -c("d_rank")),
        entry("rank_down", both & (c("d_rank") <= -RANK_MOVE), c("d_rank")),
        entry("drawdown", both & (c("d_draw") >= DRAWDOWN_MOVE), -c("d_draw")),
        entry("delivery_flips", accum | distr, -F.abs("new_delivery_trend")),
        entry("added", c("side") == "new_only", F.coalesce(newr.cast("double"), F.lit(1e18))),
        entry("removed", c("side") == "prev_only", F.coalesce(prevr.cast("double"), F.lit(1e18))),
    )
    rows = m.select("ticker", F.inline(F.filter(entries, lambda e: e.isNotNull())))
    # `row_number() <= cap` is planned as a group limit: every task keeps at most `cap` rows per
    # section before the shuffle, so a section never gathers its whole membership.
    w = Window.partitionBy("section", "capped").orderBy("sort_value", "ticker")
    ranked = rows.withColumn("position", F.row_number().over(w))
    limited = ranked.filter(F.col("position") <= F.greatest(F.lit(cap), F.lit(top_n)))
    return limited.filter(~F.col("capped") | (F.col("position") <= cap)).select("section", "ticker", "sort_value", "position")


def rank_and_price_change(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Rank change and rounded price change against the last stored run."""
    prev = previous.select("ticker", F.col("rank").alias("prev_rank"), F.col("currentPrice").alias("prev_price"))
    change = F.when(
        (F.col("prev_price") > 0) & (F.col("currentPrice") != 0),
        V.rounded((F.col("currentPrice") - F.col("prev_price")) / F.col("prev_price") * 100, 1),
    )
    return current.join(prev, "ticker", "left").withColumns(
        {"rank_chg": F.col("prev_rank") - F.col("rank"), "price_chg_pct": change}
    )


def pattern_flags(df: DataFrame) -> DataFrame:
    """Accumulation, value trap and near-low-quality flags; a missing input never matches."""
    c = F.col
    position = N.range_position("currentPrice", "fiftyTwoWeekLow", "fiftyTwoWeekHigh", "pct_below_52w_high")
    rows = df.withColumn("range_position_pct", position)
    flag = lambda condition: F.coalesce(condition, F.lit(False))
    return rows.withColumns(
        {
            "pat_accum": flag((c("delivery_trend") >= 5) & (c("institutional_pct") >= 30) & (c("final_score") >= 55)),
            "pat_trap": flag((c("pct_below_52w_high") >= 30) & (c("g_quality") < 40) & (c("delivery_trend") <= -5)),
            "pat_near_low": flag(c("final_score").isNotNull() & (c("range_position_pct") < 20) & (c("g_quality") >= 60)),
        }
    )


def cheap_and_strong() -> Column:
    c = F.col
    return F.coalesce(
        c("final_score").isNotNull() & (c("g_valuation") >= 55) & (c("g_quality") >= 55) & (c("pct_below_52w_high") >= 10),
        F.lit(False),
    )
