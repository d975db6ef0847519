"""Delivery averages and trend, bulk and block deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boursecraft import catalog
from boursecraft.functions import values as V
from boursecraft.operators import latest as L
from boursecraft.session import materialise

RECENT, MIN_SESSIONS, NAMES_LENGTH = 5, 4, 300


def most_liquid(rows: DataFrame, tie: Column, keys: tuple[str, ...] = ("symbol", "day")) -> DataFrame:
    """One row per (symbol, day): the largest volume, then the greatest ``tie``."""
    return L.pick(rows, list(keys), [F.col("volume"), tie])


def delivery_summary(per_day: DataFrame) -> DataFrame:
    """Average delivery, average of the newest five sessions, and their difference to the rest.

    With five sessions or fewer the rest is all but the newest. Fewer than four sessions: nothing.
    ``per_day`` holds at most one row per symbol and session, and the sessions are a short window.
    """
    w = Window.partitionBy("symbol").orderBy(F.desc("day"))
    ranked = per_day.withColumn("rn", F.row_number().over(w))
    pct = F.col("delivery_pct")
    n = F.count("*")
    recent = F.avg(F.when(F.col("rn") <= RECENT, pct))
    prior = F.when(n > RECENT, F.avg(F.when(F.col("rn") > RECENT, pct))).otherwise(F.avg(F.when(F.col("rn") > 1, pct)))
    return ranked.groupBy("symbol").agg(
        n.alias("sessions"), V.rounded(F.avg(pct), 1).alias("avg_delivery_pct"), V.rounded(recent, 1).alias("delivery_recent_pct"),
        V.rounded(recent - prior, 1).alias("delivery_trend"),
    ).filter(F.col("sessions") >= MIN_SESSIONS)


def quantity(text: Column) -> Column:
    return F.coalesce(F.trim(F.replace(text, F.lit(","), F.lit(""))).try_cast("long"), F.lit(0))


def combine_deals(bulk: DataFrame, block: DataFrame) -> DataFrame:
    return bulk.withColumn("deal_type", F.lit("bulk")).unionByName(block.withColumn("deal_type", F.lit("block")), allowMissingColumns=True)


def deal_summary(deals: DataFrame, institution: str = catalog.INSTITUTION_PATTERN, length: int = NAMES_LENGTH) -> DataFrame:
    """Per symbol: traded quantities, distinct institutional buyers and sellers and their names.

    Deals are combined per (symbol, side, client) first, so a heavily traded symbol contributes one
    row per client. Only names that can appear within the first ``length`` characters are gathered:
    each name is at least one character and a separator of three, so the first ``length`` names in
    order always suffice.
    """
    side = F.substring(F.upper(F.trim("side")), 1, 1)
    per_client = (
        deals.groupBy("symbol", side.alias("side"), "client")
        .agg(F.sum(quantity(F.col("quantity"))).alias("qty"))
        .withColumn("inst", F.coalesce(F.col("client").rlike(institution), F.lit(False)))
    )
    # one row per symbol, side and client; read for the totals and for the names
    per_client = materialise(per_client, "deals")
    buy, sell = F.col("side") == "B", F.col("side") == "S"
    totals = per_client.groupBy("symbol").agg(
        F.coalesce(F.sum(F.when(buy, F.col("qty"))), F.lit(0)).alias("deal_buy_qty"),
        F.coalesce(F.sum(F.when(sell, F.col("qty"))), F.lit(0)).alias("deal_sell_qty"),
        F.count_if(buy & F.col("inst")).alias("n_inst_buy"),
        F.count_if(sell & F.col("inst")).alias("n_inst_sell"),
    )
    w = Window.partitionBy("symbol", "side").orderBy("client")
    listed = per_client.filter("inst AND side IN ('B', 'S')").withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") <= length)
    joined = lambda s: F.substring(F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("client")))), " | "), 1, length)
    names = listed.groupBy("symbol").agg(joined("B").alias("inst_buyers"), joined("S").alias("inst_sellers"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return totals.join(names, "symbol", "left").select(*totals.columns, empty("inst_buyers"), empty("inst_sellers"))
