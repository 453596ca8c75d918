"""Adjustment by event chains: a few rows a market instead of a window over every bar (WIN1, D9).

The chain of a security lists its event days in order, each with its factor and with the product of
all factors from that day on. A bar's multiplier is that product at the first event after the bar's
day, found by binary search, so bars are neither sorted nor grouped. A late corporate action changes
one chain row; the bars it touches are those of its security before its day.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.adjust import scaled

CHAIN = "_chain"
ACTIONS = "code string, date date, adjustment_factor double"


def _events(prices: DataFrame) -> DataFrame:
    factor = F.col("adjustment_factor").cast("double")
    return prices.where(factor.isNotNull() & (factor != 1.0)).select(
        "code", "date", factor.alias("factor")
    )


def _chained(events: DataFrame) -> DataFrame:
    """Chains of (code, date, factor). The window holds one security's events, not its bars."""
    later = (
        Window.partitionBy("code")
        .orderBy(F.col("date").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        events.withColumn("later", F.product("factor").over(later))
        .groupBy("code")
        .agg(F.array_sort(F.collect_list(F.struct("date", "factor", "later"))).alias("events"))
    )


def event_chain(prices: DataFrame) -> DataFrame:
    """code and events (date, factor, later) of every security that has an event.

    Bars are unique per security and day. A factor of exactly one, or none, is no event.
    """
    return _chained(_events(prices))


def extend_chain(chain: DataFrame, actions: DataFrame) -> DataFrame:
    """The chains of the securities that ``actions`` (code, date, adjustment_factor) name, renewed.

    An action sets the factor of its day, whether or not the chain knew one; of several for one day
    the largest counts. A factor of one, or null, takes the day's event away, so a chain may come
    back empty. Other securities are not read beyond their code.
    """
    named = actions.groupBy("code", "date").agg(F.max("adjustment_factor").alias("factor"))
    codes = named.select("code").distinct()
    known = chain.join(codes, "code", "left_semi").select("code", F.inline("events"))
    kept = known.select("code", "date", "factor").join(named, ["code", "date"], "left_anti")
    new = named.where(F.col("factor").isNotNull() & (F.col("factor") != 1.0))
    renewed = _chained(kept.unionByName(new.select("code", "date", "factor")))
    none = F.expr("CAST(array() AS array<struct<date: date, factor: double, later: double>>)")
    return codes.join(renewed, "code", "left").select("code", F.coalesce("events", none).alias("events"))


def replace_chain(chain: DataFrame, renewed: DataFrame) -> DataFrame:
    """The whole table of chains with the renewed rows in place of the old ones."""
    rest = chain.join(renewed.select("code"), "code", "left_anti")
    return rest.unionByName(renewed.where(F.size("events") > 0))


def chain_multiplier(events: Column, day: Column) -> Column:
    """The product of the factors after ``day``: binary search for the first later event."""

    def narrow(span: Column, _: Column) -> Column:
        low, high = span["low"], span["high"]
        middle = F.floor((low + high) / 2).cast("int")
        after = F.get(events, middle)["date"] > day
        smaller = F.struct(low.alias("low"), middle.alias("high"))
        larger = F.struct((middle + 1).alias("low"), high.alias("high"))
        return F.when(low >= high, span).when(after, smaller).otherwise(larger)

    size = F.size(events)
    steps = F.sequence(F.lit(1), F.length(F.bin(size)))
    start = F.struct(F.lit(0).alias("low"), size.alias("high"))
    found = F.aggregate(steps, start, narrow, lambda span: F.get(events, span["low"])["later"])
    return F.coalesce(found, F.lit(1.0))


def adjust_with_chain(
    prices: DataFrame,
    chain: DataFrame,
    mode: Literal["add", "replace"] = "add",
    volume: bool = True,
    turnover: bool = False,
) -> DataFrame:
    """Bars on the scale of the last event of their chain, as ``adjust_prices`` has them.

    ``chain`` has a row a security with events. From a stored table its size is known, and the planner
    broadcasts it or shuffles by its own limit; bars are not sorted for a window either way.
    """
    joined = prices.join(chain.withColumnRenamed("events", CHAIN), "code", "left")
    return scaled(joined, chain_multiplier(F.col(CHAIN), F.col("date")), mode, volume, turnover).drop(CHAIN)
