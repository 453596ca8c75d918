"""Split and dividend adjustment of price histories (WIN1-WIN4, PRJ16, D9).

A stored factor describes its own day only. A row's multiplier is the product of
the factors of all later days of the same security.

The windows below hold one security at a time. Bars are unique per security and
day, so such a group never has more rows than the calendar has days, however
large the table is.
"""

from __future__ import annotations

from datetime import date
from typing import Literal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions import inverse_multiplier, is_adjustment_event
from barloom.schemas import FACTOR_TOLERANCE

MULTIPLIER = "_multiplier"
PRICES = ("open", "high", "low", "close")


def latest_first() -> WindowSpec:
    """One security, latest day first: a frame growing from there takes one pass."""
    return Window.partitionBy("code").orderBy(F.col("date").desc())


def earliest_first() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def _day_factor() -> Column:
    return F.coalesce(F.col("adjustment_factor").cast("double"), F.lit(1.0))


def later_factors() -> Column:
    """The product of the factors of all later days of a row's security."""
    later_days = latest_first().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.product(_day_factor()).over(later_days), F.lit(1.0))


def cumulative_adjustment(prices: DataFrame, name: str = MULTIPLIER) -> DataFrame:
    """Add the product of the factors strictly after each row (WIN1)."""
    known = "adjustment_factor" in prices.columns
    return prices.withColumn(name, later_factors() if known else F.lit(1.0))


def scaled(
    prices: DataFrame,
    multiplier: Column,
    mode: Literal["add", "replace"],
    volume: bool = True,
    turnover: bool = False,
) -> DataFrame:
    """Bars times a multiplier, volume divided by it (WIN2-WIN4).

    ``add`` writes ``adj_*`` columns (a stored ``adj_close`` gives way),
    ``replace`` takes the columns' own names. What the bars lack is left out.
    The multiplier is worked out once a row and does not appear in the result.
    """
    wanted = [*PRICES, *["volume"] * volume, *["turnover_value"] * turnover]
    by = F.col(MULTIPLIER)
    results = {name: F.col(name) for name in prices.columns}
    for name in wanted:
        if name in prices.columns:
            share = inverse_multiplier(by) if name == "volume" else by
            target = name if mode == "replace" else f"adj_{name}"
            results[target] = F.col(name).cast("double") * share
    columns = [value.alias(name) for name, value in results.items()]
    return prices.withColumn(MULTIPLIER, multiplier).select(*columns)


def adjust_prices(
    prices: DataFrame,
    mode: Literal["none", "add", "replace"] = "add",
    volume: bool = True,
    turnover: bool = False,
) -> DataFrame:
    """Bring every bar to the scale of the latest bar of its security in the frame.

    Filter days before the call: bars outside the frame have no say in the result.
    """
    if mode not in ("none", "add", "replace"):
        raise ValueError("mode must be 'none', 'add' or 'replace'")
    if mode == "none" or "adjustment_factor" not in prices.columns:
        return prices
    return scaled(prices, later_factors(), mode, volume, turnover)


def adjust_to_reference(
    prices: DataFrame,
    reference: date | Literal["latest", "earliest"] = "latest",
    mode: Literal["add", "replace"] = "add",
    volume: bool = True,
    turnover: bool = False,
) -> DataFrame:
    """Bring bars to the scale of a chosen day, forward or backward in time.

    The reference value is the product of the factors after the reference day,
    taken over the same partitioning as the multiplier, so it costs no shuffle.
    """
    if reference == "latest":
        return scaled(prices, later_factors(), mode, volume, turnover)
    whole = Window.partitionBy("code")
    start = F.min("date").over(whole) if reference == "earliest" else F.lit(reference)
    dated = prices.withColumn("_reference", start)
    after = F.when(F.col("date") > F.col("_reference"), _day_factor())
    at_reference = F.coalesce(F.product(after).over(whole), F.lit(1.0))
    moved = scaled(dated, later_factors() / at_reference, mode, volume, turnover)
    return moved.drop("_reference")


def adjustment_events(prices: DataFrame, tolerance: float = FACTOR_TOLERANCE) -> DataFrame:
    """Days on which a security's factor differs from one (PRJ16)."""
    event = is_adjustment_event(F.col("adjustment_factor"), tolerance)
    return prices.where(event).select("code", "date", "adjustment_factor")
