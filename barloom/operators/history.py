"""Price histories, series and latest rows over any number of securities (WIN5, AGG9, SRT3)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import Literal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.adjust import PRICES, adjust_prices, earliest_first, latest_first

_RECENCY = "_recency"


def in_days(rows: DataFrame, start: date | None, end: date | None, day: str = "date") -> DataFrame:
    """Inclusive date range; an open side does not filter (PRJ8)."""
    if start is not None:
        rows = rows.where(F.col(day) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(day) <= F.lit(end))
    return rows


def of_codes(rows: DataFrame, codes: Sequence[str] | DataFrame | None) -> DataFrame:
    """Membership filter (PRJ9): a short list is pushed to the scan, a frame is semi-joined.

    No list, and an empty list, mean every security.
    """
    if isinstance(codes, DataFrame):
        return rows.join(codes.select("code"), "code", "left_semi")
    return rows.where(F.col("code").isin(list(codes))) if codes else rows


def not_of_codes(rows: DataFrame, codes: Sequence[str] | DataFrame) -> DataFrame:
    """The negation of :func:`of_codes`."""
    if isinstance(codes, DataFrame):
        return rows.join(codes.select("code"), "code", "left_anti")
    return rows.where(~F.col("code").isin(list(codes)))


def select_columns(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column subset that names what is missing (PRJ11)."""
    missing = [name for name in columns if name not in rows.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return rows.select(*columns)


def keyed_columns(rows: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Column subset that always keeps the key, key first (PRJ10)."""
    if columns is None:
        return rows
    return rows.select("code", "date", *(c for c in columns if c not in ("code", "date")))


def price_history(
    prices: DataFrame,
    start: date | None = None,
    end: date | None = None,
    codes: Sequence[str] | DataFrame | None = None,
    columns: Sequence[str] | None = None,
    adjust: Literal["none", "add", "replace"] = "none",
    volume: bool = True,
    turnover: bool = False,
) -> DataFrame:
    """Filter, adjust, then select (WIN5).

    Days are filtered before the adjustment, so factors after ``end`` do not count.
    """
    chosen = in_days(of_codes(prices, codes), start, end)
    adjusted = adjust_prices(chosen, adjust, volume, turnover)
    return adjusted if columns is None else select_columns(adjusted, columns)


def price_series(
    prices: DataFrame,
    field: str,
    adjusted: bool | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """One field of every history as ``code, date, field``.

    Prices and volume are adjusted unless told otherwise, turnover only when
    asked, and the factor itself never.
    """
    if adjusted is None:
        adjusted = field in (*PRICES, "volume")
    mode = "replace" if adjusted and field != "adjustment_factor" else "none"
    return price_history(
        prices, start, end, columns=["code", "date", field], adjust=mode, turnover=adjusted
    )


def latest_price(
    prices: DataFrame, columns: Sequence[str] | None = None, adjusted: bool = True
) -> DataFrame:
    """The latest row of every security (AGG9).

    No factor follows the latest day, so its multiplier is one and adjusting only
    turns the volume into a double. The history never has to be multiplied out.
    """
    latest = last_n(prices, 1)
    if adjusted and "adjustment_factor" in prices.columns:
        scaled = [name for name in (*PRICES, "volume") if name in prices.columns]
        latest = latest.withColumns({name: F.col(name).cast("double") for name in scaled})
    return latest if columns is None else select_columns(latest, columns)


def last_n(prices: DataFrame, n: int) -> DataFrame:
    """The latest n rows of every security (SRT3); each map task passes on at most n."""
    return (
        prices.withColumn(_RECENCY, F.row_number().over(latest_first()))
        .where(F.col(_RECENCY) <= n)
        .drop(_RECENCY)
    )


def first_n(prices: DataFrame, n: int) -> DataFrame:
    """The earliest n rows of every security."""
    return (
        prices.withColumn(_RECENCY, F.row_number().over(earliest_first()))
        .where(F.col(_RECENCY) <= n)
        .drop(_RECENCY)
    )


def head(rows: DataFrame, n: int) -> DataFrame:
    """Preview of n rows; zero shows everything."""
    return rows.limit(n) if n else rows


def first_and_last_day(prices: DataFrame) -> DataFrame:
    """Span of every history (AGG10)."""
    return prices.groupBy("code").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
