"""Filtered scans of the provider's record sets (SRC2-SRC6)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _equal(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    return rows if value is None else rows.where(F.col(column) == value)


def _between(rows: DataFrame, column: str, start: date | None, end: date | None) -> DataFrame:
    """Inclusive range over ISO day text, which sorts like the days it names."""
    if start is not None:
        rows = rows.where(F.col(column) >= start.isoformat())
    if end is not None:
        rows = rows.where(F.col(column) <= end.isoformat())
    return rows


def daily_quotes(
    quotes: DataFrame,
    code: str | None = None,
    on: date | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Raw quotes by code, day, or day range (SRC2)."""
    rows = _equal(quotes, "Code", code)
    return _between(rows, "Date", on or start, on or end)


def listed_info(listing: DataFrame, code: str | None = None) -> DataFrame:
    """Listing rows by code (SRC3); the as-of day is chosen by ``read_latest``."""
    return _equal(listing, "Code", code)


def statements(
    rows: DataFrame,
    code: str | None = None,
    disclosed_on: date | None = None,
    code_column: str = "LocalCode",
    day_column: str = "DisclosedDate",
) -> DataFrame:
    """Financial statements by code and disclosure day (SRC4), whatever their other columns."""
    rows = _equal(rows, code_column, code)
    return _between(rows, day_column, disclosed_on, disclosed_on)


def announcements(rows: DataFrame) -> DataFrame:
    """Upcoming earnings announcements (SRC5): a plain scan."""
    return rows


def trading_calendar(
    calendar: DataFrame,
    division: str | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Calendar days by holiday division and range (SRC6)."""
    return _between(_equal(calendar, "HolidayDivision", division), "Date", start, end)
