"""Day sequences, default windows and gaps (CAL1-CAL4, D5)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import next_weekday, previous_weekday

# Default window lengths in days.
FIRST_RUN_LOOKBACK = 365
WINDOW_LENGTH = 14
SAMPLE_LOOKBACK = 84


def day_sequence(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every day from start to end (CAL1)."""
    if start > end:
        raise ValueError(f"{start} is after {end}")
    bounds = spark.range(1).select(F.sequence(F.lit(start), F.lit(end)).alias("days"))
    return bounds.select(F.explode("days").alias("date"))


def days_spanned(rows: DataFrame, day: str = "date") -> DataFrame:
    """Every day between the first and the last day of the rows (CAL1 over data)."""
    span = rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).where(F.col("a").isNotNull())
    return span.select(F.explode(F.sequence("a", "b")).alias("date"))


def default_window(stored: DataFrame, today: date, day: str = "date") -> DataFrame:
    """The next window to fetch (CAL3): from the weekday after the latest stored day,
    or a year back when nothing is stored, for two weeks."""
    latest = F.max(day)
    begin = F.coalesce(F.date_add(latest, 1), F.date_sub(F.lit(today), FIRST_RUN_LOOKBACK))
    window = stored.agg(begin.alias("begin")).select(next_weekday(F.col("begin")).alias("from_date"))
    return window.withColumn("to_date", F.date_add("from_date", WINDOW_LENGTH))


def resolve_window(
    stored: DataFrame, today: date, start: date | None = None, end: date | None = None
) -> DataFrame:
    """The window with either side given by the caller (CAL3)."""
    window = default_window(stored, today)
    if start is not None:
        window = window.select(
            F.lit(start).alias("from_date"), F.date_add(F.lit(start), WINDOW_LENGTH).alias("to_date")
        )
    return window.withColumn("to_date", F.lit(end)) if end is not None else window


def stored_window(stored: DataFrame, day: str = "date") -> DataFrame:
    """First and last stored day, the default window of the later layers (CAL4)."""
    return stored.agg(F.min(day).alias("from_date"), F.max(day).alias("to_date"))


def with_weekdays(rows: DataFrame, day: str = "date") -> DataFrame:
    """Every day with the weekday it moves to in either direction (CAL2)."""
    return rows.withColumns(
        {
            "next_weekday": next_weekday(F.col(day)),
            "previous_weekday": previous_weekday(F.col(day)),
        }
    )


def sample_day(spark: SparkSession, today: date) -> DataFrame:
    """The default day of a quotes request: a weekday at least twelve weeks back (CAL2)."""
    back = F.date_sub(F.lit(today), SAMPLE_LOOKBACK)
    return spark.range(1).select(previous_weekday(back).alias("date"))


def missing_days(prices: DataFrame, open_days: DataFrame) -> DataFrame:
    """Open days without a bar between a security's first and last bar.

    Only the gaps between neighbouring bars are expanded, not the whole
    calendar of every security.
    """
    in_order = Window.partitionBy("code").orderBy("date")
    gaps = (
        prices.select("code", "date")
        .withColumn("following", F.lead("date").over(in_order))
        .where(F.date_diff("following", "date") > 1)
    )
    absent = gaps.select(
        "code",
        F.explode(
            F.sequence(F.date_add("date", 1), F.date_sub(F.col("following"), 1))
        ).alias("date"),
    )
    return absent.join(open_days.select("date").distinct(), "date", "left_semi").select(
        "code", "date"
    )
