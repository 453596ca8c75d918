"""Calendar arithmetic without loops (CAL2)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SATURDAY = 5


def next_weekday(day: Column) -> Column:
    """The day itself, or the Monday after a weekend day."""
    past_friday = F.weekday(day) - SATURDAY
    return F.when(past_friday >= 0, F.date_add(day, F.lit(2) - past_friday)).otherwise(day)


def previous_weekday(day: Column) -> Column:
    """The day itself, or the Friday before a weekend day."""
    past_friday = F.weekday(day) - SATURDAY
    return F.when(past_friday >= 0, F.date_sub(day, past_friday + 1)).otherwise(day)


def compact_day(day: Column) -> Column:
    """The eight-digit form used in request parameters."""
    return F.date_format(day, "yyyyMMdd")
