"""Strict and lenient conversions of raw fields (PRJ2-PRJ4)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FORMAT = "yyyy-MM-dd"


def nan_to_null(value: Column) -> Column:
    """NaN never comes from JSON, so it is treated as a missing value."""
    return F.nanvl(value, F.lit(None).cast("double"))


def strict_double(value: Column) -> Column:
    """Under ANSI mode a malformed value fails the job."""
    return nan_to_null(value.cast("double"))


def lenient_double(value: Column) -> Column:
    """A malformed value becomes null."""
    return nan_to_null(value.try_cast("double"))


def day_from_text(value: Column, strict: bool = True) -> Column:
    parse = F.to_date if strict else F.try_to_date
    return parse(value, DAY_FORMAT)
