"""Expressions over the columns of a price bar."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.schemas import FACTOR_TOLERANCE


def filled_adj_close(adj_close: Column, close: Column, factor: Column) -> Column:
    """The delivered adjusted close, else the close scaled by the day's own factor (PRJ6)."""
    return F.coalesce(adj_close, close * F.coalesce(factor, F.lit(1.0)))


def broken_bar() -> Column:
    """True where the four prices contradict each other; null prices never do (PRJ17)."""
    high, low = F.col("high"), F.col("low")
    too_low = (high < low) | (high < F.col("open")) | (high < F.col("close"))
    too_high = (low > F.col("open")) | (low > F.col("close"))
    return F.coalesce(too_low | too_high, F.lit(False))


def is_adjustment_event(factor: Column, tolerance: float = FACTOR_TOLERANCE) -> Column:
    """True where the factor differs from one by more than the tolerance (PRJ16)."""
    return F.abs(F.coalesce(factor.cast("double"), F.lit(1.0)) - 1.0) > tolerance


def inverse_multiplier(multiplier: Column) -> Column:
    """Share counts scale against prices; a zero multiplier leaves them alone (WIN3)."""
    return F.when(multiplier == 0, F.lit(1.0)).otherwise(F.lit(1.0) / multiplier)
