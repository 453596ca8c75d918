"""Corporate actions and checks of delivered adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.adjust import MULTIPLIER, cumulative_adjustment, latest_first

# What counts as an action, a split, and an unexplained move.
ACTION_THRESHOLD = 0.01
SPLIT_BELOW = 0.9
GAP_THRESHOLD = 0.3


def corporate_actions(prices: DataFrame, threshold: float = ACTION_THRESHOLD) -> DataFrame:
    """Factor changes above the threshold with a type guessed from their size."""
    factor = F.coalesce(F.col("adjustment_factor"), F.lit(1.0))
    kind = F.when(factor < SPLIT_BELOW, "split").when(factor < 1, "dividend").otherwise("other")
    return prices.where(F.abs(factor - 1) > threshold).select(
        "code", "date", factor.alias("adjustment_factor"), kind.alias("action_type")
    )


def suspicious_gaps(prices: DataFrame, threshold: float = GAP_THRESHOLD) -> DataFrame:
    """Moves between neighbouring bars above the threshold on days without a factor."""
    slim = prices.select("code", "date", "close", "adjustment_factor")
    moved = slim.withColumn("previous_close", F.lead("close").over(latest_first())).withColumn(
        "change", F.col("close") / F.nullif(F.col("previous_close"), F.lit(0.0)) - 1
    )
    unexplained = F.coalesce(F.col("adjustment_factor"), F.lit(1.0)) == 1.0
    return moved.where(unexplained & (F.abs("change") > threshold)).select(
        "code", "date", "previous_close", "close", "change"
    )


def adjustment_check(prices: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per security, how often the delivered adjusted close disagrees with the factors."""
    slim = prices.select("code", "date", "close", "adjustment_factor", "adj_close")
    expected = F.col("close") * F.col(MULTIPLIER)
    gap = F.abs(F.col("adj_close") - expected)
    compared = cumulative_adjustment(slim).select("code", gap.alias("gap"), expected.alias("expected"))
    off = F.col("gap") > F.abs("expected") * tolerance
    return compared.groupBy("code").agg(
        F.count("gap").alias("compared"),
        F.count_if(off).alias("mismatches"),
        F.max("gap").alias("largest_gap"),
    )
