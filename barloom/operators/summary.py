"""Aggregates over normalised prices (AGG1-AGG6, AGG8, D3, D6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(prices: DataFrame, day: str = "date") -> DataFrame:
    """Rows per day (AGG1)."""
    return prices.groupBy(day).agg(F.count(F.lit(1)).alias("record_count"))


def quality_stats(prices: DataFrame) -> DataFrame:
    """Null counts, close range and total volume of the frame (AGG2)."""
    return prices.agg(
        F.count_if(F.col("close").isNull()).alias("null_closes"),
        F.count_if(F.col("volume").isNull()).alias("null_volumes"),
        F.min("close").alias("min_close"),
        F.max("close").alias("max_close"),
        F.sum("volume").alias("total_volume"),
    )


def top_by_avg_close(prices: DataFrame, n: int = 10) -> DataFrame:
    """The n securities with the highest mean close (AGG3, SRT2); the code breaks ties."""
    per_code = prices.groupBy("code").agg(
        F.avg("close").alias("avg_close"),
        F.avg("volume").alias("avg_volume"),
        F.count(F.lit(1)).alias("trading_days"),
    )
    return per_code.orderBy(F.desc("avg_close"), "code").limit(n)


def period_return(prices: DataFrame) -> DataFrame:
    """First and last close of every security by date, and the change in percent (AGG4)."""
    ends = prices.groupBy("code").agg(
        F.min_by("close", "date").alias("first_close"),
        F.max_by("close", "date").alias("last_close"),
    )
    change = (F.col("last_close") - F.col("first_close")) / F.nullif(
        F.col("first_close"), F.lit(0.0)
    )
    return ends.withColumn("return_pct", change * 100)


def market_summary(prices: DataFrame) -> DataFrame:
    """One row over the whole frame (AGG5, AGG6).

    ``code_rows`` counts rows with a code; ``distinct_codes`` counts securities.
    """
    return prices.agg(
        F.count("code").alias("code_rows"),
        F.count_distinct("code").alias("distinct_codes"),
        F.avg("close").alias("avg_close_price"),
        F.sum("volume").alias("total_volume"),
        F.max("close").alias("highest_price"),
        F.min("close").alias("lowest_price"),
    )


def distinct_codes(prices: DataFrame) -> DataFrame:
    return prices.select("code").distinct()


def distinct_days(prices: DataFrame) -> DataFrame:
    return prices.select("date").distinct()


def price_summary(prices: DataFrame) -> DataFrame:
    """Count, range, mean and sample deviation of the close per security (D3)."""
    return prices.groupBy("code").agg(
        F.count("close").alias("observations"),
        F.min("close").alias("min_close"),
        F.max("close").alias("max_close"),
        F.avg("close").alias("avg_close"),
        F.stddev_samp("close").alias("std_close"),
        F.avg("volume").alias("avg_volume"),
    )


def market_coverage(prices: DataFrame) -> DataFrame:
    """Securities seen per day, against all securities of the frame.

    One pass groups by day and as a whole. The window then sees one row a day.
    """
    counted = prices.rollup("date").agg(
        F.count_distinct("code").alias("codes"), F.grouping("date").alias("_whole")
    )
    total = F.max(F.when(F.col("_whole") == 1, F.col("codes"))).over(Window.partitionBy(F.lit(0)))
    return (
        counted.withColumn("all_codes", total)
        .where(F.col("_whole") == 0)
        .select("date", "codes", "all_codes", (F.col("codes") / F.col("all_codes")).alias("coverage"))
    )
