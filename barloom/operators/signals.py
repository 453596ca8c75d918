"""Universe, point-in-time data, composite signals and factor evaluation."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.crosssection import with_rank, with_ranks, zscores

SCORE_DIGITS = 9
TILES = 10


def universe(
    prices: DataFrame, as_of: date, min_close: float, min_volume: float, min_age_days: int
) -> DataFrame:
    """Securities that trade high and often enough and are not recent listings."""
    per_code = (
        prices.where(F.col("date") <= F.lit(as_of))
        .groupBy("code")
        .agg(
            F.min("date").alias("first_date"),
            F.avg("close").alias("avg_close"),
            F.avg("volume").alias("avg_volume"),
        )
    )
    return per_code.where(
        (F.col("avg_close") >= min_close)
        & (F.col("avg_volume") >= min_volume)
        & (F.date_diff(F.lit(as_of), F.col("first_date")) >= min_age_days)
    )


def point_in_time(
    prices: DataFrame, statements: DataFrame, disclosed: str = "disclosed_date"
) -> DataFrame:
    """Attach to every bar the latest statement disclosed on or before its day.

    Both frames are stacked per security and the last statement is carried along
    the days, so it is one shuffle and no range join. A statement without a
    disclosure date is known on no day and left out. A fact named like a price
    column is refused.
    """
    facts = [name for name in statements.columns if name not in ("code", disclosed)]
    clashing = sorted({disclosed, *facts} & set(prices.columns))
    if clashing:
        raise ValueError(f"statements and prices both have {clashing}")
    statements = statements.where(F.col(disclosed).isNotNull())
    known = F.struct(F.col(disclosed), *facts)
    bars = prices.withColumns({"_known": F.lit(None).cast(_type_of(statements, known)), "_bar": F.lit(1)})
    news = statements.select(
        "code", F.col(disclosed).alias("date"), known.alias("_known"), F.lit(0).alias("_bar")
    )
    stacked = bars.unionByName(news, allowMissingColumns=True)
    so_far = (
        Window.partitionBy("code")
        .orderBy("date", "_bar", "_known")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        stacked.withColumn("_latest", F.last("_known", ignorenulls=True).over(so_far))
        .where("_bar = 1")
        .select(*prices.columns, *(F.col(f"_latest.{name}") for name in (disclosed, *facts)))
    )


def _type_of(rows: DataFrame, column: Column) -> T.DataType:
    return rows.select(column.alias("x")).schema["x"].dataType


def composite_score(rows: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum of daily standard scores.

    A factor missing on a day counts as average. Scores are rounded, so that
    summation order cannot break or make ties.
    """
    terms = [F.coalesce(F.col(f"z_{f}"), F.lit(0.0)) * w for f, w in weights.items()]
    score = F.round(reduce(add, terms), SCORE_DIGITS) + F.lit(0.0)
    return zscores(rows, list(weights), ["date"]).select(*rows.columns, score.alias("score"))


def composite_signals(scored: DataFrame, tiles: int = TILES) -> DataFrame:
    """Rank of the score within its day, best first, and its tile."""
    return with_rank(scored, "score", descending=True, tiles=tiles)


def rank_ic(rows: DataFrame, factor: str, outcome: str) -> DataFrame:
    """Per day, the correlation of the ranks of a factor and of the outcome."""
    both = rows.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    pairs = both.select("date", factor, outcome)
    ranked = with_ranks(pairs, {factor: "_f", outcome: "_o"})
    per_day = ranked.groupBy("date").agg(
        F.count(F.lit(1)).alias("codes"),
        F.corr("_f", "_o").alias("ic"),
        F.stddev_pop("_f").alias("_fs"),
        F.stddev_pop("_o").alias("_os"),
    )
    usable = (F.col("codes") >= 3) & (F.col("_fs") > 0) & (F.col("_os") > 0)
    return per_day.select("date", "codes", F.when(usable, F.col("ic")).alias("rank_ic"))


def tile_returns(rows: DataFrame, factor: str, outcome: str, tiles: int = TILES) -> DataFrame:
    """Mean outcome of each tile of a factor over all days."""
    both = rows.where(F.col(factor).isNotNull() & F.col(outcome).isNotNull())
    return (
        with_rank(both.select("date", factor, outcome), factor, tiles=tiles)
        .groupBy("decile")
        .agg(F.count(F.lit(1)).alias("bars"), F.avg(outcome).alias("avg_return"))
    )
