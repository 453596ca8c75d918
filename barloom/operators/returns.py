"""Returns, features and return-series metrics on adjusted prices.

Windows here follow one security through time; see ``adjust`` for why such a
group is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.adjust import (
    MULTIPLIER,
    cumulative_adjustment,
    earliest_first,
    latest_first,
)

# Return horizons, momentum and volatility windows in trading days.
HORIZONS = (1, 5, 21, 63)
MOMENTUM_DAYS = 63
VOLATILITY_DAYS = 20
TRADING_DAYS_PER_YEAR = 252

# The group of securities that no listing names.
UNLISTED = "unlisted"


def adjusted_closes(prices: DataFrame) -> DataFrame:
    """``code, date, close`` with the close adjusted to the latest scale."""
    slim = prices.select("code", "date", "close", "adjustment_factor")
    return cumulative_adjustment(slim).select(
        "code", "date", (F.col("close") * F.col(MULTIPLIER)).alias("close")
    )


def multi_period_returns(
    prices: DataFrame, horizons: Sequence[int] = HORIZONS, extra: Sequence[str] = ()
) -> DataFrame:
    """Simple returns over n trading days of the security itself, ``ret_<n>``.

    The latest-first order of the adjustment is kept, so earlier days are read
    with ``lead`` and no second sort is needed.
    """
    closes = adjusted_closes(prices)
    returns = {
        f"ret_{n}": F.col("close")
        / F.nullif(F.lead("close", n).over(latest_first()), F.lit(0.0))
        - 1
        for n in horizons
    }
    return closes.withColumns(returns)


def with_forward_return(returns: DataFrame, name: str = "ret_1") -> DataFrame:
    """Add the return of the next trading day of the same security."""
    return returns.withColumn("forward_return", F.lag(name, 1).over(latest_first()))


def features(prices: DataFrame) -> DataFrame:
    """Three-month momentum and twenty-day volatility per bar."""
    returns = multi_period_returns(prices, (1, MOMENTUM_DAYS))
    recent = latest_first().rowsBetween(0, VOLATILITY_DAYS - 1)
    enough = F.count("ret_1").over(recent) == VOLATILITY_DAYS
    return returns.select(
        "code",
        "date",
        "close",
        "ret_1",
        F.col(f"ret_{MOMENTUM_DAYS}").alias("mom_3m"),
        F.when(enough, F.stddev_samp("ret_1").over(recent)).alias("vol_20d"),
    )


def forward_fill(
    rows: DataFrame, columns: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Replace nulls by the last earlier value of the security, at most ``limit`` rows back."""
    start = Window.unboundedPreceding if limit is None else -limit
    so_far = earliest_first().rowsBetween(start, 0)
    return rows.withColumns(
        {name: F.last(name, ignorenulls=True).over(so_far) for name in columns}
    )


def security_vs_group(returns: DataFrame, groups: DataFrame, value: str = "ret_1") -> DataFrame:
    """Correlation of every security with the mean of its group.

    ``groups`` maps ``code`` to ``peer_group``; securities without one are the
    group ``UNLISTED``. The group mean is one row per group and day, so the work
    grows with the bars and never with pairs of securities.
    """
    known = returns.where(F.col(value).isNotNull()).join(groups, "code", "left")
    known = known.withColumn("peer_group", F.coalesce("peer_group", F.lit(UNLISTED)))
    means = known.groupBy("peer_group", "date").agg(F.avg(value).alias("peer_mean"))
    return _correlate(known.join(means, ["peer_group", "date"]), ["code"], value, "peer_mean")


def pair_correlation(returns: DataFrame, pairs: DataFrame, value: str = "ret_1") -> DataFrame:
    """Correlation of the given pairs over their common days.

    ``pairs`` has ``code_a`` and ``code_b``; only asked pairs are joined.
    """
    known = returns.where(F.col(value).isNotNull()).select("code", "date", value)
    left = known.withColumnsRenamed({"code": "code_a", value: "value_a"})
    right = known.withColumnsRenamed({"code": "code_b", value: "value_b"})
    both = pairs.join(left, "code_a").join(right, ["code_b", "date"])
    return _correlate(both, ["code_a", "code_b"], "value_a", "value_b")


def _correlate(rows: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """Pearson correlation per group; null for fewer than three days or without spread."""
    measured = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"),
        F.corr(left, right).alias("corr"),
        F.stddev_pop(left).alias("_left"),
        F.stddev_pop(right).alias("_right"),
    )
    usable = (F.col("days") >= 3) & (F.col("_left") > 0) & (F.col("_right") > 0)
    return measured.select(*by, "days", F.when(usable, F.col("corr")).alias("correlation"))


def performance_metrics(closes: DataFrame) -> DataFrame:
    """Growth, risk and drawdown of every series of adjusted closes.

    A zero close has no return after it, no drawdown before a positive one, and
    no growth when it is the first.
    """
    peak = earliest_first().rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0.0)
    steps = closes.select(
        "code",
        "date",
        "close",
        (F.col("close") / F.nullif(F.lag("close").over(earliest_first()), zero) - 1).alias("ret"),
        (F.col("close") / F.nullif(F.max("close").over(peak), zero) - 1).alias("drawdown"),
    )
    sums = steps.groupBy("code").agg(
        F.count("ret").alias("periods"),
        F.min_by("close", "date").alias("_first"),
        F.max_by("close", "date").alias("_last"),
        F.avg("ret").alias("_mean"),
        F.stddev_samp("ret").alias("_spread"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"),
    )
    year = float(TRADING_DAYS_PER_YEAR)
    growth = F.pow(F.col("_last") / F.nullif("_first", zero), F.lit(year) / F.col("periods")) - 1
    spread = F.col("_spread") * F.sqrt(F.lit(year))
    return (
        sums.where("periods > 0")
        .withColumn("cagr", growth)
        .withColumn("volatility", spread)
        .withColumn("sharpe", F.when(spread > 0, F.col("_mean") * year / spread))
        .withColumn(
            "calmar", F.when(F.col("max_drawdown") < 0, growth / -F.col("max_drawdown"))
        )
        .select(
            "code",
            "periods",
            "cagr",
            "volatility",
            "sharpe",
            "max_drawdown",
            "calmar",
            "hit_rate",
        )
    )
