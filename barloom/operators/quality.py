"""Data-quality report, validation and quarantine by day (DQ1, DQ2, PRJ17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import broken_bar
from barloom.operators.normalize import BAD_VALUE
from barloom.schemas import HIGH_CLOSE_WARNING, REQUIRED_PRICE_COLUMNS

# Marks rows of a file that lacks columns normalisation reads.
SCHEMA_GAP = "_schema_gap"


def ohlc_violations(prices: DataFrame) -> DataFrame:
    """Bars whose four prices contradict each other."""
    return prices.where(broken_bar())


def quality_report(
    prices: DataFrame, day: str = "date", expected_days: DataFrame | None = None
) -> DataFrame:
    """One row of counts per day with a ``valid`` flag and the first ``reason`` against it.

    ``expected_days`` adds days that lost every row on the way; they are reported
    as ``empty``. Where ``day`` is the day rows were landed under, rows of another
    date are counted too. Counting is one aggregate with map-side partials, so the
    size of a day does not matter.
    """
    require_columns(prices)
    more = {}
    if SCHEMA_GAP in prices.columns:
        more["schema_gaps"] = F.count_if(SCHEMA_GAP)
    if day != "date":
        more["misdated_rows"] = F.count_if(F.col("date") != F.to_date(day))
    bad = F.col(BAD_VALUE) if BAD_VALUE in prices.columns else F.lit(False)
    report = prices.groupBy(day).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("code").isNull()).alias("null_codes"),
        F.count_if(F.col("close").isNull()).alias("null_closes"),
        F.min("close").alias("min_close"),
        F.max("close").alias("max_close"),
        F.count_if(broken_bar()).alias("broken_bars"),
        F.count_if(bad).alias("bad_values"),
        *(count.alias(name) for name, count in more.items()),
    )
    if expected_days is not None:
        report = expected_days.select(day).distinct().join(report, day, "left")
        counts = ["rows", "null_codes", "null_closes", "broken_bars", "bad_values", *more]
        report = report.fillna(0, subset=counts)
    reason = F.when(F.col("rows") == 0, "empty")
    if "schema_gaps" in more:
        reason = reason.when(F.col("schema_gaps") > 0, "schema")
    reason = (
        reason.when(F.col("bad_values") > 0, "bad_value")
        .when(F.col("null_codes") > 0, "null_code")
        .when(F.col("null_closes") > 0, "null_close")
        .when(F.col("min_close") <= 0, "non_positive_close")
        .when(F.col("broken_bars") > 0, "broken_bar")
    )
    if "misdated_rows" in more:
        reason = reason.when(F.col("misdated_rows") > 0, "misdated_rows")
    return (
        report.withColumn(
            "high_close", F.coalesce(F.col("max_close") > HIGH_CLOSE_WARNING, F.lit(False))
        )
        .withColumn("reason", reason)
        .withColumn("valid", F.col("reason").isNull())
    )


def split_by_quality(
    prices: DataFrame, report: DataFrame, day: str = "date"
) -> tuple[DataFrame, DataFrame]:
    """Rows of valid days, and rows of rejected days with the reason attached."""
    verdict = report.select(day, "valid", "reason")
    accepted = prices.join(verdict.where("valid"), day, "left_semi")
    rejected = prices.join(verdict.where(~F.col("valid")).select(day, "reason"), day)
    return accepted, rejected


def require_columns(prices: DataFrame) -> None:
    missing = [name for name in REQUIRED_PRICE_COLUMNS if name not in prices.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def require_valid_day(prices: DataFrame) -> None:
    """Raise ``ValueError`` when any day of the frame fails validation."""
    failed = quality_report(prices).where(~F.col("valid")).limit(1).collect()
    if not failed:
        return
    row = failed[0]
    messages = {
        "bad_value": f"Found {row.bad_values} malformed values",
        "null_code": f"Found {row.null_codes} null codes",
        "null_close": f"Found {row.null_closes} null closes",
        "non_positive_close": f"Found a non-positive close: {row.min_close}",
        "broken_bar": f"Found {row.broken_bars} bars with invalid OHLC",
        "empty": "Found no rows",
    }
    raise ValueError(messages[row.reason])
