from __future__ import annotations

import pytest

from barloom.operators.normalize import BAD_VALUE
from barloom.operators.quality import (
    ohlc_violations,
    quality_report,
    require_valid_day,
    split_by_quality,
)
from tests.frames import BARS, D15, D16, D17

GOOD = ("1301", D15, 101.0, 105.0, 98.0, 102.0, 1000)


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), BARS)


@pytest.mark.parametrize(
    ("row", "message"),
    [
        ((None, D15, 101.0, 105.0, 98.0, 102.0, 1), "Found 1 null codes"),
        (("1", D15, 101.0, 105.0, 98.0, None, 1), "Found 1 null close"),
        (("1", D15, -10.0, 105.0, -10.0, -10.0, 1), "non-positive close"),
        (("1", D15, 100.0, 95.0, 98.0, 102.0, 1), "invalid OHLC"),
    ],
)
def test_invalid_days_are_refused(spark, row, message):
    with pytest.raises(ValueError, match=message):
        require_valid_day(bars(spark, GOOD, row))


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Missing required columns.*open"):
        require_valid_day(bars(spark, GOOD).select("code", "date"))


def test_high_close_only_warns(spark):
    rows = bars(spark, ("1", D15, 1500000.0, 1500000.0, 1500000.0, 1500000.0, 1))
    require_valid_day(rows)
    report = quality_report(rows).first()
    assert report.valid and report.high_close


def test_null_prices_do_not_break_a_bar(spark):
    rows = bars(spark, ("1", D15, None, None, 98.0, 102.0, 1), ("2", D15, None, 90.0, 98.0, 80.0, 1))
    assert [r.code for r in ohlc_violations(rows).collect()] == ["2"]


def test_report_names_empty_days_and_splits_rows(spark):
    rows = bars(spark, GOOD, ("2", D16, 100.0, 95.0, 98.0, 102.0, 1))
    days = spark.createDataFrame([(D15,), (D16,), (D17,)], "date date")
    report = quality_report(rows, expected_days=days)
    reasons = {r.date: r.reason for r in report.collect()}
    assert reasons == {D15: None, D16: "broken_bar", D17: "empty"}
    accepted, rejected = split_by_quality(rows, report)
    assert [r.code for r in accepted.collect()] == ["1301"]
    assert [(r.code, r.reason) for r in rejected.collect()] == [("2", "broken_bar")]


def test_flagged_values_reject_their_day(spark):
    from pyspark.sql import functions as F

    rows = bars(spark, GOOD).withColumn(BAD_VALUE, F.lit(True))
    assert quality_report(rows).first().reason == "bad_value"
