from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import compact_day
from barloom.operators import calendar
from tests.frames import price_row, prices


def test_sequence(spark):
    days = [r.date for r in calendar.day_sequence(spark, date(2024, 2, 27), date(2024, 3, 1)).collect()]
    assert days == [date(2024, 2, 27) + timedelta(days=n) for n in range(4)]
    with pytest.raises(ValueError):
        calendar.day_sequence(spark, date(2024, 1, 2), date(2024, 1, 1))


def test_weekday_moves_match_a_loop(spark):
    days = calendar.day_sequence(spark, date(2023, 12, 25), date(2024, 1, 31))
    for row in calendar.with_weekdays(days).collect():
        ahead = back = row.date
        while ahead.weekday() >= 5:
            ahead += timedelta(days=1)
        while back.weekday() >= 5:
            back -= timedelta(days=1)
        assert (row.next_weekday, row.previous_weekday) == (ahead, back)


def test_windows(spark):
    stored = spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 1, 2),)], "date date")
    today = date(2024, 6, 1)
    assert tuple(calendar.default_window(stored, today).first()) == (
        date(2024, 1, 8),
        date(2024, 1, 22),
    )
    first = calendar.default_window(stored.limit(0), today).first()
    assert tuple(first) == (date(2023, 6, 2), date(2023, 6, 16))
    given = calendar.resolve_window(stored, today, start=date(2024, 3, 1)).first()
    assert tuple(given) == (date(2024, 3, 1), date(2024, 3, 15))
    ended = calendar.resolve_window(stored, today, end=date(2024, 3, 1)).first()
    assert tuple(ended) == (date(2024, 1, 8), date(2024, 3, 1))
    assert tuple(calendar.stored_window(stored).first()) == (date(2024, 1, 2), date(2024, 1, 5))
    assert calendar.sample_day(spark, date(2024, 6, 1)).first().date == date(2024, 3, 8)


def test_missing_days(spark):
    rows = prices(spark, [price_row("1", date(2024, 1, d)) for d in (2, 3, 9)])
    open_days = calendar.day_sequence(spark, date(2024, 1, 1), date(2024, 1, 31)).where(
        F.weekday("date") < 5
    )
    missing = sorted(r.date.day for r in calendar.missing_days(rows, open_days).collect())
    assert missing == [4, 5, 8]


def test_compact_day(spark):
    day = spark.createDataFrame([(date(2024, 1, 5),)], "date date")
    assert day.select(compact_day(F.col("date"))).first()[0] == "20240105"
