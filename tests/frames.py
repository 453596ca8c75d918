"""Small frames with known answers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from barloom.schemas import DAILY_PRICES

D15, D16, D17 = date(2024, 1, 15), date(2024, 1, 16), date(2024, 1, 17)

RAW = (
    "Code string, Date string, Open double, High double, Low double, Close double, "
    "Volume long, TurnoverValue double, AdjustmentFactor double, AdjustmentClose double"
)
# Two raw quotes of one day.
RAW_ROWS = [
    ("1301", "2024-01-15", 101.0, 105.0, 98.0, 102.0, 100000, 10200000.0, 1.0, 102.0),
    ("1332", "2024-01-15", 201.0, 210.0, 198.0, 205.0, 50000, 10250000.0, 1.1, 225.5),
]
BARS = (
    "code string, date date, open double, high double, low double, close double, volume long"
)
SPLIT = (
    "code string, date date, open double, high double, low double, close double, "
    "volume double, turnover_value double, adjustment_factor double, processed_at string"
)
# A security before and after a split of one into three.
SPLIT_ROWS = [
    ("13010", D15, 300.0, 330.0, 290.0, 315.0, 900.0, 283500.0, 1.0, "t"),
    ("13010", D16, 110.0, 120.0, 105.0, 115.0, 2700.0, 310500.0, 1 / 3, "t"),
]


def raw_quotes(spark: SparkSession, rows=RAW_ROWS) -> DataFrame:
    return spark.createDataFrame(rows, RAW)


def split_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPLIT_ROWS, SPLIT)


def price_row(code, day, close=100.0, factor=1.0, processed_at="t1", volume=1000):
    return (
        code,
        day,
        close,
        close + 5,
        close - 5,
        close,
        volume,
        close * volume,
        factor,
        close * factor,
        processed_at,
    )


def prices(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, DAILY_PRICES)


def two_by_two(spark: SparkSession) -> DataFrame:
    return prices(
        spark, [price_row(code, day) for code in ("1301", "1332") for day in (D15, D16)]
    )


def listing(spark: SparkSession) -> DataFrame:
    names = (
        "Code CompanyName CompanyNameEnglish Sector17Code Sector33Code MarketCode".split()
    )
    rows = [
        ("13010", "Kyokuyo Co., Ltd.", "Kyokuyo Co., Ltd.", "1", "0050", "0111"),
        ("99990", "Sample Holdings", "Sample (Holdings)", "2", "3050", "0112"),
    ]
    return spark.createDataFrame(rows, ", ".join(f"{name} string" for name in names))
