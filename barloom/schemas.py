"""Declared schemas and fixed values of the data model.

Security codes are strings everywhere: reading them by inference would turn
``'01301'`` into an integer.
"""

from pyspark.sql import types as T

# Column names of the normalised table, in storage order.
DAILY_PRICES = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
        T.StructField("turnover_value", T.DoubleType()),
        T.StructField("adjustment_factor", T.DoubleType()),
        T.StructField("adj_close", T.DoubleType()),
        T.StructField("processed_at", T.StringType()),
    ]
)
PRICE_COLUMNS = DAILY_PRICES.fieldNames()

# Provider column names of a raw daily quote that normalisation reads.
RAW_QUOTES = T.StructType(
    [
        T.StructField("Code", T.StringType()),
        T.StructField("Date", T.StringType()),
        T.StructField("Open", T.DoubleType()),
        T.StructField("High", T.DoubleType()),
        T.StructField("Low", T.DoubleType()),
        T.StructField("Close", T.DoubleType()),
        T.StructField("Volume", T.LongType()),
        T.StructField("TurnoverValue", T.StringType()),
        T.StructField("AdjustmentFactor", T.StringType()),
        T.StructField("AdjustmentClose", T.StringType()),
    ]
)

# Provider column names of the listing snapshot.
LISTED_INFO = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "Code",
            "CompanyName",
            "CompanyNameEnglish",
            "Sector17Code",
            "Sector17CodeName",
            "Sector33Code",
            "Sector33CodeName",
            "MarketCode",
            "MarketCodeName",
        )
    ]
)

# Provider column names of the trading calendar.
TRADING_CALENDAR = T.StructType(
    [T.StructField("Date", T.StringType()), T.StructField("HolidayDivision", T.StringType())]
)

# Endpoint and table names used as dataset directories.
DAILY_QUOTES_ENDPOINT = "daily_quotes"
LISTED_INFO_ENDPOINT = "listed_info"
DAILY_PRICES_TABLE = "daily_prices"

# Columns a day must have before it can be validated.
REQUIRED_PRICE_COLUMNS = ["code", "date", "open", "high", "low", "close", "volume"]

# Thresholds.
FACTOR_TOLERANCE = 1e-9
HIGH_CLOSE_WARNING = 1_000_000.0
