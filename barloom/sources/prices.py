"""Scans of the normalised and the security-major price datasets (SRC8, SRC9)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.history import in_days, keyed_columns, of_codes
from barloom.schemas import DAILY_PRICES, PRICE_COLUMNS
from barloom.sources.raw import PARTITION, read_or_empty

YEAR, BUCKET = "year", "bucket"
_BY_DAY = T.StructType([*DAILY_PRICES.fields, T.StructField(PARTITION, T.StringType())])
_BY_SECURITY = T.StructType(
    [
        *DAILY_PRICES.fields,
        T.StructField(YEAR, T.IntegerType()),
        T.StructField(BUCKET, T.IntegerType()),
    ]
)


def bucket_of(code: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(code), F.lit(buckets)).cast("int")


def read_daily_prices(
    spark: SparkSession,
    path: str,
    start: date | None = None,
    end: date | None = None,
    codes: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Normalised prices of an inclusive range (SRC8).

    The range selects the landing days to read, and then the rows by their own
    date. Rows come unsorted: order them where they are consumed.
    """
    prices = read_or_empty(spark, path, _BY_DAY)
    if start is not None:
        prices = prices.where(F.col(PARTITION) >= start.isoformat())
    if end is not None:
        prices = prices.where(F.col(PARTITION) <= end.isoformat())
    return of_codes(in_days(prices.select(*PRICE_COLUMNS), start, end), codes)


def read_by_security(spark: SparkSession, path: str) -> DataFrame:
    """The whole security-major dataset with its layout columns."""
    return read_or_empty(spark, path, _BY_SECURITY)


def read_security_prices(
    spark: SparkSession,
    path: str,
    buckets: int,
    codes: str | Sequence[str],
    start: date | None = None,
    end: date | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Prices of one or a few securities (SRC9).

    The codes' buckets and the years of the range are known before the scan, so
    only those directories are read; inside a file rows are sorted by code, so
    row groups without the code are skipped too.
    """
    wanted = [codes] if isinstance(codes, str) else list(codes)
    rows = read_by_security(spark, path)
    same_bucket = F.array_contains(
        F.array(*(bucket_of(F.lit(code), buckets) for code in wanted)), F.col(BUCKET)
    )
    rows = in_days(rows.where(same_bucket & F.col("code").isin(wanted)), start, end)
    if start is not None:
        rows = rows.where(F.col(YEAR) >= start.year)
    if end is not None:
        rows = rows.where(F.col(YEAR) <= end.year)
    return keyed_columns(rows.select(*PRICE_COLUMNS), columns)
