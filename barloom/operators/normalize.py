"""Raw provider quotes to the fixed price schema (NORM, PRJ1-PRJ7)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import (
    day_from_text,
    filled_adj_close,
    lenient_double,
    nan_to_null,
    strict_double,
)
from barloom.schemas import PRICE_COLUMNS

BAD_VALUE = "_bad_value"

# Provider name of every strictly typed price field.
_PRICE_FIELDS = {"Open": "open", "High": "high", "Low": "low", "Close": "close"}


def normalize_quotes(
    raw: DataFrame,
    processed_at: str,
    on_bad_value: Literal["fail", "flag"] = "fail",
    keep: Sequence[str] = (),
    keep_incomplete: Column | None = None,
) -> DataFrame:
    """Rename, type, filter and fill one or many days of raw quotes.

    ``fail`` casts strictly, so one malformed price ends the job. ``flag`` keeps
    malformed rows and marks them in ``_bad_value``, so that a later step can
    reject only their days, and so do rows that meet ``keep_incomplete``. ``keep``
    names further columns to carry along. Rows keep no particular order.
    """
    strict = on_bad_value == "fail"
    price = strict_double if strict else lenient_double
    volume = F.col("Volume").cast("long") if strict else F.col("Volume").try_cast("long")
    columns = [
        F.col("Code").alias("code"),
        day_from_text(F.col("Date"), strict).alias("date"),
        *(price(F.col(source)).alias(name) for source, name in _PRICE_FIELDS.items()),
        volume.alias("volume"),
        lenient_double(F.col("TurnoverValue")).alias("turnover_value"),
        lenient_double(F.col("AdjustmentFactor")).alias("adjustment_factor"),
        lenient_double(F.col("AdjustmentClose")).alias("adj_close"),
        F.lit(processed_at).alias("processed_at"),
    ]
    complete = (
        F.col("code").isNotNull() & F.col("date").isNotNull() & F.col("close").isNotNull()
    )
    if strict:
        typed = raw.select(*columns, *keep).where(complete)
        return fill_adj_close(typed).select(*PRICE_COLUMNS, *keep)
    flagged = raw.select(*columns, _has_bad_value().alias(BAD_VALUE), *keep)
    stays = F.lit(False) if keep_incomplete is None else keep_incomplete
    typed = flagged.where(complete | F.col(BAD_VALUE) | stays)
    return fill_adj_close(typed).select(*PRICE_COLUMNS, BAD_VALUE, *keep)


def _has_bad_value() -> Column:
    checks = [("Date", lambda c: day_from_text(c, strict=False))]
    checks += [(name, lambda c: c.try_cast("double")) for name in _PRICE_FIELDS]
    checks += [("Volume", lambda c: c.try_cast("long"))]
    return reduce(
        or_, (F.col(name).isNotNull() & parse(F.col(name)).isNull() for name, parse in checks)
    )


def fill_adj_close(prices: DataFrame) -> DataFrame:
    """Fill a missing adjusted close from the close and the day's factor (PRJ6)."""
    return prices.withColumn(
        "adj_close",
        filled_adj_close(
            nan_to_null(F.col("adj_close")), F.col("close"), F.col("adjustment_factor")
        ),
    )
