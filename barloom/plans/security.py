"""One security of a lake: its listing row, histories and series."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import cached_property
from typing import Literal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from barloom.operators.adjust import adjustment_events
from barloom.operators.history import latest_price, price_history, price_series
from barloom.operators.listing import (
    ATTRIBUTES,
    listing_row,
    resolve_codes,
    search_listing,
)
from barloom.plans.lake import PriceLake
from barloom.schemas import FACTOR_TOLERANCE

Day = date | None


def search_securities(
    lake: PriceLake, field: str, value: str, match: Literal["exact", "icontains"] = "exact"
) -> DataFrame:
    """Matching rows of the latest listing; many securities stay one frame."""
    listing = lake.listing()
    return listing if not listing.columns else search_listing(listing, field, value, match)


class Security:
    """A code resolved against the lake. Results are lazy frames of this code only."""

    def __init__(self, code: str, lake: PriceLake) -> None:
        self.lake = lake
        self.code = self._resolve(str(code))

    def _resolve(self, code: str) -> str:
        cleaned = code.strip()
        numeric = cleaned.isascii() and cleaned.isdigit()
        if numeric and len(cleaned) == 5:
            return cleaned
        if not numeric or len(cleaned) != 4:
            reason = "not 4 or 5 digits" if numeric else "not numeric"
            raise ValueError(f"Security code {code!r} is {reason}")
        spark = self.lake.spark
        listing = self.lake.listing()
        if "Code" not in listing.columns:
            listing = spark.createDataFrame([], "Code string")
        asked = spark.createDataFrame([(code,)], "request string")
        # The prefix is pushed to the scan: other securities' row groups are skipped.
        stored = self.lake.all_prices().where(F.col("code").startswith(cleaned))
        return resolve_codes(asked, listing, stored).first().code

    @property
    def base_code(self) -> str:
        return self.code[:4]

    @cached_property
    def listing(self) -> Row:
        return listing_row(self.lake.listing(), self.code)

    def __getattr__(self, name: str) -> str | None:
        if name in ATTRIBUTES:
            return self.listing.asDict().get(ATTRIBUTES[name])
        raise AttributeError(name)

    def history(
        self,
        start: Day = None,
        end: Day = None,
        columns: Sequence[str] | None = None,
        adjust: Literal["none", "add", "replace"] = "none",
        volume: bool = True,
        turnover: bool = False,
    ) -> DataFrame:
        prices = self.lake.security_prices(self.code, start, end)
        return price_history(
            prices, columns=columns, adjust=adjust, volume=volume, turnover=turnover
        )

    def series(
        self, field: str, start: Day = None, end: Day = None, adjusted: bool | None = None
    ) -> DataFrame:
        return price_series(self.history(start, end), field, adjusted)

    def events(
        self, start: Day = None, end: Day = None, tolerance: float = FACTOR_TOLERANCE
    ) -> DataFrame:
        return adjustment_events(self.history(start, end), tolerance)

    def latest(
        self, columns: Sequence[str] | None = None, adjusted: bool = True
    ) -> dict[str, object] | None:
        row = latest_price(self.history(), columns, adjusted).first()
        return None if row is None else row.asDict()

    def __repr__(self) -> str:
        return f"Security({self.code!r})"
