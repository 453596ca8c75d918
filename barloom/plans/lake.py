"""The layered dataset: raw partitions, normalised prices, security-major prices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from barloom.operators.history import in_days
from barloom.operators.merge import pending_days
from barloom.schemas import (
    DAILY_PRICES_TABLE,
    DAILY_QUOTES_ENDPOINT,
    LISTED_INFO_ENDPOINT,
    PRICE_COLUMNS,
)
from barloom.sinks.prices import (
    compact_by_security,
    merge_by_security,
    normalize_and_store,
    save_bucketed_table,
)
from barloom.sinks.raw import store_raw
from barloom.sources.inventory import available_codes, available_days, security_stats, storage_stats
from barloom.sources.prices import read_by_security, read_daily_prices, read_security_prices
from barloom.sources.raw import read_latest, read_raw

DEFAULT_BUCKETS = 64


@dataclass(frozen=True)
class PriceLake:
    """Paths below one root, and the jobs that move data between them.

    ``buckets`` is part of the security-major path: data written with another
    count is never read by mistake.
    """

    spark: SparkSession
    root: str
    buckets: int = DEFAULT_BUCKETS

    @property
    def raw_root(self) -> str:
        return f"{self.root}/raw"

    @property
    def prices_path(self) -> str:
        return f"{self.root}/normalized/{DAILY_PRICES_TABLE}"

    @property
    def quarantine_path(self) -> str:
        return f"{self.root}/quarantine/{DAILY_PRICES_TABLE}"

    @property
    def by_security_path(self) -> str:
        return f"{self.root}/by_security_{self.buckets}/{DAILY_PRICES_TABLE}"

    # Raw layer
    def land(
        self,
        rows: DataFrame,
        endpoint: str,
        day: date | str,
        lineage: bool = False,
        metadata: Mapping[str, object] | None = None,
    ) -> None:
        store_raw(rows, self.raw_root, endpoint, day, lineage, metadata=metadata)

    def raw(
        self,
        endpoint: str,
        on: date | None = None,
        between: tuple[date, date] | None = None,
        schema: T.StructType | None = None,
    ) -> DataFrame:
        return read_raw(self.spark, self.raw_root, endpoint, on, between, schema)

    def raw_days(self, endpoint: str) -> DataFrame:
        return available_days(self.spark, f"{self.raw_root}/{endpoint}")

    def listing(self, as_of: date | None = None) -> DataFrame:
        return read_latest(self.spark, self.raw_root, LISTED_INFO_ENDPOINT, as_of)

    def raw_stats(self, endpoints: Sequence[str] | None = None) -> DataFrame:
        return storage_stats(self.spark, self.raw_root, None if endpoints is None else list(endpoints))

    # Normalised layer
    def normalize(
        self,
        start: date | None = None,
        end: date | None = None,
        force: bool = False,
        processed_at: str | None = None,
    ) -> DataFrame:
        landed = in_days(self.raw_days(DAILY_QUOTES_ENDPOINT), start, end)
        if landed.isEmpty():
            raise LookupError("no raw daily quotes are stored")
        wanted = pending_days(landed, self.price_days(), force).orderBy("date").collect()
        return self.normalize_days([row.date.isoformat() for row in wanted], processed_at)

    def normalize_days(self, days: list[str], processed_at: str | None = None) -> DataFrame:
        """Normalise the given landed days, stored already or not."""
        return normalize_and_store(
            self.spark,
            f"{self.raw_root}/{DAILY_QUOTES_ENDPOINT}",
            days,
            self.prices_path,
            self.quarantine_path,
            processed_at or datetime.now().isoformat(),
        )

    def daily_prices(
        self,
        start: date | None = None,
        end: date | None = None,
        codes: Sequence[str] | DataFrame | None = None,
    ) -> DataFrame:
        return read_daily_prices(self.spark, self.prices_path, start, end, codes)

    def price_days(self) -> DataFrame:
        return available_days(self.spark, self.prices_path)

    def price_stats(self) -> DataFrame:
        return storage_stats(self.spark, f"{self.root}/normalized", [DAILY_PRICES_TABLE])

    # Security-major layer
    def cluster(
        self, start: date | None = None, end: date | None = None, force: bool = False
    ) -> dict[str, int]:
        incoming = self.daily_prices(start, end)
        return merge_by_security(incoming, self.by_security_path, self.buckets, force)

    def compact(self, years: Sequence[int]) -> None:
        compact_by_security(self.spark, self.by_security_path, self.buckets, list(years))

    def bucketed_table(self, table: str) -> DataFrame:
        prices = self.all_prices().select(*PRICE_COLUMNS)
        path = f"{self.root}/bucketed_{self.buckets}/{table}"
        return save_bucketed_table(prices, table, path, self.buckets)

    def security_prices(
        self,
        codes: str | Sequence[str],
        start: date | None = None,
        end: date | None = None,
        columns: Sequence[str] | None = None,
    ) -> DataFrame:
        return read_security_prices(
            self.spark, self.by_security_path, self.buckets, codes, start, end, columns
        )

    def all_prices(self) -> DataFrame:
        return read_by_security(self.spark, self.by_security_path)

    def codes(self) -> DataFrame:
        return available_codes(self.all_prices())

    def security_stats(self) -> DataFrame:
        return security_stats(self.all_prices())
