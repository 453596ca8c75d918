"""Parameterised SQL over the layers of a lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.lake import PriceLake
from barloom.schemas import PRICE_COLUMNS


def register_views(lake: PriceLake, endpoints: tuple[str, ...] = ()) -> None:
    """Temporary views over the layers; raw endpoints get a ``raw_`` prefix."""
    lake.daily_prices().createOrReplaceTempView("daily_prices")
    lake.all_prices().select(*PRICE_COLUMNS).createOrReplaceTempView("security_prices")
    for endpoint in endpoints:
        lake.raw(endpoint).createOrReplaceTempView(f"raw_{endpoint}")


def run_sql(spark: SparkSession, text: str, **arguments: object) -> DataFrame:
    """Run SQL with ``:name`` markers bound to values, never spliced into the text."""
    return spark.sql(text, args=arguments)
