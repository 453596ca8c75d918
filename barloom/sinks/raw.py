"""Storing raw responses by day (SNK1, SNK2)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.raw import PARTITION


def with_lineage(
    rows: DataFrame,
    endpoint: str,
    day: date | Column,
    ingested_at: str | None = None,
    metadata: Mapping[str, object] | None = None,
) -> DataFrame:
    """Add where a row came from and when it arrived (SNK2)."""
    day_text = F.lit(day.isoformat()) if isinstance(day, date) else day.cast("string")
    rows = rows.withColumns(
        {
            "_endpoint": F.lit(endpoint),
            "_partition_date": day_text,
            "_ingested_at": F.lit(ingested_at or datetime.now().isoformat()),
        }
    )
    if not metadata:
        return rows
    fields = [F.lit(value).alias(name) for name, value in metadata.items()]
    return rows.withColumn("_metadata", F.to_json(F.struct(*fields)))


def store_raw(
    rows: DataFrame,
    root: str,
    endpoint: str,
    day: date | str | Column,
    lineage: bool = False,
    ingested_at: str | None = None,
    metadata: Mapping[str, object] | None = None,
) -> None:
    """Replace the stored partition of every day present in the rows (SNK1).

    ``day`` is one day, or the column holding each row's day. Days without rows
    are not touched, so an empty response leaves its day pending.
    """
    if isinstance(day, str):
        day = F.col(day)
    if lineage:
        rows = with_lineage(rows, endpoint, day, ingested_at, metadata)
    text = F.lit(day.isoformat()) if isinstance(day, date) else day.cast("string")
    write_days(rows.withColumn(PARTITION, text), f"{root}/{endpoint}", PARTITION)


def write_days(rows: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions that occur in the rows.

    The rebalance hint gathers a day into few files and lets adaptive execution
    split a day that is too large for one task.
    """
    (
        rows.hint("rebalance", partition)
        .write.partitionBy(partition)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
