"""Merging new bars into stored ones, one row per security and day (JN1, JN2, WIN6, SET1-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE_KEY = ("code", "date")
_POSITION = "_position"


def keep_last(
    rows: DataFrame, order: Sequence[str | Column], key: Sequence[str] = PRICE_KEY
) -> DataFrame:
    """One row per key: the last one in ``order``.

    Spark keeps only the best row of each key per map task before it shuffles, so
    a key repeated across a large part of the table does not pile up in one task.
    Rows equal in ``order`` are told apart by their remaining columns.
    """
    ranked = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [F.col(name) for name in rows.columns if name not in key]
    latest = Window.partitionBy(*key).orderBy(*(c.desc() for c in [*ranked, *rest]))
    return (
        rows.withColumn(_POSITION, F.row_number().over(latest))
        .where(F.col(_POSITION) == 1)
        .drop(_POSITION)
    )


def new_rows_only(
    incoming: DataFrame, stored: DataFrame, key: Sequence[str] = PRICE_KEY
) -> DataFrame:
    """Incoming rows whose key is not stored yet (JN2).

    Only distinct keys of the stored side are shuffled or broadcast.
    """
    return incoming.join(stored.select(*key).distinct(), list(key), "left_anti")


def merge_skipping(
    stored: DataFrame, incoming: DataFrame, order: Sequence[str | Column] = ("processed_at",)
) -> DataFrame:
    """Stored rows win; only keys not stored yet are added.

    Duplicates are cut before the join, which then reuses their partitioning.
    """
    return stored.unionByName(new_rows_only(keep_last(incoming, order), stored))


def merge_replacing(
    stored: DataFrame, incoming: DataFrame, order: Sequence[str | Column] = ("processed_at",)
) -> DataFrame:
    """Incoming rows win over stored rows of the same key (WIN6).

    A small increment is broadcast by the planner, and then the stored side is
    neither shuffled nor sorted.
    """
    return new_rows_only(stored, incoming).unionByName(keep_last(incoming, order))


def pending_days(requested: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Requested days that still have to be processed (JN1, SET3)."""
    days = requested.select("date").distinct()
    return days if force else days.join(stored.select("date"), "date", "left_anti")


def rewrite_stats(incoming: DataFrame) -> DataFrame:
    """Counts of the rows offered to a security-major rewrite, written or not (SNK4)."""
    return incoming.agg(
        F.count_distinct("date").alias("dates_processed"),
        F.count_distinct("code").alias("stocks_input"),
        F.count(F.lit(1)).alias("records_input"),
    )


def duplicate_keys(rows: DataFrame, key: Sequence[str] = PRICE_KEY) -> DataFrame:
    """Keys held by more than one row."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
