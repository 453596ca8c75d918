"""Collections of documents as frames keyed by ``_id`` (DOC1-DOC8).

Filters are Spark columns. The one-document forms act on the smallest matching
``_id``, so that a retried task chooses the same document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from barloom.session import materialize

ID = "_id"


class DuplicateKeyError(ValueError):
    """An inserted document repeats a unique key."""


def _matches(condition: Column | None) -> Column:
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def find(
    documents: DataFrame,
    condition: Column | None = None,
    columns: Sequence[str] | None = None,
    sort: Sequence[Column] | None = None,
    skip: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Filter, sort, skip, limit, then project (DOC1). No limit, and zero, mean all.

    The id is always kept. Deep skips read everything before them: page with
    :func:`page_after` instead. A skip without a limit needs the place of every
    row, see :func:`_skipped`.
    """
    found = documents.where(_matches(condition))
    if skip > 0 and not limit:
        found = _skipped(found, list(sort or [F.col(ID)]), skip)
    if sort:
        found = found.orderBy(*sort)
    if limit:
        found = found.offset(skip).limit(limit)
    if columns is None:
        return found
    return found.select(ID, *(name for name in columns if name != ID))


def _skipped(found: DataFrame, sort: list[Column], skip: int) -> DataFrame:
    """All but the first ``skip`` rows of an order.

    Rows are dealt into ordered ranges and stored once in the shared folder;
    range totals say how many rows lie ahead, so no task orders everything.
    """
    dealt = found.repartitionByRange(*sort).withColumn("_range", F.spark_partition_id())
    stored = materialize(dealt, "ranges")
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    )
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*sort))
    placed = stored.withColumn("_nth", nth).join(offsets, "_range")
    return placed.where(F.col("_ahead") + F.col("_nth") > skip).select(*found.columns)


def find_one(
    documents: DataFrame, condition: Column | None = None, columns: Sequence[str] | None = None
) -> Row | None:
    return find(documents, condition, columns, [F.col(ID)], limit=1).first()


def page_after(
    documents: DataFrame,
    size: int = 100,
    cursor: object | None = None,
    condition: Column | None = None,
    sort: str = ID,
) -> DataFrame:
    """One page in id order after a cursor, with ``has_more`` and ``next_cursor`` (DOC2).

    One row more than the page is fetched to learn whether another page follows;
    the window below therefore sees at most size + 1 rows. A cursor is an id, so
    any other order would skip or repeat documents and is refused.
    """
    if sort != ID:
        raise ValueError(f"pages are ordered by {ID!r}; cannot page by {sort!r}")
    rest = documents.where(_matches(condition))
    if cursor is not None:
        rest = rest.where(F.col(ID) > F.lit(cursor))
    fetched = rest.orderBy(ID).limit(size + 1)
    whole = Window.partitionBy(F.lit(0))
    numbered = fetched.withColumns(
        {
            "_place": F.row_number().over(whole.orderBy(ID)),
            "has_more": F.count(F.lit(1)).over(whole) > size,
        }
    )
    page = numbered.where(F.col("_place") <= size)
    last = F.max(F.when(F.col("_place") == size, F.col(ID))).over(whole)
    return page.withColumn("next_cursor", F.when(F.col("has_more"), last)).drop("_place")


def count(documents: DataFrame, condition: Column | None = None) -> DataFrame:
    """Number of matching documents (DOC3)."""
    return documents.agg(F.count_if(_matches(condition)).alias("n"))


def aggregate(
    documents: DataFrame,
    by: Sequence[str],
    measures: Mapping[str, Column],
    condition: Column | None = None,
) -> DataFrame:
    """Match, then group (DOC4)."""
    named = [measure.alias(name) for name, measure in measures.items()]
    return documents.where(_matches(condition)).groupBy(*by).agg(*named)


def colliding_keys(
    documents: DataFrame, incoming: DataFrame, key: Sequence[str] = (ID,)
) -> DataFrame:
    """Keys an insert may not use: stored already, or repeated in the insert (DOC5)."""
    offered = incoming.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    stored = documents.select(*key).distinct().withColumn("stored", F.lit(True))
    return (
        offered.join(stored, list(key), "left")
        .withColumn("stored", F.coalesce("stored", F.lit(False)))
        .where(F.col("stored") | (F.col("copies") > 1))
    )


def insert(documents: DataFrame, incoming: DataFrame, key: Sequence[str] = (ID,)) -> DataFrame:
    """All incoming documents, or an error and none (DOC5)."""
    clash = colliding_keys(documents, incoming, key).select(*key).limit(1).collect()
    if clash:
        raise DuplicateKeyError(f"Duplicate key: {clash[0].asDict()}")
    return documents.unionByName(incoming)


def _first_match(documents: DataFrame, condition: Column) -> Column:
    """True on the matching document with the smallest id: a one-row scalar subquery."""
    smallest = documents.where(_matches(condition)).agg(F.min(ID)).scalar()
    return F.col(ID) == smallest


def update_many(
    documents: DataFrame, condition: Column, changes: Mapping[str, Column]
) -> DataFrame:
    """Set fields on every matching document (DOC6)."""
    hit = _matches(condition)
    present = set(documents.columns)
    return documents.withColumns(
        {
            name: F.when(hit, value).otherwise(F.col(name) if name in present else F.lit(None))
            for name, value in changes.items()
        }
    )


def update_one(
    documents: DataFrame,
    condition: Column,
    changes: Mapping[str, Column],
    upsert: DataFrame | None = None,
) -> DataFrame:
    """Set fields on the first matching document; ``upsert`` is added when none matches (DOC6)."""
    updated = update_many(documents, _first_match(documents, condition), changes)
    if upsert is None:
        return updated
    none_matched = ~documents.where(_matches(condition)).exists()
    return updated.unionByName(upsert.where(none_matched))


def update_counts(
    documents: DataFrame, condition: Column, changes: Mapping[str, Column]
) -> DataFrame:
    """How many documents match, and how many of them a change would alter (DOC6)."""
    hit = _matches(condition)
    altered = reduce(
        or_,
        (
            ~F.col(name).eqNullSafe(value) if name in documents.columns else value.isNotNull()
            for name, value in changes.items()
        ),
    )
    return documents.agg(
        F.count_if(hit).alias("matched"), F.count_if(hit & altered).alias("modified")
    )


def replace(documents: DataFrame, incoming: DataFrame, upsert: bool = False) -> DataFrame:
    """Replace whole documents by id; unknown ids are added only on ``upsert`` (DOC7).

    Both forms are one anti join and a union: a stored document survives unless
    its id comes in, and a small increment is broadcast by the planner. Repeated
    ids in ``incoming`` are refused, since no order says which one is the last.
    """
    repeated = incoming.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if repeated:
        raise DuplicateKeyError(f"Repeated key: {repeated[ID]!r}")
    kept = documents.join(incoming.select(ID), ID, "left_anti")
    if not upsert:
        incoming = incoming.join(documents.select(ID), ID, "left_semi")
    return kept.unionByName(incoming)


def delete_counts(documents: DataFrame, condition: Column) -> DataFrame:
    """How many documents ``delete_many`` and ``delete_one`` take away (DOC8)."""
    matched = F.count_if(_matches(condition))
    return documents.agg(
        matched.alias("deleted_many"), F.least(matched, F.lit(1)).alias("deleted_one")
    )


def delete_many(documents: DataFrame, condition: Column) -> DataFrame:
    """Documents left after deleting every match; an unknown condition deletes nothing (DOC8)."""
    return documents.where(~_matches(condition))


def delete_one(documents: DataFrame, condition: Column) -> DataFrame:
    """Documents left after deleting the first match (DOC8)."""
    return documents.where(~_matches(_first_match(documents, condition)))
