"""Storing normalised prices and rewriting them security-major (SNK3, SNK4, DQ2)."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.merge import keep_last, new_rows_only
from barloom.operators.normalize import normalize_quotes
from barloom.operators.quality import SCHEMA_GAP, quality_report
from barloom.schemas import PRICE_COLUMNS, RAW_QUOTES
from barloom.session import new_folder, remove_folder
from barloom.sinks.raw import write_days
from barloom.sources.prices import BUCKET, YEAR, bucket_of, read_by_security
from barloom.sources.raw import PARTITION, read_days_by_schema

logger = logging.getLogger(__name__)
_FRESH = "_fresh"
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def normalize_and_store(
    spark: SparkSession,
    raw_path: str,
    days: list[str],
    prices_path: str,
    quarantine_path: str,
    processed_at: str,
) -> DataFrame:
    """Normalise the given raw days; set aside those that fail (SNK3, DQ2).

    A day is validated and stored as a whole under the day it was landed under.
    Days go through the same few jobs, one scan per schema found among their
    files; a day whose files lack a column, or hold rows of another date, is
    rejected like one with bad rows, and a bad day does not stop the others. The
    last verdict counts: a day leaves the quarantine when it is accepted, and the
    accepted prices when it is rejected. Returns the report of the days, which are
    bounded by the calendar and so may pass through the driver.
    """
    expected = spark.createDataFrame([(day,) for day in days], f"{PARTITION} string")
    frames = [_normalized(raw, processed_at) for raw in read_days_by_schema(spark, raw_path, days)]
    if not frames:
        nothing = spark.createDataFrame([], RAW_QUOTES).withColumn(PARTITION, F.lit(""))
        frames = [_normalized(nothing, processed_at)]
    rows = reduce(DataFrame.unionByName, frames)
    report = quality_report(rows, PARTITION, expected)
    # As plain rows, so that both writes and every retried task see one verdict.
    report = spark.createDataFrame(report.collect(), report.schema)
    verdict = {row[PARTITION]: row.valid for row in report.select(PARTITION, "valid").collect()}
    accepted = [day for day in days if verdict[day]]
    rejected = [day for day in days if not verdict[day]]
    if accepted:
        good = rows.where(F.col(PARTITION).isin(accepted)).select(*PRICE_COLUMNS, PARTITION)
        write_days(good, prices_path, PARTITION)
    if rejected:
        bad = rows.where(F.col(PARTITION).isin(rejected)).join(
            F.broadcast(report.select(PARTITION, "reason")), PARTITION
        )
        write_days(bad, quarantine_path, PARTITION)
    for others, path in ((accepted, quarantine_path), (rejected, prices_path)):
        for day in others:
            remove_folder(spark, f"{path}/{PARTITION}={day}")
    return report


def _normalized(raw: DataFrame, processed_at: str) -> DataFrame:
    """Flagged rows; columns the frame lacks are null, and its rows say so."""
    plain = {f.name for f in raw.schema if not isinstance(f.dataType, _NESTED)}
    missing = [name for name in RAW_QUOTES.fieldNames() if name not in plain]
    filled = raw.withColumns({name: F.lit(None).cast("string") for name in missing})
    marked = filled.withColumn(SCHEMA_GAP, F.lit(bool(missing)))
    keep = [PARTITION, SCHEMA_GAP]
    return normalize_quotes(marked, processed_at, "flag", keep, F.col(SCHEMA_GAP))


def write_by_security(
    prices: DataFrame, path: str, buckets: int, mode: Literal["append", "overwrite"]
) -> None:
    """Write bars clustered by security; ``overwrite`` replaces the partitions they touch.

    A bucket holds many securities, so files stay large; the year bounds a
    partition and confines a daily increment to the current year. Rows are dealt
    by ranges of (year, bucket, code): a large bucket is split between securities,
    and a security's year lies in one file of a write.
    """
    laid_out = prices.select(*PRICE_COLUMNS).withColumns(_layout(buckets))
    (
        laid_out.repartitionByRange(YEAR, BUCKET, "code")
        .sortWithinPartitions(YEAR, BUCKET, "code", "date")
        .write.partitionBy(YEAR, BUCKET)
        .mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def _layout(buckets: int) -> dict[str, Column]:
    return {YEAR: F.year("date"), BUCKET: bucket_of(F.col("code"), buckets)}


def merge_by_security(
    incoming: DataFrame, path: str, buckets: int, force: bool = False
) -> dict[str, int]:
    """Merge bars into the security-major dataset, one row per security and day (SNK4, JN2, WIN6).

    Without ``force`` stored bars win: only new keys are appended, and nothing
    stored is rewritten (:func:`compact_by_security` joins the small files of
    many increments). With it incoming bars win, and the partitions they touch
    are rewritten. Returns what was offered and what was written.
    """
    # Stored once: what is offered may cost a long plan, and several steps below read it.
    with staged(incoming.select(*PRICE_COLUMNS), "offered") as offered:
        return _merge_staged(offered, path, buckets, force)


def _merge_staged(incoming: DataFrame, path: str, buckets: int, force: bool) -> dict[str, int]:
    spark: SparkSession = incoming.sparkSession
    # The set of days is bounded by the calendar; its years prune the stored partitions.
    days = incoming.groupBy("date").agg(F.count(F.lit(1)).alias("records")).collect()
    codes = incoming.agg(F.count_distinct("code").alias("codes")).first().codes
    known = [day.date for day in days if day.date is not None]
    years = sorted({day.year for day in known})
    stored = read_by_security(spark, path).where(F.col(YEAR).isin(years))
    fresh = keep_last(incoming, ["processed_at"])
    if not force and not stored.isEmpty():
        fresh = new_rows_only(fresh, stored)
    fresh = fresh.withColumn(_FRESH, F.lit(True))
    if force:
        touched = incoming.select(*(column.alias(name) for name, column in _layout(buckets).items()))
        kept = stored.join(touched.distinct(), [YEAR, BUCKET], "left_semi")
        rest = new_rows_only(kept, incoming).select(*PRICE_COLUMNS)
        fresh = fresh.unionByName(rest.withColumn(_FRESH, F.lit(False)))
    # Complete in the shared folder before the dataset, which was read, is touched.
    with staged(fresh, "increment") as rows:
        written = (
            rows.where(_FRESH)
            .agg(
                F.count_distinct("code").alias("stocks_written"),
                F.count(F.lit(1)).alias("records_written"),
            )
            .first()
        )
        if written.records_written:
            write_by_security(rows, path, buckets, "overwrite" if force else "append")
    return {
        "dates_processed": len(known),
        "stocks_input": codes,
        "records_input": sum(day.records for day in days),
        **written.asDict(),
    }


def compact_by_security(spark: SparkSession, path: str, buckets: int, years: list[int]) -> None:
    """Rewrite whole years so that each partition is again few sorted files."""
    stored = read_by_security(spark, path).where(F.col(YEAR).isin(years))
    with staged(stored.select(*PRICE_COLUMNS), "compacted") as rows:
        write_by_security(rows, path, buckets, "overwrite")


@contextmanager
def staged(rows: DataFrame, label: str) -> Iterator[DataFrame]:
    """Rows written to the shared folder and read back; the folder goes when all went well.

    If a copy from it is cut short the rows are still there: the log names them,
    and copying again is harmless.
    """
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    logger.info("staged %s in %s", label, path)
    yield spark.read.schema(rows.schema).parquet(path)
    remove_folder(spark, path)


def save_bucketed_table(prices: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Save bars as a table bucketed by security, and return the table.

    Windows and joins by ``code`` over it need no shuffle, so many analyses can
    share the one that wrote it.
    """
    (
        prices.repartition(buckets, "code")
        .write.bucketBy(buckets, "code")
        .sortBy("code", "date")
        .option("path", path)
        .mode("overwrite")
        .saveAsTable(table)
    )
    return prices.sparkSession.table(table)
