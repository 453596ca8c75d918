"""Scans of raw partitions: one dataset per endpoint, one partition per day (SRC7, SRC10)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from barloom.sources.inventory import available_days

PARTITION = "partition_date"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """A Parquet dataset, or an empty frame when the path does not exist.

    With a schema the empty frame is a scan of no files, which knows ``_metadata`` like any other.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        if schema is None:
            return spark.createDataFrame([], T.StructType([]))
        return spark.read.schema(schema).parquet()


def read_raw(
    spark: SparkSession,
    root: str,
    endpoint: str,
    on: date | None = None,
    between: tuple[date, date] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Raw rows of an endpoint on a day, in an inclusive range, or all (SRC7).

    The day is the partition column, so the filter selects directories before
    anything is read. Directories that do not name a day are skipped.
    """
    if on is not None and between is not None:
        raise ValueError("give a day or a range, not both")
    if schema is not None:
        # Declared as text: a directory with a bad name must not break the scan.
        schema = T.StructType([*schema.fields, T.StructField(PARTITION, T.StringType())])
    rows = read_or_empty(spark, f"{root}/{endpoint}", schema)
    if PARTITION not in rows.columns:
        return rows
    text = F.col(PARTITION).cast("string")
    if on is not None:
        rows = rows.where(text == on.isoformat())
    elif between is not None:
        rows = rows.where(text.between(between[0].isoformat(), between[1].isoformat()))
    return rows.where(F.try_to_date(text, "yyyy-MM-dd").isNotNull()).withColumn(PARTITION, text)


def read_days_by_schema(spark: SparkSession, path: str, days: list[str]) -> list[DataFrame]:
    """Raw rows of the given days as one frame per schema that their files have.

    Days land by themselves, so column types may differ from one to the next, and
    one schema for all would fail the whole scan. The footers of the days' files
    are read in tasks; the driver sees one row per schema with its files.
    """
    if not days:
        return []
    folders = [f"{path}/{PARTITION}={day}" for day in days]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folders)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schemas = [
                from_arrow_schema(pq.read_schema(pa.BufferReader(content.as_buffer()))).json()
                for content in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(schemas)], ["path", "schema"])

    kinds = (
        files.select("path", "content")
        .mapInArrow(footers, "path string, schema string")
        .groupBy("schema")
        .agg(F.collect_list("path").alias("paths"))
        .collect()
    )
    frames = []
    for kind in kinds:
        fields = T.StructType.fromJson(json.loads(kind.schema)).fields
        schema = T.StructType([*fields, T.StructField(PARTITION, T.StringType())])
        reader = spark.read.schema(schema).option("basePath", path)
        frames.append(reader.parquet(*kind.paths))
    return frames


def read_latest(
    spark: SparkSession,
    root: str,
    endpoint: str,
    as_of: date | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Rows of the latest stored day, optionally not after ``as_of`` (SRC10, SRC3).

    The day comes from a directory listing, so one partition is read.
    """
    days = available_days(spark, f"{root}/{endpoint}")
    if as_of is not None:
        days = days.where(F.col("date") <= F.lit(as_of))
    latest = days.agg(F.max("date").alias("day")).first().day
    if latest is None:
        return read_raw(spark, root, endpoint, schema=schema).limit(0)
    return read_raw(spark, root, endpoint, on=latest, schema=schema)
