"""What is stored: days, securities, files and sizes (INV1-INV4).

File facts come from directory listings through the ``binaryFile`` source with
its content column pruned, so no data file is opened.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FILES = "path string, length bigint"
_MEGABYTE = 1024 * 1024


def data_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of every data file below a dataset directory."""
    reader = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true")
    )
    try:
        return reader.load(path).select("path", "length")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _FILES)


def _directory_value(column: str) -> Column:
    return F.nullif(F.regexp_extract("path", f"/{column}=([^/]+)/", 1), F.lit(""))


def available_days(spark: SparkSession, path: str, partition: str = "partition_date") -> DataFrame:
    """Stored days (INV1); directories that do not name a day are ignored."""
    day = F.try_to_date(_directory_value(partition), "yyyy-MM-dd")
    days = data_files(spark, path).select(day.alias("date")).distinct()
    return days.where(F.col("date").isNotNull())


def available_codes(prices: DataFrame) -> DataFrame:
    """Stored securities (INV2)."""
    return prices.select("code").distinct()


def storage_stats(
    spark: SparkSession,
    root: str,
    tables: list[str] | None = None,
    partition: str = "partition_date",
) -> DataFrame:
    """Days, files and megabytes per dataset, and a ``total`` row (INV3).

    Datasets are the folders below ``root`` that hold days; ``tables`` picks some.
    """
    files = data_files(spark, root).select(
        F.regexp_extract("path", f"/([^/]+)/{partition}=", 1).alias("dataset"),
        F.try_to_date(_directory_value(partition), "yyyy-MM-dd").alias("day"),
        "length",
    )
    files = files.where(F.col("day").isNotNull())
    if tables is not None:
        files = files.where(F.col("dataset").isin(tables))
    sums = files.rollup("dataset").agg(
        F.count_distinct("day").alias("dates"),
        F.count(F.lit(1)).alias("files"),
        F.round(F.coalesce(F.sum("length"), F.lit(0)) / _MEGABYTE, 2).alias("size_mb"),
    )
    return sums.withColumn("dataset", F.coalesce("dataset", F.lit("total")))


def security_stats(prices: DataFrame) -> DataFrame:
    """Records, files and their megabytes per security (INV4).

    Files are shared by the securities of a bucket, so each is charged in
    proportion to the rows it holds of a security.
    """
    per_file = prices.groupBy(
        "code",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
    ).agg(F.count(F.lit(1)).alias("rows"))
    file_rows = per_file.groupBy("file").agg(F.sum("rows").alias("file_rows"))
    return (
        per_file.join(file_rows, "file")
        .groupBy("code")
        .agg(
            F.sum("rows").alias("records"),
            F.count(F.lit(1)).alias("files"),
            F.round(F.sum(F.col("size") * F.col("rows") / F.col("file_rows")) / _MEGABYTE, 2).alias(
                "size_mb"
            ),
        )
    )
