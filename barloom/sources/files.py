"""Parquet and CSV tables (SRC11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by its extension: ``.parquet``, else CSV with a header.

    Without a schema CSV columns stay text, so codes keep their leading zeros.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.lower().endswith(".parquet"):
        return reader.parquet(path)
    return reader.option("header", True).csv(path)
