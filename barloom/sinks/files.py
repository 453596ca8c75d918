"""Saving a result for other tools (SNK5)."""

from pyspark.sql import DataFrame


def save_table(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet for a ``.parquet`` path, else CSV with a header."""
    writer = rows.write.mode(mode)
    if path.lower().endswith(".parquet"):
        writer.parquet(path)
    else:
        writer.option("header", True).csv(path)
