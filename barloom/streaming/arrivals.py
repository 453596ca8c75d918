"""Normalise raw days as they land, each file once (SNK3 as a file stream).

The stream's checkpoint plays the part of the list of finished days. It handles
what has arrived and stops; a scheduler starts it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.plans.lake import PriceLake
from barloom.schemas import DAILY_QUOTES_ENDPOINT, RAW_QUOTES
from barloom.sources.raw import PARTITION


def normalize_arrivals(
    lake: PriceLake,
    checkpoint: str,
    processed_at: str,
    schema: T.StructType = RAW_QUOTES,
    files_per_batch: int = 1000,
) -> None:
    """Process every raw file that arrived since the last run.

    A file only tells which day has changed: the whole day is read again, because
    a day is validated and replaced as a whole. Repeating a batch after a failure
    overwrites the same days with the same rows.
    """
    spark = lake.spark
    landed = T.StructType([*schema.fields, T.StructField(PARTITION, T.StringType())])
    arrivals = (
        spark.readStream.schema(landed)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{lake.raw_root}/{DAILY_QUOTES_ENDPOINT}")
        .select(PARTITION)
    )

    def process(batch: DataFrame, _batch_id: int) -> None:
        # Days are bounded by the calendar; as a list they prune the raw partitions.
        changed = sorted(row[0] for row in batch.distinct().collect())
        lake.normalize_days(changed, processed_at)

    query = (
        arrivals.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
