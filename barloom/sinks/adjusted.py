"""A stored layer of adjusted bars that late corporate actions correct in place (WIN1, D9, SNK4)."""

from __future__ import annotations

import logging
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import chain as chains
from barloom.operators.adjust import PRICES
from barloom.session import remove_folder, replace_folder
from barloom.sinks.prices import staged
from barloom.sources.prices import BUCKET, YEAR, bucket_of

logger = logging.getLogger(__name__)
ADJUSTED = tuple(f"adj_{name}" for name in (*PRICES, "volume"))


def _chain_path(path: str) -> str:
    return f"{path}/_chain"


def _write(bars: DataFrame, chain: DataFrame, path: str, buckets: int) -> None:
    """Adjust bars by their chains and write them by (year, bucket).

    Bars are shuffled once, by code: the join hashes the chains, a row a security, and leaves the bars
    unsorted, and the files of a task hold whole securities, sorted. So the bars are neither sampled
    for ranges nor shuffled again for the layout, whether or not the chains fit a broadcast.
    """
    adjusted = chains.adjust_with_chain(bars, chain.hint("shuffle_hash"))
    laid_out = adjusted.withColumns({YEAR: F.year("date"), BUCKET: bucket_of(F.col("code"), buckets)})
    (
        laid_out.sortWithinPartitions(YEAR, BUCKET, "code", "date")
        .write.partitionBy(YEAR, BUCKET)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def write_adjusted(prices: DataFrame, path: str, buckets: int) -> None:
    """Store bars with their adjusted columns by (year, bucket), and the event chains beside them."""
    spark = prices.sparkSession
    chains.event_chain(prices).write.mode("overwrite").parquet(_chain_path(path))
    _write(prices, read_chain(spark, path), path, buckets)


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_chain_path(path))


def read_adjusted(spark: SparkSession, path: str) -> DataFrame:
    """Stored bars with adjusted columns; files in folders that begin with _ are not part of them."""
    return spark.read.parquet(path)


def readjust_late_actions(actions: DataFrame, path: str, buckets: int) -> dict[str, int]:
    """Correct the stored bars for ``actions`` (code, date, adjustment_factor) that came late.

    Only bars of the named securities on or before the last day of their actions change: the day's own
    factor and the scale of what lies before. Only (year, bucket) partitions that hold such bars are
    read and rewritten; the other bars in them follow from chains that did not change after their day, so
    they come out as they were. The new partitions are complete in a folder that the log names, inside
    ``path`` but no part of the dataset, before any old one gives way to them; chains are published
    last. A run cut short before that is repeated as a whole, with the same result; one cut short
    between two moves first needs the rest of that folder moved. Returns partitions rewritten and
    bars changed.
    """
    spark = actions.sparkSession
    named = actions.groupBy("code", "date").agg(F.max("adjustment_factor").alias("_factor"))
    with staged(named, "late-actions") as late:
        bounds = late.groupBy("code").agg(F.max("date").alias("_last"))
        # bounded by buckets and by the calendar
        scope = bounds.agg(
            F.collect_set(bucket_of(F.col("code"), buckets)).alias("buckets"),
            F.max(F.year("_last")).alias("year"),
        ).first()
        if not scope["buckets"]:
            return {"partitions": 0, "bars": 0}
        given = late.select("code", "date", F.col("_factor").alias("adjustment_factor"))
        known = read_chain(spark, path)
        with staged(chains.extend_chain(known, given), "chains") as renewed:
            with staged(chains.replace_chain(known, renewed), "chains-all") as whole:
                stored = read_adjusted(spark, path).where(
                    F.col(BUCKET).isin(scope["buckets"]) & (F.col(YEAR) <= scope["year"])
                )
                own = stored.join(bounds, "code").where(F.col("date") <= F.col("_last"))
                # as many rows as partitions
                touched = own.groupBy(YEAR, BUCKET).agg(F.count(F.lit(1)).alias("bars")).collect()
                if touched:
                    hit = reduce(or_, ((F.col(YEAR) == t[YEAR]) & (F.col(BUCKET) == t[BUCKET]) for t in touched))
                    bars = stored.where(hit).drop(YEAR, BUCKET, *ADJUSTED)
                    # beside the dataset, so that a partition moves without a copy
                    fresh = f"{path}/_readjusted-{uuid.uuid4().hex}"
                    _write(_with_actions(bars, late), whole, fresh, buckets)
                    logger.info("staged readjusted partitions in %s", fresh)
                    for t in touched:
                        place = f"{YEAR}={t[YEAR]}/{BUCKET}={t[BUCKET]}"
                        replace_folder(spark, f"{fresh}/{place}", f"{path}/{place}")
                    remove_folder(spark, fresh)
                whole.write.mode("overwrite").parquet(_chain_path(path))
    return {"partitions": len(touched), "bars": sum(t["bars"] for t in touched)}


def _with_actions(bars: DataFrame, late: DataFrame) -> DataFrame:
    """Bars with the factors of late actions (code, date, _factor; null: none) in place of their own."""
    ofs = F.map_from_entries(F.collect_list(F.struct("date", "_factor"))).alias("_late")
    per_code = late.groupBy("code").agg(ofs)
    joined = bars.join(per_code.hint("shuffle_hash"), "code", "left")
    found = F.try_element_at("_late", "date")
    factor = F.coalesce(found, F.col("adjustment_factor")).alias("adjustment_factor")
    return joined.select(*[factor if name == "adjustment_factor" else name for name in bars.columns])
