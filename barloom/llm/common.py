"""What several operators share: words, stored intermediate tables, and a global order without a global sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import shared_folder

# A word is a run of characters other than blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
TIE_PARTS = 64


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def settle(rows: DataFrame) -> DataFrame:
    """Compute a frame once and cut its lineage, in the cluster's shared checkpoint folder.

    Spark removes the files once the frame is no longer referenced, where the session
    asks for that (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once, even where the body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """All words of a text as an array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda word: word != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_order_bucket(rows: DataFrame, key: str, tie: str, bucket: str) -> DataFrame:
    """Add a bucket number that rises with (key, tie), nulls first: sorted buckets of like row counts.

    Cuts are percentiles of the key, so buckets follow the data, and their number follows the
    shuffle partitions. A key that fills several percentiles by itself is split by its tie, a
    non-negative number whose remainder by TIE_PARTS then leads the order among rows of that key;
    ``order_by`` gives that order.
    """
    n = 4 * shuffle_partitions(rows.sparkSession)
    stats = rows.agg(
        F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("cuts"),
        F.count(F.lit(1)).alias("n"),
        F.count(key).alias("keyed"),
    ).first()
    cuts = stats["cuts"] or []
    hot = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    splits = sorted({float(c) for c in cuts} | {float(h + 1) for h in hot})
    null_is_hot = (stats["n"] - stats["keyed"]) * n > stats["n"]
    is_hot = F.lit(null_is_hot) & F.col(key).isNull()
    if hot:
        is_hot = is_hot | F.coalesce(F.col(key).isin(hot), F.lit(False))
    part = F.when(is_hot, F.pmod(F.col(tie), F.lit(TIE_PARTS))).otherwise(F.lit(0))
    if splits:
        cutter = Bucketizer(
            splits=[float("-inf"), *splits, float("inf")],
            inputCol="__key",
            outputCol="__cut",
            handleInvalid="keep",
        )
        rows = cutter.transform(rows.withColumn("__key", F.col(key).cast("double")))
        base = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col("__cut").cast("long"))
    else:
        base = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0))
    return rows.withColumn(bucket, base.cast("long") * TIE_PARTS + part).drop("__key", "__cut")


def order_by(key: str, tie: str) -> list[Column]:
    """The order that ``with_order_bucket`` follows."""
    return [
        F.asc_nulls_first(key),
        F.pmod(F.col(tie), F.lit(TIE_PARTS)).asc(),
        F.asc_nulls_first(tie),
    ]


def bucket_offsets(rows: DataFrame, bucket: str, **sums: Column) -> DataFrame:
    """Per bucket, the sum of each measure over all earlier buckets, and ``<name>_all`` over all.

    The buckets are few (a small multiple of the shuffle partitions), so one task orders them.
    """
    totals = rows.groupBy(bucket).agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    return totals.select(
        bucket,
        *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums],
        *[F.sum(name).over(everything).alias(f"{name}_all") for name in sums],
    )
