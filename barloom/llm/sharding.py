"""Contiguous shards of near-equal bytes, from a global prefix sum over per-partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import bucket_offsets, order_by, settle, with_order_bucket


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text) to one of ``shards`` runs of ascending doc_id.

    Returns doc_id, size (UTF-8 bytes of the text, plus 1), text_crc32, shard, slot. A row goes to
    the shard that its middle byte falls into when all bytes are cut into equal runs, so a shard
    is off its target by less than one text at either end; a text longer than a target leaves
    shards beside it short or empty.

    Null text counts as empty; null doc_ids come first; rows of one doc_id are ordered by their
    text's hash, so equal rows may swap places. Other columns are ignored; no rows give no rows.

    Only 32 bytes a row are shuffled. Rows are dealt into ordered buckets; bucket totals give each
    bucket its offset; within a bucket a running sum does the rest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = settle(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("__tie"),
        )
    )
    rows = with_order_bucket(narrow, "doc_id", "__tie", "__bucket")
    offsets = bucket_offsets(rows, "__bucket", __bytes=F.col("size"), __rows=F.lit(1))
    inside = (
        Window.partitionBy("__bucket")
        .orderBy(*order_by("doc_id", "__tie"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    middle = 2 * (F.col("__bytes") + F.sum("size").over(inside)) - F.col("size")
    placed = rows.join(offsets, "__bucket").select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr("__rows").alias("__before"),
        F.row_number().over(inside).alias("__nth"),
        middle.alias("__middle"),
        F.col("__bytes_all"),
    )
    placed = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.least(
            F.expr(f"__middle * {shards} DIV (2 * __bytes_all)"), F.lit(shards - 1)
        ).cast("int").alias("shard"),
        (F.col("__before") + F.col("__nth") - 1).alias("__row"),
    )
    firsts = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__row") - F.col("__first")).alias("slot")
    )
