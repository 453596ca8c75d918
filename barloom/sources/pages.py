"""Landed response pages to rows (SRC1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the field by which a page announces the next one.
NEXT_PAGE_FIELD = "pagination_key"


def read_pages(spark: SparkSession, path: str, one_page_per_file: bool = True) -> DataFrame:
    """Landed pages as ``request, page, body``.

    Pages lie at ``<path>/request=<id>/page=<n>/``, either one JSON document per
    file or one per line. The request and page number come from the directories.
    """
    layout = T.StructType(
        [
            T.StructField("value", T.StringType()),
            T.StructField("request", T.StringType()),
            T.StructField("page", T.LongType()),
        ]
    )
    pages = spark.read.schema(layout).text(path, wholetext=one_page_per_file)
    return pages.select("request", "page", F.col("value").alias("body"))


def flatten_pages(pages: DataFrame, data_key: str, record: T.StructType) -> DataFrame:
    """Records of all pages as rows with their ``request``, ``page`` and ``position``.

    A request whose first page lacks the data key gives no rows at all; a later
    page without it adds none. A page that is not JSON fails the job. Order is
    kept as columns, not by sorting.
    """
    envelope = T.StructType([T.StructField(data_key, T.ArrayType(record))])
    parsed = pages.select(
        "request",
        "page",
        F.from_json("body", envelope, {"mode": "FAILFAST"})[data_key].alias("records"),
    )
    # Only first pages are parsed here, and only keyless requests are kept, so the
    # side that is joined (and possibly broadcast by size) stays small.
    keyless = parsed.where((F.col("page") == 0) & F.col("records").isNull()).select("request")
    return (
        parsed.join(keyless, "request", "left_anti")
        .select("request", "page", F.posexplode("records").alias("position", "record"))
        .select("request", "page", "position", "record.*")
    )
