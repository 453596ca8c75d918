"""Listing search, lookup, joins and code resolution (PRJ12-PRJ15, JN3, JN4)."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from barloom.functions import base_code, clean_code

# Listing attributes offered as accessors.
ATTRIBUTES = {
    "company_name": "CompanyName",
    "company_name_english": "CompanyNameEnglish",
    "sector17_code": "Sector17Code",
    "sector33_code": "Sector33Code",
    "market_code": "MarketCode",
}


def search_listing(
    listing: DataFrame, field: str, value: str, match: Literal["exact", "icontains"] = "exact"
) -> DataFrame:
    """Listing rows whose field equals, or contains regardless of case, the value (PRJ12).

    The value is a literal, never a pattern; rows without a code are left out.
    """
    if field not in listing.columns:
        raise ValueError(f"{field!r} is not a listing column; there are {listing.columns}")
    text = F.col(field).cast("string")
    if match == "exact":
        hit = text == value
    elif match == "icontains":
        hit = F.contains(F.lower(text), F.lit(value.lower()))
    else:
        raise ValueError(f"unknown kind of match {match!r}")
    return listing.where(hit & (F.col("Code") != ""))


def listing_row(listing: DataFrame, code: str) -> Row:
    """The listing row of one code (PRJ13)."""
    if "Code" not in listing.columns:
        raise LookupError("the listing has no 'Code' column")
    found = listing.where(F.col("Code") == code).limit(1).collect()
    if not found:
        raise LookupError(f"{code} is not in the listing")
    return found[0]


def listing_attributes(listing: DataFrame) -> DataFrame:
    """Code, base code and the accessor attributes of every listed security (PRJ14, PRJ15)."""
    present = {new: old for new, old in ATTRIBUTES.items() if old in listing.columns}
    return listing.select(
        F.col("Code").alias("code"),
        base_code(F.col("Code")).alias("base_code"),
        *(F.col(old).alias(new) for new, old in present.items()),
    )


def prices_with_listing(prices: DataFrame, listing: DataFrame) -> DataFrame:
    """Attach listing attributes; unlisted securities keep null attributes (JN3).

    No broadcast hint: the planner broadcasts the listing only below its size
    limit, and otherwise adaptive execution splits an oversized security.
    """
    return prices.join(listing_attributes(listing).drop("base_code"), "code", "left")


def resolve_codes(
    requests: DataFrame, listing: DataFrame, stored: DataFrame, request: str = "request"
) -> DataFrame:
    """Resolve requested codes to stored codes in bulk (JN4).

    Five digits stand as they are. Four digits take an exact listing hit, else the
    best listed code sharing the base, else the best stored one, else a ``0`` is
    appended. The best code is the smallest one ending in ``0``, else the smallest.
    Anything else gets a ``status`` instead of an error.
    """
    length = F.length("_clean")
    status = (
        F.when(~F.coalesce(F.col("_clean").rlike(r"\A[0-9]+\z"), F.lit(False)), "not numeric")
        .when(~length.isin(4, 5), "not 4 or 5 digits")
        .otherwise("ok")
    )
    # The whole request is the join key: bases have four characters, so other
    # requests find nothing, and no null key gathers them in one task.
    asked = requests.withColumn("_clean", clean_code(F.col(request))).withColumn("status", status)
    listed = _best_by_base(listing.select(F.col("Code").cast("string").alias("code")), "_listed")
    held = _best_by_base(stored.select("code"), "_stored")
    best = F.coalesce(
        F.when(F.col("_listed.exact"), F.col("_clean")),
        F.col("_listed.best"),
        F.col("_stored.best"),
        F.concat("_clean", F.lit("0")),
    )
    code = F.when(F.col("status") != "ok", F.lit(None)).when(length == 5, F.col("_clean"))
    return (
        asked.join(listed, "_clean", "left")
        .join(held, "_clean", "left")
        .select(*requests.columns, code.otherwise(best).alias("code"), "status")
    )


def _best_by_base(codes: DataFrame, name: str) -> DataFrame:
    """One row per base: its best code, and whether the bare base is itself a code.

    Codes are made distinct by a hash aggregate first; the smallest of a struct
    needs a sorting one, which then sees only distinct codes.
    """
    rank = F.struct((~F.col("code").endswith("0")).alias("other"), F.col("code").alias("code"))
    return (
        codes.where(F.length("code") >= 4)
        .distinct()
        .groupBy(base_code(F.col("code")).alias("_clean"))
        .agg(F.min(rank).alias("top"), F.max(F.length("code") == 4).alias("exact"))
        .select("_clean", F.struct(F.col("top.code").alias("best"), "exact").alias(name))
    )
