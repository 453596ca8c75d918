from __future__ import annotations

import pytest

from barloom.operators.listing import (
    listing_attributes,
    listing_row,
    prices_with_listing,
    resolve_codes,
    search_listing,
)
from tests.frames import listing, two_by_two


def test_search(spark):
    rows = listing(spark)
    hit = search_listing(rows, "CompanyNameEnglish", "Kyokuyo Co., Ltd.").collect()
    assert [r.Code for r in hit] == ["13010"]
    assert search_listing(rows, "CompanyName", "sample", "icontains").first().Code == "99990"
    literal = search_listing(rows, "CompanyNameEnglish", "(HOLD", "icontains")
    assert literal.first().Code == "99990"
    assert search_listing(rows, "CompanyName", "kyokuyo").isEmpty()
    with pytest.raises(ValueError):
        search_listing(rows, "UnknownField", "value")
    with pytest.raises(ValueError):
        search_listing(rows, "Code", "value", "regex")


def test_null_fields_and_empty_codes_never_match(spark):
    rows = spark.createDataFrame(
        [("1", None), ("", "abc"), (None, "abc"), ("2", "abc")], "Code string, Name string"
    )
    assert [r.Code for r in search_listing(rows, "Name", "B", "icontains").collect()] == ["2"]


def test_lookup(spark):
    assert listing_row(listing(spark), "13010").MarketCode == "0111"
    with pytest.raises(LookupError):
        listing_row(listing(spark), "00000")
    with pytest.raises(LookupError):
        listing_row(listing(spark).drop("Code"), "13010")
    assert listing_attributes(listing(spark)).orderBy("code").first().base_code == "1301"


def test_join_keeps_unlisted(spark):
    rows = prices_with_listing(two_by_two(spark), listing(spark))
    assert rows.count() == 4 and rows.where("company_name is not null").isEmpty()


@pytest.mark.parametrize(
    ("request_text", "code", "status"),
    [
        ("13010", "13010", "ok"),
        (" 1301 ", "13010", "ok"),
        ("1400", "14005", "ok"),
        ("1500", "15000", "ok"),
        ("1600", "1600", "ok"),
        ("1700", "17000", "ok"),
        ("1800", "18003", "ok"),
        ("1900", "19000", "ok"),
        ("13", None, "not 4 or 5 digits"),
        ("12a4", None, "not numeric"),
        ("", None, "not numeric"),
    ],
)
def test_resolution(spark, request_text, code, status):
    listed = [("13010",), ("13015",), ("14005",), ("15005",), ("15000",), ("1600",), ("16000",)]
    held = [("17000",), ("17005",), ("18003",), ("18005",), ("14000",)]
    rows = resolve_codes(
        spark.createDataFrame([(request_text,)], "request string"),
        spark.createDataFrame(listed, "Code string"),
        spark.createDataFrame(held, "code string"),
    ).collect()
    assert [(r.code, r.status) for r in rows] == [(code, status)]


def test_a_null_request_gets_a_status(spark):
    rows = resolve_codes(
        spark.createDataFrame([(None,)], "request string"),
        spark.createDataFrame([("13010",)], "Code string"),
        spark.createDataFrame([("13010",)], "code string"),
    )
    assert rows.first().status == "not numeric"
