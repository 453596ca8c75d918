from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.normalize import BAD_VALUE, fill_adj_close, normalize_quotes
from barloom.schemas import DAILY_PRICES, PRICE_COLUMNS
from tests.frames import D15, RAW, RAW_ROWS, raw_quotes


def test_schema_and_values(spark):
    rows = normalize_quotes(raw_quotes(spark), "now")
    assert [(f.name, f.dataType) for f in rows.schema] == [
        (f.name, f.dataType) for f in DAILY_PRICES
    ]
    by_code = {row.code: row for row in rows.collect()}
    assert by_code["1301"].date == D15
    assert by_code["1332"].adj_close == 225.5
    assert by_code["1301"].volume == 100000
    assert by_code["1301"].processed_at == "now"


def test_missing_adjusted_close_is_filled(spark):
    rows = raw_quotes(
        spark,
        [
            RAW_ROWS[0][:8] + (1.1, None),
            ("1302",) + RAW_ROWS[0][1:7] + (None, None, None),
        ],
    )
    filled = {r.code: r.adj_close for r in normalize_quotes(rows, "now").collect()}
    assert filled["1301"] == pytest.approx(112.2)
    assert filled["1302"] == 102.0


def test_null_core_rows_are_dropped(spark):
    base = RAW_ROWS[0]
    rows = [base, (None, *base[1:]), (base[0], None, *base[2:]), (*base[:5], None, *base[6:])]
    assert normalize_quotes(raw_quotes(spark, rows), "now").count() == 1


def test_lenient_and_strict_casts(spark):
    text = raw_quotes(spark).withColumn("TurnoverValue", F.lit("n/a"))
    assert {r.turnover_value for r in normalize_quotes(text, "now").collect()} == {None}
    broken = raw_quotes(spark).withColumn("Open", F.lit("n/a"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        normalize_quotes(broken, "now").collect()
    undated = raw_quotes(spark).withColumn("Date", F.lit("15/01/2024"))
    with pytest.raises(Exception, match="CANNOT_PARSE"):
        normalize_quotes(undated, "now").collect()


def test_flagging_keeps_and_marks_malformed_rows(spark):
    rows = raw_quotes(spark).withColumn(
        "Close", F.when(F.col("Code") == "1301", F.lit("x")).otherwise(F.lit("205"))
    )
    flags = {
        r.code: r[BAD_VALUE] for r in normalize_quotes(rows, "now", on_bad_value="flag").collect()
    }
    assert flags == {"1301": True, "1332": False}


def test_not_a_number_counts_as_missing(spark):
    rows = raw_quotes(spark, [(*RAW_ROWS[0][:9], float("nan")), (*RAW_ROWS[1][:5], float("nan"), *RAW_ROWS[1][6:])])
    kept = normalize_quotes(rows, "now").collect()
    assert [r.code for r in kept] == ["1301"]
    assert kept[0].adj_close == 102.0


def test_fill_leaves_present_values(spark):
    rows = spark.createDataFrame(
        [(10.0, 2.0, 7.0), (10.0, 2.0, None), (10.0, None, None)],
        "close double, adjustment_factor double, adj_close double",
    )
    assert sorted(r.adj_close for r in fill_adj_close(rows).collect()) == [7.0, 10.0, 20.0]


def test_codes_stay_text(spark, tmp_path):
    path = str(tmp_path / "quotes")
    raw = raw_quotes(spark, [("01301", *RAW_ROWS[0][1:])])
    normalize_quotes(raw, "now").write.partitionBy("code").parquet(path)
    back = spark.read.schema(DAILY_PRICES).parquet(path).select(*PRICE_COLUMNS)
    assert back.first().code == "01301"
    assert isinstance(back.schema["code"].dataType, T.StringType)
    assert RAW.startswith("Code string")
