from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.operators.adjust import adjust_prices
from barloom.operators.merge import (
    duplicate_keys,
    keep_last,
    merge_replacing,
    merge_skipping,
    pending_days,
    rewrite_stats,
)
from barloom.schemas import PRICE_COLUMNS
from barloom.sinks.prices import compact_by_security, merge_by_security, save_bucketed_table
from barloom.sources.prices import read_by_security, read_security_prices
from tests.frames import D15, D16, D17, price_row, prices, two_by_two


def closes(rows):
    return sorted((r.code, r.date, r.close) for r in rows.collect())


def test_skipping_and_replacing(spark):
    stored = prices(spark, [price_row("1", D15, 100.0), price_row("1", D16, 101.0)])
    incoming = prices(
        spark, [price_row("1", D16, 999.0, processed_at="t2"), price_row("1", D17, 102.0)]
    )
    assert closes(merge_skipping(stored, incoming)) == [
        ("1", D15, 100.0),
        ("1", D16, 101.0),
        ("1", D17, 102.0),
    ]
    forced = merge_replacing(stored, incoming)
    assert closes(forced)[1] == ("1", D16, 999.0)
    assert closes(merge_replacing(forced, incoming)) == closes(forced)


def test_both_merges_agree_without_overlap(spark):
    stored, incoming = (
        prices(spark, [price_row("1", D15)]),
        prices(spark, [price_row("1", D16)]),
    )
    assert closes(merge_skipping(stored, incoming)) == closes(merge_replacing(stored, incoming))


def test_last_copy_wins_even_on_first_write(spark):
    rows = prices(
        spark,
        [
            price_row("1", D15, 1.0, processed_at="t1"),
            price_row("1", D15, 2.0, processed_at="t3"),
            price_row("1", D15, 3.0, processed_at="t2"),
        ],
    )
    assert closes(keep_last(rows, ["processed_at"])) == [("1", D15, 2.0)]
    assert duplicate_keys(rows).first().copies == 3


def test_hot_key_is_cut_before_the_shuffle(spark):
    rows = prices(spark, [price_row("1", D15)]).crossJoin(spark.range(5)).drop("id")
    plan = keep_last(rows, ["processed_at"])._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.rindex("WindowGroupLimit"), plan.index("Exchange")
    assert partial > exchange


def test_pending_days(spark):
    wanted, stored = two_by_two(spark), prices(spark, [price_row("1", D15)])
    assert [r.date for r in pending_days(wanted, stored).collect()] == [D16]
    assert pending_days(wanted, stored, force=True).count() == 2


def test_stats(spark):
    stats = rewrite_stats(two_by_two(spark)).first()
    assert tuple(stats) == (2, 2, 4)


@pytest.mark.parametrize("buckets", [1, 4])
def test_dataset_merges(spark, tmp_path, buckets):
    path = str(tmp_path / "by_security")
    first = merge_by_security(two_by_two(spark), path, buckets)
    assert first == {
        "dates_processed": 2,
        "stocks_input": 2,
        "records_input": 4,
        "stocks_written": 2,
        "records_written": 4,
    }
    again = merge_by_security(two_by_two(spark), path, buckets)
    assert (again["records_input"], again["records_written"]) == (4, 0)

    late = prices(
        spark,
        [price_row("1301", D16, 999.0, processed_at="t2"), price_row("1301", D17, 103.0)],
    )
    merge_by_security(late, path, buckets)
    stored = read_by_security(spark, path).select(*PRICE_COLUMNS)
    assert stored.count() == 5 and stored.where("close = 999").isEmpty()
    merge_by_security(late, path, buckets, force=True)
    stored = read_by_security(spark, path).select(*PRICE_COLUMNS)
    assert stored.count() == 5 and stored.where("close = 999").count() == 1
    assert duplicate_keys(stored).isEmpty()

    one = read_security_prices(spark, path, buckets, "1301", start=D16, columns=["volume", "close"])
    assert one.columns == ["code", "date", "volume", "close"]
    assert one.count() == 2
    assert read_security_prices(spark, path, buckets, "0000").isEmpty()


def test_older_years_are_left_alone(spark, tmp_path):
    from datetime import date

    path = str(tmp_path / "years")
    merge_by_security(prices(spark, [price_row("1", date(2020, 5, 5))]), path, 2)
    before = {r.path for r in spark.read.format("binaryFile").load(path + "/year=2020").select("path").collect()}
    merge_by_security(prices(spark, [price_row("1", D15)]), path, 2, force=True)
    after = {r.path for r in spark.read.format("binaryFile").load(path + "/year=2020").select("path").collect()}
    assert before == after
    assert read_by_security(spark, path).count() == 2


def test_increments_are_appended_and_compacted(spark, tmp_path):
    path = str(tmp_path / "increments")
    for day in (D15, D16, D17):
        merge_by_security(prices(spark, [price_row("1", day), price_row("2", day)]), path, 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    assert files.option("pathGlobFilter", "*.parquet").load(path).count() == 3
    compact_by_security(spark, path, 1, [2024])
    assert files.option("pathGlobFilter", "*.parquet").load(path).count() == 1
    stored = read_by_security(spark, path)
    assert stored.count() == 6 and duplicate_keys(stored).isEmpty()


def test_one_security_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "pruned")
    rows = prices(spark, [price_row(f"{n:05d}", D15) for n in range(40)])
    merge_by_security(rows, path, 8)
    scan = read_security_prices(spark, path, 8, "00007", start=D15)
    assert scan.count() == 1
    assert len(scan.inputFiles()) >= 1
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1]
    assert "EqualTo(code,00007)" in plan or "In(code, [00007])" in plan


def test_bucketed_bars_are_adjusted_without_a_shuffle(spark, tmp_path):
    rows = prices(spark, [price_row(f"{n:05d}", day) for n in range(9) for day in (D15, D16)])
    table = save_bucketed_table(rows, "bucketed_bars", str(tmp_path / "bars"), 4)
    plan = adjust_prices(table, "add")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    assert adjust_prices(table, "add").count() == 18
    spark.sql("DROP TABLE bucketed_bars")


@pytest.mark.parametrize("force", [False, True])
def test_what_is_offered_is_worked_out_once(spark, tmp_path, force):
    path = str(tmp_path / "once")
    merge_by_security(prices(spark, [price_row("1301", D15)]), path, 4)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(code):
        seen.add(1)
        return code

    offered = two_by_two(spark).withColumn("code", counted("code"))
    assert merge_by_security(offered, path, 4, force)["records_input"] == 4
    assert seen.value == 4
