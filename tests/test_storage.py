from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import PriceLake, Security, search_securities
from barloom.operators.summary import daily_counts
from barloom.plans.views import register_views, run_sql
from barloom.schemas import RAW_QUOTES
from barloom.sinks.files import save_table
from barloom.sinks.prices import merge_by_security
from barloom.sinks.raw import store_raw, with_lineage
from barloom.sources import endpoints
from barloom.sources.files import load_table
from barloom.sources.inventory import available_days, data_files, storage_stats
from barloom.sources.prices import read_by_security
from barloom.sources.pages import flatten_pages, read_pages
from barloom.sources.raw import read_latest, read_raw
from barloom.streaming.arrivals import normalize_arrivals
from tests.frames import D15, D16, D17, RAW_ROWS, listing, raw_quotes

QUOTE = "Code string, Date string, Close double, Volume long"
RECORD = T.StructType([T.StructField("Code", T.StringType()), T.StructField("Close", T.DoubleType())])


def quotes(spark, day, count=2):
    rows = [(f"130{n % 10}", day.isoformat(), 100.0 + n, n) for n in range(count)]
    return spark.createDataFrame(rows, QUOTE)


def stored(spark, root):
    for day in (D15, D16, D17):
        store_raw(quotes(spark, day), root, "daily_quotes", day)
    return root


def test_raw_scans(spark, tmp_path):
    root = stored(spark, str(tmp_path))
    assert read_raw(spark, root, "daily_quotes").count() == 6
    assert read_raw(spark, root, "daily_quotes", on=D15).count() == 2
    assert read_raw(spark, root, "daily_quotes", between=(D15, D16)).count() == 4
    assert read_raw(spark, root, "daily_quotes", on=date(2020, 1, 1)).isEmpty()
    assert read_raw(spark, root, "nothing").isEmpty()
    assert read_raw(spark, root, "nothing", schema=RAW_QUOTES).columns[0] == "Code"
    with pytest.raises(ValueError):
        read_raw(spark, root, "daily_quotes", on=D15, between=(D15, D16))


def test_only_wanted_days_are_opened(spark, tmp_path):
    root = stored(spark, str(tmp_path))
    scan = read_raw(spark, root, "daily_quotes", on=D16)
    assert scan.select(F.input_file_name()).distinct().count() == 1
    filters = scan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1]
    assert "2024-01-16" in filters.split("]")[0]


def test_storing_again_replaces_the_day_only(spark, tmp_path):
    root = stored(spark, str(tmp_path))
    store_raw(quotes(spark, D16, 5), root, "daily_quotes", D16)
    counts = daily_counts(read_raw(spark, root, "daily_quotes"), "Date").orderBy("Date").collect()
    assert [r.record_count for r in counts] == [2, 5, 2]


def test_empty_response_leaves_the_day_pending(spark, tmp_path):
    root = str(tmp_path)
    store_raw(quotes(spark, D15).limit(0), root, "daily_quotes", D15)
    assert available_days(spark, f"{root}/daily_quotes").isEmpty()


def test_badly_named_partitions_are_ignored(spark, tmp_path):
    root = stored(spark, str(tmp_path))
    quotes(spark, D15).write.parquet(f"{root}/daily_quotes/partition_date=invalid")
    schema = T.StructType(quotes(spark, D15).schema.fields)
    assert read_raw(spark, root, "daily_quotes").count() == 6
    assert read_raw(spark, root, "daily_quotes", schema=schema).count() == 6
    days = sorted(r.date for r in available_days(spark, f"{root}/daily_quotes").collect())
    assert days == [D15, D16, D17]


def test_many_rows(spark, tmp_path):
    store_raw(quotes(spark, D15, 1000), str(tmp_path), "daily_quotes", D15)
    rows = read_raw(spark, str(tmp_path), "daily_quotes")
    assert rows.count() == 1000 and rows.where("Code = '1300'").count() == 100


def test_lineage(spark):
    plain = with_lineage(quotes(spark, D15), "daily_quotes", D15, "then")
    row = plain.first()
    assert (row._endpoint, row._partition_date, row._ingested_at) == ("daily_quotes", "2024-01-15", "then")
    assert "_metadata" not in plain.columns
    full = with_lineage(quotes(spark, D15), "daily_quotes", D15, metadata={"count": 2, "call": "x"})
    assert json.loads(full.select("_metadata").first()[0]) == {"count": 2, "call": "x"}


def test_latest_snapshot(spark, tmp_path):
    root = str(tmp_path)
    store_raw(listing(spark), root, "listed_info", D15)
    store_raw(listing(spark).limit(1), root, "listed_info", D17)
    assert read_latest(spark, root, "listed_info").count() == 1
    assert read_latest(spark, root, "listed_info", as_of=D16).count() == 2
    assert read_latest(spark, root, "listed_info", as_of=date(2020, 1, 1)).isEmpty()
    assert read_latest(spark, root, "nothing").isEmpty()


def test_stats(spark, tmp_path):
    root = stored(spark, str(tmp_path))
    store_raw(listing(spark), root, "listed_info", D15)
    stats = {r.dataset: r for r in storage_stats(spark, root, ["daily_quotes", "listed_info"]).collect()}
    assert (stats["daily_quotes"].dates, stats["listed_info"].dates) == (3, 1)
    assert stats["total"].files == stats["daily_quotes"].files + stats["listed_info"].files
    assert stats["total"].files == data_files(spark, root).count()


def test_pages(spark, tmp_path):
    def page(request, number, body):
        folder = tmp_path / f"request={request}" / f"page={number}"
        folder.mkdir(parents=True)
        (folder / "body.json").write_text(json.dumps(body, indent=1))

    record = [{"Code": "01301", "Close": 1.5}, {"Code": "2", "Close": None}]
    page("a", 0, {"info": record, "pagination_key": "k"})
    page("a", 1, {"other": []})
    page("a", 2, {"info": [{"Code": "3", "Close": 3}]})
    page("b", 0, {"message": "none", "pagination_key": "k"})
    page("b", 1, {"info": record})
    rows = flatten_pages(read_pages(spark, str(tmp_path)), "info", RECORD)
    ordered = rows.orderBy("request", "page", "position").collect()
    assert [(r.request, r.page, r.position, r.Code, r.Close) for r in ordered] == [
        ("a", 0, 0, "01301", 1.5),
        ("a", 0, 1, "2", None),
        ("a", 2, 0, "3", 3.0),
    ]


def test_page_that_is_not_json_fails(spark):
    pages = spark.createDataFrame([("a", 0, "<html>")], "request string, page long, body string")
    with pytest.raises(Exception, match="MALFORMED"):
        flatten_pages(pages, "info", RECORD).collect()


def test_endpoint_scans(spark):
    raw = raw_quotes(spark)
    assert endpoints.daily_quotes(raw, "1301").count() == 1
    assert endpoints.daily_quotes(raw, on=D15).count() == 2
    assert endpoints.daily_quotes(raw, start=D16).isEmpty()
    days = [("2024-01-04", "0"), ("2024-01-05", "0"), ("2024-01-06", "1"), ("2024-01-07", "0")]
    calendar = spark.createDataFrame(days, "Date string, HolidayDivision string")
    assert endpoints.trading_calendar(calendar, "1").first().Date == "2024-01-06"
    assert endpoints.trading_calendar(calendar, start=date(2024, 1, 5), end=date(2024, 1, 6)).count() == 2
    facts = spark.createDataFrame(
        [("1301", "2024-01-15"), ("1302", "2024-01-16")], "LocalCode string, DisclosedDate string"
    )
    assert endpoints.statements(facts, "1301").count() == 1
    assert endpoints.statements(facts, disclosed_on=D16).first().LocalCode == "1302"
    assert endpoints.announcements(facts).count() == 2


@pytest.mark.parametrize("name", ["out.parquet", "out.csv"])
def test_saved_tables_read_back(spark, tmp_path, name):
    path = str(tmp_path / name)
    save_table(listing(spark), path)
    assert load_table(spark, path).orderBy("Code").first().Code == "13010"
    assert sorted(load_table(spark, path, listing(spark).schema).collect()) == sorted(
        listing(spark).collect()
    )


@pytest.fixture
def lake(spark, tmp_path):
    built = PriceLake(spark, str(tmp_path), buckets=4)
    built.land(raw_quotes(spark), "daily_quotes", D15)
    second = [(c, "2024-01-16", *rest[:-2], 0.5, None) for c, _, *rest in RAW_ROWS]
    built.land(raw_quotes(spark, second), "daily_quotes", D16)
    broken = [(*RAW_ROWS[0][:2], 101.0, 90.0, *RAW_ROWS[0][4:])]
    built.land(raw_quotes(spark, broken).withColumn("Date", F.lit("2024-01-17")), "daily_quotes", D17)
    names = [("13010", "Kyokuyo"), ("1332", "Bare"), ("1301", "Short")]
    built.land(spark.createDataFrame(names, "Code string, CompanyName string"), "listed_info", D15)
    return built


def test_layers_end_to_end(lake):
    report = {r.partition_date: r.reason for r in lake.normalize(processed_at="t1").collect()}
    assert report == {"2024-01-15": None, "2024-01-16": None, "2024-01-17": "broken_bar"}
    assert sorted(r.date for r in lake.price_days().collect()) == [D15, D16]
    assert lake.daily_prices(D16, D17).count() == 2
    assert lake.daily_prices(codes=["1301"]).count() == 2
    bad = lake.spark.read.parquet(lake.quarantine_path)
    assert [r.reason for r in bad.select("reason").collect()] == ["broken_bar"]

    pending = [r.partition_date for r in lake.normalize(processed_at="t2").collect()]
    assert pending == ["2024-01-17"]
    assert {r.processed_at for r in lake.daily_prices().collect()} == {"t1"}
    lake.normalize(processed_at="t3", force=True)
    assert {r.processed_at for r in lake.daily_prices().collect()} == {"t3"}

    stats = lake.cluster()
    assert (stats["dates_processed"], stats["stocks_written"], stats["records_written"]) == (2, 2, 4)
    assert sorted(r.code for r in lake.codes().collect()) == ["1301", "1332"]
    per_code = {r.code: r.records for r in lake.security_stats().collect()}
    assert per_code == {"1301": 2, "1332": 2}
    assert lake.price_stats().where("dataset = 'total'").first().dates == 2

    stock = Security("1301", lake)
    assert stock.code == "1301" and stock.company_name == "Short" and stock.base_code == "1301"
    assert stock.listing.Code == "1301"
    assert [r.close for r in stock.series("close").orderBy("date").collect()] == [51.0, 102.0]
    assert stock.events().first().date == D16
    assert stock.latest()["close"] == 102.0
    assert stock.history(D16, columns=["close"]).count() == 1
    assert Security("77777", lake).latest() is None
    assert Security("7777", lake).code == "77770"
    with pytest.raises(ValueError, match="not numeric"):
        Security("abc", lake)
    with pytest.raises(LookupError):
        _ = Security("77777", lake).listing
    assert search_securities(lake, "CompanyName", "kyo", "icontains").first().Code == "13010"

    register_views(lake, ("listed_info",))
    counted = run_sql(
        lake.spark, "SELECT count(*) AS n FROM daily_prices WHERE code = :code", code="1301"
    )
    assert counted.first().n == 2
    assert lake.spark.table("raw_listed_info").count() == 3


def test_rows_landed_under_another_day(spark, tmp_path):
    """A day that holds rows of another date is rejected, so one-day reads miss nothing."""
    lake = PriceLake(spark, str(tmp_path), buckets=2)
    lake.land(raw_quotes(spark), "daily_quotes", D15)
    lake.land(raw_quotes(spark), "daily_quotes", D16)
    report = {r.partition_date: r.reason for r in lake.normalize(processed_at="t").collect()}
    assert report == {"2024-01-15": None, "2024-01-16": "misdated_rows"}
    assert lake.daily_prices(D15, D16).count() == lake.daily_prices(D15, D15).count() == 2
    assert lake.daily_prices(D16, D16).isEmpty()
    assert lake.cluster()["records_written"] == 2


def test_days_of_other_schemas(spark, tmp_path):
    """A day with another type is cast; one without a column is rejected; the others are stored."""
    lake = PriceLake(spark, str(tmp_path), buckets=2)
    lake.land(raw_quotes(spark), "daily_quotes", D15)
    other = raw_quotes(spark).withColumn("Date", F.lit("2024-01-16"))
    lake.land(other.withColumn("Volume", F.col("Volume").cast("double")), "daily_quotes", D16)
    lacking = raw_quotes(spark).withColumn("Date", F.lit("2024-01-17")).drop("AdjustmentFactor")
    lake.land(lacking, "daily_quotes", D17)
    report = {r.partition_date: r.reason for r in lake.normalize(processed_at="t").collect()}
    assert report == {"2024-01-15": None, "2024-01-16": None, "2024-01-17": "schema"}
    assert lake.daily_prices().count() == 4
    assert lake.daily_prices(D16).first().volume is not None
    assert spark.read.parquet(lake.quarantine_path).count() == 2


def test_the_last_verdict_counts(spark, tmp_path):
    lake = PriceLake(spark, str(tmp_path), buckets=2)
    good = raw_quotes(spark)
    bad = good.withColumn("High", F.lit(1.0))

    def stored():
        held = {r.date for r in available_days(spark, lake.quarantine_path).collect()}
        return lake.daily_prices().count(), held

    for rows, wanted in ((bad, (0, {D15})), (good, (2, set())), (bad, (0, {D15}))):
        lake.land(rows, "daily_quotes", D15)
        lake.normalize(processed_at="t", force=True)
        assert stored() == wanted


def test_one_security_lies_in_one_file_of_a_year(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.format_string("%04d", F.col("id") % 40).alias("code"),
        F.date_add(F.lit(D15), (F.col("id") / 40).cast("int") % 300).alias("date"),
        *[F.lit(1.0).alias(name) for name in ("open", "high", "low", "close")],
        F.lit(1).cast("long").alias("volume"),
        *[F.lit(1.0).alias(name) for name in ("turnover_value", "adjustment_factor", "adj_close")],
        F.lit("t").alias("processed_at"),
    )
    path = str(tmp_path / "bars")
    merge_by_security(rows, path, 2)
    stored = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    files = stored.groupBy("code", "year").agg(F.count_distinct("file").alias("n"))
    assert files.agg(F.max("n")).first()[0] == 1
    late = rows.where("code < '0004'").withColumn("close", F.lit(2.0))
    assert merge_by_security(late, path, 2, force=True)["records_written"] == 1200
    assert read_by_security(spark, path).where("close = 2.0").count() == 1200
    assert read_by_security(spark, path).count() == 12_000


def test_a_lake_whose_days_are_all_rejected_has_no_securities(spark, tmp_path):
    lake = PriceLake(spark, str(tmp_path / "lake"), 4)
    worthless = [(*RAW_ROWS[0][:5], 0.0, *RAW_ROWS[0][6:])]
    lake.land(raw_quotes(spark, worthless), "daily_quotes", D15)
    assert [r.reason for r in lake.normalize(processed_at="s").collect()] == ["non_positive_close"]
    assert lake.cluster()["records_written"] == 0
    stats = lake.security_stats()
    assert stats.columns == ["code", "records", "files", "size_mb"]
    assert stats.collect() == [] and lake.codes().collect() == []


def test_arrivals_are_processed_once(lake, tmp_path):
    spark, checkpoint = lake.spark, str(tmp_path / "checkpoint")
    schema = spark.read.parquet(f"{lake.raw_root}/daily_quotes").drop("partition_date").schema
    normalize_arrivals(lake, checkpoint, "s1", schema)
    assert sorted(r.date for r in lake.price_days().collect()) == [D15, D16]
    normalize_arrivals(lake, checkpoint, "s2", schema)
    assert {r.processed_at for r in lake.daily_prices().collect()} == {"s1"}
    lake.land(raw_quotes(spark), "daily_quotes", date(2024, 1, 15))
    normalize_arrivals(lake, checkpoint, "s3", schema)
    assert {(r.date, r.processed_at) for r in lake.daily_prices().collect()} == {
        (D15, "s3"),
        (D16, "s1"),
    }
