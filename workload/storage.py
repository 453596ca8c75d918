"""Scans, sinks and inventory (SRC, SNK, INV)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barloom.operators.adjust import adjust_prices
from barloom.operators.history import not_of_codes
from barloom.operators.merge import merge_replacing, merge_skipping, pending_days, rewrite_stats
from barloom.plans.views import register_views, run_sql
from barloom.schemas import (
    DAILY_QUOTES_ENDPOINT,
    LISTED_INFO_ENDPOINT,
    PRICE_COLUMNS,
    RAW_QUOTES,
)
from barloom.session import new_folder
from barloom.sinks.files import save_table
from barloom.sinks.prices import merge_by_security, save_bucketed_table
from barloom.sinks.raw import with_lineage
from barloom.sources import endpoints
from barloom.sources.files import load_table
from barloom.sources.inventory import storage_stats as dataset_stats
from barloom.sources.pages import flatten_pages as pages_to_rows
from barloom.sources.prices import read_by_security
from workload import inputs
from workload.inputs import sql
from workload.registry import query

_RAW = ", ".join(f'"{name}"' for name in RAW_QUOTES.fieldNames())
_ALL = ", ".join(PRICE_COLUMNS)


@query(
    """WITH p AS (SELECT event_id, event_type, value, event_id // 100 AS n FROM events),
    q AS (SELECT *, n // 10 AS r, n % 10 AS page FROM p),
    k AS (SELECT *, r % 97 = 5 AS keyless FROM q)
    SELECT CAST(r AS VARCHAR) AS request, page,
        CAST(row_number() OVER (PARTITION BY n ORDER BY event_id) - 1 AS INTEGER) AS position,
        event_id, event_type, value FROM k
    WHERE NOT keyless AND r NOT IN (SELECT r FROM k WHERE page = 0 AND keyless)"""
)
def flatten_pages(spark, folder):
    return pages_to_rows(inputs.pages(spark, folder), "daily_quotes", inputs.PAGE_RECORD)


@query(
    sql(
        """SELECT * FROM calendar WHERE "HolidayDivision" = '0'
        AND "Date" BETWEEN '1996-01-01' AND '1998-12-31'""",
        "calendar",
    )
)
def trading_calendar(spark, folder):
    rows = inputs.calendar(spark, folder)
    return endpoints.trading_calendar(rows, "0", date(1996, 1, 1), date(1998, 12, 31))


@query(
    sql(
        """SELECT * FROM raw_quotes WHERE "Code" = '00070'
        AND "Date" BETWEEN '2024-01-03' AND '2024-01-25'""",
        "raw_quotes",
    )
)
def quotes_scan(spark, folder):
    rows = inputs.raw_quotes(spark, folder)
    return endpoints.daily_quotes(rows, "00070", start=date(2024, 1, 3), end=date(2024, 1, 25))


@query(
    sql(
        """SELECT "Code", "CompanyName" || ' KK' AS "CompanyName", "CompanyNameEnglish",
        "Sector17Code", "Sector17CodeName", "Sector33Code", "Sector33CodeName", "MarketCode",
        "MarketCodeName", '2024-01-26' AS partition_date FROM listing""",
        "listing",
    )
)
def latest_snapshot(spark, folder):
    return inputs.lake(spark, folder).listing()


@query(sql("""SELECT *, '2024-01-05' AS partition_date FROM listing""", "listing"))
def listing_scan(spark, folder):
    listed = inputs.lake(spark, folder).listing(as_of=date(2024, 1, 20))
    return endpoints.listed_info(listed)


@query(
    sql(
        "SELECT * FROM statements WHERE disclosed_date = DATE '1998-08-15'",
        "statements",
    )
)
def statements_scan(spark, folder):
    rows = inputs.statements(spark, folder)
    return endpoints.statements(rows, None, date(1998, 8, 15), "code", "disclosed_date")


@query(sql("SELECT code, disclosed_date, quarter FROM statements", "statements"))
def announcements_scan(spark, folder):
    rows = inputs.statements(spark, folder).select("code", "disclosed_date", "quarter")
    return endpoints.announcements(rows)


@query(
    sql(
        f"""SELECT {_RAW}, "Date" AS partition_date FROM raw_quotes
        WHERE "Date" = '2024-01-15'""",
        "raw_quotes",
    )
)
def raw_scan_date(spark, folder):
    lake = inputs.lake(spark, folder)
    return lake.raw(DAILY_QUOTES_ENDPOINT, on=date(2024, 1, 15), schema=RAW_QUOTES)


@query(
    sql(
        f"""SELECT {_RAW}, "Date" AS partition_date FROM raw_quotes
        WHERE "Date" BETWEEN '2024-01-10' AND '2024-01-24'""",
        "raw_quotes",
    )
)
def raw_scan_range(spark, folder):
    days = (date(2024, 1, 10), date(2024, 1, 24))
    return inputs.lake(spark, folder).raw(DAILY_QUOTES_ENDPOINT, between=days, schema=RAW_QUOTES)


@query(sql(f"""SELECT {_RAW}, "Date" AS partition_date FROM raw_quotes""", "raw_quotes"))
def raw_scan_all(spark, folder):
    return inputs.lake(spark, folder).raw(DAILY_QUOTES_ENDPOINT, schema=RAW_QUOTES)


@query(
    sql(
        f"""SELECT {_ALL} FROM accepted
        WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'""",
        "accepted",
    )
)
def silver_scan_range(spark, folder):
    scan = inputs.lake(spark, folder).daily_prices(date(2024, 1, 5), date(2024, 1, 25))
    return scan.orderBy("date", "code")


@query(
    sql(
        f"""SELECT {_ALL} FROM accepted WHERE code IN
        (SELECT "Code" FROM listing WHERE "MarketCodeName" = 'ASIA')""",
        "accepted",
        "listing",
    )
)
def silver_scan_codes(spark, folder):
    listed = inputs.listing(spark, folder).where("MarketCodeName = 'ASIA'")
    codes = listed.select(F.col("Code").alias("code"))
    return inputs.lake(spark, folder).daily_prices(codes=codes)


@query(
    sql(
        f"""SELECT {_ALL} FROM accepted WHERE code = '00080'
        AND date >= DATE '2024-01-04'""",
        "accepted",
    )
)
def gold_scan_code(spark, folder):
    scan = inputs.lake(spark, folder).security_prices("00080", start=date(2024, 1, 4))
    return scan.orderBy("date")


@query(
    sql(
        """SELECT code, date, close, volume FROM accepted
        WHERE code IN ('00010', '00050', '00120')""",
        "accepted",
    )
)
def gold_scan_columns(spark, folder):
    codes = ["00010", "00050", "00120"]
    return inputs.lake(spark, folder).security_prices(codes, columns=["close", "volume"])


@query(
    sql(
        f"""SELECT {_RAW}, 'daily_quotes' AS _endpoint, "Date" AS _partition_date,
        '{inputs.PROCESSED_AT}' AS _ingested_at,
        '{{"api_call":"daily_quotes","page_count":1}}' AS _metadata FROM raw_quotes""",
        "raw_quotes",
    )
)
def lineage_columns(spark, folder):
    rows = inputs.raw_quotes(spark, folder)
    facts = {"api_call": "daily_quotes", "page_count": 1}
    return with_lineage(
        rows, DAILY_QUOTES_ENDPOINT, F.col("Date"), inputs.PROCESSED_AT, metadata=facts
    )


@query(
    sql(
        """SELECT count(DISTINCT date) AS dates_processed, count(DISTINCT code) AS stocks_input,
        count(*) AS records_input FROM prices""",
        "prices",
    )
)
def security_major_stats(spark, folder):
    return rewrite_stats(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT DISTINCT date FROM normalized
        WHERE date NOT IN (SELECT date FROM verdict WHERE reason IS NULL)""",
        "normalized",
        "verdict",
    )
)
def pending_dates(spark, folder):
    wanted = inputs.normalized(spark, folder)
    return pending_days(wanted, inputs.lake(spark, folder).price_days())


@query(sql("SELECT DISTINCT date FROM accepted", "accepted"))
def available_dates(spark, folder):
    return inputs.lake(spark, folder).price_days()


@query(sql("SELECT DISTINCT code FROM accepted", "accepted"))
def available_codes(spark, folder):
    return inputs.lake(spark, folder).codes()


def _stats(spark, folder):
    lake = inputs.lake(spark, folder)
    return dataset_stats(spark, lake.raw_root)


@query(
    sql(
        """SELECT 'daily_quotes' AS dataset, count(DISTINCT "Date") AS dates FROM raw_quotes
        UNION ALL SELECT 'listed_info', 2
        UNION ALL SELECT 'total', count(DISTINCT d) FROM (SELECT "Date" AS d FROM raw_quotes
            UNION ALL SELECT '2024-01-05' UNION ALL SELECT '2024-01-26')""",
        "raw_quotes",
    )
)
def storage_stats(spark, folder):
    return _stats(spark, folder).select("dataset", "dates")


@query("SELECT unnest(['daily_quotes', 'listed_info']) AS dataset, true AS files, true AS size_mb")
def storage_sizes(spark, folder):
    """Files and sizes of the listing against those that a scan of the data reports."""
    lake = inputs.lake(spark, folder)
    scans = [
        lake.raw(endpoint).select(
            F.lit(endpoint).alias("dataset"), "_metadata.file_path", "_metadata.file_size"
        )
        for endpoint in (DAILY_QUOTES_ENDPOINT, LISTED_INFO_ENDPOINT)
    ]
    seen = scans[0].union(scans[1]).distinct().groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("file_size") / (1 << 20), 2).alias("mb")
    )
    return _stats(spark, folder).join(seen, "dataset").select(
        "dataset", (F.col("files") == F.col("n")).alias("files"), (F.col("size_mb") == F.col("mb")).alias("size_mb")
    )


@query(sql("SELECT code, count(*) AS records FROM accepted GROUP BY code", "accepted"))
def security_records(spark, folder):
    return inputs.lake(spark, folder).security_stats().select("code", "records")


# A late increment that overlaps what is stored: closes differ by one.
_INCREMENT_FROM, _STORED_TO = date(1998, 1, 1), date(1998, 6, 30)
_LATER = "2024-02-02T00:00:00"
_PARTS = f"""stored AS (SELECT {_ALL} FROM prices WHERE date <= DATE '{_STORED_TO}'),
    incoming AS (SELECT * REPLACE (close + 1 AS close, '{_LATER}' AS processed_at)
        FROM (SELECT {_ALL} FROM prices WHERE date >= DATE '{_INCREMENT_FROM}'))"""


def _parts(spark, folder):
    bars = inputs.prices(spark, folder)
    stored = bars.where(F.col("date") <= F.lit(_STORED_TO))
    late = bars.where(F.col("date") >= F.lit(_INCREMENT_FROM))
    return stored, late.withColumns({"close": F.col("close") + 1, "processed_at": F.lit(_LATER)})


def _merge_sql(body: str) -> str:
    return sql(body, "prices", also=_PARTS)


@query(
    _merge_sql(
        """SELECT * FROM stored UNION ALL SELECT * FROM incoming i WHERE NOT EXISTS
        (SELECT 1 FROM stored s WHERE s.code = i.code AND s.date = i.date)"""
    )
)
def merge_skip_existing(spark, folder):
    return merge_skipping(*_parts(spark, folder))


@query(
    _merge_sql(
        """SELECT * FROM incoming UNION ALL SELECT * FROM stored s WHERE NOT EXISTS
        (SELECT 1 FROM incoming i WHERE s.code = i.code AND s.date = i.date)"""
    )
)
def merge_force_refresh(spark, folder):
    return merge_replacing(*_parts(spark, folder))


@query(
    _merge_sql(
        """SELECT * FROM incoming UNION ALL SELECT * FROM stored s WHERE NOT EXISTS
        (SELECT 1 FROM incoming i WHERE s.code = i.code AND s.date = i.date)"""
    )
)
def merge_stored_dataset(spark, folder):
    """The same merge through files: write, merge in place, read back."""
    stored, incoming = _parts(spark, folder)
    path = new_folder(spark, "by-security")
    merge_by_security(stored, path, 16)
    merge_by_security(incoming, path, 16, force=True)
    return read_by_security(spark, path).select(*PRICE_COLUMNS)


@query(
    sql(
        """SELECT code, date, close, close * m AS adj_close, volume * (1 / m) AS adj_volume
        FROM adjusted""",
        "adjusted",
    )
)
def adjusted_bucketed(spark, folder):
    """Adjustment over a bucketed table: the window finds its rows already together."""
    path = new_folder(spark, "bucketed")
    table = f"bars_{path.rsplit('-', 1)[1]}"
    bars = save_bucketed_table(inputs.prices(spark, folder), table, path, 16)
    adjusted = adjust_prices(bars, "add")
    return adjusted.select("code", "date", "close", "adj_close", "adj_volume")


@query(sql("SELECT * FROM listing WHERE \"Code\" = '00080'", "listing"))
def listing_scan_code(spark, folder):
    listed = inputs.lake(spark, folder).listing(as_of=date(2024, 1, 20))
    return endpoints.listed_info(listed, "00080").drop("partition_date")


@query(
    sql(
        f"""SELECT {_ALL} FROM accepted WHERE code NOT IN
        (SELECT "Code" FROM listing WHERE "MarketCodeName" = 'ASIA')""",
        "accepted",
        "listing",
    )
)
def silver_scan_not_codes(spark, folder):
    listed = inputs.listing(spark, folder).where("MarketCodeName = 'ASIA'")
    codes = listed.select(F.col("Code").alias("code"))
    return not_of_codes(inputs.lake(spark, folder).daily_prices(), codes)


def _saved(spark, folder, extension):
    path = f"{new_folder(spark, 'saved')}/prices.{extension}"
    bars = inputs.prices(spark, folder)
    save_table(bars, path)
    return load_table(spark, path, bars.schema)


@query(sql(f"SELECT {_ALL} FROM prices", "prices"))
def saved_parquet(spark, folder):
    return _saved(spark, folder, "parquet")


@query(sql(f"SELECT {_ALL} FROM prices", "prices"))
def saved_csv(spark, folder):
    return _saved(spark, folder, "csv")


@query(
    sql(
        """SELECT code, count(*) AS bars, max(close) AS highest FROM accepted
        WHERE close >= 100 GROUP BY code""",
        "accepted",
    )
)
def sql_over_layers(spark, folder):
    register_views(inputs.lake(spark, folder))
    return run_sql(
        spark,
        """SELECT code, count(*) AS bars, max(close) AS highest FROM daily_prices
        WHERE close >= :floor GROUP BY code""",
        floor=100,
    )
