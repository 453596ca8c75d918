"""Normalisation, quality, listing and calendar (NORM, PRJ, DQ, JN, CAL)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barloom.operators import calendar, listing, normalize, quality
from barloom.schemas import PRICE_COLUMNS
from workload import inputs
from workload.inputs import sql
from workload.registry import query

_ALL = ", ".join(PRICE_COLUMNS)
_REPORT = """date, rows, null_codes, null_closes, min_close, max_close, broken_bars, bad_values,
    high_close, reason, reason IS NULL AS valid"""


@query(sql(f"SELECT {_ALL} FROM normalized", "normalized"))
def normalize_quotes(spark, folder):
    return normalize.normalize_quotes(inputs.raw_quotes(spark, folder), inputs.PROCESSED_AT)


@query(
    sql(
        """SELECT code, date, close, adjustment_factor,
        CASE WHEN adj_close IS NULL THEN close * coalesce(adjustment_factor, 1.0)
            ELSE adj_close END AS adj_close
        FROM (SELECT code, date, close,
                CASE WHEN volume > 5 THEN adjustment_factor END AS adjustment_factor,
                CASE WHEN open > 200 THEN adj_close END AS adj_close FROM normalized)""",
        "normalized",
    )
)
def fill_adj_close(spark, folder):
    gappy = inputs.normalized(spark, folder).select(
        "code",
        "date",
        "close",
        F.when(F.col("volume") > 5, F.col("adjustment_factor")).alias("adjustment_factor"),
        F.when(F.col("open") > 200, F.col("adj_close")).alias("adj_close"),
    )
    return normalize.fill_adj_close(gappy)


@query(sql(f"SELECT {_ALL} FROM broken WHERE is_broken", "broken"))
def ohlc_violations(spark, folder):
    return quality.ohlc_violations(inputs.normalized(spark, folder))


def _report(spark, folder):
    landed = inputs.raw_quotes(spark, folder).select(F.to_date("Date").alias("date"))
    prices = inputs.normalized(spark, folder)
    return prices, quality.quality_report(prices, expected_days=landed)


@query(sql(f"SELECT {_REPORT} FROM verdict", "verdict"))
def dq_report(spark, folder):
    return _report(spark, folder)[1]


@query(
    sql(
        f"""SELECT {_ALL}, reason FROM normalized
        JOIN (SELECT date, reason FROM verdict WHERE reason IS NOT NULL) USING (date)""",
        "normalized",
        "verdict",
    )
)
def quarantine_dates(spark, folder):
    return quality.split_by_quality(*_report(spark, folder))[1]


@query(sql(f"SELECT {_ALL} FROM accepted", "accepted"))
def accepted_dates(spark, folder):
    return quality.split_by_quality(*_report(spark, folder))[0]


@query(sql("""SELECT * FROM listing WHERE "MarketCodeName" = 'ASIA'""", "listing"))
def search_exact(spark, folder):
    return listing.search_listing(inputs.listing(spark, folder), "MarketCodeName", "ASIA")


@query(
    sql(
        """SELECT * FROM listing WHERE contains(lower("CompanyNameEnglish"), 'er#00000001')""",
        "listing",
    )
)
def search_icontains(spark, folder):
    rows = inputs.listing(spark, folder)
    return listing.search_listing(rows, "CompanyNameEnglish", "eR#00000001", "icontains")


@query(
    sql(
        """SELECT "Code" AS code, substr("Code", 1, 4) AS base_code,
        "CompanyName" AS company_name, "CompanyNameEnglish" AS company_name_english,
        "Sector17Code" AS sector17_code, "Sector33Code" AS sector33_code,
        "MarketCode" AS market_code FROM listing""",
        "listing",
    )
)
def base_code(spark, folder):
    return listing.listing_attributes(inputs.listing(spark, folder))


@query(
    sql(
        f"""SELECT {", ".join("p." + name for name in PRICE_COLUMNS)},
        "CompanyName" AS company_name, "CompanyNameEnglish" AS company_name_english,
        "Sector17Code" AS sector17_code, "Sector33Code" AS sector33_code,
        "MarketCode" AS market_code FROM prices p LEFT JOIN listing l ON p.code = l."Code\"""",
        "prices",
        "listing",
    )
)
def prices_with_listing(spark, folder):
    return listing.prices_with_listing(
        inputs.prices(spark, folder), inputs.listing(spark, folder)
    )


@query(
    sql(
        """SELECT c_custkey, request,
            CASE WHEN NOT regexp_full_match(c, '[0-9]+') OR length(c) NOT IN (4, 5) THEN NULL
                WHEN length(c) = 5 THEN c ELSE coalesce(l.best, h.best, c || '0') END AS code,
            CASE WHEN NOT regexp_full_match(c, '[0-9]+') THEN 'not numeric'
                WHEN length(c) NOT IN (4, 5) THEN 'not 4 or 5 digits' ELSE 'ok' END AS status
        FROM cleaned LEFT JOIN listed l ON l.b = c LEFT JOIN held h ON h.b = c""",
        "listing",
        "prices",
        also="""asked AS (SELECT c_custkey, CASE c_custkey % 50
            WHEN 0 THEN printf('%04d', c_custkey) || '0'
            WHEN 1 THEN 'A' || printf('%04d', c_custkey)
            WHEN 2 THEN ' ' || printf('%04d', c_custkey) || ' '
            WHEN 3 THEN '12' ELSE printf('%04d', c_custkey) END AS request FROM customer),
        cleaned AS (SELECT *, trim(request) AS c FROM asked),
        listed AS (SELECT substr("Code", 1, 4) AS b, coalesce(min("Code") FILTER
            ("Code" LIKE '%0'), min("Code")) AS best FROM listing GROUP BY 1),
        held AS (SELECT substr(code, 1, 4) AS b, coalesce(min(code) FILTER
            (code LIKE '%0'), min(code)) AS best FROM prices GROUP BY 1)""",
    )
)
def resolve_codes(spark, folder):
    stored = inputs.prices(spark, folder).select("code")
    return listing.resolve_codes(
        inputs.requests(spark, folder), inputs.listing(spark, folder), stored
    )


@query(
    sql(
        """SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE)
        AS date FROM prices""",
        "prices",
    )
)
def date_sequence(spark, folder):
    return calendar.days_spanned(inputs.prices(spark, folder))


_DAYS = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders"


def _order_days(spark, folder):
    orders = inputs.table(spark, folder, "orders")
    return orders.select(F.to_date("o_orderdate").alias("date")).distinct()


@query(
    f"""SELECT date, date + CASE isodow(date) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END
    AS next_weekday FROM ({_DAYS})"""
)
def next_weekday(spark, folder):
    moved = calendar.with_weekdays(_order_days(spark, folder))
    return moved.select("date", "next_weekday")


@query(
    f"""SELECT date, date - CASE isodow(date) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END
    AS previous_weekday FROM ({_DAYS})"""
)
def previous_weekday(spark, folder):
    moved = calendar.with_weekdays(_order_days(spark, folder))
    return moved.select("date", "previous_weekday")


@query(
    sql(
        """SELECT f AS from_date, f + 14 AS to_date FROM
        (SELECT d + CASE isodow(d) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS f
            FROM (SELECT max(date) + 1 AS d FROM prices))""",
        "prices",
    )
)
def default_window(spark, folder):
    return calendar.default_window(inputs.prices(spark, folder), date(2024, 2, 1))


@query(sql("SELECT min(date) AS from_date, max(date) AS to_date FROM prices", "prices"))
def stored_window(spark, folder):
    return calendar.stored_window(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT code, o.date AS date FROM span JOIN open_days o ON o.date BETWEEN a AND b
        WHERE NOT EXISTS (SELECT 1 FROM prices p WHERE p.code = span.code AND p.date = o.date)""",
        "prices",
        "calendar",
        also="""open_days AS (SELECT CAST("Date" AS DATE) AS date FROM calendar
            WHERE "HolidayDivision" = '0'),
        span AS (SELECT code, min(date) AS a, max(date) AS b FROM prices GROUP BY code)""",
    )
)
def missing_dates(spark, folder):
    days = inputs.calendar(spark, folder).where("HolidayDivision = '0'")
    open_days = days.select(F.to_date("Date").alias("date"))
    return calendar.missing_days(inputs.prices(spark, folder), open_days)


@query(
    """SELECT f AS from_date, f + 14 AS to_date FROM (SELECT d + CASE isodow(d)
        WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS f
        FROM (SELECT DATE '2024-02-01' - 365 AS d))"""
)
def default_window_first_run(spark, folder):
    """Nothing is stored yet: the window starts a year back."""
    nothing = inputs.prices(spark, folder).where(F.col("close") < 0)
    return calendar.default_window(nothing, date(2024, 2, 1))


@query(
    sql(
        """SELECT * FROM listing WHERE "Code" = (SELECT max("Code") FROM listing)""",
        "listing",
    )
)
def listing_row_lookup(spark, folder):
    listed = inputs.listing(spark, folder)
    code = listed.agg(F.max("Code")).first()[0]
    return spark.createDataFrame([listing.listing_row(listed, code)], listed.schema)
