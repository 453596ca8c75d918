"""Market data derived from the driver's tables, once in Spark and once in SQL.

Prices are whole numbers and factors are powers of two, so sums, means and
products are exact and do not depend on the order of summation.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.normalize import normalize_quotes
from barloom.plans.lake import PriceLake
from barloom.schemas import DAILY_QUOTES_ENDPOINT, LISTED_INFO_ENDPOINT
from barloom.session import new_folder

PROCESSED_AT = "2024-02-01T00:00:00"
SNAPSHOT_DAYS = (date(2024, 1, 5), date(2024, 1, 26))
_LAKE_BUCKETS = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def four_digits(key: Column) -> Column:
    """At least four digits: longer keys are not cut."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(4)), F.lit("0"))


def _code(key: Column) -> Column:
    return F.concat(four_digits(key), F.lit("0"))


def _factor(key: Column, turn: Column) -> Column:
    step = (turn + key) % 22
    return F.when(step == 0, 0.5).when(step == 11, 2.0).otherwise(1.0)


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per supplier and ship day, in the normalised schema.

    Lines follow each other by order and line number. As one decimal, wide enough
    for any two of them, the pair keeps to the fixed-width buffers of a hash aggregate.
    """
    price = F.floor("l_extendedprice")
    place = F.expr(
        "CAST(l_orderkey AS DECIMAL(19, 0)) * 10000000000000000000BD + l_linenumber"
    ).cast("decimal(38, 0)")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("k"),
        F.to_date("l_shipdate").alias("date"),
        price.alias("price"),
        place.alias("place"),
        "l_quantity",
    )
    bars = lines.groupBy("k", "date").agg(
        F.min_by("price", "place").cast("double").alias("open"),
        F.max("price").cast("double").alias("high"),
        F.min("price").cast("double").alias("low"),
        F.max_by("price", "place").cast("double").alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
        F.sum(F.col("price") * F.col("l_quantity")).alias("turnover_value"),
    )
    factor = _factor(F.col("k"), F.dayofyear("date"))
    return bars.select(
        _code(F.col("k")).alias("code"),
        "date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "turnover_value",
        factor.alias("adjustment_factor"),
        (F.col("close") * factor).alias("adj_close"),
        F.lit(PROCESSED_AT).alias("processed_at"),
    )


def raw_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """One provider-style quote per user and day, with the flaws normalisation must handle.

    Some closes, factors and adjusted closes are missing, some turnovers are not
    numbers, and the 13th, 17th and 21st fail validation for different reasons.
    """
    price = F.ceil(F.col("value") * 10).cast("double")
    bars = (
        table(spark, folder, "events")
        .select(
            F.col("user_id").alias("k"), F.to_date("ts").alias("d"), "event_id", price.alias("p")
        )
        .groupBy("k", "d")
        .agg(
            F.min_by("p", "event_id").alias("o"),
            F.max("p").alias("h"),
            F.min("p").alias("l"),
            F.max_by("p", "event_id").alias("c"),
            F.count(F.lit(1)).alias("v"),
            F.sum("p").cast("long").alias("t"),
        )
    )
    day, key = F.day("d"), F.col("k")
    turn = key + day
    swapped = (day == 13) & (F.col("o") > 200)
    close = (
        F.when((day == 21) | (turn % 29 == 0), F.lit(None))
        .when((day == 17) & (F.col("o") > 200), F.lit(0.0))
        .otherwise(F.col("c"))
    )
    return bars.select(
        _code(key).alias("Code"),
        F.date_format("d", "yyyy-MM-dd").alias("Date"),
        F.col("o").alias("Open"),
        F.when(swapped, F.col("l") - 1).otherwise(F.col("h")).alias("High"),
        F.col("l").alias("Low"),
        close.alias("Close"),
        F.col("v").alias("Volume"),
        F.when(turn % 13 == 0, F.lit("n/a")).otherwise(F.col("t").cast("string")).alias(
            "TurnoverValue"
        ),
        F.when(turn % 5 == 0, F.lit(None))
        .otherwise(_factor(key, day).cast("string"))
        .alias("AdjustmentFactor"),
        F.when(turn % 3 == 0, F.lit(None))
        .otherwise(F.col("c").cast("long").cast("string"))
        .alias("AdjustmentClose"),
    )


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return normalize_quotes(raw_quotes(spark, folder), PROCESSED_AT)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as listed securities; rich ones have a second share class."""
    suppliers = (
        table(spark, folder, "supplier")
        .join(
            table(spark, folder, "nation"),
            F.col("s_nationkey") == F.col("n_nationkey"),
        )
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    classes = F.when(F.col("s_acctbal") > 8000, F.array(F.lit("0"), F.lit("5"))).when(
        F.col("s_acctbal") < 1000, F.array(F.lit("5"))
    )
    return suppliers.withColumn(
        "suffix", F.explode(F.coalesce(classes, F.array(F.lit("0"))))
    ).select(
        F.concat(four_digits(F.col("s_suppkey")), "suffix").alias("Code"),
        F.col("s_name").alias("CompanyName"),
        F.upper("s_name").alias("CompanyNameEnglish"),
        F.col("n_nationkey").cast("string").alias("Sector17Code"),
        F.col("n_name").alias("Sector17CodeName"),
        (F.col("n_nationkey") + 50).cast("string").alias("Sector33Code"),
        F.col("n_name").alias("Sector33CodeName"),
        F.col("r_regionkey").cast("string").alias("MarketCode"),
        F.col("r_name").alias("MarketCodeName"),
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Every order day as a calendar row; weekends have division 1."""
    days = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(
        F.date_format("d", "yyyy-MM-dd").alias("Date"),
        F.when(F.weekday("d") >= 5, "1").otherwise("0").alias("HolidayDivision"),
    )


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly figures per security, disclosed 45 days after the quarter."""
    quarters = prices(spark, folder).groupBy("code", F.trunc("date", "quarter").alias("quarter"))
    return quarters.agg(
        F.sum("volume").alias("units"), F.sum("turnover_value").alias("revenue")
    ).select(
        "code",
        F.date_add(F.add_months("quarter", 3), 45).alias("disclosed_date"),
        "quarter",
        "units",
        "revenue",
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").withColumnRenamed("doc_id", "_id")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Code requests in every accepted and refused form, one per customer."""
    key = F.col("c_custkey")
    four = four_digits(key)
    kind = key % 50
    request = (
        F.when(kind == 0, F.concat(four, F.lit("0")))
        .when(kind == 1, F.concat(F.lit("A"), four))
        .when(kind == 2, F.concat(F.lit(" "), four, F.lit(" ")))
        .when(kind == 3, F.lit("12"))
        .otherwise(four)
    )
    return table(spark, folder, "customer").select("c_custkey", request.alias("request"))


# Record fields of the paged responses built from events.
PAGE_RECORD = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
_PAGE_ROWS, _PAGES_PER_REQUEST = 100, 10


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Events as landed pages of a hundred records; every 97th request lacks the data field."""
    number = F.floor(F.col("event_id") / _PAGE_ROWS).cast("long")
    grouped = (
        table(spark, folder, "events")
        .select(number.alias("n"), F.struct("event_id", "event_type", "value").alias("r"))
        .groupBy("n")
        .agg(F.array_sort(F.collect_list("r")).alias("daily_quotes"))
        .withColumn("request", F.floor(F.col("n") / _PAGES_PER_REQUEST).cast("string"))
        .withColumn("page", F.col("n") % _PAGES_PER_REQUEST)
    )
    keyless = F.col("request").cast("long") % 97 == 5
    body = F.when(keyless, F.lit('{"message": "no data"}')).otherwise(
        F.to_json(F.struct("daily_quotes", F.col("n").cast("string").alias("pagination_key")))
    )
    return grouped.select("request", "page", body.alias("body"))


_LAKES: dict[tuple[str, str], PriceLake] = {}


def lake(spark: SparkSession, folder: str) -> PriceLake:
    """All layers filled from the tables, once per application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LAKES:
        _LAKES[key] = _filled_lake(spark, folder)
    return _LAKES[key]


def _filled_lake(spark: SparkSession, folder: str) -> PriceLake:
    filled = PriceLake(spark, new_folder(spark, "lake"), _LAKE_BUCKETS)
    filled.land(raw_quotes(spark, folder), DAILY_QUOTES_ENDPOINT, "Date")
    first, second = SNAPSHOT_DAYS
    listed = listing(spark, folder)
    filled.land(listed, LISTED_INFO_ENDPOINT, first)
    renamed = listed.withColumn("CompanyName", F.concat("CompanyName", F.lit(" KK")))
    filled.land(renamed, LISTED_INFO_ENDPOINT, second)
    filled.normalize(processed_at=PROCESSED_AT)
    filled.cluster()
    return filled


# ---------------------------------------------------------------------------
# The same derivations in SQL
# ---------------------------------------------------------------------------
_FACTOR = "CASE ({turn} + k) % 22 WHEN 0 THEN 0.5 WHEN 11 THEN 2.0 ELSE 1.0 END"

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "keyed": (
        (),
        """SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date,
            CAST(floor(l_extendedprice) AS BIGINT) AS price,
            {'o': l_orderkey, 'n': l_linenumber} AS place, l_quantity FROM lineitem""",
    ),
    "bars": (
        ("keyed",),
        f"""SELECT k, date, CAST(arg_min(price, place) AS DOUBLE) AS open,
            CAST(max(price) AS DOUBLE) AS high, CAST(min(price) AS DOUBLE) AS low,
            CAST(arg_max(price, place) AS DOUBLE) AS close,
            CAST(sum(l_quantity) AS BIGINT) AS volume,
            CAST(sum(price * l_quantity) AS DOUBLE) AS turnover_value,
            CAST({_FACTOR.format(turn="dayofyear(date)")} AS DOUBLE) AS adjustment_factor
            FROM keyed GROUP BY k, date""",
    ),
    "prices": (
        ("bars",),
        f"""SELECT printf('%04d0', k) AS code, date, open, high, low, close, volume,
            turnover_value, adjustment_factor, close * adjustment_factor AS adj_close,
            '{PROCESSED_AT}' AS processed_at FROM bars""",
    ),
    "adjusted": (
        ("prices",),
        """SELECT *, coalesce(product(coalesce(adjustment_factor, 1.0)) OVER (
                PARTITION BY code ORDER BY date DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS m
            FROM prices""",
    ),
    "day_users": (
        (),
        """SELECT user_id AS k, CAST(ts AS DATE) AS d, event_id,
            CAST(ceil(value * 10) AS DOUBLE) AS p FROM events""",
    ),
    "user_bars": (
        ("day_users",),
        """SELECT k, d, arg_min(p, event_id) AS o, max(p) AS h, min(p) AS l,
            arg_max(p, event_id) AS c, count(*) AS v, CAST(sum(p) AS BIGINT) AS t
            FROM day_users GROUP BY k, d""",
    ),
    "raw_quotes": (
        ("user_bars",),
        f"""SELECT printf('%04d0', k) AS "Code", strftime(d, '%Y-%m-%d') AS "Date", o AS "Open",
            CASE WHEN day(d) = 13 AND o > 200 THEN l - 1 ELSE h END AS "High", l AS "Low",
            CASE WHEN day(d) = 21 OR (k + day(d)) % 29 = 0 THEN NULL
                 WHEN day(d) = 17 AND o > 200 THEN CAST(0 AS DOUBLE) ELSE c END AS "Close",
            v AS "Volume",
            CASE WHEN (k + day(d)) % 13 = 0 THEN 'n/a' ELSE CAST(t AS VARCHAR) END
                AS "TurnoverValue",
            CASE WHEN (k + day(d)) % 5 = 0 THEN NULL ELSE
                CAST(CAST({_FACTOR.format(turn="day(d)")} AS DOUBLE) AS VARCHAR) END
                AS "AdjustmentFactor",
            CASE WHEN (k + day(d)) % 3 = 0 THEN NULL ELSE CAST(CAST(c AS BIGINT) AS VARCHAR) END
                AS "AdjustmentClose"
            FROM user_bars""",
    ),
    "normalized": (
        ("raw_quotes",),
        f"""SELECT "Code" AS code, CAST("Date" AS DATE) AS date, "Open" AS open, "High" AS high,
            "Low" AS low, "Close" AS close, "Volume" AS volume,
            TRY_CAST("TurnoverValue" AS DOUBLE) AS turnover_value,
            TRY_CAST("AdjustmentFactor" AS DOUBLE) AS adjustment_factor,
            coalesce(TRY_CAST("AdjustmentClose" AS DOUBLE),
                "Close" * coalesce(TRY_CAST("AdjustmentFactor" AS DOUBLE), 1.0)) AS adj_close,
            '{PROCESSED_AT}' AS processed_at
            FROM raw_quotes WHERE "Code" IS NOT NULL AND "Date" IS NOT NULL
            AND "Close" IS NOT NULL""",
    ),
    "broken": (
        ("normalized",),
        """SELECT *, coalesce(high < low OR high < open OR high < close OR low > open
            OR low > close, false) AS is_broken FROM normalized""",
    ),
    "report": (
        ("broken",),
        """SELECT CAST(e."Date" AS DATE) AS date, count(b.date) AS rows,
            CAST(count_if(b.date IS NOT NULL AND b.code IS NULL) AS BIGINT) AS null_codes,
            CAST(count_if(b.date IS NOT NULL AND b.close IS NULL) AS BIGINT) AS null_closes,
            min(b.close) AS min_close, max(b.close) AS max_close,
            CAST(count_if(coalesce(b.is_broken, false)) AS BIGINT) AS broken_bars,
            CAST(0 AS BIGINT) AS bad_values
            FROM (SELECT DISTINCT "Date" FROM raw_quotes) e
            LEFT JOIN broken b ON b.date = CAST(e."Date" AS DATE) GROUP BY 1""",
    ),
    "verdict": (
        ("report",),
        """SELECT *, coalesce(max_close > 1000000, false) AS high_close,
            CASE WHEN rows = 0 THEN 'empty' WHEN null_codes > 0 THEN 'null_code'
                WHEN null_closes > 0 THEN 'null_close'
                WHEN min_close <= 0 THEN 'non_positive_close'
                WHEN broken_bars > 0 THEN 'broken_bar' END AS reason
            FROM report""",
    ),
    "accepted": (
        ("normalized", "verdict"),
        """SELECT * FROM normalized
            WHERE date IN (SELECT date FROM verdict WHERE reason IS NULL)""",
    ),
    "listing": (
        (),
        """SELECT printf('%04d', s_suppkey) || suffix AS "Code", s_name AS "CompanyName",
            upper(s_name) AS "CompanyNameEnglish",
            CAST(n_nationkey AS VARCHAR) AS "Sector17Code", n_name AS "Sector17CodeName",
            CAST(n_nationkey + 50 AS VARCHAR) AS "Sector33Code", n_name AS "Sector33CodeName",
            CAST(r_regionkey AS VARCHAR) AS "MarketCode", r_name AS "MarketCodeName"
            FROM (SELECT *, unnest(CASE WHEN s_acctbal > 8000 THEN ['0', '5']
                    WHEN s_acctbal < 1000 THEN ['5'] ELSE ['0'] END) AS suffix
                FROM supplier)
            JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "calendar": (
        (),
        """SELECT strftime(d, '%Y-%m-%d') AS "Date",
            CASE WHEN isodow(d) >= 6 THEN '1' ELSE '0' END AS "HolidayDivision"
            FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""",
    ),
    "statements": (
        ("prices",),
        """SELECT code, CAST(CAST(q AS DATE) + INTERVAL 3 MONTH AS DATE) + 45 AS disclosed_date,
            CAST(q AS DATE) AS quarter, CAST(sum(volume) AS BIGINT) AS units,
            sum(turnover_value) AS revenue
            FROM (SELECT *, date_trunc('quarter', date) AS q FROM prices) GROUP BY code, q""",
    ),
    "documents_by_id": ((), "SELECT * EXCLUDE (doc_id), doc_id AS _id FROM documents"),
    "adj_closes": (("adjusted",), "SELECT code, date, close * m AS close FROM adjusted"),
    "returns": (
        ("adj_closes",),
        """SELECT code, date, close,
            close / nullif(lag(close, 1) OVER w, 0) - 1 AS ret_1,
            close / nullif(lag(close, 5) OVER w, 0) - 1 AS ret_5,
            close / nullif(lag(close, 21) OVER w, 0) - 1 AS ret_21,
            close / nullif(lag(close, 63) OVER w, 0) - 1 AS ret_63
            FROM adj_closes WINDOW w AS (PARTITION BY code ORDER BY date)""",
    ),
    "features": (
        ("returns",),
        """SELECT code, date, close, ret_1, ret_63 AS mom_3m,
            CASE WHEN count(ret_1) OVER w = 20 THEN stddev_samp(ret_1) OVER w END AS vol_20d
            FROM returns WINDOW w AS (PARTITION BY code ORDER BY date
                ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    ),
}


def sql(body: str, *needs: str, also: str = "") -> str:
    """A statement with the named derivations, and whatever they need, in front.

    ``also`` holds further table expressions that only this statement uses.
    """
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in _CTES[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} AS ({_CTES[name][1]})" for name in ordered]
    return f"WITH {', '.join(parts + [also] * bool(also))} {body}"
