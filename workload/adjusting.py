"""Adjusted histories, series and summaries (WIN, AGG, SRT, PRJ16)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barloom.operators import adjust, chain, history, summary
from barloom.session import materialize, new_folder
from barloom.sinks.adjusted import read_adjusted, readjust_late_actions, write_adjusted
from workload import inputs
from workload.inputs import sql
from workload.registry import query


@query(
    sql(
        """SELECT code, date, close, adjustment_factor, m AS multiplier FROM adjusted""",
        "adjusted",
    )
)
def cumulative_adjustment(spark, folder):
    slim = inputs.prices(spark, folder).select("code", "date", "close", "adjustment_factor")
    return adjust.cumulative_adjustment(slim, "multiplier")


@query(
    sql(
        """SELECT code, date, open, high, low, close, volume, turnover_value, adjustment_factor,
        processed_at, open * m AS adj_open, high * m AS adj_high, low * m AS adj_low,
        close * m AS adj_close, volume * (1 / m) AS adj_volume FROM adjusted""",
        "adjusted",
    )
)
def adjusted_add(spark, folder):
    return adjust.adjust_prices(inputs.prices(spark, folder), "add")


_ADDED = sql(
    """SELECT code, date, open, high, low, close, volume, turnover_value, adjustment_factor,
    processed_at, open * m AS adj_open, high * m AS adj_high, low * m AS adj_low,
    close * m AS adj_close, volume * (1 / m) AS adj_volume FROM adjusted""",
    "adjusted",
)


@query(_ADDED)
def adjusted_from_chain(spark, folder):
    rows = inputs.prices(spark, folder)
    chains = materialize(chain.event_chain(rows), "event-chain")
    return chain.adjust_with_chain(rows, chains, "add")


@query(_ADDED)
def readjust_late_action(spark, folder):
    """Every action from 1997 on arrives after the bars are stored."""
    rows = materialize(inputs.prices(spark, folder), "bars")
    late = F.col("date") >= F.lit(date(1997, 1, 1))
    path = new_folder(spark, "adjusted")
    unaware = F.when(late, F.lit(1.0)).otherwise(F.col("adjustment_factor"))
    write_adjusted(rows.withColumn("adjustment_factor", unaware), path, 4)
    actions = rows.where(late & (F.col("adjustment_factor") != 1.0))
    readjust_late_actions(actions.select("code", "date", "adjustment_factor"), path, 4)
    return read_adjusted(spark, path).drop("year", "bucket")


@query(
    sql(
        """SELECT code, date, open * m AS open, high * m AS high, low * m AS low,
        close * m AS close, volume * (1 / m) AS volume, turnover_value, adjustment_factor,
        adj_close, processed_at FROM adjusted""",
        "adjusted",
    )
)
def adjusted_replace(spark, folder):
    return adjust.adjust_prices(inputs.prices(spark, folder), "replace")


@query(
    sql(
        "SELECT code, date, volume, volume * (1 / m) AS adj_volume FROM adjusted",
        "adjusted",
    )
)
def adjusted_volume(spark, folder):
    rows = inputs.prices(spark, folder)
    return history.price_history(
        rows, columns=["code", "date", "volume", "adj_volume"], adjust="add"
    )


@query(
    sql(
        """SELECT code, date, turnover_value, turnover_value * m AS adj_turnover_value
        FROM adjusted""",
        "adjusted",
    )
)
def adjusted_turnover(spark, folder):
    columns = ["code", "date", "turnover_value", "adj_turnover_value"]
    return history.price_history(
        inputs.prices(spark, folder), columns=columns, adjust="add", turnover=True
    )


@query(
    sql(
        """SELECT code, date, open * m AS open, high * m AS high, low * m AS low,
            close * m AS close, volume * (1 / m) AS volume,
            turnover_value * m AS turnover_value, adjustment_factor FROM early""",
        "prices",
        also="""early AS (SELECT *, coalesce(product(adjustment_factor) OVER (
            PARTITION BY code ORDER BY date DESC
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS m FROM prices
            WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31')""",
    )
)
def price_history_range(spark, folder):
    columns = [
        "code",
        "date",
        "open",
        "high",
        "low",
        "close",
        "volume",
        "turnover_value",
        "adjustment_factor",
    ]
    return history.price_history(
        inputs.prices(spark, folder),
        date(1996, 1, 1),
        date(2000, 12, 31),
        columns=columns,
        adjust="replace",
        turnover=True,
    )


@query(sql("SELECT code, date, close * m AS close FROM adjusted", "adjusted"))
def close_series(spark, folder):
    return history.price_series(inputs.prices(spark, folder), "close")


@query(sql("SELECT code, date, volume * (1 / m) AS volume FROM adjusted", "adjusted"))
def volume_series(spark, folder):
    return history.price_series(inputs.prices(spark, folder), "volume")


@query(sql("SELECT code, date, turnover_value FROM prices", "prices"))
def turnover_series(spark, folder):
    return history.price_series(inputs.prices(spark, folder), "turnover_value")


@query(sql("SELECT code, date, adjustment_factor FROM prices", "prices"))
def factor_series(spark, folder):
    return history.price_series(inputs.prices(spark, folder), "adjustment_factor")


for _field in ("open", "high", "low"):

    def _series(spark, folder, field=_field):
        return history.price_series(inputs.prices(spark, folder), field)

    _series.__name__ = f"{_field}_series"
    query(sql(f"SELECT code, date, {_field} * m AS {_field} FROM adjusted", "adjusted"))(_series)


@query(
    sql(
        """SELECT code, date, adjustment_factor FROM prices
        WHERE abs(coalesce(adjustment_factor, 1) - 1) > 1e-9""",
        "prices",
    )
)
def adjustment_events(spark, folder):
    return adjust.adjustment_events(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT code, date, open, high, low, close, CAST(volume AS DOUBLE) AS volume,
        turnover_value, adjustment_factor, adj_close, processed_at
        FROM adjusted QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1""",
        "adjusted",
    )
)
def latest_price(spark, folder):
    return history.latest_price(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT code, date, close, volume FROM prices
        QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) <= 5""",
        "prices",
    )
)
def last_n_per_code(spark, folder):
    slim = inputs.prices(spark, folder).select("code", "date", "close", "volume")
    return history.last_n(slim, 5)


@query(
    sql(
        """SELECT code, min(date) AS first_date, max(date) AS last_date FROM prices
        GROUP BY code""",
        "prices",
    )
)
def history_span(spark, folder):
    return history.first_and_last_day(inputs.prices(spark, folder))


@query(sql("SELECT date, count(*) AS record_count FROM prices GROUP BY date", "prices"))
def daily_counts(spark, folder):
    return summary.daily_counts(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT count(*) FILTER (close IS NULL) AS null_closes,
        count(*) FILTER (volume IS NULL) AS null_volumes, min(close) AS min_close,
        max(close) AS max_close, CAST(sum(volume) AS BIGINT) AS total_volume FROM prices""",
        "prices",
    )
)
def quality_stats(spark, folder):
    return summary.quality_stats(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT code, avg(close) AS avg_close, avg(volume) AS avg_volume,
        count(*) AS trading_days FROM prices GROUP BY code
        ORDER BY avg_close DESC, code LIMIT 10""",
        "prices",
    )
)
def top_by_avg_close(spark, folder):
    return summary.top_by_avg_close(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT code, f AS first_close, l AS last_close, (l - f) / f * 100 AS return_pct
        FROM (SELECT code, arg_min(close, date) AS f, arg_max(close, date) AS l
            FROM prices GROUP BY code)""",
        "prices",
    )
)
def period_return(spark, folder):
    return summary.period_return(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT count(code) AS code_rows, count(DISTINCT code) AS distinct_codes,
        avg(close) AS avg_close_price, CAST(sum(volume) AS BIGINT) AS total_volume,
        max(close) AS highest_price, min(close) AS lowest_price FROM prices""",
        "prices",
    )
)
def market_summary(spark, folder):
    return summary.market_summary(inputs.prices(spark, folder))


@query(sql("SELECT DISTINCT code FROM prices", "prices"))
def distinct_codes(spark, folder):
    return summary.distinct_codes(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT code, count(close) AS observations, min(close) AS min_close,
        max(close) AS max_close, avg(close) AS avg_close,
        round(stddev_samp(close), 4) AS std_close, avg(volume) AS avg_volume
        FROM prices GROUP BY code""",
        "prices",
    )
)
def price_summary(spark, folder):
    rows = summary.price_summary(inputs.prices(spark, folder))
    return rows.withColumn("std_close", F.round("std_close", 4))


@query(
    sql(
        """SELECT date, codes, all_codes, codes / all_codes AS coverage
        FROM (SELECT date, count(DISTINCT code) AS codes,
            (SELECT count(DISTINCT code) FROM prices) AS all_codes FROM prices GROUP BY date)""",
        "prices",
    )
)
def market_coverage(spark, folder):
    return summary.market_coverage(inputs.prices(spark, folder))
