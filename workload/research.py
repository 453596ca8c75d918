"""Research operators that the reference only describes (tier D)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from barloom.operators import adjust, corporate, crosssection, merge, returns
from barloom.operators import signals as factors
from workload import inputs
from workload.inputs import sql
from workload.registry import query

_AS_OF = date(2001, 6, 30)


@query(sql("SELECT * FROM returns", "returns"))
def returns_multi(spark, folder):
    return returns.multi_period_returns(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT code, date, close, ret_1, mom_3m, round(vol_20d, 6) AS vol_20d FROM features""",
        "features",
    )
)
def features(spark, folder):
    rows = returns.features(inputs.prices(spark, folder))
    return rows.withColumn("vol_20d", F.round("vol_20d", 6))


@query(
    sql(
        """SELECT code, CAST(count(*) AS BIGINT) AS days,
        round(corr(ret_1, peer_mean), 6) AS correlation FROM
        (SELECT *, avg(ret_1) OVER (PARTITION BY peer_group, date) AS peer_mean
            FROM (SELECT r.*, coalesce("Sector17Code", 'unlisted') AS peer_group FROM returns r
                LEFT JOIN listing l ON r.code = l."Code" WHERE ret_1 IS NOT NULL))
        GROUP BY code""",
        "returns",
        "listing",
    )
)
def return_correlation(spark, folder):
    listed = inputs.listing(spark, folder)
    groups = listed.select(F.col("Code").alias("code"), F.col("Sector17Code").alias("peer_group"))
    daily = returns.multi_period_returns(inputs.prices(spark, folder), (1,))
    rows = returns.security_vs_group(daily, groups)
    return rows.withColumn("correlation", F.round("correlation", 6))


@query(
    sql(
        """SELECT a.code AS code_a, b.code AS code_b, CAST(count(*) AS BIGINT) AS days,
        CASE WHEN count(*) >= 3 THEN round(corr(a.ret_1, b.ret_1), 6) END AS correlation
        FROM pairs JOIN returns a ON a.code = code_a AND a.ret_1 IS NOT NULL
        JOIN returns b ON b.code = code_b AND b.date = a.date AND b.ret_1 IS NOT NULL
        GROUP BY a.code, b.code""",
        "returns",
        also="""pairs AS (SELECT printf('%04d0', s_suppkey) AS code_a,
            printf('%04d0', s_suppkey + 1) AS code_b FROM supplier)""",
    )
)
def pair_correlation(spark, folder):
    key = F.col("s_suppkey")
    pairs = inputs.table(spark, folder, "supplier").select(
        F.concat(inputs.four_digits(key), F.lit("0")).alias("code_a"),
        F.concat(inputs.four_digits(key + 1), F.lit("0")).alias("code_b"),
    )
    daily = returns.multi_period_returns(inputs.prices(spark, folder), (1,))
    rows = returns.pair_correlation(daily, pairs)
    return rows.withColumn("correlation", F.round("correlation", 6))


@query(
    sql(
        """SELECT code, date, adjustment_factor, CASE WHEN adjustment_factor < 0.9 THEN 'split'
        WHEN adjustment_factor < 1 THEN 'dividend' ELSE 'other' END AS action_type
        FROM prices WHERE abs(adjustment_factor - 1) > 0.01""",
        "prices",
    )
)
def corporate_actions(spark, folder):
    return corporate.corporate_actions(inputs.prices(spark, folder))


_AT_REFERENCE = """SELECT code, date, open * (m / r) AS adj_open, high * (m / r) AS adj_high,
    low * (m / r) AS adj_low, close * (m / r) AS adj_close, volume * (1 / (m / r)) AS adj_volume
    FROM (SELECT *, coalesce(product(CASE WHEN date > {day} THEN adjustment_factor END)
        OVER (PARTITION BY code), 1.0) AS r FROM {rows})"""
_SCALED = ["adj_open", "adj_high", "adj_low", "adj_close", "adj_volume"]


@query(sql(_AT_REFERENCE.format(day="DATE '1998-06-30'", rows="adjusted"), "adjusted"))
def adjust_to_reference(spark, folder):
    rows = adjust.adjust_to_reference(inputs.prices(spark, folder), date(1998, 6, 30))
    return rows.select("code", "date", *_SCALED)


@query(
    sql(
        _AT_REFERENCE.format(
            day="first_day",
            rows="(SELECT *, min(date) OVER (PARTITION BY code) AS first_day FROM adjusted)",
        ),
        "adjusted",
    )
)
def adjust_to_earliest(spark, folder):
    rows = adjust.adjust_to_reference(inputs.prices(spark, folder), "earliest")
    return rows.select("code", "date", *_SCALED)


@query(
    sql(
        """SELECT * FROM (SELECT code, date, p AS previous_close, close,
            close / nullif(p, 0) - 1 AS change
            FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS p FROM prices)
            WHERE adjustment_factor = 1.0) WHERE abs(change) > 0.3""",
        "prices",
    )
)
def suspicious_gaps(spark, folder):
    return corporate.suspicious_gaps(inputs.prices(spark, folder))


@query(
    sql(
        """SELECT code, count(gap) AS compared,
        CAST(count_if(gap > abs(expected) * 1e-6) AS BIGINT) AS mismatches,
        max(gap) AS largest_gap
        FROM (SELECT code, abs(adj_close - close * m) AS gap, close * m AS expected
            FROM adjusted) GROUP BY code""",
        "adjusted",
    )
)
def adjustment_check(spark, folder):
    return corporate.adjustment_check(inputs.prices(spark, folder))


_CLAMPED = """limits AS (SELECT date, quantile_cont(volume, 0.01) AS lo,
        quantile_cont(volume, 0.99) AS hi
        FROM (SELECT date, CAST(volume AS DOUBLE) AS volume FROM prices) GROUP BY date),
    clamped AS (SELECT p.code AS code, date, "Sector17Code" AS sector,
        greatest(least(CAST(volume AS DOUBLE), hi), lo) AS volume
        FROM prices p JOIN limits USING (date) LEFT JOIN listing l ON p.code = l."Code")"""


@query(
    sql(
        """SELECT code, date, sector, round(volume, 6) AS volume,
        round(CASE WHEN stddev_samp(volume) OVER w > 1e-9 THEN (volume - avg(volume) OVER w)
            / stddev_samp(volume) OVER w END, 6) + 0.0 AS z_volume
        FROM clamped WINDOW w AS (PARTITION BY date, sector)""",
        "prices",
        "listing",
        also=_CLAMPED,
    )
)
def winsorize_zscore(spark, folder):
    rows = inputs.prices(spark, folder).select(
        "code", "date", F.col("volume").cast("double").alias("volume")
    )
    sectors = inputs.listing(spark, folder).select(
        F.col("Code").alias("code"), F.col("Sector17Code").alias("sector")
    )
    clamped = crosssection.winsorize(rows, "volume").join(sectors, "code", "left")
    scored = crosssection.zscores(clamped, ["volume"], ["date", "sector"])
    return scored.withColumns(
        {"volume": F.round("volume", 6), "z_volume": F.round("z_volume", 6) + F.lit(0.0)}
    )


@query(
    sql(
        """SELECT p.code, p.date, p.close, s.disclosed_date, s.quarter, s.units, s.revenue
        FROM prices p ASOF LEFT JOIN statements s
        ON p.code = s.code AND p.date >= s.disclosed_date""",
        "statements",
    )
)
def pit_fundamentals(spark, folder):
    bars = inputs.prices(spark, folder).select("code", "date", "close")
    return factors.point_in_time(bars, inputs.statements(spark, folder))


@query(
    sql(
        f"""SELECT code, min(date) AS first_date, avg(close) AS avg_close,
        avg(volume) AS avg_volume FROM prices WHERE date <= DATE '{_AS_OF}' GROUP BY code
        HAVING avg(close) >= 50000 AND avg(volume) >= 20
        AND DATE '{_AS_OF}' - min(date) >= 365""",
        "prices",
    )
)
def universe(spark, folder):
    return factors.universe(inputs.prices(spark, folder), _AS_OF, 50000.0, 20.0, 365)


_WEIGHTS = {"mom_3m": 0.6, "vol_20d": -0.4}
_Z = """CASE WHEN stddev_samp({f}) OVER d > 1e-9 THEN ({f} - avg({f}) OVER d)
    / stddev_samp({f}) OVER d END"""
_SCORED = f"""scored AS (SELECT code, date, round(
    coalesce({_Z.format(f="mom_3m")}, 0.0) * 0.6 + coalesce({_Z.format(f="vol_20d")}, 0.0) * -0.4,
    9) + 0.0 AS score FROM (SELECT code, date, round(mom_3m, 6) AS mom_3m,
        round(vol_20d, 6) AS vol_20d FROM features) WINDOW d AS (PARTITION BY date))"""


def _scored(spark, folder):
    rows = returns.features(inputs.prices(spark, folder)).select(
        "code", "date", F.round("mom_3m", 6).alias("mom_3m"), F.round("vol_20d", 6).alias("vol_20d")
    )
    scored = factors.composite_score(rows, _WEIGHTS)
    return scored.select("code", "date", "score")


@query(
    sql(
        """SELECT code, date, score, rank, CAST(floor(CAST((rank - 1) * 10 AS DOUBLE) / n)
            AS INTEGER) + 1 AS decile
        FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY score DESC) AS rank,
            count(*) OVER (PARTITION BY date) AS n FROM scored)""",
        "features",
        also=_SCORED,
    )
)
def signals(spark, folder):
    return factors.composite_signals(_scored(spark, folder))


@query(
    sql(
        """SELECT code, date, sector, score, CAST(pos AS INTEGER) AS place
        FROM (SELECT *, row_number() OVER
            (PARTITION BY date, sector ORDER BY score DESC, code) AS pos
            FROM (SELECT s.code, date, score, "Sector17Code" AS sector FROM scored s
                LEFT JOIN listing l ON s.code = l."Code")) WHERE pos <= 2""",
        "features",
        "listing",
        also=_SCORED,
    )
)
def top_per_sector(spark, folder):
    sectors = inputs.listing(spark, folder).select(
        F.col("Code").alias("code"), F.col("Sector17Code").alias("sector")
    )
    scored = _scored(spark, folder).join(sectors, "code", "left")
    return crosssection.top_per_group(scored, "score", 2, ["date", "sector"])


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
    GROUP BY ALL HAVING count(*) > 1"""
)
def duplicate_keys(spark, folder):
    lines = inputs.table(spark, folder, "lineitem")
    return merge.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@query(
    sql(
        """SELECT code, CAST(periods AS BIGINT) AS periods, round(cagr, 6) AS cagr,
        round(vol, 6) AS volatility, round(CASE WHEN vol > 0 THEN mean * 252 / vol END, 6)
            AS sharpe, round(dd, 6) AS max_drawdown,
        round(CASE WHEN dd < 0 THEN cagr / -dd END, 6) AS calmar, round(hit, 6) AS hit_rate
        FROM (SELECT code, count(ret) AS periods,
            pow(arg_max(close, date) / nullif(arg_min(close, date), 0), 252.0 / count(ret)) - 1 AS cagr,
            avg(ret) AS mean, stddev_samp(ret) * sqrt(252.0) AS vol, min(drop) AS dd,
            avg(CAST(ret > 0 AS DOUBLE)) AS hit
            FROM (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret,
                close / nullif(max(close) OVER w, 0) - 1 AS drop FROM adj_closes
                WINDOW w AS (PARTITION BY code ORDER BY date))
            GROUP BY code HAVING count(ret) > 0)""",
        "adj_closes",
    )
)
def performance_metrics(spark, folder):
    closes = returns.adjusted_closes(inputs.prices(spark, folder))
    rows = returns.performance_metrics(closes)
    measures = [name for name in rows.columns if name not in ("code", "periods")]
    return rows.withColumns({name: F.round(name, 6) for name in measures})


_OUTCOME = """outcome AS (SELECT code, date, ret_5 AS factor, lead(ret_1) OVER
    (PARTITION BY code ORDER BY date) AS forward_return FROM returns),
    known AS (SELECT * FROM outcome WHERE factor IS NOT NULL AND forward_return IS NOT NULL)"""


def _outcome(spark, folder):
    daily = returns.multi_period_returns(inputs.prices(spark, folder), (1, 5))
    return returns.with_forward_return(daily).select("date", "ret_5", "forward_return")


_RANK_IC = sql(
        """SELECT date, codes, CASE WHEN codes >= 3 AND fs > 0 AND os > 0
            THEN round(ic, 6) + 0.0 END AS rank_ic
        FROM (SELECT date, count(*) AS codes, corr(f, o) AS ic, stddev_pop(f) AS fs,
            stddev_pop(o) AS os
            FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY factor) AS f,
                rank() OVER (PARTITION BY date ORDER BY forward_return) AS o FROM known)
            GROUP BY date)""",
        "returns",
        also=_OUTCOME,
    )


@query(_RANK_IC)
def rank_ic(spark, folder):
    rows = factors.rank_ic(_outcome(spark, folder), "ret_5", "forward_return")
    return rows.withColumn("rank_ic", F.round("rank_ic", 6) + F.lit(0.0))


@query(_RANK_IC)
def rank_ic_banded(spark, folder):
    """An earlier name of ``rank_ic``; days of every size now go one way."""
    return rank_ic(spark, folder)


@query(
    sql(
        """SELECT decile, count(*) AS bars, round(avg(forward_return), 6) AS avg_return
        FROM (SELECT forward_return, CAST(floor(CAST((r - 1) * 10 AS DOUBLE) / n) AS INTEGER) + 1
                AS decile
            FROM (SELECT *, rank() OVER (PARTITION BY date ORDER BY factor) AS r,
                count(*) OVER (PARTITION BY date) AS n FROM known)) GROUP BY decile""",
        "returns",
        also=_OUTCOME,
    )
)
def decile_returns(spark, folder):
    rows = factors.tile_returns(_outcome(spark, folder), "ret_5", "forward_return")
    return rows.withColumn("avg_return", F.round("avg_return", 6))


@query(
    sql(
        """SELECT code, date, last_value(close IGNORE NULLS) OVER (PARTITION BY code
            ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close
        FROM (SELECT "Code" AS code, CAST("Date" AS DATE) AS date, "Close" AS close
            FROM raw_quotes)""",
        "raw_quotes",
    )
)
def forward_fill(spark, folder):
    rows = inputs.raw_quotes(spark, folder).select(
        F.col("Code").alias("code"), F.to_date("Date").alias("date"), F.col("Close").alias("close")
    )
    return returns.forward_fill(rows, ["close"], limit=3)


@query(
    sql(
        """SELECT code, CAST(year(date) AS INTEGER) AS year, count(*) AS bars,
        max(close) AS highest FROM prices WHERE close >= 10000 GROUP BY ALL""",
        "prices",
    )
)
def sql_over_views(spark, folder):
    from barloom.plans.views import run_sql

    inputs.prices(spark, folder).createOrReplaceTempView("derived_prices")
    return run_sql(
        spark,
        """SELECT code, year(date) AS year, count(*) AS bars, max(close) AS highest
        FROM derived_prices WHERE close >= :floor GROUP BY code, year(date)""",
        floor=10000,
    )
