from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import corporate, crosssection, returns, signals
from barloom.session import materialize
from tests.frames import D15, D16, D17, price_row, prices


@pytest.fixture(scope="module")
def crowd(spark):
    """Three days; on the first, a third of the rows share one value."""
    n = F.col("id")
    value = (
        F.when(n % 3 == 0, F.lit(0.0))
        .when(n % 17 == 0, F.lit(None))
        .otherwise(F.sin(n.cast("double")) * F.pow(F.lit(10.0), (n % 7 - 3).cast("double")))
    )
    other = F.cos(n.cast("double"))
    day = F.when(n % 2 == 0, F.lit(D15)).when(n % 5 == 0, F.lit(D16)).otherwise(F.lit(D17))
    return spark.range(3000).select(
        F.format_string("%05d", n).alias("code"),
        day.alias("date"),
        value.alias("value"),
        other.alias("other"),
    )


def plain_ranks(rows, descending=False):
    """(day, code) to the rank of value, smallest rank for equals; nulls and NaN have none."""
    days = {}
    for r in rows:
        known = r.value is not None and r.value == r.value
        days.setdefault(r.date, []).append((r.code, r.value if known else None))
    ranks = {}
    for day, values in days.items():
        ordered = sorted((v for _, v in values if v is not None), reverse=descending)
        first = {}
        for i, v in enumerate(ordered):
            first.setdefault(v, i + 1)
        ranks.update({(day, code): first.get(v) for code, v in values})
    return ranks


@pytest.fixture(scope="module", params=["crowd", "odd", "one value", "narrow"])
def values(request, spark, crowd):
    n = F.col("id")
    odd = (
        F.when(n % 7 == 0, float("nan"))
        .when(n % 7 == 1, float("inf"))
        .when(n % 7 == 2, float("-inf"))
        .when(n % 7 == 3, -0.0)
        .when(n % 7 == 4, 0.0)
        .when(n % 7 == 5, n.cast("double"))
    )
    kinds = {"odd": odd, "one value": F.lit(5.0), "narrow": 1000 + (n % 701) * 0.04}
    if request.param == "crowd":
        return crowd
    return spark.range(2000).select(
        F.format_string("%05d", n).alias("code"),
        F.when(n % 3 == 0, F.lit(D15)).otherwise(F.lit(D16)).alias("date"),
        kinds[request.param].alias("value"),
    )


@pytest.mark.parametrize("descending", [False, True])
def test_ranks(values, descending):
    ranked = crosssection.with_rank(values, "value", descending=descending, tiles=10)
    found = {(r.date, r.code): r.rank for r in ranked.collect()}
    assert found == plain_ranks(values.collect(), descending)
    sizes = {r.date: r.n for r in ranked.where("rank IS NOT NULL").groupBy("date").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    for r in ranked.where("rank IS NOT NULL").collect():
        assert r.decile == (r.rank - 1) * 10 // sizes[r.date] + 1


def test_percentiles(values):
    levels = {"p01": 0.01, "p50": 0.5, "p99": 0.99, "top": 1.0}
    found = crosssection.group_percentiles(values, "value", levels).collect()
    rows = values.collect()
    for row in found:
        known = sorted(
            r.value for r in rows if r.date == row.date and r.value is not None and r.value == r.value
        )
        for name, level in levels.items():
            place = level * (len(known) - 1)
            low, high = known[int(place)], known[-int(-place // 1)]
            share = place - int(place)
            endless = low in (float("inf"), float("-inf"))
            wanted = low if endless or low == high or share == 0 else low + (high - low) * share
            assert row[name] == wanted
    clamped = crosssection.winsorize(values, "value")
    assert clamped.count() == len(rows)
    missing = "value IS NULL OR isnan(value)"
    assert clamped.where(missing).count() == values.where(missing).count()


def test_a_value_of_half_the_rows_fills_no_range(spark, monkeypatch):
    """Ranges hold counted values, so none is above twice the mean, and equal values share a rank."""
    kept = []

    def keep(rows, label="table"):
        stored = materialize(rows, label)
        kept.append((label, stored))
        return stored

    monkeypatch.setattr(crosssection, "materialize", keep)
    n = F.col("id")
    rows = spark.range(20_000).select(
        F.lit(D15).alias("date"), n.alias("code"), F.when(n % 2 == 0, 0.0).otherwise(n.cast("double")).alias("value")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = crosssection.with_rank(rows, "value")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = dict(kept)["ranges"].groupBy("_range").count().toPandas()["count"]
    assert len(ranges) == 8 and ranges.sum() == 10_001 and ranges.max() <= 2 * ranges.mean()
    found = ranked.groupBy("rank").count().orderBy("rank").collect()
    assert [r.rank for r in found] == [1, *range(10_001, 20_001)] and found[0]["count"] == 10_000


def test_ranks_of_several_values_and_null_groups(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, 2.0, 5), (None, 3.0, float("nan"), 4), (None, 3.0, 1.0, None), (None, -0.0, 0.0, 7), ("a", None, 2.0, 9)],
        "g string, x double, y double, z int",
    )
    found = crosssection.with_ranks(rows, {"x": "rx", "y": "ry", "z": "rz"}, ["g"]).collect()
    got = sorted(((r.g, r.z, r.rx, r.ry, r.rz) for r in found), key=str)
    expected = [("a", 5, 1, 1, 1), (None, 4, 2, None, 1), (None, None, 2, 2, None), (None, 7, 1, 1, 2), ("a", 9, None, 1, 2)]
    assert got == sorted(expected, key=str)
    assert crosssection.with_ranks(rows.where("false"), {"x": "rx"}, ["g"]).isEmpty()


def test_zscores(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    scores = {(r.g, r.v): r.z_v for r in crosssection.zscores(rows, ["v"], ["g"]).collect()}
    assert scores["a", 1.0] == pytest.approx(-(0.5**0.5)) and scores["b", 5.0] is None


def test_top_per_group(spark):
    rows = spark.createDataFrame(
        [("c", "g", 1.0), ("b", "g", 2.0), ("a", "g", 2.0), ("d", "g", None)],
        "code string, g string, v double",
    )
    top = crosssection.top_per_group(rows, "v", 2, ["g"])
    assert [(r.code, r.place) for r in top.orderBy("place").collect()] == [("a", 1), ("b", 2)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange")


def history(spark, closes, factor=None):
    start = date(2024, 1, 1)
    return prices(
        spark,
        [
            price_row("1", start + timedelta(days=n), c, (factor or {}).get(n, 1.0))
            for n, c in enumerate(closes)
        ],
    )


def test_returns_cross_a_split(spark):
    rows = returns.multi_period_returns(history(spark, [100.0, 50.0, 60.0], {1: 0.5}), (1, 2))
    found = {r.date.day: (r.ret_1, r.ret_2) for r in rows.collect()}
    assert found[1] == (None, None)
    assert found[2] == (0.0, None)
    assert found[3] == (pytest.approx(0.2), pytest.approx(0.2))
    ahead = returns.with_forward_return(rows)
    assert {r.date.day: r.forward_return for r in ahead.collect()}[2] == pytest.approx(0.2)


def test_features_need_full_windows(spark):
    rows = returns.features(history(spark, [100.0 + n % 5 for n in range(70)]))
    assert rows.where("vol_20d is not null").count() == 50
    assert rows.where("mom_3m is not null").count() == 7


def test_performance(spark):
    closes = returns.adjusted_closes(history(spark, [100.0, 120.0, 90.0, 110.0]))
    row = returns.performance_metrics(closes).first()
    assert row.periods == 3
    assert row.max_drawdown == pytest.approx(-0.25)
    assert row.hit_rate == pytest.approx(2 / 3)
    assert row.cagr == pytest.approx(1.1 ** (252 / 3) - 1)


def test_correlations(spark):
    rows = spark.createDataFrame(
        [(c, date(2024, 1, d), sign * d * 0.01) for c, sign in (("a", 1), ("b", -1)) for d in range(1, 6)],
        "code string, date date, ret_1 double",
    )
    pairs = spark.createDataFrame([("a", "b")], "code_a string, code_b string")
    assert returns.pair_correlation(rows, pairs).first().correlation == pytest.approx(-1.0)
    groups = spark.createDataFrame([("a", "g"), ("b", "h")], "code string, peer_group string")
    own = returns.security_vs_group(rows, groups).collect()
    assert [r.correlation for r in own] == pytest.approx([1.0, 1.0])


def test_forward_fill(spark):
    rows = spark.createDataFrame(
        [("1", date(2024, 1, d), v) for d, v in ((1, 1.0), (2, None), (3, None), (4, None))],
        "code string, date date, v double",
    )
    limited = returns.forward_fill(rows, ["v"], 2).orderBy("date")
    assert [r.v for r in limited.collect()] == [1.0, 1.0, 1.0, None]
    assert returns.forward_fill(rows, ["v"]).where("v is null").isEmpty()


def test_corporate_actions_and_gaps(spark):
    rows = history(spark, [100.0, 50.0, 49.0, 20.0, 30.0], {1: 0.5, 2: 0.98, 4: 1.5})
    kinds = {r.date.day: r.action_type for r in corporate.corporate_actions(rows).collect()}
    assert kinds == {2: "split", 3: "dividend", 5: "other"}
    gaps = corporate.suspicious_gaps(rows).collect()
    assert [(r.date.day, r.previous_close) for r in gaps] == [(4, 49.0)]
    check = corporate.adjustment_check(history(spark, [100.0, 50.0])).first()
    assert (check.compared, check.mismatches) == (2, 0)


def test_point_in_time(spark):
    rows = history(spark, [1.0, 2.0, 3.0, 4.0]).select("code", "date", "close")
    facts = spark.createDataFrame(
        [("1", date(2024, 1, 2), 10), ("1", date(2024, 1, 4), 20), ("2", date(2024, 1, 1), 99)],
        "code string, disclosed_date date, eps int",
    )
    known = signals.point_in_time(rows, facts).orderBy("date").collect()
    assert [r.eps for r in known] == [None, 10, 10, 20]


def test_universe(spark):
    rows = history(spark, [100.0] * 40)
    last = date(2024, 2, 9)
    assert signals.universe(rows, last, 50.0, 10.0, 30).count() == 1
    assert signals.universe(rows, last, 150.0, 10.0, 30).isEmpty()
    assert signals.universe(rows, last, 50.0, 10.0, 90).isEmpty()


def test_rank_ic_and_tiles(crowd):
    assert [r.codes for r in signals.rank_ic(crowd, "value", "other").collect()]
    same_order = signals.rank_ic(crowd.withColumn("again", F.col("value") * 2), "value", "again")
    assert [r.rank_ic for r in same_order.collect()] == pytest.approx([1.0] * 3)
    twice = crowd.withColumn("again", F.col("other") * 2)
    tiles = signals.tile_returns(twice, "other", "again").orderBy("decile").collect()
    means = [r.avg_return for r in tiles]
    assert len(means) == 10 and means == sorted(means)


def test_statements_without_a_day_are_never_known(spark):
    rows = history(spark, [1.0, 2.0]).select("code", "date", "close")
    facts = spark.createDataFrame(
        [("1", None, 99), ("1", date(2024, 1, 2), 10)], "code string, disclosed_date date, eps int"
    )
    known = signals.point_in_time(rows, facts).orderBy("date").collect()
    assert [r.eps for r in known] == [None, 10]
    with pytest.raises(ValueError, match="close"):
        signals.point_in_time(rows, facts.withColumnRenamed("eps", "close"))


def test_zero_closes_have_no_returns(spark):
    closes = history(spark, [0.0, 100.0, 0.0, 50.0]).select("code", "date", "close")
    row = returns.performance_metrics(closes).first()
    assert row.periods == 1 and row.cagr is None and row.max_drawdown == -1.0


def test_unlisted_securities_are_a_group(spark):
    rows = spark.createDataFrame(
        [("a", date(2024, 1, d), d * 0.01) for d in range(1, 6)], "code string, date date, ret_1 double"
    )
    groups = spark.createDataFrame([("b", "g")], "code string, peer_group string")
    assert returns.security_vs_group(rows, groups).first().correlation == pytest.approx(1.0)


def test_scored_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(value):
        seen.add(1)
        return value

    rows = spark.range(6).select(
        F.col("id").alias("code"), (F.col("id") % 2).alias("date"), counted(F.col("id").cast("double")).alias("x")
    )
    scored = crosssection.zscores(rows, ["x"], ["date"]).collect()
    assert sorted(round(r.z_x, 6) for r in scored) == [-1.0, -1.0, 0.0, 0.0, 1.0, 1.0]
    assert seen.value == 6


@pytest.mark.parametrize("descending", [False, True])
def test_windows_of_ranks_are_bounded(spark, monkeypatch, descending):
    """A large group is cut; half of its rows share a value, and a third of the others have none."""
    n = F.col("id")
    value = F.when(n % 2 == 0, 0.0).when(n % 3 == 0, None).otherwise(F.sin(n.cast("double")))
    day = F.when(n % 10 == 0, F.lit(D16)).when(n % 97 > 0, F.lit(D15))
    rows = spark.range(6000).select(day.alias("date"), n.alias("code"), value.alias("value"), (-n).alias("other"))
    plain = {(r.date, r.code): r for r in crosssection.with_rank(rows, "value", descending=descending, tiles=10).collect()}
    monkeypatch.setattr(crosssection, "PART_ROWS", 200)
    names = {"value": "rank", "other": "place"}
    ranked = crosssection.with_ranks(rows, names, descending=descending, tiles={"value": (10, "decile")})
    found = ranked.collect()
    assert len(found) == 6000
    for r in found:
        own = plain[r.date, r.code]
        assert (r.rank, r.decile) == (own.rank, own.decile)
    for day in (D15, D16, None):
        codes = sorted((r.code for r in found if r.date == day), reverse=not descending)
        assert [r.place for r in sorted(found, key=lambda r: r.place) if r.date == day] == list(range(1, len(codes) + 1))
        assert [r.code for r in sorted(found, key=lambda r: r.place) if r.date == day] == codes


def test_windows_of_ranks_hold_so_many_rows(spark, monkeypatch):
    held = []

    def keep(rows, label="table"):
        stored = materialize(rows, label)
        held.append((label, stored.count()))
        return stored

    monkeypatch.setattr(crosssection, "materialize", keep)
    monkeypatch.setattr(crosssection, "PART_ROWS", 200, raising=False)
    n = F.col("id")
    rows = spark.range(6000).select(F.lit(D15).alias("date"), F.sin(n.cast("double")).alias("x"), F.cos(n.cast("double")).alias("y"))
    ranked = crosssection.with_ranks(rows, {"x": "rx", "y": "ry"})
    assert sorted(r.rx for r in ranked.collect()) == list(range(1, 6001))
    # the rows once; cuts and sums of the parts are a few rows a group
    assert sum(rows for _, rows in held) < 6400
    assert "_salt" in ranked._jdf.queryExecution().optimizedPlan().toString()
