"""Event chains against the window, and late corporate actions on stored bars."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators.adjust import adjust_prices
from barloom.operators.chain import adjust_with_chain, event_chain, extend_chain
from barloom.sinks import adjusted as adjusted_sink
from barloom.sinks.adjusted import read_adjusted, read_chain, readjust_late_actions, write_adjusted
from tests.frames import price_row, prices

START = date(2021, 11, 1)


def market(spark, seed=1, days=120):
    chance = random.Random(seed)
    rows = []
    for k in range(9):
        for n in range(days):
            factor = chance.choice((0.5, 0.1, 2.0, 1 / 3)) if chance.random() < 0.05 * (k % 3) else 1.0
            if chance.random() < 0.02:
                factor = None
            row = list(price_row(f"1{k:02d}0", START + timedelta(n), 100.0 + n, 1.0))
            row[8] = factor
            rows.append(tuple(row))
    return prices(spark, rows)


def by_key(rows):
    return {(r.code, r.date): r.asDict() for r in rows.collect()}


def assert_same(left, right):
    left, right = by_key(left), by_key(right)
    assert left.keys() == right.keys()
    for key, row in left.items():
        other = right[key]
        assert row.keys() == other.keys()
        for name, value in row.items():
            same = pytest.approx(other[name], rel=1e-12) if isinstance(value, float) else other[name]
            assert value == same, (key, name)


@pytest.mark.parametrize("mode", ["add", "replace"])
def test_chain_equals_the_window(spark, mode):
    bars = market(spark)
    found = adjust_with_chain(bars, event_chain(bars), mode, turnover=True)
    assert_same(found, adjust_prices(bars, mode, turnover=True))
    none = bars.where("false")
    assert adjust_with_chain(none, event_chain(none), mode).isEmpty()


def test_bars_are_not_sorted(spark):
    bars = market(spark)
    chain = spark.createDataFrame(event_chain(bars).collect(), event_chain(bars).schema)
    plan = adjust_with_chain(bars, F.broadcast(chain))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_chains_take_late_sets_changes_and_removals(spark):
    bars = market(spark, 2)
    chain = event_chain(bars)
    first = chain.orderBy("code").first()
    changed, removed = first.events[0].date, first.events[-1].date
    actions = [(first.code, changed, 0.25), (first.code, removed, 1.0), ("9999", START, 0.5), ("1000", START, None)]
    schema = "code string, date date, adjustment_factor double"
    renewed = extend_chain(chain, spark.createDataFrame(actions, schema)).collect()
    found = {r.code: r.events for r in renewed}
    assert set(found) == {first.code, "9999", "1000"} and found["1000"] == []
    days = {e.date: e.factor for e in found[first.code]}
    assert days.get(changed) == 0.25 or changed == removed
    assert removed not in days
    assert [(e.factor, e.later) for e in found["9999"]] == [(0.5, 0.5)]


def test_late_actions_rewrite_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "adjusted")
    bars = market(spark, 3)
    write_adjusted(bars, path, 4)
    drop = ["year", "bucket"]
    assert_same(read_adjusted(spark, path).drop(*drop), adjust_prices(bars, "add"))
    files = {r.f for r in read_adjusted(spark, path).select(F.col("_metadata.file_path").alias("f")).collect()}
    day = date(2021, 12, 15)
    actions = spark.createDataFrame([("1000", day, 0.5)], "code string, date date, adjustment_factor double")
    counts = readjust_late_actions(actions, path, 4)
    # bars up to the action's day, all of one bucket and of 2021
    assert counts == {"partitions": 1, "bars": (day - START).days + 1}
    fixed = F.when((F.col("code") == "1000") & (F.col("date") == day), F.lit(0.5))
    after = bars.withColumn("adjustment_factor", F.coalesce(fixed, F.col("adjustment_factor")))
    assert_same(read_adjusted(spark, path).drop(*drop), adjust_prices(after, "add"))
    kept = {r.f for r in read_adjusted(spark, path).select(F.col("_metadata.file_path").alias("f")).collect()}
    gone = {f.rsplit("/", 1)[0] for f in files - kept}
    assert len(gone) == 1 and "year=2021" in gone.pop()
    stored_chain = {r.code: [tuple(e) for e in r.events] for r in read_chain(spark, path).collect()}
    expected = {r.code: [tuple(e) for e in r.events] for r in event_chain(after).collect()}
    assert stored_chain == expected
    # once more: nothing else changes
    assert readjust_late_actions(actions, path, 4) == counts
    assert_same(read_adjusted(spark, path).drop(*drop), adjust_prices(after, "add"))
    none = actions.where("false")
    assert readjust_late_actions(none, path, 4) == {"partitions": 0, "bars": 0}


def test_a_rewrite_shuffles_each_bar_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "adjusted")
    plans = []
    scaled = adjusted_sink.chains.adjust_with_chain

    def seen(bars, chain):
        plans.append(scaled(bars, chain))
        return plans[-1]

    monkeypatch.setattr(adjusted_sink.chains, "adjust_with_chain", seen)
    bars = market(spark, 4)
    stored = str(tmp_path / "bars")
    bars.write.parquet(stored)
    write_adjusted(spark.read.parquet(stored), path, 4)
    schema = "code string, date date, adjustment_factor double"
    readjust_late_actions(spark.createDataFrame([("1000", date(2021, 12, 15), 0.5)], schema), path, 4)
    # bars and chains, and once more the actions
    for plan, shuffles in zip(plans, (2, 3), strict=True):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(code") == shuffles
        assert "rangepartitioning" not in text and "Sort" not in text.replace("SortAggregate", "")
    hidden = {p.name for p in (tmp_path / "adjusted").iterdir() if p.name.startswith("_")}
    assert hidden - {"_SUCCESS"} == {"_chain"}
