from __future__ import annotations

from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.operators.adjust import (
    adjust_prices,
    adjust_to_reference,
    adjustment_events,
    cumulative_adjustment,
)
from barloom.operators.history import (
    head,
    last_n,
    first_n,
    latest_price,
    not_of_codes,
    of_codes,
    price_history,
    price_series,
    select_columns,
)
from tests.frames import D15, D16, price_row, prices, split_history, two_by_two


def values(rows, column):
    return [row[column] for row in rows.orderBy("code", "date").collect()]


@pytest.fixture(scope="module")
def several(spark):
    """The split history, and securities with no, one and many events on other days."""
    other = [
        price_row(code, D15 + timedelta(days=step), 40.0 + step, factor)
        for code, factors in {
            "20000": [1.0] * 4,
            "30000": [0.5, 1.0, 0.25, 2.0],
            "40000": [None, 2.0, None, 0.5, 3.0],
        }.items()
        for step, factor in enumerate([f or 1.0 for f in factors])
    ]
    return split_history(spark).unionByName(prices(spark, other).drop("adj_close")).persist()


def plain(rows, field, adjusted):
    """What a field is after scaling by the factors of later days, worked out bar by bar."""
    expected = {}
    for bar in rows:
        scale = 1.0
        for other in rows:
            if adjusted and other.code == bar.code and other.date > bar.date:
                scale *= other.adjustment_factor
        expected[bar.code, bar.date] = bar[field] / scale if field == "volume" else bar[field] * scale
    return expected


# Expected values of the split history are fixed.
@pytest.mark.parametrize(
    ("field", "by_default", "split"),
    [
        ("open", True, [100.0, 110.0]),
        ("high", True, [110.0, 120.0]),
        ("low", True, [290.0 / 3, 105.0]),
        ("close", True, [105.0, 115.0]),
        ("volume", True, [2700.0, 2700.0]),
        ("turnover_value", False, [283500.0, 310500.0]),
        ("adjustment_factor", None, [1.0, 1 / 3]),
    ],
)
def test_every_field(several, field, by_default, split):
    """Series, added and replaced columns of a field follow the plain product."""
    rows = several.collect()

    def found(frame, column):
        return {(r.code, r.date): r[column] for r in frame.collect()}

    default = found(price_series(several, field), field)
    assert default == pytest.approx(plain(rows, field, bool(by_default)))
    assert [default["13010", day] for day in (D15, D16)] == pytest.approx(split)
    assert found(price_series(several, field, adjusted=False), field) == pytest.approx(
        plain(rows, field, False)
    )
    forced = found(price_series(several, field, adjusted=True), field)
    assert forced == pytest.approx(plain(rows, field, by_default is not None))
    if by_default is not None:
        added = adjust_prices(several, "add", turnover=True)
        assert found(added, f"adj_{field}") == pytest.approx(plain(rows, field, True))
        assert found(added, field) == plain(rows, field, False)
        replaced = adjust_prices(several, "replace", turnover=True)
        assert replaced.columns == several.columns
        assert found(replaced, field) == pytest.approx(plain(rows, field, True))


def test_events(spark):
    events = adjustment_events(split_history(spark)).collect()
    assert [(e.date, e.adjustment_factor) for e in events] == [(D16, pytest.approx(1 / 3))]


def test_days_are_filtered_before_adjusting(spark):
    early = price_history(split_history(spark), end=D15, adjust="add")
    assert values(early, "adj_open") == [300.0]


def test_stored_adj_close_is_overwritten_in_add_mode(spark):
    rows = prices(spark, [price_row("1", D15, 100.0, 0.5), price_row("1", D16, 60.0, 0.5)])
    assert values(adjust_prices(rows, "add"), "adj_close") == [50.0, 60.0]


def test_zero_multiplier_leaves_volume(spark):
    rows = prices(spark, [price_row("1", D15, 100.0), price_row("1", D16, 60.0, 0.0)])
    added = adjust_prices(rows, "add")
    assert values(added, "adj_volume") == [1000.0, 1000.0]
    assert values(added, "adj_close") == [0.0, 60.0]


def test_missing_columns_are_skipped(spark):
    slim = split_history(spark).select("code", "date", "close", "adjustment_factor")
    assert set(adjust_prices(slim, "add").columns) - set(slim.columns) == {"adj_close"}
    bare = slim.drop("adjustment_factor")
    assert adjust_prices(bare, "add").columns == bare.columns
    with pytest.raises(ValueError):
        adjust_prices(slim, "other")


def test_reference_days(spark):
    rows = split_history(spark)
    assert values(adjust_to_reference(rows), "adj_close") == pytest.approx([105.0, 115.0])
    assert values(adjust_to_reference(rows, "earliest"), "adj_close") == pytest.approx([315.0, 345.0])
    assert values(adjust_to_reference(rows, D15), "adj_close") == pytest.approx([315.0, 345.0])
    assert values(adjust_to_reference(rows, D16), "adj_close") == pytest.approx([105.0, 115.0])


def test_latest_equals_last_row_of_adjusted_history(spark):
    rows = split_history(spark).unionByName(
        split_history(spark).withColumn("code", F.lit("99990")).where(F.col("date") == F.lit(D15))
    )
    history = adjust_prices(rows, "replace")
    expected = {r.code: r for r in last_n(history, 1).collect()}
    latest = {r.code: r for r in latest_price(rows).collect()}
    assert latest == expected
    assert {r.close for r in latest_price(rows, ["close"]).collect()} == {115.0, 315.0}


def test_selection_helpers(spark):
    rows = two_by_two(spark)
    assert of_codes(rows, []).count() == 4
    assert of_codes(rows, ["1301"]).count() == 2
    picked = spark.createDataFrame([("1332",)], "code string")
    assert {r.code for r in of_codes(rows, picked).collect()} == {"1332"}
    assert {r.code for r in not_of_codes(rows, ["1332"]).collect()} == {"1301"}
    assert {r.code for r in not_of_codes(rows, picked).collect()} == {"1301"}
    assert head(rows, 0).count() == 4 and head(rows, 3).count() == 3
    assert {r.date for r in first_n(rows, 1).collect()} == {D15}
    with pytest.raises(ValueError, match="nothing"):
        select_columns(rows, ["code", "nothing"])


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.lists(st.sampled_from([0.25, 0.5, 1.0, 2.0, None]), min_size=1, max_size=30),
        min_size=1,
        max_size=4,
    )
)
def test_against_plain_loops(spark, histories):
    rows, expected = [], {}
    for number, factors in enumerate(histories):
        code = f"{number:04d}0"
        product = 1.0
        for step in range(len(factors) - 1, -1, -1):
            day = date(2024, 1, 1) + timedelta(days=step)
            rows.append(price_row(code, day, 64.0, 1.0)[:8] + (factors[step], None, "t"))
            expected[code, day] = product
            product *= 1.0 if factors[step] is None else factors[step]
    frame = prices(spark, rows)
    found = {(r.code, r.date): r.m for r in cumulative_adjustment(frame, "m").collect()}
    assert found == expected
    kept = adjust_prices(frame, "add").where(
        F.col("adj_close") * F.col("adj_volume") != F.col("close") * F.col("volume")
    )
    assert kept.isEmpty()
    flat = adjust_prices(frame.withColumn("adjustment_factor", F.lit(1.0)), "add")
    assert flat.where("adj_close <> close or adj_volume <> volume").isEmpty()
