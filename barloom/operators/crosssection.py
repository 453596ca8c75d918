"""Ranks, percentiles and standard scores across all securities of a day.

A day holds as many rows as there are securities, and nothing bounds that. Percentiles and the rank
of one value (``with_rank``) therefore count values first: equal values of a group become one row with
their number, combined by map task, so a value that half of a day's rows share weighs no more than any
other. The counted values are dealt into ranges of (group, value) whose borders follow them and stored
once; inside a range they are ordered, and totals of the ranges, a few rows a group, place each range
in its group. Rows get their places by a join on the value.

Ranks of several values (``with_ranks``) order the rows instead, in windows of so many rows at most: a
small group is one of them, a large one is cut at percentiles. No step gathers a large group.

NaN counts as missing, like null: it has no rank and no part in percentiles and
moments. Infinite values rank at the ends; they have no part in moments.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import materialize

BEFORE, TOTAL = "_before", "_total"
_KEY, _RANGE, _PART, _ROW, _N = "_key", "_range", "_part", "_row", "_n"
# Rows that a window of ranks orders in one piece; larger groups are cut.
PART_ROWS = 1 << 17
# A spread this small is rounding, not spread.
LEAST_SPREAD = 1e-9


def _known(rows: DataFrame, value: str) -> Column:
    """The value, null where it is NaN."""
    if isinstance(rows.schema[value].dataType, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(value), F.col(value))
    return F.col(value)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(and_, [left[name].eqNullSafe(right[name]) for name in names])


def value_places(
    counted: DataFrame, value: str, group: Sequence[str], descending: bool = False
) -> DataFrame:
    """Counted values (group, value, ``_n``) with their place in the order of their group.

    Adds ``_before`` (rows of values that come earlier) and ``_total`` (rows of the group). The values,
    each once a group and none missing, are written to the shared folder while the plan is built:
    ranges must be the same for every branch that reads them.
    """
    group = list(group)
    order = F.desc(value) if descending else F.asc(value)
    dealt = counted.repartitionByRange(*group, order)
    stored = materialize(dealt.withColumn(_RANGE, F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*group, _RANGE).orderBy(order)
    inside = F.coalesce(F.sum(_N).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.partitionBy(*group)
    ahead = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ranges = stored.groupBy(*group, _RANGE).agg(F.sum(_N).alias("_all"))
    offsets = ranges.select(
        *group,
        _RANGE,
        F.coalesce(F.sum("_all").over(ahead), F.lit(0)).alias("_ahead"),
        F.sum("_all").over(whole).alias(TOTAL),
    )
    placed = stored.withColumn("_inside", inside)
    return placed.join(offsets, _same(placed, offsets, [*group, _RANGE])).select(
        *[placed[name] for name in counted.columns],
        (F.col("_ahead") + F.col("_inside")).alias(BEFORE),
        TOTAL,
    )


def _cuts(stored: DataFrame, value: str, group: Sequence[str], parts: int) -> DataFrame:
    """Values that cut the groups above ``PART_ROWS`` into so many parts, ``_cuts`` of each such group."""
    whole = stored.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    large = whole.where(F.col("_all") > PART_ROWS).select(
        *[F.col(name).alias(f"_of_{name}") for name in group]
    )
    same = [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in group]
    levels = [i / parts for i in range(1, parts)]
    cut = F.array_distinct(F.percentile_approx(_key(stored, value), levels, 20 * parts))
    held = stored.join(large, reduce(and_, same, F.lit(True)), "left_semi")
    return materialize(held.groupBy(*group).agg(cut.alias("_cuts")), "cuts")


def _key(rows: DataFrame, value: str) -> Column:
    """The known value with one zero: 0.0 and -0.0 are equal."""
    if isinstance(rows.schema[value].dataType, T.DoubleType | T.FloatType):
        return _known(rows, value) + F.lit(0.0)
    return F.col(value)


def _joined(rows: DataFrame, facts: DataFrame, names: Sequence[str]) -> DataFrame:
    """The facts of equal names, nulls among them, beside all rows."""
    facts = facts.withColumnsRenamed({name: f"_of_{name}" for name in names})
    same = [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in names]
    return rows.join(facts, reduce(and_, same, F.lit(True)), "left").drop(
        *[f"_of_{name}" for name in names]
    )


def _with_place(
    rows: DataFrame, stored: DataFrame, value: str, group: Sequence[str], descending: bool, parts: int
) -> DataFrame:
    """Add ``_before_<value>`` and ``_total_<value>`` to ``rows``, which have the rows of ``stored``."""
    order = F.desc_nulls_last(_KEY) if descending else F.asc_nulls_last(_KEY)
    before, total = f"_before_{value}", f"_total_{value}"
    if parts == 1:
        whole = Window.partitionBy(*group)
        return rows.withColumn(_KEY, _key(stored, value)).withColumns(
            {
                before: F.when(F.col(_KEY).isNotNull(), F.rank().over(whole.orderBy(order)) - F.lit(1).cast("long")),
                total: F.count(_KEY).over(whole),
            }
        ).drop(_KEY)
    cuts = _cuts(stored, value, group, parts)

    def parted(held: DataFrame) -> DataFrame:
        cut = _joined(held.withColumn(_KEY, _key(stored, value)), cuts, group)
        below = F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(_KEY)))
        part = 2 * below + F.array_contains("_cuts", F.col(_KEY)).cast("int")
        known = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(part)
        return cut.withColumn(_PART, F.when(F.col(_KEY).isNotNull(), known).otherwise(F.lit(-1))).drop("_cuts")

    whole = Window.partitionBy(*group)
    ahead = whole.orderBy(F.desc(_PART) if descending else F.asc(_PART))
    sums = parted(stored.select(*dict.fromkeys([*group, value]))).groupBy(*group, _PART).agg(F.count(_KEY).alias(_N))
    totals = materialize(
        sums.select(
            *group,
            _PART,
            (F.sum(_N).over(ahead) - F.col(_N)).alias("_ahead"),
            F.sum(_N).over(whole).alias(total),
        ),
        "parts",
    )
    alike = (F.col(_PART) < 0) | (F.col(_PART) % 2 == 1)
    salted = parted(rows).withColumn("_salt", F.when(alike, F.col(_ROW) % parts).otherwise(F.lit(0)))
    inside = F.rank().over(Window.partitionBy(*group, _PART, "_salt").orderBy(order)) - 1
    placed = _joined(salted.withColumn("_inside", inside), totals, [*group, _PART])
    place = F.when(F.col(_KEY).isNotNull(), F.col("_ahead") + F.col("_inside"))
    return placed.withColumn(before, place).drop(_KEY, _PART, "_salt", "_inside", "_ahead")


def with_ranks(
    rows: DataFrame,
    names: dict[str, str],
    group: Sequence[str] = ("date",),
    descending: bool = False,
    tiles: dict[str, tuple[int, str]] | None = None,
) -> DataFrame:
    """Add the ranks of several values within their groups: value column to rank column.

    Equal values share the smallest rank; a missing value has a null rank. ``tiles`` cuts groups by
    the rank of a value into so many parts, in a column of the given name: equal values always fall
    into the same part. Values are numbers, dates or times.

    The rows are stored once and ordered by a window each value. Where a group has more than
    ``PART_ROWS`` rows, percentiles of the value cut the large groups: a value that is a cut is a part of
    its own, whose rows all have one place and may lie in any task; what is between two cuts is a part
    that is ordered by itself. Sums of the parts, a few rows a group, place each part in its group.
    """
    group = list(group)
    stored = materialize(rows.withColumn(_ROW, F.monotonically_increasing_id() % (1 << 20)), "ranked")
    sizes = stored.groupBy(*group).agg(F.count(F.lit(1)).alias(_N))
    largest = sizes.agg(F.max(_N)).first()[0] or 0
    result = stored
    for value in names:
        result = _with_place(result, stored, value, group, descending, -(-max(largest, 1) // PART_ROWS))
    return _ranks_and_tiles(result, rows.columns, names, tiles)


def _ranks_and_tiles(
    placed: DataFrame,
    columns: Sequence[str],
    names: dict[str, str],
    tiles: dict[str, tuple[int, str]] | None,
) -> DataFrame:
    ranks = [(F.col(f"_before_{value}") + 1).alias(name) for value, name in names.items()]
    for value, (parts, name) in (tiles or {}).items():
        share = F.col(f"_before_{value}") * parts / F.col(f"_total_{value}")
        ranks.append((F.floor(share).cast("int") + 1).alias(name))
    return placed.select(*columns, *ranks)


def with_rank(
    rows: DataFrame,
    value: str,
    group: Sequence[str] = ("date",),
    name: str = "rank",
    descending: bool = False,
    tiles: int | None = None,
    tile_name: str = "decile",
) -> DataFrame:
    """Add the rank of one value within its group, and its tile, as ``with_ranks`` does.

    Places come from counted values and a join on the value, so values may be of any type; it takes
    more shuffles than ``with_ranks``.
    """
    group = list(group)
    stored = materialize(rows, "ranked")
    known = stored.select(*group, _known(stored, value).alias(_KEY)).where(F.col(_KEY).isNotNull())
    counted = known.groupBy(*group, _KEY).agg(F.count(F.lit(1)).alias(_N))
    own = value_places(counted, _KEY, group, descending).select(
        *[F.col(column).alias(f"_of_{column}") for column in group],
        F.col(_KEY),
        F.col(BEFORE).alias(f"_before_{value}"),
        F.col(TOTAL).alias(f"_total_{value}"),
    )
    same = [stored[column].eqNullSafe(F.col(f"_of_{column}")) for column in group]
    met = reduce(and_, same, _known(stored, value) == F.col(_KEY))
    cut = {value: (tiles, tile_name)} if tiles is not None else None
    return _ranks_and_tiles(stored.join(own, met, "left"), rows.columns, {value: name}, cut)


def group_percentiles(
    rows: DataFrame, value: str, levels: dict[str, float], group: Sequence[str] = ("date",)
) -> DataFrame:
    """Exact percentiles of each group, one column per level; groups without values have none.

    Between two values ``low`` and ``high`` it is ``low + (high - low) * share``;
    next to an infinite one it is that one.
    """
    known = rows.select(*group, _known(rows, value).alias(_KEY)).where(F.col(_KEY).isNotNull())
    counted = known.groupBy(*group, _KEY).agg(F.count(F.lit(1)).alias(_N))
    placed = value_places(counted, _KEY, group)
    measures: list[Column] = []
    for name, level in levels.items():
        position = F.lit(level) * (F.col(TOTAL) - 1)
        for edge, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col(BEFORE) <= index) & (index < F.col(BEFORE) + F.col(_N))
            measures.append(F.max(F.when(here, F.col(_KEY))).alias(f"_{name}_{edge}"))
    picked = placed.groupBy(*group).agg(*measures, F.max(TOTAL).alias(TOTAL))
    result = []
    for name, level in levels.items():
        position = F.lit(level) * (F.col(TOTAL) - 1)
        share = position - F.floor(position)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        endless = F.abs(low) == float("inf")
        between = F.when(endless | (low == high) | (share == 0), low).otherwise(
            low + (high - low) * share
        )
        result.append(between.alias(name))
    return picked.select(*group, *result)


def winsorize(
    rows: DataFrame,
    value: str,
    lower: float = 0.01,
    upper: float = 0.99,
    group: Sequence[str] = ("date",),
) -> DataFrame:
    """Clamp a value to the given percentiles of its group (D12); a missing one stays as it is."""
    limits = group_percentiles(rows, value, {"_low": lower, "_high": upper}, group)
    clamped = F.greatest(F.least(F.col(value), F.col("_high")), F.col("_low"))
    clamped = F.when(_known(rows, value).isNotNull(), clamped).otherwise(F.col(value))
    return rows.join(limits, list(group), "left").withColumn(value, clamped).drop("_low", "_high")


def zscores(rows: DataFrame, values: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Distances from the group mean in sample deviations, ``z_<value>``.

    Null without a spread above ``LEAST_SPREAD``, and for missing and infinite
    values. The moments of all values are one aggregate with map-side partials,
    joined back; null groups are groups of their own. The rows are stored once, as both
    the moments and the join read them.
    """
    rows = materialize(rows, "scored")
    moments, finite = [], {}
    for value in values:
        known = _known(rows, value)
        finite[value] = F.when(F.abs(known) < float("inf"), known)
        moments += [
            F.avg(finite[value]).alias(f"_mean_{value}"),
            F.stddev_samp(finite[value]).alias(f"_std_{value}"),
        ]
    keys = {name: f"_group_{name}" for name in group}
    per_group = rows.groupBy(*group).agg(*moments).withColumnsRenamed(keys)
    same = [F.col(name).eqNullSafe(F.col(key)) for name, key in keys.items()]
    joined = rows.join(per_group, reduce(and_, same), "left")
    scores = [
        F.when(
            F.col(f"_std_{value}") > LEAST_SPREAD,
            (finite[value] - F.col(f"_mean_{value}")) / F.col(f"_std_{value}"),
        ).alias(f"z_{value}")
        for value in values
    ]
    return joined.select(*rows.columns, *scores)


def top_per_group(
    rows: DataFrame, value: str, n: int, group: Sequence[str], tie_break: str = "code"
) -> DataFrame:
    """The n largest values of each group (D15); each map task passes on at most n rows."""
    best_first = Window.partitionBy(*group).orderBy(F.desc(value), tie_break)
    return (
        rows.where(F.col(value).isNotNull())
        .withColumn("place", F.row_number().over(best_first))
        .where(F.col("place") <= n)
    )
