"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import count_words, settle

BUCKETS = 1 << 16
# Weights by the rank of a source, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
# How often the pipeline's mix goes on with smaller documents.
ROUNDS = 8
# Up to so many sources, tables of one row a source are broadcast; more are joined by shuffling.
FEW_SOURCES = 100_000


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
) -> DataFrame:
    """Target words of each source, from ``sizes`` (source, size): source, source_size, target.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times
    all words. A target stops at ``most`` times its source; what is cut off is shared again by
    weight until none is above. That ends at one common level, ``min(cap, weight * level)``;
    with sources ordered by cap over weight the full ones are a prefix, so the level follows from
    running sums. One row a source reaches these windows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn(
        "__rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    )
    weight = F.lit(weights[-1])
    for i, value in enumerate(weights[:-1]):
        weight = F.when(F.col("__rank") % len(weights) == i, F.lit(value)).otherwise(weight)
    weighed = ranked.select(
        "source",
        "source_size",
        weight.cast("double").alias("__weight"),
        (F.col("source_size") * most).cast("double").alias("__cap"),
    )
    by_fill = Window.orderBy(F.col("__cap") / F.col("__weight"), F.asc_nulls_last("source"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    goal = F.sum("source_size").over(everything) * F.lit(float(share))
    left = F.sum("__weight").over(everything) - F.coalesce(
        F.sum("__weight").over(before), F.lit(0.0)
    )
    level = (goal - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / left
    levels = weighed.withColumn("__level", level).withColumn(
        "__open", F.col("__level") * F.col("__weight") <= F.col("__cap")
    )
    # The first source that isn't full sets the level; if all are full, there is none.
    chosen = F.first(F.when(F.col("__open"), F.col("__level")), ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(F.col("__cap"), F.col("__weight") * chosen)
    return levels.select(
        "source", "source_size", F.coalesce(target, F.col("__cap")).alias("target")
    )


def uniform(doc_id: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the doc_id alone (null counts as an id)."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def _cut(ranked: DataFrame, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Where each source's rows, by rank, no longer fit its __goal; no row for one that fits whole."""
    running = Window.partitionBy("__source").orderBy("__bucket")
    upto = F.sum("__words").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = (
        ranked.where("__rank IS NOT NULL")
        .groupBy("__source", "__bucket")
        .agg(F.sum("size").alias("__words"), F.first("__goal").alias("__goal"))
        .withColumn("__upto", upto)
    )
    ends = (
        filled.where("__upto > __goal")
        .groupBy("__source")
        .agg(
            F.min(F.struct("__bucket", (F.col("__upto") - F.col("__words")).alias("__before"))).alias(
                "__end"
            )
        )
        .select("__source", F.col("__end.__bucket").alias("__end"), F.col("__end.__before"))
    )
    # A source without an end fits whole.
    marked = ranked.join(small(ends), "__source", "left")
    in_end = marked.where("__bucket = __end")
    in_order = (
        Window.partitionBy("__source")
        .orderBy("__rank", "__row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.col("__before") + F.sum("size").over(in_order)
    fits = F.col("__upto") <= F.col("__goal")
    # The bucket of an end has rows, so each end has its row here, fitting rows or none.
    return (
        in_end.withColumn("__upto", upto)
        .groupBy("__source")
        .agg(
            F.first("__end").alias("__cut_bucket"),
            F.max(F.when(fits, F.struct("__rank", "__row"))).alias("__last"),
            F.coalesce(F.max(F.when(fits, F.col("__upto"))), F.first("__before")).alias("__reached"),
        )
    )


def _before_cut() -> Column:
    return (
        F.col("__cut_bucket").isNull()
        | (F.col("__bucket") < F.col("__cut_bucket"))
        | (
            (F.col("__bucket") == F.col("__cut_bucket"))
            & F.coalesce(F.struct("__rank", "__row") <= F.col("__last"), F.lit(False))
        )
    )


def pareto_mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    rounds: int = 0,
) -> DataFrame:
    """How often each row of ``docs`` (doc_id, text, source) enters a mix that meets source targets.

    Returns doc_id, source, size (words; null text: 0), source_size, target, copies, taken.
    A source whose target is r times its words takes every document floor(r) times for certain.
    For the rest, each document has inclusion probability p = r - floor(r) and ranks by its odds
    u / (1 - u) divided by p / (1 - p), u being fixed by its doc_id. As p is one for all documents of
    a source, that is the order of u: an equal-probability sample within the source. The sample's size is fixed in
    words: the source's documents are taken in ascending rank as long as they fit what is left of
    the target, and one more, the document whose size is nearest to the gap, where that narrows it.

    A document that does not fit ends the sample there, as the SQL of ``op1_pareto_mix`` has it; a
    very long one leaves a source far off its target. With ``rounds``, documents larger than what is
    left are passed over and the sample goes on in rank with those that fit, up to so many times.

    Reruns agree. Rows repeated under one doc_id are drawn one by one. Null sources are one
    source; a source without words has target 0. Empty texts have no words: they are taken as
    the rank says, at no cost. Other columns are ignored; no rows give no rows.

    Texts are read once, for their word counts. A source is never gathered: what is known of it is
    one row, broadcast unless sources are many; ranks fall into
    65,536 buckets, whose word totals are running sums per source, and only the bucket in which
    a source's sample ends is ordered row by row.
    """
    sizes = settle(
        docs.select(
            "doc_id",
            "source",
            count_words(F.col("text")).alias("size"),
            uniform(F.col("doc_id")).alias("__u"),
            F.monotonically_increasing_id().alias("__row"),
        )
    )
    targets = settle(source_targets(sizes.select("source", "size"), weights, share, most))
    few = targets.count() <= FEW_SOURCES
    small: Callable[[DataFrame], DataFrame] = F.broadcast if few else lambda rows: rows
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("__whole", F.floor(ratio).cast("long")).select(
        F.coalesce(F.xxhash64("source", F.col("source").isNull()), F.lit(0)).alias("__source"),
        "source_size",
        "target",
        "__whole",
        (F.col("target") - F.col("__whole") * F.col("source_size")).alias("__goal"),
        (ratio - F.col("__whole")).alias("__p"),
    )
    odds = F.col("__u") / (1 - F.col("__u"))
    inclusion = F.col("__p") / (1 - F.col("__p"))
    ranked = (
        sizes.withColumn("__source", F.xxhash64("source", F.col("source").isNull()))
        .join(small(targets), "__source")
        .withColumn("__rank", F.when(F.col("__p") > 0, odds / inclusion))
        # rank / (1 + rank) rises with the rank and lies between 0 and 1
        .withColumn(
            "__bucket", F.floor(F.col("__rank") / (1 + F.col("__rank")) * BUCKETS).cast("int")
        )
    )
    cut = _cut(ranked, small)
    drawn = ranked.join(small(cut), "__source", "left").withColumn(
        "__in",
        F.col("__rank").isNotNull() & _before_cut(),
    )
    for _ in range(rounds):
        # a source that fits whole has no gap
        drawn = settle(drawn.withColumn("__goal", F.col("__goal") - F.col("__reached")))
        fits = F.col("__rank").isNotNull() & ~F.col("__in") & (F.col("size") <= F.col("__goal"))
        left = drawn.drop("__cut_bucket", "__last", "__reached").withColumn("__fits", fits)
        open_rows = left.where("__fits")
        if open_rows.isEmpty():
            drawn = drawn.withColumn("__reached", F.when(F.col("__goal").isNotNull(), F.lit(0.0)))
            break
        everything = open_rows.groupBy("__source").agg(F.sum("size").alias("__all"))
        cut = _cut(open_rows, small)
        drawn = (
            left.join(small(everything), "__source", "left")
            .join(small(cut), "__source", "left")
            .withColumn("__in", F.col("__in") | (F.col("__fits") & _before_cut()))
            .withColumn("__reached", F.coalesce("__reached", "__all", F.lit(0)))
            .drop("__fits", "__all")
        )
    gap = F.col("__goal") - F.col("__reached")
    closing = (
        drawn.where(F.col("__rank").isNotNull() & ~F.col("__in"))
        .where(F.abs(F.col("size") - gap) < gap)
        .groupBy("__source")
        .agg(F.min(F.struct(F.abs(F.col("size") - gap), "__rank", "__row")).alias("__close"))
        .select("__source", F.col("__close.__row").alias("__closing"))
    )
    copies = F.col("__whole") + F.when(
        F.col("__in") | F.coalesce(F.col("__row") == F.col("__closing"), F.lit(False)), 1
    ).otherwise(0)
    return drawn.join(small(closing), "__source", "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )
