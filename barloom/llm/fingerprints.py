"""Threshold-scaled sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import TIE_PARTS, let, with_order_bucket, words

WORDS = 5
SCALE = 8


def sketch(text: Column, n: int = WORDS, scale: int = SCALE) -> Column:
    """The hashes of a text's ``n``-word shingles that lie in the lowest 1/``scale`` of all hashes.

    A sorted array of longs. A text of fewer words is one shingle. The smallest hash always stays,
    so only a text without words (or null) has an empty sketch. The sketch of two documents
    together is the union of theirs, cut by the same rule.
    """

    def shingles(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        whole = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
        return F.when(F.size(w) >= n, hashed).otherwise(
            F.coalesce(whole, F.array().cast("array<bigint>"))
        )

    return let(let(words(text), shingles), lambda hashes: cut(hashes, scale))


def cut(hashes: Column, scale: int = SCALE) -> Column:
    """Hashes below the fraction, and the smallest one in any case; sorted, each once."""
    limit = F.lit(-(1 << 63) + (1 << 64) // scale)
    return let(
        F.array_min(hashes),
        lambda least: F.array_sort(
            F.array_distinct(F.filter(hashes, lambda h: (h < limit) | (h == least)))
        ),
    )


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two sketched texts' shingles together."""
    return cut(F.array_union(a, b), scale)


def digest(hashes: Column) -> Column:
    """A sketch as a string of 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch found in the other, 0 to 1; of two empty ones, 1.

    A text of n shingles has no hash below 1/8 with chance (7/8)^n (51 % at 5, 7 % at 20). A longer
    text's sketch does not keep its one hash, so the share is 0 even if it holds the text whole.
    """
    smaller = F.least(F.size(a), F.size(b))
    return (
        F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0)
        .when(smaller == 0, 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / smaller)
    )


def with_next(docs: DataFrame, **carried: Column) -> DataFrame:
    """doc_id, and each carried column as ``<name>`` and ``next_<name>``, the next row's value.

    Rows of ``docs`` (doc_id, text) follow each other in descending doc_id, null ids last, rows
    of one id by the hash of their text; after the last row comes the first. Carried columns are
    functions of the text that are never null. No rows give no rows.

    Texts are shuffled once, into ordered buckets. There the next row is a window's lead; the end
    of a bucket is joined to the first row of the bucket below it, one row a bucket.
    """
    names = list(carried)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__tie"))
    dealt = with_order_bucket(keyed, "doc_id", "__tie", "__bucket")
    order = [
        F.desc_nulls_last("doc_id"),
        F.pmod(F.col("__tie"), F.lit(TIE_PARTS)).desc(),
        F.desc_nulls_last("__tie"),
    ]
    inside = Window.partitionBy("__bucket").orderBy(*order)
    rows = (
        dealt.repartition("__bucket")
        .select("doc_id", "__tie", "__bucket", *[value.alias(name) for name, value in carried.items()])
        .withColumn("__lead", F.lead(F.struct(*names)).over(inside))
    )
    # The first row of each bucket, found by ids alone; equal rows are one candidate.
    first = F.max(
        F.struct(
            F.col("doc_id").isNotNull().alias("keyed"),
            "doc_id",
            F.pmod(F.col("__tie"), F.lit(TIE_PARTS)).alias("part"),
            F.col("__tie").alias("tie"),
        )
    )
    heads = dealt.groupBy("__bucket").agg(first.alias("__head"))
    downwards = Window.orderBy(F.desc("__bucket"))
    turn = Window.partitionBy(F.lit(0)).orderBy(F.desc("__bucket"))
    links = heads.select(
        F.col("__bucket").alias("__end"),
        F.coalesce(F.lead("__head").over(downwards), F.first("__head").over(turn)).alias("__head"),
    ).select(
        "__end", F.col("__head.doc_id").alias("__id"), F.col("__head.tie").alias("__head_tie")
    )
    after = (
        keyed.join(
            F.broadcast(links),  # one row a bucket, a small multiple of the shuffle partitions
            F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__head_tie") == F.col("__tie")),
        )
        .dropDuplicates(["__end"])
        .select("__end", F.struct(*[v.alias(name) for name, v in carried.items()]).alias("__after"))
    )
    joined = rows.join(
        after, (F.col("__bucket") == F.col("__end")) & F.col("__lead").isNull(), "left"
    )
    following = F.coalesce("__lead", "__after")
    return joined.select(
        "doc_id", *names, *[following[name].alias(f"next_{name}") for name in names]
    )


def edited(text: Column, following: Column) -> Column:
    """A text whose last half of code points gives way to as many (or all) first ones of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half)
    )


def edit_likeness(docs: DataFrame, n: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprint every text, its edited text and the next document, and compare them.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (containments), n_hashes. Null texts count as empty. Texts shorter than two code
    points are their own edited text. See ``with_next`` for the order and ``sketch`` for the rest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_next(docs, text=text, sketch=sketch(text, n, scale))
    rows = rows.withColumn("__edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        "sketch",
        "next_sketch",
        sketch(F.col("__edited"), n, scale).alias("__edited_sketch"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        digest(F.col("sketch")).alias("fingerprint"),
        digest(F.col("__edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("__edited_sketch")).alias("near_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.size("sketch").alias("n_hashes"),
    )
