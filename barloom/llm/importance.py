"""Importance resampling of documents towards the word statistics of a target set."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from barloom.llm.common import shuffle_partitions
from barloom.session import materialize

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
# What lies between words: ASCII other than digits and letters. Texts are lower-cased (A-Z) first.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Words up to this many bytes have their place in the shift tables.
SHORT = 64
# Words that one Python worker remembers, and the word hashes it works on at a time.
KNOWN = 300_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def _crc_steps() -> np.ndarray:
    """CRC-32 of each single byte, by the reversed polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(0xEDB88320), value >> 1)
    return value.astype(np.uint32)


def shift_tables(longest: int = SHORT) -> np.ndarray:
    """[n, k, b]: what byte k of a CRC, of value b, becomes when n bytes follow.

    A CRC is linear: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b).
    """
    steps = _crc_steps()
    tables = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        tables[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(longest):
        tables[n + 1] = steps[tables[n] & np.uint32(255)] ^ (tables[n] >> np.uint32(8))
    return tables


class Words:
    """Numbers of words seen, with the CRC of each, of a blank and the word, and its length."""

    def __init__(self) -> None:
        self.splitter = pre_tokenizers.Split(Regex(GAP), "removed")
        self.shift = shift_tables()
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[bytes] = []
        self.table = np.zeros((1 << 12, 3), np.int64)

    def _learn(self, word: str) -> int:
        n = len(self.names)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        name = word.encode("utf-8", "surrogatepass")
        self.table[n] = zlib.crc32(name), zlib.crc32(b" " + name), len(name) + 1
        self.names.append(name)
        self.number[word] = n
        return n

    def spans(self, text: str | None) -> list[tuple[str, tuple[int, int]]]:
        """Words of a text with the code points where they start and end."""
        return self.splitter.pre_tokenize_str((text or "").translate(_LOWER))

    def buckets(self, text: str | None, most: int = BUCKETS) -> tuple[int, np.ndarray]:
        """How many words a text has, and the buckets of its words, then of its word pairs.

        A window over two neighbouring spans is a pair; its name is both words and one blank,
        whatever stands between the spans, and its CRC comes from those of its words.
        """
        if len(self.names) > KNOWN:
            self.forget()
        number = self.number
        rows = np.array(
            [number[w] if w in number else self._learn(w) for w, _ in self.spans(text)], np.int64
        )
        if not len(rows):
            return 0, np.empty(0, np.int16)
        crc, with_blank, size = self.table[rows].T
        left, right, follow = crc[:-1], with_blank[1:], size[1:]
        short = np.minimum(follow, SHORT)
        moved = self.shift[short, 0, left & 255]
        for k in range(1, 4):
            moved = moved ^ self.shift[short, k, (left >> (8 * k)) & 255]
        pairs = moved.astype(np.int64) ^ right
        for i in np.flatnonzero(follow > SHORT):
            pairs[i] = zlib.crc32(b" " + self.names[rows[i + 1]], int(left[i]))
        return len(rows), (np.concatenate([crc, pairs]) % most).astype(np.int16)


def bucketed(docs: DataFrame, keep_id: bool = True) -> DataFrame:
    """doc_id, n_words and the buckets of all features of every text of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [words.buckets(text) for text in part.column(1).to_pylist()]
                sizes = [len(own) for _, own in found]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate([own for _, own in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([n for n, _ in found], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    ],
                    ["doc_id", "n_words", "buckets"],
                )

    fields = T.StructType.fromDDL("n_words bigint, buckets array<smallint>").fields
    own = docs.schema["doc_id"] if keep_id else T.StructField("doc_id", T.LongType())
    key = F.col("doc_id") if keep_id else F.lit(None).cast("long").alias("doc_id")
    return docs.select(key, "text").mapInArrow(run, T.StructType([own, *fields]))


def histogram(rows: DataFrame) -> np.ndarray:
    """How many features lie in each bucket: summed by task, then over all; BUCKETS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=BUCKETS)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], ["bucket", "n"])

    counted = rows.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
    result = np.zeros(BUCKETS, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        result[bucket] = n
    return result


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of its smoothed share in the target over that in the corpus)."""
    up = (target + 1.0) * (float(corpus.sum()) + BUCKETS)
    down = (corpus + 1.0) * (float(target.sum()) + BUCKETS)
    return np.floor(1000.0 * np.log(up / down)).astype(np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` of ``bucketed`` with n_features and weight, the floored mean of their gains."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            flat = shared.value[lists.flatten().to_numpy()]
            upto = np.concatenate([[0], np.cumsum(flat)])
            ends = np.cumsum(sizes)
            weight = (upto[ends] - upto[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(weight.astype(np.int64)),
                ],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    fields = T.StructType.fromDDL("n_words bigint, n_features bigint, weight bigint").fields
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x a Gumbel variate) that the doc_id decides; the same on every run."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, most: Column) -> DataFrame:
    """``rows`` (score, doc_id, drawable) with rank: 1, 2, ... by score down, then doc_id, for the
    drawable ones, null beyond ``most`` (of their number, ``n``).

    Rows are dealt once to ranges of (score, doc_id) and stored with their range; ranks are
    places in the range after the counts of the ranges before, one row a range.
    """
    n = shuffle_partitions(rows.sparkSession)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = rows.repartitionByRange(n, F.desc("drawable"), *order)
    dealt = materialize(dealt.withColumn("__range", F.spark_partition_id()), "ranges")
    counted = dealt.groupBy("__range").agg(F.sum(F.col("drawable").cast("long")).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(
        "__range",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("n"),
    )
    inside = Window.partitionBy("__range").orderBy(F.desc("drawable"), *order)
    place = F.row_number().over(inside) + F.col("__before")
    rank = F.when(F.col("drawable") & (place <= most), place.cast("long"))
    return (
        dealt.join(F.broadcast(counted), "__range")
        .withColumn("rank", rank)
        .drop("__range", "__before", "n")
    )


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank for every row of ``docs`` (doc_id, text).

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII; features are
    words and pairs of neighbouring ones, repeats counted, in 10,000 buckets by CRC-32 of their
    UTF-8 bytes. A bucket's gain is the log of its share among the features of ``target`` (text)
    over that among all features of ``docs``; a document's weight the floored mean of its
    features' gains. Score adds Gumbel noise fixed by doc_id, so that the ``percent`` % highest
    scores among documents of at least ``least`` words are an importance sample without
    replacement. rank numbers those drawn from 1 (ties: smaller doc_id first); others have null.

    Null and empty texts have no features and weight 0. A null doc_id counts as empty text in the
    noise and comes last among ties. Rows that repeat are counted and drawn one by one; no target
    rows give equal shares. Other columns are ignored; no rows give no rows.

    Texts are cut into words once; what is stored of them is their buckets. Counts cover all
    rows. Only 10,000 sums and one row a range of scores reach the driver.
    """
    held = materialize(bucketed(docs), "feature-buckets")
    gain = gains(histogram(held), histogram(bucketed(target, keep_id=False)))
    scored = weigh(held, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = scored.withColumn("drawable", F.col("n_words") >= least)
    drawn = F.floor(F.col("n") * percent / 100)
    return ranked(scored, drawn).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank"
    )
