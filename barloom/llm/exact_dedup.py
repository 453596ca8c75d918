"""Exact duplicates by an exchange of Golomb-coded fingerprints; only suspects' texts move."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import shuffle_partitions
from barloom.session import materialize

# A fingerprint has so many bits more than the number of rows: one row in 2^10 is a false suspect.
SPARE_BITS = 10
# A sender is a run of at most so many rows of one task.
SENDER_ROWS = 1 << 17
# Rows whose fingerprints one owner receives: at least and at most, about.
OWNER_LEAST, OWNER_MOST = 1 << 12, 1 << 22
# Rows whose bitmaps are broadcast at once: 32 MB of bits, whatever the input.
SLICE_ROWS = 1 << 28

_STORED = """sender bigint, slice int, class int, sha binary, text binary,
    ids array<{kind}>, chars array<bigint>,
    owner int, divisor int, quotients binary, remainders binary, order array<int>, twice array<boolean>"""


@dataclass(frozen=True)
class Exchange:
    """Sizes that follow from the number of rows."""

    width: int
    owners: int
    slices: int

    @classmethod
    def of(cls, rows: int, partitions: int) -> Exchange:
        width = min(62, max(rows, 2).bit_length() + SPARE_BITS)
        owners = max(math.ceil(rows / OWNER_MOST), min(partitions, math.ceil(rows / OWNER_LEAST)), 1)
        return cls(width, owners, max(math.ceil(rows / SLICE_ROWS), 1))

    @property
    def span(self) -> int:
        """Fingerprints an owner is in charge of: a range."""
        return -(-(1 << self.width) // self.owners)

    def fingerprint(self, sha: bytes) -> int:
        return int.from_bytes(sha[:8], "big") >> (64 - self.width)


def normalized(text: bytes) -> bytes:
    """A text without any blank, tab, line feed, vertical tab, form feed or return."""
    return b"".join(text.split())


def encode_golomb(values: np.ndarray, below: int) -> tuple[int, bytes, bytes]:
    """Ascending integers under ``below`` as Golomb codes of their gaps.

    The divisor is the power of two nearest below ln 2 times the mean gap. Quotients in unary and
    remainders are kept apart, so that both are read at once.
    """
    gaps = np.diff(values, prepend=0).astype(np.int64)
    divisor = max(int(math.log2(max(below / max(len(values), 1) * math.log(2), 1))), 0)
    ends = np.cumsum((gaps >> divisor) + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    bits = (gaps[:, None] >> np.arange(divisor)) & 1
    return divisor, np.packbits(unary).tobytes(), np.packbits(bits.astype(np.uint8)).tobytes()


def decode_golomb(n: int, divisor: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """The ``n`` integers of ``encode_golomb``."""
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)) == 0)[:n]
    high = np.diff(stops, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * divisor)
    low = bits.reshape(n, divisor).astype(np.int64) @ (1 << np.arange(divisor, dtype=np.int64))
    return np.cumsum((high.astype(np.int64) << divisor) + low)


def _send(docs: DataFrame, plan: Exchange) -> DataFrame:
    """Rows of three kinds, told apart by what is null.

    Every row's text with the number of its class (rows of one sender and one hash); at a sender's
    end its classes with their rows' doc_ids and code points, and a message for each owner: the
    sorted coded fingerprints, the class of each and whether several rows of the sender share it.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType.fromDDL(_STORED.format(kind=kind.simpleString()))
    names = schema.fieldNames()

    def batch_of(n: int, kinds: dict, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns[name], kinds[name]) if name in columns else pa.nulls(n, kinds[name])
                for name in names
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        classes: dict[bytes, int] = {}
        ids: list[list] = []
        chars: list[list] = []
        rows, block, partition = 0, 0, None

        def close(sender: int) -> Iterator[pa.RecordBatch]:
            n = len(classes)
            where = [partition % plan.slices] * n
            found = list(classes)
            for k in range(0, n, 4096):
                part = slice(k, k + 4096)
                own = list(range(n)[part])
                yield batch_of(
                    len(own), kinds, sender=[sender] * len(own), slice=where[part],
                    **{"class": own, "sha": found[part], "ids": ids[part], "chars": chars[part]},
                )
            prints = np.array([plan.fingerprint(sha) for sha in found], np.int64)
            several = np.array([len(own) > 1 for own in ids], bool)
            order = np.argsort(prints, kind="stable")
            prints = prints[order]
            owners = prints // plan.span
            for owner in np.unique(owners):
                mine = slice(*np.searchsorted(owners, [owner, owner + 1]))
                low = int(owner) * plan.span
                divisor, quotients, remainders = encode_golomb(prints[mine] - low, plan.span)
                yield batch_of(
                    1, kinds, sender=[sender], slice=where[:1], owner=[int(owner)], divisor=[divisor],
                    quotients=[quotients], remainders=[remainders],
                    order=[order[mine]], twice=[several[order[mine]]],
                )

        for batch in batches:
            if kinds is None:
                id_kind = batch.schema.field(0).type
                kinds = {
                    "sender": pa.int64(), "slice": pa.int32(), "class": pa.int32(), "sha": pa.binary(),
                    "text": pa.binary(), "ids": pa.list_(id_kind), "chars": pa.list_(pa.int64()),
                    "owner": pa.int32(), "divisor": pa.int32(), "quotients": pa.binary(),
                    "remainders": pa.binary(), "order": pa.list_(pa.int32()),
                    "twice": pa.list_(pa.bool_()),
                }
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                if rows + part.num_rows > SENDER_ROWS:
                    yield from close(partition << 24 | block)
                    classes.clear()
                    ids, chars = [], []
                    rows, block = 0, block + 1
                partition = part.column(3)[0].as_py()
                texts = [normalized(text) for text in part.column(2).to_pylist()]
                shas = [hashlib.sha256(text).digest() for text in texts]
                own = []
                for sha, doc_id, size in zip(
                    shas, part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True
                ):
                    number = classes.setdefault(sha, len(classes))
                    if number == len(ids):
                        ids.append([])
                        chars.append([])
                    ids[number].append(doc_id)
                    chars[number].append(size)
                    own.append(number)
                rows += len(own)
                n = len(own)
                yield batch_of(
                    n, kinds, sender=[partition << 24 | block] * n, slice=[partition % plan.slices] * n,
                    **{"class": own, "sha": shas, "text": texts},
                )
        if rows:
            yield from close(partition << 24 | block)

    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(
        "doc_id",
        F.length(text).cast("long").alias("__chars"),
        text.cast("binary").alias("__text"),
        F.spark_partition_id().cast("long").alias("__partition"),
    )
    return source.mapInArrow(run, schema)


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: for each sender, which of its fingerprints came more than once in all."""
    sizes = [len(order) for order in messages["order"]]
    values = [
        decode_golomb(n, *row)
        for n, row in zip(
            sizes, messages[["divisor", "quotients", "remainders"]].itertuples(index=False), strict=True
        )
    ]
    flat = np.concatenate(values)
    ordered = np.sort(flat)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    hit = np.zeros(len(flat), bool)
    if len(again):
        hit = again[np.minimum(np.searchsorted(again, flat), len(again) - 1)] == flat
    parts = np.split(hit, np.cumsum(sizes)[:-1])
    return pd.DataFrame(
        {
            "sender": messages["sender"],
            "owner": messages["owner"],
            "bits": [np.packbits(part).tobytes() for part in parts],
        }
    )


def _receive(messages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A sender's classes that are suspect, one bit each: answered so, or of several rows."""
    answered = dict(zip(answers["owner"], answers["bits"], strict=True))
    n = sum(len(order) for order in messages["order"])
    suspect = np.zeros(-(-n // 64) * 64, np.uint8)
    for owner, order, twice in messages[["owner", "order", "twice"]].itertuples(index=False):
        bits = np.unpackbits(np.frombuffer(answered[owner], np.uint8), count=len(order))
        suspect[order] = bits | np.asarray(twice, np.uint8)
    words = np.packbits(suspect, bitorder="little").view(np.int64)
    return pd.DataFrame({"sender": messages["sender"][:1], "bits": [words]})


def _bitmaps(stored: DataFrame) -> DataFrame:
    """sender, slice and the bitmap of its suspect classes, in words of 64."""
    sent = stored.where("owner IS NOT NULL")
    answers = (
        sent.select("owner", "sender", "divisor", "quotients", "remainders", "order")
        .groupBy("owner")
        .applyInPandas(_answer, "sender bigint, owner int, bits binary")
    )
    mine = sent.select("sender", "slice", "owner", "order", "twice")
    bitmaps = (
        mine.groupBy("sender")
        .cogroup(answers.groupBy("sender"))
        .applyInPandas(_receive, "sender bigint, bits array<bigint>")
    )
    return materialize(bitmaps.join(mine.select("sender", "slice").distinct(), "sender"), "bitmaps")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its group of equal texts and whether it stays.

    Texts are equal when identical after deleting blank, tab, line feed, vertical tab, form feed
    and return. Of equal texts the row with the most code points in the original text stays, then
    the smallest doc_id (null last), then one of the rows that repeat it. Returns doc_id,
    keep_id (doc_id of the row that stays), group_size, kept, text_sha256 (of the text without
    those characters). Null texts are empty, and all empty texts are equal. Other columns are
    ignored; no rows give no rows.

    Runs of rows of a task are senders. Each sorts the fingerprints (leading bits of SHA-256) of its
    distinct texts and sends them, Golomb-coded, to owners of fingerprint ranges; a text that
    fills a third of all rows is sent once a sender. Owners answer with a bit for each fingerprint.
    Only texts of suspect classes are shuffled: bytes of equal hash are compared (the least and the
    greatest, combined by task first), and differing ones fail the job rather than join.
    The sender's rows are stored, so retried tasks meet the same senders; bitmaps are broadcast in
    slices of at most 2^28 rows.
    """
    plan = Exchange.of(docs.count(), shuffle_partitions(docs.sparkSession))
    stored = materialize(_send(docs, plan), "dedup-senders")
    bitmaps = _bitmaps(stored)
    flagged = F.expr("bit_get(bits[class div 64], class % 64) = 1")
    suspects = None
    for k in range(plan.slices):
        bits = F.broadcast(bitmaps.where(F.col("slice") == k).select("sender", "bits"))
        texts = stored.where((F.col("slice") == k) & F.col("text").isNotNull())
        own = texts.select("sender", "class", "sha", "text").join(bits, "sender").where(flagged)
        own = own.select("sha", "text")
        suspects = own if suspects is None else suspects.unionByName(own)
    checked = suspects.groupBy("sha").agg(
        F.min("text").alias("least"), F.max("text").alias("greatest"), F.count(F.lit(1)).alias("n")
    )
    differ = F.raise_error(F.lit("different texts share a SHA-256"))
    size = F.when(F.col("least") == F.col("greatest"), F.col("n")).otherwise(differ.cast("long"))
    verified = checked.select("sha", size.alias("group_size")).where("group_size > 1")

    classes = stored.where("ids IS NOT NULL").select("sender", "class", "sha", "ids", "chars")
    classes = classes.withColumn("rows", F.arrays_zip("chars", "ids"))
    first = F.expr(
        """array_min(transform(rows, (r, i) -> struct(-r.chars AS fewer, r.ids IS NULL AS no_id,
            r.ids AS doc_id, sender, i AS place)))"""
    )
    classes = classes.select("sender", "class", "sha", "ids", first.alias("own"))
    staying = classes.join(verified, "sha", "left_semi").groupBy("sha").agg(F.min("own").alias("best"))
    groups = verified.join(staying, "sha")
    named = classes.join(groups, "sha", "left").withColumn("best", F.coalesce("best", "own"))
    spread = named.select(
        "*", F.posexplode("ids").alias("place", "doc_id")
    )
    kept = (F.col("best.sender") == F.col("sender")) & (F.col("best.place") == F.col("place"))
    return spread.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
