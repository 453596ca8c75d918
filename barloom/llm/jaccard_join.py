"""Exact Jaccard self-join of word n-gram sets, by regions around pivots.

Jaccard distance is a metric on sets. Two documents link when their distance is at most
``eps = 1 - percent / 100``.

Regions. With documents as pivots, unrelated texts are all at distance 1 from every pivot and the
triangle inequality separates nothing, so the outer regions lie around singletons: the pivot {s}
is nearer than 1 exactly to the sets that hold s. Pivots are ordered by how many sets of the whole
input hold them, rarest first; a set's home is its first pivot, and its boundary copies go to as
many further pivots as a set within ``eps`` may have ahead of the first one in common:
n - ceil(percent * n / 100) in all. Two linked sets meet in the region of their first common pivot.
Items that only one set holds come first in that order and have no region at all: a set with
enough of them is farther than ``eps`` from every other set and needs no further look.

How many sets hold an item is found by an exchange of fingerprints: runs of documents of a task are
senders; each sends its distinct items as sorted, Golomb-coded fingerprints with local counts to
owners of fingerprint ranges, which answer with the count over all senders. An item that a third
of all documents hold is sent once a sender.

Inside a region, two of its documents serve as pivots, in fuller ones six; a set is compared with
those of its fullest region. Everything within ``eps`` of a pivot is linked to it, so its members
form one component and need no further comparison. What is left are
pairs from different components; the triangle inequality drops those whose distances to a pivot
differ by more than ``eps``.

Before any two sets are fetched, their images in coarser spaces are compared: items that no other set
holds are in the symmetric difference for sure; to them comes the city-block distance between
counts of the other items in 32 hash bins, then between the parities of such counts in 4,096, and for
large sets between counts in 1,024. None is ever above the rest of the symmetric difference, and
the parities of common sets are seldom below it, so that sets just too far apart are told apart
where they meet. The pairs left are compared exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import shuffle_partitions
from barloom.llm.exact_dedup import decode_golomb, encode_golomb
from barloom.session import materialize, new_folder, remove_folder

WORDS = 5
PERCENT = 80
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
# Bits of fingerprints beyond those that tell all items apart: one item in 2^6 looks shared by chance.
SPARE_BITS = 6
# A sender is a run of at most so many items, distinct sets and rows of one task.
SENDER_ITEMS, SENDER_SETS, SENDER_ROWS = 1 << 21, 30_000, 1 << 17
# Items that one owner receives, about.
OWNER_ITEMS = 1 << 22
MOST_HELD = 255
# Bits of the filter that spares documents without candidates the second pass: at most, and a document.
FILTER_BITS, FILTER_SHARE = 1 << 28, 32
COARSE_BINS, PARITY_BINS, FINE_BINS = 32, 4096, 1024
# Sets above this size have fine bins as well.
LARGE = 2000
# So many pivots of a set go along into its regions, to tell where a pair meets first.
CARRIED = 64
# Regions with at least so many members get the further pivots, the smallest keys under these masks.
FULL = 8
_MASKS = tuple((odd * 0xBF58476D1CE4E5B9) % (1 << 63) for odd in (*_ODD, 0x165667B19E3779F9))


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word runs of a text, A-Z lower-cased.

    Fewer words are one run; no words, or null, give an empty set.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(n, len(words))
    value = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        value = (value ^ (value >> np.uint64(29))) * np.uint64(_ODD[0])
        value += words[k : len(words) - size + 1 + k] * np.uint64(_ODD[1])
    value = (value ^ (value >> np.uint64(32))) * np.uint64(_ODD[2])
    return np.unique(value ^ (value >> np.uint64(29)))


def set_key(items: np.ndarray) -> int:
    """A signed 64-bit hash of a set; equal sets have equal keys."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes())).astype(np.int64))


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """How many pivots a set has: n - ceil(percent * n / 100) + 1."""
    return size + (-percent * size) // 100 + 1


def bins_of(prints: np.ndarray, width: int, bins: int, most: int) -> list[int]:
    """How many fingerprints of ``width`` bits fall into each hash bin, stopping at ``most``."""
    shift = max(width - (bins.bit_length() - 1), 0)
    held = np.bincount(prints >> shift, minlength=bins)
    return np.minimum(held, most).tolist()


def parities_of(prints: np.ndarray, width: int) -> list[int]:
    """Whether each of PARITY_BINS hash bins holds an odd number of fingerprints, a bit each."""
    shift = max(width - (PARITY_BINS.bit_length() - 1), 0)
    odd = (np.bincount(prints >> shift, minlength=PARITY_BINS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).tolist()


def bins_allow(name: str, percent: int) -> Column:
    """Whether lone items and the bins <name>_a and <name>_b of the others allow two sets to link."""

    def gap(x: Column, y: Column) -> Column:
        if name == "parities":
            return F.bit_count(x.bitwiseXOR(y))
        return F.abs(x.cast("int") - y.cast("int"))

    gaps = F.zip_with(f"{name}_a", f"{name}_b", gap)
    apart = F.aggregate(gaps, F.col("lone_a") + F.col("lone_b"), lambda total, gap: total + gap)
    return (100 + percent) * apart <= (100 - percent) * (F.col("size_a") + F.col("size_b"))


def may_link(percent: int) -> Column:
    """Whether sizes, lone items, coarse bins and parities of two sets allow a link."""
    size_a, size_b = F.col("size_a"), F.col("size_b")
    apart = F.col("lone_a") + F.col("lone_b")
    return (
        (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b))
        & ((100 + percent) * apart <= (100 - percent) * (size_a + size_b))
        & bins_allow("coarse", percent)
        & bins_allow("parities", percent)
    )


# What pairs keep of their two sets: sizes, and a document of each.
_PAIR = ("a", "b", "size_a", "size_b", "first_a", "first_b")


def finely(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs without those of two large sets whose fine bins rule out a link."""
    for end in ("a", "b"):
        side = points.select(*[F.col(name).alias(f"{name}_{end}") for name in ("first", "fine")], F.col("key").alias(end))
        pairs = pairs.join(side, end)
    return pairs.where(finely_allowed(percent)).select(*_PAIR)


def finely_allowed(percent: int) -> Column:
    """Whether fine bins allow a link; small sets have none, and bins beside none say nothing."""
    return F.coalesce(bins_allow("fine", percent), F.lit(True))


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    """Unsigned items as signed longs, bit by bit."""
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _map_sets(docs: DataFrame, n: int, schema: str, each) -> DataFrame:
    """``each(doc_ids, sets)`` over blocks of the n-gram sets of (doc_id, text)."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays(
                    each(part, lambda texts: [ngram_set(text, n) for text in texts]), names
                )

    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Exchange:
    """Sizes that follow from the bytes of all texts."""

    width: int
    owners: int

    @classmethod
    def of(cls, docs: DataFrame) -> Exchange:
        total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        items = max(total // 6, 1 << 10)
        owners = max(math.ceil(items / OWNER_ITEMS), min(shuffle_partitions(docs.sparkSession), items >> 14), 1)
        return cls(min(items.bit_length() + SPARE_BITS, 62), owners)

    @property
    def span(self) -> int:
        return -(-(1 << self.width) // self.owners)


_STORED = """sender bigint, class int, key bigint, size bigint, ids array<{kind}>, owner int, n int,
    divisor int, quotients binary, remainders binary, counts binary, order binary"""


class _Sender:
    """A run of documents of a task: its distinct sets, and what it sends about them."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.classes: dict[int | None, int] = {}
        self.sets: list[np.ndarray] = []
        self.ids: list[list] = []
        self.rows = self.items = 0

    def add(self, doc_id, items: np.ndarray) -> None:
        key = set_key(items) if len(items) else None
        place = self.classes.setdefault(key, len(self.classes))
        if place == len(self.ids):
            self.ids.append([])
            self.sets.append(items)
            self.items += len(items)
        self.ids[place].append(doc_id)
        self.rows += 1

    def full(self, following: int) -> bool:
        return self.rows > 0 and (
            self.items + following > SENDER_ITEMS
            or len(self.sets) >= SENDER_SETS
            or self.rows >= SENDER_ROWS
        )

    def held(self) -> dict[str, list]:
        """Its sets, each once, with the doc_ids of their rows."""
        n = len(self.ids)
        return {
            "sender": [self.number] * n,
            "class": list(range(n)),
            "key": list(self.classes),
            "size": [len(items) for items in self.sets],
            "ids": self.ids,
        }

    def messages(self, plan: Exchange) -> Iterator[dict[str, list]]:
        """To each owner the coded fingerprints, and, for itself, which sets hold each."""
        if not self.items:
            return
        prints = (np.concatenate(self.sets) >> np.uint64(64 - plan.width)).astype(np.int64)
        owner_of_item = np.repeat(np.arange(len(self.sets), dtype=np.uint16), [len(s) for s in self.sets])
        order = np.argsort(prints, kind="stable")
        prints, holders = prints[order], owner_of_item[order]
        starts = np.flatnonzero(np.diff(prints, prepend=-1))
        ends = np.append(starts[1:], len(prints))
        distinct = prints[starts]
        owners = distinct // plan.span
        for owner in np.unique(owners):
            low, high = np.searchsorted(owners, [owner, owner + 1])
            divisor, quotients, remainders = encode_golomb(
                distinct[low:high] - int(owner) * plan.span, plan.span
            )
            counts = (ends[low:high] - starts[low:high]).astype(np.uint16)
            yield {
                "sender": [self.number],
                "owner": [int(owner)],
                "n": [int(high - low)],
                "divisor": [divisor],
                "quotients": [quotients],
                "remainders": [remainders],
                "counts": [counts.tobytes()],
                "order": [holders[starts[low] : ends[high - 1]].tobytes()],
            }


def _send(docs: DataFrame, n: int, plan: Exchange) -> DataFrame:
    """Sets by sender, each once, and the senders' messages; told apart by ``owner`` being null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(_STORED.format(kind=kind))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = kinds = None

        def close() -> Iterator[pa.RecordBatch]:
            for columns in itertools.chain([sender.held()], sender.messages(plan)):
                rows = len(columns["sender"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[name], kinds[name])
                        if name in columns
                        else pa.nulls(rows, kinds[name])
                        for name in names
                    ],
                    names,
                )

        for batch in batches:
            if sender is None and batch.num_rows:
                first = batch.column(2)[0].as_py() << 24
                sender = _Sender(first)
                kinds = _arrow_kinds(schema, batch.schema.field(0).type)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, text in zip(
                    part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True
                ):
                    items = ngram_set(text, n)
                    if sender.full(len(items)):
                        yield from close()
                        sender = _Sender(sender.number + 1)
                    sender.add(doc_id, items)
        if sender is not None:
            yield from close()

    source = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("__partition"))
    return source.mapInArrow(run, schema)


def _arrow_kinds(schema: T.StructType, id_kind: pa.DataType) -> dict[str, pa.DataType]:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return {
        field.name: plain.get(field.dataType.simpleString(), pa.list_(id_kind)) for field in schema
    }


def _decoded(messages: pd.DataFrame) -> list[np.ndarray]:
    columns = ["n", "divisor", "quotients", "remainders"]
    return [decode_golomb(*row) for row in messages[columns].itertuples(index=False)]


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """An owner's counts: for each sender's fingerprints how many sets of all senders hold them."""
    prints = _decoded(messages)
    flat = np.concatenate(prints)
    counts = np.concatenate([np.frombuffer(c, np.uint16) for c in messages["counts"]]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    sums = np.minimum(np.add.reduceat(counts[order], first), MOST_HELD).astype(np.uint8)
    held = np.empty(len(flat), np.uint8)
    held[order] = np.repeat(sums, np.diff(np.append(first, len(flat))))
    parts = np.split(held, np.cumsum([len(p) for p in prints])[:-1])
    return pd.DataFrame(
        {
            "sender": messages["sender"],
            "owner": messages["owner"],
            "held": [part.tobytes() for part in parts],
        }
    )


def _receive(plan: Exchange, percent: int, messages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """Those sets of a sender that have a region: lone items, bins of the others, pivots."""
    messages = messages.sort_values("owner")
    answered = dict(zip(answers["owner"], answers["held"], strict=True))
    prints, held = [], []
    for owner, own, counts in zip(
        messages["owner"], _decoded(messages), messages["counts"], strict=True
    ):
        repeats = np.frombuffer(counts, np.uint16)
        prints.append(np.repeat(own + owner * plan.span, repeats))
        held.append(np.repeat(np.frombuffer(answered[owner], np.uint8), repeats))
    item, count = np.concatenate(prints), np.concatenate(held)
    owner = np.concatenate([np.frombuffer(o, np.uint16) for o in messages["order"]]).astype(np.int64)
    by_set = np.lexsort((item, count, owner))
    item, count, owner = item[by_set], count[by_set], owner[by_set]
    size = np.bincount(owner)
    start = np.cumsum(size) - size
    lone = np.bincount(owner[count == 1], minlength=len(size))
    last = prefix_length(size, percent)
    rows = []
    for k in np.flatnonzero(lone < last):
        mine = slice(start[k] + lone[k], start[k] + size[k])
        shared = item[mine]
        rows.append(
            (
                int(k),
                int(lone[k]),
                bins_of(shared, plan.width, COARSE_BINS, 32767),
                parities_of(shared, plan.width),
                bins_of(shared, plan.width, FINE_BINS, 127) if size[k] > LARGE else [],
                np.unique(item[start[k] + lone[k] : start[k] + last[k]]).tolist(),
            )
        )
    found = pd.DataFrame(rows, columns=["class", "lone", "coarse", "parities", "fine", "pivots"])
    return found.assign(sender=messages["sender"].iloc[0] if len(messages) else 0)


def nodes_of(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All sets by sender (key, size, ids; empty sets have key null), and those with a region, each key once."""
    spark = docs.sparkSession
    plan = Exchange.of(docs)
    path = new_folder(spark, "ngram-senders")
    _send(docs, n, plan).write.parquet(path)
    stored = spark.read.parquet(path)
    sent = stored.where("owner IS NOT NULL")
    codes = sent.select("sender", "owner", "n", "divisor", "quotients", "remainders", "counts")
    answers = codes.groupBy("owner").applyInPandas(_answer, "sender bigint, owner int, held binary")
    mine = sent.select(*codes.columns, "order").groupBy("sender")

    def receive(messages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _receive(plan, percent, messages, answers)

    placed = mine.cogroup(answers.groupBy("sender")).applyInPandas(
        receive,
        "class int, lone bigint, coarse array<smallint>, parities array<bigint>, fine array<tinyint>, "
        "pivots array<bigint>, sender bigint",
    )
    nodes = stored.where("owner IS NULL").select("sender", "class", "key", "size", "ids")
    nodes = materialize(nodes, "ngram-sets-held")
    own = nodes.select("sender", "class", "key", "size", F.array_min("ids").alias("first"))
    held = ("size", "lone", "coarse", "parities", "fine", "pivots")
    points = placed.join(own, ["sender", "class"]).groupBy("key")
    points = points.agg(F.min("first").alias("first"), *[F.first(name).alias(name) for name in held])
    points = materialize(points, "ngram-nodes")
    remove_folder(spark, path)
    return nodes, points


def _bitmap(positions: DataFrame, bits: int) -> np.ndarray:
    """So many bits, set at the given positions; a bounded array, whatever the input."""
    bit = F.expr("shiftleft(1L, CAST(position % 64 AS INT))")
    words = (
        positions.groupBy(F.expr("position DIV 64").alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .toPandas()
    )
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint64)


def _position(doc_id: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(bits))


def sets_of(docs: DataFrame, first_docs: DataFrame, n: int) -> DataFrame:
    """key, size and items of the sets of ``first_docs`` (doc_id), each key once.

    A bit filter on doc_id, sized by the number of wanted documents and never above 32 MB, lets them
    pass, and a few others by chance, so that no text and no set of the others is shuffled.
    """
    bits = 1 << min(max(first_docs.count() * FILTER_SHARE, 64) - 1, FILTER_BITS - 1).bit_length()
    wanted = first_docs.select(_position("doc_id", bits).alias("position"))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, bits))

    def each(part: pa.RecordBatch, sets) -> list[pa.Array]:
        position = part.column(0).to_numpy(zero_copy_only=False)
        held = shared.value[position // 64] >> (position % 64).astype(np.uint64)
        passing = np.flatnonzero(held & np.uint64(1))
        found = [s for s in sets(part.column(1).take(pa.array(passing)).to_pylist()) if len(s)]
        return [
            pa.array([set_key(items) for items in found], pa.int64()),
            pa.array([len(items) for items in found], pa.int64()),
            _longs(found),
        ]

    source = docs.select(_position("doc_id", bits).alias("position"), "text")
    rows = _map_sets(source, n, "key bigint, size bigint, items array<bigint>", each)
    return materialize(rows.dropDuplicates(["key"]), "ngram-sets")


def possible(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of keys whose sizes and bins allow a link."""
    held = ("size", "first", "lone", "coarse", "parities", "fine")
    for end in ("a", "b"):
        names = {"key": end, **{name: f"{name}_{end}" for name in held}}
        side = points.select(*[F.col(name).alias(new) for name, new in names.items()])
        pairs = pairs.join(side, end)
    return pairs.where(may_link(percent)).where(finely_allowed(percent)).select(*_PAIR)


def distances(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, distance and linked of ``possible`` pairs, from their whole sets; without pairs no text is read."""
    if pairs.isEmpty():
        return pairs.select("a", "b", F.lit(1.0).alias("distance"), F.lit(False).alias("linked"))
    wanted = pairs.select(F.explode(F.array("first_a", "first_b")).alias("doc_id")).distinct()
    sets = sets_of(docs, _stored(wanted), n)
    shared = F.size(F.array_intersect("items_a", "items_b")).cast("bigint")
    together = F.col("size_a") + F.col("size_b") - F.col("shared")
    return (
        pairs.join(sets.select(F.col("key").alias("b"), F.col("items").alias("items_b")), "b")
        .join(sets.select(F.col("key").alias("a"), F.col("items").alias("items_a")), "a")
        .select("a", "b", "size_a", "size_b", shared.alias("shared"))
        .select(
            "a",
            "b",
            (1 - F.col("shared") / together).alias("distance"),
            (100 * F.col("shared") >= percent * together).alias("linked"),
        )
    )


def _stored(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, written and read again: Spark knows their size before it plans a join.

    Small ones are broadcast without a shuffle of either side, which spares the driver jobs and threads.
    """
    return materialize(rows, "ngram-links")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for all ends of ``edges`` (a, b), a stored table.

    In every round each node follows its smallest neighbour, and that one's, down to a node without
    smaller ones. The edges then become those between such ends, each once: a dense group of links is
    read in full once and is gone after it. A round leaves at most half of the nodes that still have edges.
    """
    labels = None
    while True:
        both = edges.select(F.explode(F.expr("array(struct(a, b), struct(b AS a, a AS b))")).alias("e"))
        hooks = _stored(both.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("m")).select(
            "node", F.least("node", "m").alias("root")
        ))
        moving = True
        while moving:
            jump = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = _stored(hooks.join(jump, "root").select("node", F.col("root").alias("old"), "next"))
            moving = not moved.where("next < old").isEmpty()
            hooks = moved.select("node", F.col("next").alias("root"))
        if labels is None:
            labels = hooks
        else:
            further = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = _stored(
                labels.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            )
        ends = {end: hooks.select(F.col("node").alias(end), F.col("root").alias(f"to_{end}")) for end in ("a", "b")}
        left = edges.join(ends["a"], "a").join(ends["b"], "b").where("to_a != to_b")
        edges = _stored(
            left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
        if edges.isEmpty():
            return labels


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``roots`` and further ``links`` (a, b).

    Only the components that the further links join are looked at; without such links all stays.
    """
    if links.isEmpty():
        return roots
    for end in ("a", "b"):
        side = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        links = links.join(side, end, "left")
    between = links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(_stored(between.where("a != b")))
    # a root stands for itself in ``roots``; what had no link before comes new
    everyone = roots.union(joined.select("node", F.col("node").alias("root"))).distinct()
    further = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
    labels = everyone.join(further, "root", "left")
    return _stored(labels.select("node", F.coalesce("next", "root").alias("root")))


_CENTRES = f"""array_distinct(CASE WHEN members < {FULL} THEN array(low, high)
    ELSE array(low, high, {", ".join(f"p{i}" for i in range(len(_MASKS)))}) END)"""


def linked_components(
    docs: DataFrame, n: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id, text).

    Rows link when 100 * intersection >= percent * union of their n-gram sets; component_id is the
    smallest doc_id reachable by links, itself included. Rows without words are linked with
    nothing: their component is their own doc_id. A null doc_id never names a component unless
    all its rows have none. Rows that repeat a doc_id stand for themselves. Other columns are
    ignored; no rows give no rows.

    Equal sets are one node, so copies cost a row each. Sets are told apart by 64-bit hashes.
    """
    nodes, points = nodes_of(docs, n, percent)
    members = points.select(F.explode("pivots").alias("pivot"), "key")
    regions = (
        members.groupBy("pivot")
        .agg(
            F.min("key").alias("low"),
            F.max("key").alias("high"),
            F.count(F.lit(1)).alias("members"),
            *[F.expr(f"min(key ^ {m}L) ^ {m}L").alias(f"p{i}") for i, m in enumerate(_MASKS)],
        )
        .where("low < high")
        .select("pivot", "members", F.expr(_CENTRES).alias("centres"))
    )
    shared = materialize(members.join(regions, "pivot"), "ngram-regions")

    def ordered(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    # a set meets the centres of its fullest region: near copies share it, and so their centres
    fullest = shared.groupBy("key").agg(F.max(F.struct("members", "pivot", "centres")).alias("own"))
    to_centres = fullest.select("key", F.explode("own.centres").alias("centre"))
    to_centres = to_centres.where("key != centre").select(*ordered("centre", "key")).distinct()
    near = _stored(possible(to_centres, points, percent))
    first = _stored(distances(docs, near, n, percent))
    links = first.where("linked").select("a", "b")
    roots = components(links)
    open_pairs = _open_pairs(shared, first, roots, points, percent)
    if open_pairs is not None:
        open_pairs = _stored(finely(open_pairs, points, percent))
        rest = _stored(distances(docs, open_pairs, n, percent).where("linked").select("a", "b"))
        roots = extended(roots, rest)
    classes = points.select("key", "first")
    joined = _stored(roots.withColumnRenamed("node", "key").join(classes, "key"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("lowest"))
    named = _stored(joined.join(lowest, "root").select("key", "lowest"))
    copies = nodes.where("key IS NOT NULL").groupBy("key").agg(F.min(F.array_min("ids")).alias("copy"))
    copies = copies.join(named, "key", "left")
    result = nodes.join(copies, "key", "left").select(
        "size", "lowest", "copy", F.explode("ids").alias("doc_id")
    )
    own = F.coalesce("lowest", "copy", "doc_id")
    return result.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id"))


def _open_pairs(
    shared: DataFrame, first: DataFrame, roots: DataFrame, points: DataFrame, percent: int
) -> DataFrame | None:
    """Pairs of a region that lie in different components and may still be within ``eps``.

    None where each region lies in one component.

    A pair that shares several regions is formed in the first of them: rows carry the first of
    their set's pivots, and a region leaves out pairs that meet in an earlier one. What meets only
    beyond those carried may be formed in several regions, and is one pair in the end.
    """
    eps = 1 - percent / 100 + 1e-9
    placed = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "root", F.coalesce("root", "key")
    )
    mixed = (
        placed.groupBy("pivot")
        .agg(F.min("root").alias("least"), F.max("root").alias("most"))
        .where("least < most")
        .select("pivot")
    )
    inside = placed.join(mixed, "pivot")
    inside = _stored(inside.select("pivot", "key", "root", F.col("centres")[0].alias("low")))
    if inside.isEmpty():
        return None
    to_low = first.select(
        F.col("a").alias("x"), F.col("b").alias("y"), F.col("distance").alias("from_low")
    )
    inside = (
        inside.withColumn("x", F.least("key", "low"))
        .withColumn("y", F.greatest("key", "low"))
        .join(to_low, ["x", "y"], "left")
        .join(points.select("key", "size", "lone", "coarse", "parities", "pivots"), "key")
        .select(
            *("pivot", "key", "root", "size", "lone", "coarse", "parities", "from_low"),
            F.expr(f"filter(slice(pivots, 1, {CARRIED}), p -> p < pivot)").alias("earlier"),
        )
    )
    sides = {
        end: inside.select(*[F.col(name).alias(f"{name}_{end}") for name in inside.columns])
        for end in ("a", "b")
    }
    near = F.abs(F.col("from_low_a") - F.col("from_low_b")) <= eps
    return (
        sides["a"]
        .join(
            sides["b"],
            (F.col("pivot_a") == F.col("pivot_b"))
            & (F.col("key_a") < F.col("key_b"))
            & (F.col("root_a") != F.col("root_b"))
            & F.coalesce(near, F.lit(True))
            & may_link(percent)
            & ~F.arrays_overlap("earlier_a", "earlier_b"),
        )
        .select(
            F.col("key_a").alias("a"), F.col("key_b").alias("b"), "size_a", "size_b", "lone_a", "lone_b"
        )
        .distinct()
    )
