"""Bounded labelled samples, and scoring every text with a model fitted on one."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts of a sample, in bytes of UTF-8, that one fit may take.
SAMPLE_BYTES = 64 << 20


def fold(folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; a null doc_id counts as empty text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(name.cast("binary")), F.lit(folds))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    keep: Column,
    most: int,
    most_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents and ``most_bytes`` of text.

    Of the documents that ``keep`` admits, those with the smallest hash of their doc_id, one text
    each: where rows share a doc_id, the text with the smallest hash, so that no doc_id outweighs
    the others however many rows it has. Texts are taken in that order until the next one would
    pass ``most_bytes``. Rows without doc_id or label are left out; label rows that contradict each
    other count each.

    Label rows are cut to ``most`` first and broadcast; texts are picked by hash and length, and
    only picked texts leave their task.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("__label"))
    rows = rows.where(F.col("__label").isin(0, 1) & F.col("doc_id").isNotNull() & keep).distinct()
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "__label").limit(most)
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("__hash"))
    sizes = texts.select("doc_id", "__hash", F.octet_length("text").alias("__bytes"))
    own = sizes.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    own = own.groupBy("doc_id").agg(F.min(F.struct("__hash", "__bytes")).alias("__own"))
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    picked = (
        own.select("doc_id", "__own.*")
        .withColumn("__upto", F.sum("__bytes").over(upto))
        .where(F.col("__upto") <= most_bytes)
        .select("doc_id", "__hash")
    )
    found = texts.join(F.broadcast(picked), ["doc_id", "__hash"]).dropDuplicates(["doc_id"])
    return found.join(F.broadcast(chosen), "doc_id").select(
        "text", F.col("__label").alias("label")
    )


def fitted(sample: DataFrame, fit: Callable[[Iterator[tuple[str, int]]], Any]) -> Any:
    """What ``fit`` makes of the rows of a ``labelled_sample``, in an order that reruns keep.

    The sample is bounded, so one task holds it; the driver gets the model alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(_ordered(list(batches)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(iter(()))


def _ordered(batches: list[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    """Rows by text and label, texts made one at a time."""
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    order = pc.sort_indices(table, [("text", "ascending"), ("label", "ascending")])
    texts, marks = table.column("text"), table.column("label").to_numpy()
    for i in order.to_numpy():
        yield texts[int(i)].as_py(), int(marks[i])


@dataclass
class Rows:
    """Small integers of many rows, 32 bits each, in chunks that never grow once made."""

    chunks: list[np.ndarray]
    places: list[tuple[int, int, int]]

    @classmethod
    def of(cls, arrays: Iterable[np.ndarray], size: int = 1 << 20) -> Rows:
        """Holds each array once, whatever it came from."""
        chunks, places, open_rows, n = [], [], [], 0
        for array in arrays:
            places.append((len(chunks), n, n + len(array)))
            open_rows.append(array.astype(np.int32))
            n += len(array)
            if n >= size:
                chunks.append(np.concatenate(open_rows))
                open_rows, n = [], 0
        chunks.append(np.concatenate([np.empty(0, np.int32), *open_rows]))
        return cls(chunks, places)

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, i: int) -> np.ndarray:
        chunk, start, end = self.places[i]
        return self.chunks[chunk][start:end]


def map_texts(
    rows: DataFrame,
    added: T.StructType,
    each: Callable[[list[str | None]], list[pa.Array]],
    drop: tuple[str, ...] = (),
    block: int = 512,
) -> DataFrame:
    """``rows`` with the columns that ``each`` computes from blocks of texts.

    Columns of ``rows`` named like an added one are replaced; the columns in ``drop`` are left
    out. Nothing is shuffled, and a task holds one block of results at a time.
    """
    names = set(added.fieldNames())
    kept = [name for name in rows.columns if name not in names and name not in drop]
    fields = [rows.schema[name] for name in kept]
    source = rows.select(*kept, *([] if "text" in kept else [F.col("text").alias("__text")]))
    place = kept.index("text") if "text" in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                results = each(part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], *results], [*kept, *added.fieldNames()]
                )

    return source.mapInArrow(run, T.StructType([*fields, *added.fields]))


_stamps: dict[int, np.ndarray] = {}


def distinct(values: np.ndarray, below: int) -> np.ndarray:
    """Each of some non-negative integers under a small bound once, without sorting them."""
    stamps = _stamps.setdefault(below, np.zeros(below, np.int32))
    places = np.arange(len(values), dtype=np.int32)
    stamps[values] = places
    return values[stamps[values] == places]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def fit_sigmoid(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope (0.5 or more) and offset that turn margins into probabilities of label 1.

    Smoothed targets; Newton steps of length 1 at most, drawn to a slope of 3 and no offset, which
    decides where rows are few.
    """
    positive, negative = float(labels.sum()), float((1 - labels).sum())
    goal = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    usual = np.array([3.0, 0.0])
    theta = usual.copy()
    for _ in range(steps):
        p = sigmoid(x @ theta)
        gradient = x.T @ (p - goal) + (theta - usual)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), gradient)
        theta -= step / max(1.0, float(np.abs(step).max()))
        theta[0] = max(theta[0], 0.5)
    return float(theta[0]), float(theta[1])
