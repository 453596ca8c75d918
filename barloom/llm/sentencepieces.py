"""Encoding and decoding texts with a SentencePiece vocabulary by highest total score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.labels import map_texts
from barloom.llm.pieces import Pieces

VOCABULARY = "piece_bpe_32k.model"
MOST_CHUNKS = 200_000


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of runs of the given lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Encodes texts chunk by chunk; each distinct chunk is searched once, until the store is full."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after the other, and how many each text has."""
        if len(self.rows) > MOST_CHUNKS:
            self.forget()
        rows, found, sizes = self.rows, [], []
        for text in texts:
            own = self.pieces.chunks(text or "")
            found.extend(own)
            sizes.append(len(own))
        known = len(rows)
        fresh = [chunk for chunk in dict.fromkeys(found) if chunk not in rows]
        rows.update(zip(fresh, range(known, known + len(fresh)), strict=True))
        if fresh:
            ids, counts = self.pieces.best_paths(fresh)
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
            self.ids, self.counts = np.append(self.ids, ids), np.append(self.counts, counts)
        place = np.fromiter(map(rows.__getitem__, found), np.int64, len(found))
        lengths = self.counts[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *sizes])]
        return self.ids[spread(self.starts[place], lengths)], np.diff(ends)


def decode(pieces: Pieces, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of runs of piece ids: their bytes, without the blank put before a text."""
    sizes = np.fromiter(map(len, pieces.texts), np.int64, len(pieces.texts))
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(pieces.texts), np.uint8)
    lengths = sizes[ids]
    raw = flat[spread(starts[ids], lengths)].tobytes()
    cuts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
    return [text[1:] if text[:1] == " " else text for text in texts]


def load(vocabulary: str | None = None) -> Pieces:
    return Pieces.load(vocabulary or public_tokenizers.path(VOCABULARY))


def encode_texts(
    docs: DataFrame, vocabulary: str | None = None, check: bool = False
) -> DataFrame:
    """``docs`` with ids (array of piece ids of the whole text) in place of text.

    With ``check``, also round_trip: whether decoding the ids gives the text again.

    The path with the highest sum of scores is taken, a longer last piece where sums are equal.
    Characters without a piece become their UTF-8 byte pieces. Null and empty texts have no ids;
    repeated texts have equal ids. An input column named ids is replaced. ``vocabulary`` is the
    path of a model file, read on the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    held: list[Encoder] = []

    def each(texts: list[str | None]) -> list[pa.Array]:
        if not held:
            held.append(Encoder(shared.value))
        ids, counts = held[0].encode(texts)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        result = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
        if check:
            again = decode(shared.value, ids, counts)
            result.append(pa.array([a == (b or "") for a, b in zip(again, texts, strict=True)]))
        return result

    added = T.StructType.fromDDL("ids array<int>" + ", round_trip boolean" * check)
    return map_texts(docs, added, each, drop=("text",))


def decode_ids(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``rows`` with text, decoded from their ids, in place of ids; null and empty ids give ''.

    The exact inverse of ``encode_texts``, but for null texts, which come back empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load(vocabulary))
    kept = [name for name in rows.columns if name not in ("ids", "text")]
    schema = T.StructType([*[rows.schema[name] for name in kept], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = part.column(len(kept))
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                counts = np.diff(ids.offsets.to_numpy())
                counts = np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, counts)
                texts = decode(shared.value, flat, counts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, "text"]
                )

    return rows.select(*kept, F.col("ids")).mapInArrow(run, schema)
