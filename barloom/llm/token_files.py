"""Token-id files of patched frame-of-reference blocks."""

from __future__ import annotations

import re
import struct
import unicodedata
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import chain, count, islice, repeat, starmap

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from barloom.llm.sentencepieces import spread

VOCABULARY = "word_bpe_49k.json"
END = 1
# NFC and lower-casing keep letters below this code point letters, one by one.
PLAIN_END = 0x130
BLOCK = 128
# Share of a block's values that fit its packed width; the others are exceptions.
PERCENTILE = 90
SEGMENT = 1 << 18
# Bytes of text encoded at a time, a whole document at least: words that repeat in them are looked up once.
BLOCK_BYTES = 2 << 20
# Words, and parts of words, that a process keeps; a part costs ten times as much to find anew.
MOST_WORDS, MOST_PARTS = 200_000, 500_000
# Python takes U+001C to U+001F for white space; the tokenizer's \s does not, and keeps them.
_KEPT = re.compile(r"[\S\x1c-\x1f]+")
_HEADER = struct.Struct("<4sBxHIQI")
_MAGIC = b"PFR1"
_BLOCK_HEADER = np.dtype([("least", "<u4"), ("width", "u1"), ("exceptions", "u1")])
SEGMENT_SCHEMA = "part int, seq int, before bigint, n_docs int, n_ids bigint, payload binary"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of little-endian bytes, lowest bits first."""
    lanes = np.ascontiguousarray(values.T.astype(np.uint64))
    out = np.zeros((BLOCK * width // 64, values.shape[0]), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8").view(np.uint8)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((BLOCK, raw.shape[0]), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        out[i] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= words[word + 1] << np.uint64(64 - shift)
        out[i] &= mask
    return out.T.astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Block starts (bytes) and the blocks of a run of unsigned 32-bit ids.

    A block has its least value, a width that holds the PERCENTILE of its differences to it, the
    low bits of all differences packed at that width, and for each difference that needs more, its
    place and its high bits. The last block is filled up with its first value.
    """
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint32), b""
    padded = np.full(n * BLOCK, ids[(n - 1) * BLOCK], np.uint32)
    padded[: len(ids)] = ids
    values = padded.reshape(n, BLOCK)
    least = values.min(axis=1)
    rest = values - least[:, None]
    place = -(-BLOCK * PERCENTILE // 100) - 1
    limit = np.partition(rest, place, axis=1)[:, place]
    width = np.ceil(np.log2(limit.astype(float) + 1)).astype(np.uint8)
    high = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, place = np.nonzero(high)
    exceptions = np.bincount(row, minlength=n)
    packed = BLOCK // 8 * width.astype(np.int64)
    size = _BLOCK_HEADER.itemsize + packed + 5 * exceptions
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    header = np.zeros(n, _BLOCK_HEADER)
    header["least"], header["width"], header["exceptions"] = least, width, exceptions
    step = _BLOCK_HEADER.itemsize
    out[start[:, None] + np.arange(step)] = header.view(np.uint8).reshape(n, step)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        low = rest[rows] & np.uint32((1 << int(w)) - 1)
        to = (start[rows] + step)[:, None] + np.arange(BLOCK // 8 * int(w))
        out[to] = _pack(low, int(w))
    if len(row):
        turn = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        tail = (start + step + packed)[row]
        out[tail + turn] = place
        raw = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(tail + exceptions[row] + 4 * turn)[:, None] + np.arange(4)] = raw
    return start.astype("<u4"), out.tobytes()


def decode_blocks(starts: np.ndarray, raw: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` ids of the blocks at ``starts`` in ``raw``."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    start, step = starts.astype(np.int64), _BLOCK_HEADER.itemsize
    header = np.ascontiguousarray(raw[start[:, None] + np.arange(step)]).view(_BLOCK_HEADER).ravel()
    width, exceptions = header["width"].astype(np.int64), header["exceptions"].astype(np.int64)
    rest = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        at = (start[rows] + step)[:, None] + np.arange(BLOCK // 8 * int(w))
        rest[rows] = _unpack(raw[at], int(w))
    row = np.repeat(np.arange(n), exceptions)
    if len(row):
        turn = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        tail = (start + step + BLOCK // 8 * width)[row]
        place = raw[tail + turn]
        bytes_at = (tail + exceptions[row] + 4 * turn)[:, None] + np.arange(4)
        high = np.ascontiguousarray(raw[bytes_at]).view("<u4").ravel()
        rest[row, place] |= (high.astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
    return (rest + header["least"][:, None]).ravel()[:count]


def write_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment: header, doc_ids, which of them are not null, ends of documents, block starts, blocks."""
    starts, blocks = encode_blocks(ids)
    header = _HEADER.pack(_MAGIC, 1, BLOCK, len(doc_ids), len(ids), len(starts))
    keys = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ends = np.cumsum(counts).astype("<i8")
    return b"".join([header, keys.tobytes(), known.tobytes(), ends.tobytes(), starts.tobytes(), blocks])


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ends of documents, and all ids of a segment."""
    magic, version, block, n_docs, n_ids, n_blocks = _HEADER.unpack_from(payload)
    if (magic, version, block) != (_MAGIC, 1, BLOCK):
        raise ValueError("not a token segment of this version")
    at = _HEADER.size
    keys = np.frombuffer(payload, "<i8", n_docs, at)
    known = np.frombuffer(payload, np.uint8, n_docs, at + 8 * n_docs)
    ends = np.frombuffer(payload, "<i8", n_docs, at + 9 * n_docs)
    starts = np.frombuffer(payload, "<u4", n_blocks, at + 17 * n_docs)
    raw = np.frombuffer(payload, np.uint8, offset=at + 17 * n_docs + 4 * n_blocks)
    doc_ids = [int(d) if k else None for d, k in zip(keys, known, strict=True)]
    return doc_ids, ends, decode_blocks(starts, raw, n_ids)


class Runs:
    """Runs of ids by key, found in bulk and kept."""

    def __init__(self) -> None:
        # Numbers keys as they are first asked for.
        self.rows: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.starts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)

    def places(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.rows.__getitem__, keys), np.int64, len(keys))

    def fresh(self) -> list[str]:
        """Keys without runs, in the order of their places; ``add`` must follow with their runs."""
        return list(islice(reversed(self.rows), len(self.rows) - len(self.counts)))[::-1]

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.ids, self.counts = np.append(self.ids, ids), np.append(self.counts, counts)

    def get(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at all places one after the other, and how many each has."""
        lengths = self.counts[places]
        return self.ids[spread(self.starts[places], lengths)], lengths

    def trim(self, most: int) -> None:
        """Forget all but the first ``most`` keys; frequent ones come early."""
        if len(self.rows) <= most:
            return
        deque(starmap(self.rows.popitem, repeat((), len(self.rows) - most)), maxlen=0)
        self.rows.default_factory = count(most).__next__
        self.starts, self.counts = self.starts[:most].copy(), self.counts[:most].copy()
        self.ids = self.ids[: self.starts[-1] + self.counts[-1]].copy()


def split_words(texts: pa.Array) -> pa.Array:
    """What lies between the characters that the tokenizer takes for white space; ends may add empty words."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
        return pa.array([_KEPT.findall(text) for text in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Starts and lengths of runs of texts of BLOCK_BYTES at most, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, "right")))
        yield start, stop - start
        start = stop


class _Finals(dict):
    """Whether a word that ends in a character still ends in a letter once the tokenizer has normalised it."""

    def __missing__(self, last: str) -> bool:
        value = self[last] = unicodedata.normalize("NFC", last).lower()[-1].isalpha()
        return value


class WordEncoder:
    """Ids of texts by the tokenizers library, each distinct word encoded once.

    The tokenizer lower-cases, drops what its \\s matches and never joins over it, so a text's ids
    are those of the words between, one after the other. It also cuts between letters and these closing marks, so the
    words ``end``, ``End`` and ``end.`` share the ids of ``end``, and ``end###`` as well. A letter that NFC or lower-casing
    takes apart may end in a sign, which joins the mark after it; such words stay whole.
    """

    marks = ".,;:!?|#$%&*"

    def __init__(self, definition: str) -> None:
        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        # What lower-casing and the byte-level alphabet make of a letter; ASCII letters stay.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = list(filter(str.isalpha, map(chr, range(PLAIN_END))))
        self.plain = re.compile(f"[{''.join(letters)}]+")
        self.final = _Finals()
        self.signs = {ord(c): level.pre_tokenize_str(c.lower())[0][0] for c in letters}
        self.words, self.parts = Runs(), Runs()

    def _encode_parts(self) -> None:
        """Runs of letters that lower-casing keeps letters go straight to the library's model.

        Each is one pre-token, and NFC leaves it as it is, so nothing else of the library has a say in it.
        """
        fresh = self.parts.fresh()
        if not fresh:
            return
        plain = np.fromiter((found is not None for found in map(self.plain.fullmatch, fresh)), bool, len(fresh))
        counts = np.zeros(len(fresh), np.int64)
        tokenize, signs = self.model.tokenize, self.signs
        flat: list[int] = []
        ends: list[int] = []
        for part, is_plain in zip(fresh, plain, strict=True):
            if is_plain:
                signed = part if part.islower() and part.isascii() else part.translate(signs)
                flat += [piece.id for piece in tokenize(signed)]
                ends.append(len(flat))
        counts[plain] = np.diff(ends, prepend=0)
        others = [p for p, is_plain in zip(fresh, plain, strict=True) if not is_plain]
        own = [one.ids for one in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        counts[~plain] = list(map(len, own))
        result = np.empty(int(counts.sum()), np.uint32)
        starts = np.cumsum(counts) - counts
        result[spread(starts[plain], counts[plain])] = flat
        result[spread(starts[~plain], counts[~plain])] = list(chain.from_iterable(own))
        self.parts.add(result, counts)

    def _halves(self, words: list[str]) -> tuple[list[str], list[str]]:
        """What each word has before its closing marks, lower-cased if ASCII, and the marks; words to keep whole have none."""
        whole = pa.array(words, pa.string())
        core = pc.ascii_rtrim(whole, characters=self.marks)
        easy = pc.and_(pc.ascii_is_alpha(core), pc.string_is_ascii(core))
        cores = pc.if_else(easy, pc.ascii_lower(core), whole).to_numpy(zero_copy_only=False).tolist()
        ends = [""] * len(words)
        marked = pc.not_equal(pc.binary_length(core), pc.binary_length(whole))
        for i in np.flatnonzero(pc.and_(easy, marked)):
            ends[i] = words[i][len(cores[i]) :]
        for i in np.flatnonzero(pc.invert(pc.string_is_ascii(core))):
            word = words[i]
            bare = word.rstrip(self.marks)
            if bare.isalpha() and self.final[bare[-1]]:
                cores[i], ends[i] = bare, word[len(bare) :]
        return cores, ends

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, END after each, and how many each text has."""
        split = split_words(pa.array(texts, pa.string()))
        coded = pc.list_flatten(split).dictionary_encode()
        distinct = self.words.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        fresh = self.words.fresh()
        cores, ends = self._halves(fresh)
        pairs = [""] * (2 * len(fresh))
        pairs[::2], pairs[1::2] = cores, ends
        if pairs:
            halves = self.parts.places(pairs)
            self._encode_parts()
            ids, counts = self.parts.get(halves)
            self.words.add(ids, counts.reshape(-1, 2).sum(axis=1))
        flat, lengths = self.words.get(distinct[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], np.cumsum(lengths)])[ends]
        self.words.trim(MOST_WORDS)
        self.parts.trim(MOST_PARTS)
        return np.insert(flat, ends[1:], np.uint32(END)), np.diff(ends) + 1


_encoders: dict[str, WordEncoder] = {}


def encoder_of(definition: str) -> WordEncoder:
    """This process's encoder; the tasks that it runs one after the other share its words."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = WordEncoder(definition)
    return _encoders[definition]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str | None = None, segment: int = SEGMENT
) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the ids in ascending doc_id order.

    The files lie in ``path`` as Parquet, which every file system Spark knows can hold; a row is
    one segment of about ``segment`` ids of whole documents. Each document ends with END; null
    and empty texts are END alone. Null doc_ids come first; rows of one doc_id follow the hash of
    their text, so that a hot id is dealt over several files. No rows give an empty dataset.
    ``tokenizer`` is the path of a tokenizer definition, read on the driver.
    """
    with open(tokenizer or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = encoder_of(definition.value)
        names = [field.strip().split()[0] for field in SEGMENT_SCHEMA.split(",")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        seq = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before
            keys = [key for own, _, _ in held for key in own]
            counts = np.concatenate([counts for _, counts, _ in held])
            ids = np.concatenate([ids for _, _, ids in held])
            row = [part, seq, before, len(keys), len(ids), write_segment(keys, counts, ids)]
            seq, before = seq + 1, before + len(ids)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names
            )

        for batch in batches:
            for start, length in blocks(batch.column(1)):
                ids, counts = encoder.encode(batch.column(1).slice(start, length))
                keys = batch.column(0).slice(start, length).to_pylist()
                ends = np.cumsum(counts)
                for k in range(0, length, 256):
                    first, last = ends[k] - counts[k], ends[min(k + 256, length) - 1]
                    held.append((keys[k : k + 256], counts[k : k + 256], ids[first:last]))
                    if sum(len(ids) for _, _, ids in held) >= segment:
                        yield flush()
        if held:
            yield flush()

    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("__tie")]
    (
        docs.select("doc_id", "text", F.xxhash64("text").alias("__tie"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .mapInArrow(run, SEGMENT_SCHEMA)
        .write.parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian bytes, 4 an id).

    A segment knows how many ids of its file come before it; totals of the files, one row a file,
    give the rest.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        segments.groupBy("part")
        .agg(F.sum("n_ids").alias("__ids"))
        .select("part", F.coalesce(F.sum("__ids").over(before), F.lit(0)).alias("__offset"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, ends, ids = read_segment(row["payload"])
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(ends), pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(begins + row["before"], pa.int64()),
                        pa.array(ends - begins, pa.int64()),
                        pa.array(
                            [raw[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)], pa.binary()
                        ),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids"],
                )

    rows = segments.select("part", "before", "payload").mapInArrow(
        run, "part int, doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )
    return rows.join(F.broadcast(files), "part").select(
        "doc_id", (F.col("start") + F.col("__offset")).alias("start"), "n_tokens", "ids"
    )
