"""Fill-in-middle: texts cut into prefix, middle and suffix at unit borders, and put together again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks in front of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = 1
# One unit over the bytes of UTF-8: a run of letters A-Z, or one other character.
UNIT = rb"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFF][\x80-\xBF]*"
# This byte is in no UTF-8 text, so it can stand between units.
BETWEEN = b"\xff"
# Texts are worked on in blocks of about so many bytes; a longer one is a block by itself.
BLOCK_BYTES = 2 << 20


def split_units(texts: pa.Array) -> pa.ListArray:
    """Units of each text (binary, UTF-8) as a list array; joined again they are the text."""
    marked = pc.replace_substring_regex(texts, pattern=UNIT, replacement=rb"\0" + BETWEEN)
    return pc.split_pattern(marked, pattern=BETWEEN)


def cut_lists(units: pa.ListArray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix (the first ``low`` units), middle (up to ``high``) and suffix of each list, joined.

    Units are flattened with the index of their parent and their ordinal in it; each role keeps
    its own, in lists rebuilt from the counts, and ``binary_join`` makes one piece of each.
    """
    flat = units.flatten()
    parent = pc.list_parent_indices(units).to_numpy()
    sizes = pc.list_value_length(units).to_numpy()
    ordinal = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    role = (ordinal >= low[parent]).astype(np.int8) + (ordinal >= high[parent])
    pieces = []
    for own in range(3):
        mine = role == own
        counts = np.bincount(parent[mine], minlength=len(units))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(mine)))
        pieces.append(pc.binary_join(lists, b""))
    return pieces


def blocks(texts: pa.Array) -> Iterator[slice]:
    """Runs of rows of at most BLOCK_BYTES, or of one row."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > BLOCK_BYTES:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def transform(texts: pa.Array, h: list[np.ndarray]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts (binary), by four numbers a row."""
    # each text ends with an empty piece after its last unit
    units = split_units(texts)
    n = pc.list_value_length(units).to_numpy() - 1
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    prefix, middle, suffix = cut_lists(units, np.minimum(first, second), np.maximum(first, second))
    plain = (n == 0) | (h[2] % 100 >= PLAIN_FROM)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= pc.match_substring(texts, mark.encode()).to_numpy(zero_copy_only=False)
    spm = h[3] % 100 < SPM_BELOW
    p, s, m = (pa.scalar(mark.encode()) for mark in (PREFIX, SUFFIX, MIDDLE))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, b"")
    other = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, b"")
    moved = pc.if_else(pa.array(spm), other, psm)
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    none = pa.array(plain)

    def chars(piece: pa.Array) -> pa.Array:
        return pc.if_else(none, None, pc.utf8_length(piece.cast(pa.string())).cast(pa.int64()))

    return [
        pa.array(n, pa.int64()),
        pa.array(form.tolist(), pa.string()),
        chars(prefix),
        chars(middle),
        pc.if_else(none, texts, moved).cast(pa.string()),
    ]


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output for every row of ``docs`` (doc_id, text).

    A unit is a run of letters A-Z, a-z or one other code point; n counts them. The first four
    groups of eight hex digits of sha256("<seed>:<doc_id>") choose the cuts and the form: the
    prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the
    larger. The form is ``plain``, the text itself, where the text is empty or holds a mark, or
    h3 % 100 >= 90; else ``spm`` (suffix, prefix, middle) where h4 % 100 < 20, else ``psm``.
    prefix_chars and middle_chars are code points, null where plain.

    Null texts are empty. A null doc_id counts as empty text in the seed. Rows that repeat are cut
    alike. Other columns are ignored; no rows give no rows. Nothing is shuffled, and a task holds
    the units of one block of 2 MiB, or of one longer text, at a time.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), name).cast("binary"), 256)
    numbers = [
        F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"__h{k}")
        for k in range(4)
    ]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__text")
    added = T.StructType.fromDDL(
        "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )
    names = ["doc_id", *added.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in blocks(batch.column(1)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                h = [part.column(2 + k).to_numpy() for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *transform(part.column(1), h)], names
                )

    source = docs.select("doc_id", text, *numbers)
    return source.mapInArrow(run, T.StructType([docs.schema["doc_id"], *added.fields]))


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form.

    A text with a mark is never cut, and no mark can begin in one part and end in the next, so
    the first of each mark is the one that was put there.
    """

    def after(text: Column, mark: str) -> Column:
        return F.substr(text, F.instr(text, F.lit(mark)) + F.lit(len(mark)))

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    rest = F.substr(output, F.lit(1 + len(PREFIX)))
    psm = F.concat(
        before(rest, SUFFIX), after(rest, MIDDLE), before(after(rest, SUFFIX), MIDDLE)
    )
    spm = F.concat(before(after(rest, PREFIX), MIDDLE), after(rest, MIDDLE), before(rest, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
