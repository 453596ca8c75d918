"""Quality by naive Bayes features in a support vector machine."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.labels import (
    Rows,
    distinct,
    fit_sigmoid,
    fitted,
    fold,
    labelled_sample,
    map_texts,
    sigmoid,
)

BITS = 18
SAMPLE = 12_000
FOLDS = 5
THRESHOLD = 0.3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUN = re.compile(r"(.)\1+", re.DOTALL)


class _Kinds(dict):
    """Code points to the sign that stands for their kind."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        self[code] = kind
        return kind


class _Words(dict):
    """Two 31-bit hashes of a word, as one integer: of its spelling and of its shape."""

    most = 400_000
    kinds = _Kinds()

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        if word.isalpha() and word.islower():
            shape = "a"
        else:
            shape = _RUN.sub(r"\1", word.translate(self.kinds))
        spelling = zlib.crc32(word.lower().encode("utf-8", "replace")) >> 1
        kind = zlib.crc32(shape.encode("utf-8", "replace")) >> 1
        value = self[word] = kind << 31 | spelling
        return value


_known = _Words()


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed n-grams that a text holds, each once.

    Word unigrams and bigrams of the lower-cased text, and n-grams of one to three word shapes
    (runs of letters, capitals, digits and signs; a word equal to the one before it is its own
    shape). No words give no features.
    """
    seen = (text or "").split()
    if not seen:
        return np.empty(0, np.int32)
    both = np.fromiter(map(_known.__getitem__, seen), np.uint64, len(seen))
    spelling = both & np.uint64((1 << 31) - 1)
    shape = (both >> np.uint64(31)) * _MIX
    shape[1:][spelling[1:] == spelling[:-1]] = _MIX
    spelling = spelling * _MIX + np.uint64(1)
    grams = [spelling, spelling[:-1] * np.uint64(3) + spelling[1:] * np.uint64(5)]
    for n in (1, 2, 3):
        value = np.full(max(len(shape) - n + 1, 0), n, np.uint64)
        for k in range(n):
            value = (value + shape[k : len(shape) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        grams.append(value)
    mixed = np.concatenate(grams)
    mixed ^= mixed >> np.uint64(29)
    return distinct((mixed * _MIX >> np.uint64(64 - bits)).astype(np.int32), 1 << bits)


@dataclass
class Model:
    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        values = self.ratio[found]
        return float(self.weights[found] @ values) / max(float(values @ values) ** 0.5, 1e-9) + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        margins = np.array([self.margin(features(text)) for text in texts], float)
        return sigmoid(self.slope * margins + self.offset)


def log_count_ratio(rows: Rows, chosen: np.ndarray, signs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Per feature, the log of its smoothed share among positive over that among negative rows."""
    held = {1: np.ones(1 << bits), -1: np.ones(1 << bits)}
    for i in chosen:
        held[int(signs[i])][rows[i]] += 1.0  # a row holds a feature once
    return np.log(held[1] / held[1].sum()) - np.log(held[-1] / held[-1].sum())


def dual_coordinate_descent(
    rows: Rows,
    chosen: np.ndarray,
    signs: np.ndarray,
    ratio: np.ndarray,
    cost: float = 1.0,
    rounds: int = 12,
    seed: int = 1,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear hinge-loss model over indicators scaled by ``ratio``.

    Rows are scaled to unit length. The dual has one variable a row, between 0 and its class's
    cost; each step solves one variable exactly. Classes weigh the same in sum. Scaled values are
    made when a row's turn comes, so that a fit holds little besides the rows themselves.
    """
    weights, bias = np.zeros_like(ratio), 0.0
    single = ratio.astype(np.float32)
    marks = signs[chosen]
    lengths = []
    for i in chosen:
        value = single[rows[i]]
        lengths.append(max(float(np.sqrt(value @ value)), 1e-9))
    share = {s: len(marks) / (2 * max(int((marks == s).sum()), 1)) for s in (1, -1)}
    upper = np.array([cost * share[int(s)] for s in marks])
    alpha, order = np.zeros(len(chosen)), np.random.default_rng(seed)
    for _ in range(rounds):
        for k in order.permutation(len(chosen)):
            row, sign = rows[chosen[k]], marks[k]
            value = single[row] / np.float32(lengths[k])
            slack = sign * (weights[row] @ value + bias) - 1.0
            new = min(max(alpha[k] - slack / 2.0, 0.0), upper[k])
            step = (new - alpha[k]) * sign
            if step:
                weights[row] += step * value
                bias += step
                alpha[k] = new
    return weights, bias


def fit(rows: Rows, labels: np.ndarray) -> Model:
    """A model of label 1; margins become probabilities by a sigmoid fitted on a fifth left out.

    With fewer than two rows of either label, every text scores the smoothed share of label 1.
    """
    signs = np.where(labels == 1, 1, -1)
    nothing = np.zeros(1 << BITS)
    flat = Model(nothing, nothing, 0.0, 0.0, 0.0)
    few = min(int((signs == 1).sum()), int((signs == -1).sum()))
    if few < 2:
        flat.offset = float(np.log(((signs == 1).sum() + 1) / ((signs == -1).sum() + 1)))
        return flat

    def trained(chosen: np.ndarray) -> Model:
        ratio = log_count_ratio(rows, chosen, signs)
        weights, bias = dual_coordinate_descent(rows, chosen, signs, ratio)
        return Model(weights, ratio, bias, 1.0, 0.0)

    def margins(model: Model, chosen: np.ndarray) -> np.ndarray:
        return np.array([model.margin(rows[i]) for i in chosen])

    place = np.random.default_rng(7).permutation(len(rows))
    aside = place[: max(len(rows) // 5, 1)]
    if len(set(signs[aside])) < 2:
        aside = place
    rest = np.setdiff1d(place, aside) if len(aside) < len(place) else place
    slope, offset = fit_sigmoid(margins(trained(rest), aside), (signs[aside] == 1).astype(float))
    model = trained(place)
    model.slope, model.offset = slope, offset
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled documents (doc_id, quality) outside the held-out fold.

    The sample is bounded in rows and in bytes (``labels.labelled_sample``), and so is the task that
    fits, which keeps the features of each text as 32-bit numbers. The driver gets the model alone.
    """
    return fitted(labelled_sample(docs, labels, "quality", fold(FOLDS) != 0, most), _fit_texts)


def _fit_texts(labelled: Iterator[tuple[str, int]]) -> Model:
    marks: list[int] = []

    def found() -> Iterator[np.ndarray]:
        for text, label in labelled:
            marks.append(label)
            yield features(text)

    rows = Rows.of(found())
    return fit(rows, np.array(marks, int))


def score_quality(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep_text: bool = False
) -> DataFrame:
    """``docs`` with held_out, score (0 to 1, label 1 likelier) and predicted (score >= threshold).

    The text itself is left out unless ``keep_text``.

    Texts are scored whole; null and empty texts have no n-grams and score what the bias says.
    Repeated rows score alike. Input columns of the three names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(texts: list[str | None]) -> list[pa.Array]:
        scores = shared.value.score(texts)
        return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

    added = T.StructType(
        [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    drop = () if keep_text else ("text",)
    return map_texts(docs.withColumn("held_out", fold(FOLDS) == 0), added, each, drop)
