"""Toxicity by multiple-instance learning: a document is toxic when one of its sentences is."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.labels import Rows, distinct, fitted, fold, labelled_sample, map_texts, sigmoid

BITS = 18
SAMPLE = 6_000
FOLDS = 3
HELD_OUT = 1
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
LONGEST = 40
LEAST_BIAS = -9.0
UNEXPLAINED = 0.02
STEMS = (3, 4, 5)
PER_WORD = 1 + len(STEMS)
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_EDGES = re.compile(r"^\W+|\W+$")
_WORD = re.compile(r"\S+")


class _Words(dict):
    """Words to rows of ``table``: hashes of the lower-cased word and of its beginnings."""

    most = 150_000

    def __init__(self) -> None:
        super().__init__()
        self.table = np.zeros((1 << 12, PER_WORD), np.int32)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        plain = word.lower() if word.isalnum() else _EDGES.sub("", word).lower()
        for k, part in enumerate((plain, *[f"{n}^{plain[:n]}" for n in STEMS])):
            self.table[row, k] = zlib.crc32(part.encode("utf-8", "replace")) >> (32 - BITS)
        self[word] = row
        return row

    def features(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        found = self.table[rows]
        if len(self) > self.most:
            self.clear()
        return found


_known = _Words()


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Starts and ends (code points) of the sentences that hold a word.

    A sentence ends at full stops, exclamation or question marks and line ends; one of over 40
    words goes on as another after each 40 words.
    """
    spans = []
    for match in _SENTENCE.finditer(text or ""):
        found = match.group().split()
        if len(found) > LONGEST:
            inside = [m.span() for m in _WORD.finditer(match.group())]
            for k in range(0, len(inside), LONGEST):
                part = inside[k : k + LONGEST]
                spans.append((match.start() + part[0][0], match.start() + part[-1][1]))
        elif found:
            spans.append(match.span())
    return spans


@dataclass
class Bags:
    """Features of many documents: PER_WORD a word, words by sentence, sentences by document.

    A word that a sentence repeats counts once.
    """

    features: np.ndarray
    words: np.ndarray
    sentences: np.ndarray

    @classmethod
    def of(
        cls, texts: list[str | None], spans: list[list[tuple[int, int]]] | None = None
    ) -> Bags:
        spans = [sentences(text) for text in texts] if spans is None else spans
        flat: list[str] = []
        words, counts = [], []
        for text, own in zip(texts, spans, strict=True):
            for start, end in own:
                found = dict.fromkeys(text[start:end].split())
                flat.extend(found)
                words.append(len(found))
            counts.append(len(own))
        return cls(_known.features(flat).ravel(), np.array(words, np.int64), np.array(counts, np.int64))

    def by_sentence(self, values: np.ndarray) -> np.ndarray:
        """Sums over each sentence; every sentence has a word."""
        if not len(self.words):
            return np.zeros(0)
        starts = np.concatenate([[0], np.cumsum(self.words)[:-1]]) * PER_WORD
        return np.add.reduceat(values, starts)

    def by_document(self, values: np.ndarray) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.sentences)), self.sentences)
        return np.bincount(owner, values, len(self.sentences))


def above_none(evidence: np.ndarray, bias: float) -> np.ndarray:
    """What sentences score above one without evidence: 0 there, up to 1."""
    none = sigmoid(np.float64(bias))
    return (sigmoid(evidence + bias) - none) / (1 - none)


@dataclass
class Model:
    """Sentence weights, their bias, and the score that no clean training sentence exceeds."""

    weights: np.ndarray
    bias: float
    floor: float = 0.0

    def sentence_scores(self, bags: Bags) -> np.ndarray:
        return above_none(bags.by_sentence(self.weights[bags.features]), self.bias)


def noisy_or(bags: Bags, scores: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """The chance that at least one sentence of a document is toxic; 0 without sentences.

    Sentences that score ``floor`` or less do not add up: only the greatest of them counts, so
    that weak evidence says the same however long a text is. Above the floor, sentences of one
    document with the same score are taken for one sentence repeated, and count once.
    """
    owner = np.repeat(np.arange(len(bags.sentences)), bags.sentences)
    weak = np.zeros(len(bags.sentences))
    below = scores <= floor
    np.maximum.at(weak, owner[below], scores[below])
    above = np.flatnonzero(~below)
    above = above[np.lexsort((scores[above], owner[above]))]
    mine, value = owner[above], np.minimum(scores[above], 1 - 1e-12)
    once = np.ones(len(above), bool)
    once[1:] = (mine[1:] != mine[:-1]) | (value[1:] != value[:-1])
    strong = np.bincount(mine[once], np.log1p(-value[once]), len(weak))
    return 0.0 - np.expm1(strong + np.log1p(-weak))


@dataclass
class Sample:
    """Features of labelled documents: all of them by sentence, 32 bits each, and their labels."""

    features: Rows
    words: Rows
    labels: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[tuple[str, int]]) -> Sample:
        words: list[np.ndarray] = []
        marks: list[int] = []

        def each() -> Iterator[np.ndarray]:
            for text, label in rows:
                own = Bags.of([text])
                words.append(own.words.astype(np.int32))
                marks.append(label)
                yield own.features

        features = Rows.of(each())
        return cls(features, Rows.of(words), np.array(marks, float))


@dataclass
class Block:
    """Some documents of a fit: places of weights, the sentences that hold them, their documents."""

    place: np.ndarray
    holder: np.ndarray
    owner: np.ndarray
    labels: np.ndarray


def _blocks(sample: Sample, number: np.ndarray, size: int = 1 << 19) -> list[Block]:
    """The documents in blocks of about ``size`` features that have a weight."""
    blocks, place, holder, owner, marks, held, sentences_so_far = [], [], [], [], [], 0, 0

    def close() -> None:
        none = [np.empty(0, np.int32)]
        blocks.append(
            Block(
                np.concatenate(place or none),
                np.concatenate(holder or none),
                np.concatenate(owner or none),
                np.array(marks),
            )
        )

    for i in range(len(sample.labels)):
        words = sample.words[i]
        own = number[sample.features[i]]
        keep = own >= 0
        place.append(own[keep])
        inside = np.arange(sentences_so_far, sentences_so_far + len(words), dtype=np.int32)
        holder.append(np.repeat(inside, words * PER_WORD)[keep])
        owner.append(np.full(len(words), len(marks), np.int32))
        marks.append(sample.labels[i])
        held, sentences_so_far = held + len(place[-1]), sentences_so_far + len(words)
        if held >= size:
            close()
            place, holder, owner, marks, held, sentences_so_far = [], [], [], [], 0, 0
    if marks:
        close()
    return blocks


def loss_slopes(block: Block, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """Log loss of a block's documents under weights and bias ``theta``, and its gradient.

    The chance of a document is the noisy-or of its sentences, each by what it scores above one
    without evidence, and of UNEXPLAINED.
    """
    n = len(block.owner)
    evidence = np.bincount(block.holder, theta[block.place], n)
    above = np.log1p(-np.minimum(above_none(evidence, theta[-1]), 1 - 1e-12))
    whole = 0.0 - np.expm1(np.bincount(block.owner, above, len(block.labels)))
    whole = np.clip(UNEXPLAINED + (1 - UNEXPLAINED) * whole, 1e-9, 1 - 1e-9)
    loss = -np.log(np.where(block.labels == 1, whole, 1 - whole)).sum()
    # d loss / d sentence margin: p for clean documents, -p (1 - P) / P for toxic ones
    pull = np.where(block.labels == 1, -(1 - whole) / whole, 1.0)[block.owner]
    scores = sigmoid(evidence + theta[-1])
    # the bias also moves what a sentence without evidence scores
    bias = ((scores - sigmoid(theta[-1])) * pull).sum()
    slopes = np.bincount(block.place, (scores * pull)[block.holder], len(theta) - 1)
    return float(loss), np.append(slopes, bias)


def fit(sample: Sample, steps: int = 120, rate: float = 0.2, decay: float = 1e-5) -> Model:
    """Sentence weights that make the noisy-or of a document's sentences meet its label.

    Adam on the log loss over all documents, with weights of 0 or more and a small constant pull
    towards 0, so that neutral words end at 0 and can't hide a toxic one. Only features that at
    least 3 documents hold, and toxic documents more often than clean ones, get a weight. It starts
    from the log ratio of both shares, drawn towards 0 where few toxic documents hold the feature.
    A sentence counts by what it scores above one without evidence, so neutral sentences add up to
    nothing, however many there are; what no sentence explains is a chance of each document,
    UNEXPLAINED. Without both labels every sentence scores 0.
    """
    model = Model(np.zeros(1 << BITS), -5.0)
    labels = sample.labels
    if len(set(labels.tolist())) < 2:
        return model
    held = {0.0: np.zeros(1 << BITS), 1.0: np.zeros(1 << BITS)}
    for i, label in enumerate(labels):
        held[label][distinct(sample.features[i], 1 << BITS)] += 1
    ratio = np.log((held[1.0] + 1) / (labels.sum() + 2)) - np.log(
        (held[0.0] + 1) / ((1 - labels).sum() + 2)
    )
    used = np.flatnonzero((ratio > 0) & (held[1.0] + held[0.0] >= 3))
    theta = np.append(ratio[used] * held[1.0][used] / (held[1.0][used] + 10), -5.0)
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    blocks = _blocks(sample, number)
    # The lower the bias, the less weak evidence of many sentences adds up, so it is drawn down more.
    pull_down = np.append(np.full(len(used), decay), 300 * decay)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        gradient = pull_down.copy()
        for block in blocks:
            gradient += loss_slopes(block, theta)[1] / len(labels)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        unbiased = first / (1 - 0.9**step)
        theta -= rate * unbiased / (np.sqrt(second / (1 - 0.99**step)) + 3e-4)
        theta[:-1] = np.maximum(theta[:-1], 0.0)
        theta[-1] = max(theta[-1], LEAST_BIAS)
    model.weights[used], model.bias = theta[:-1], float(theta[-1])
    for i in np.flatnonzero(labels == 0):
        own = Bags(sample.features[i], sample.words[i].astype(np.int64), np.array([len(sample.words[i])]))
        if len(own.words):
            model.floor = max(model.floor, float(model.sentence_scores(own).max()))
    # a toxic sentence in a document labelled clean must not silence the others
    model.floor = min(model.floor, SENTENCE_THRESHOLD)
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Fit on at most ``most`` labelled documents (doc_id, toxic) outside the held-out fold.

    The sample is bounded in rows and in bytes (``labels.labelled_sample``), and so is the task that
    fits, which keeps the features of each text as 32-bit numbers and works in blocks of them. The
    driver gets the model alone.
    """
    sample = labelled_sample(docs, labels, "toxic", fold(FOLDS) != HELD_OUT, most)
    return fitted(sample, _fit_texts)


def _fit_texts(labelled: Iterator[tuple[str, int]]) -> Model:
    return fit(Sample.of(labelled))


def score_toxicity(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep_text: bool = False
) -> DataFrame:
    """``docs`` with held_out, score, predicted (score >= threshold) and toxic_spans.

    The text itself is left out unless ``keep_text``.

    The score is the noisy-or over all sentences of the whole text, each by what it scores above
    one without evidence. Sentences that score no more than clean training text does (0.5 at most)
    count by the greatest of them alone, so that neither neutral nor weakly suspect sentences add
    up with a text's length. toxic_spans lists (start, end, score) of the sentences
    that score 0.5 or more, in code points. Null and empty texts
    have no sentences: score 0, no spans. Input columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def each(texts: list[str | None]) -> list[pa.Array]:
        spans = [sentences(text) for text in texts]
        bags = Bags.of(texts, spans)
        scores = shared.value.sentence_scores(bags)
        whole = noisy_or(bags, scores, shared.value.floor)
        ends, found = np.cumsum(bags.sentences), [[] for _ in texts]
        flat = [place for own in spans for place in own]
        for j in np.flatnonzero(scores >= SENTENCE_THRESHOLD):
            owner = int(np.searchsorted(ends, j, "right"))
            found[owner].append({"start": flat[j][0], "end": flat[j][1], "score": float(scores[j])})
        return [
            pa.array(whole),
            pa.array((whole >= threshold).astype(np.int32)),
            pa.array(found, pa.list_(span)),
        ]

    fields = T.StructType.fromDDL(
        "score double, predicted int, toxic_spans array<struct<start: int, end: int, score: double>>"
    )
    drop = () if keep_text else ("text",)
    return map_texts(docs.withColumn("held_out", fold(FOLDS) == HELD_OUT), fields, each, drop)
