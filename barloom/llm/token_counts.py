"""Token counts from a trie of distinct pre-tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.llm.labels import map_texts
from barloom.llm.pieces import LONG, Pieces
from barloom.llm.sentencepieces import load

MOST_PRETOKENS = 200_000


def trie_counts(pieces: Pieces, words: list[str]) -> np.ndarray:
    """The number of pieces on the best path of each word, from one pass over their trie.

    Words are inserted level by level: words with one beginning share its node. A node holds the
    automaton's state, the best score of its prefix and that path's number of pieces, each
    computed once from its ancestors; a word's count is read at its terminal node.
    """
    counts = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    long = order[lengths[order] >= LONG]
    if len(long):
        counts[long] = pieces.best_paths([words[i] for i in long]).counts
        order = order[len(long) :]
    if not len(order):
        return counts
    chosen, size = [words[i] for i in order], lengths[order]
    symbol, point = pieces.symbols_of(chosen)
    start = np.cumsum(size) - size
    # per level: the node of each word that is long enough, counted over all levels
    nodes_at = [np.zeros(len(chosen), np.int64)]
    best, taken = [np.zeros(1)], [np.zeros(1, np.int64)]
    state = np.zeros(1, np.int32)
    score, count = best[0], taken[0]
    first_of_level = 0
    for t in range(int(size[0])):
        n = int(np.searchsorted(-size, -t))
        parents = nodes_at[t][:n] - first_of_level
        where = start[:n] + t
        # unknown characters differ by the bytes they take
        _, first, inverse = np.unique(
            parents << 21 | point[where].astype(np.int64), return_index=True, return_inverse=True
        )
        first_of_level = len(score)
        nodes_at.append(inverse + first_of_level)
        parent = parents[first]
        state = pieces.step(state[parent], symbol[where[first]])
        here = np.arange(len(first)) + first_of_level
        score = np.append(score, np.full(len(first), -np.inf))
        back = np.zeros(len(score), np.int32)

        def before(rows: np.ndarray, length: np.ndarray, t=t, first=first) -> np.ndarray:
            return score[ancestors(nodes_at, t + 1 - length, first[rows])]

        pieces.relax(state, here, before, score, back)
        lone = np.flatnonzero(~pieces.single[symbol[where[first]]])
        above = nodes_at[t][first]
        value = score[above[lone]] + pieces.unknown
        better = lone[value > score[here[lone]]]
        score[here[better]] = value[value > score[here[lone]]]
        back[here[better]] = 0
        node = back[here]
        code = point[where[first]]
        own = np.where(node > 0, 1, 1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000))
        reach = np.where(node > 0, pieces.depth[node], 1)
        count = np.append(count, count[ancestors(nodes_at, t + 1 - reach, first)] + own)
        ended = np.flatnonzero(size[:n] == t + 1)
        counts[order[ended]] = count[nodes_at[t + 1][ended]]
    return counts


def ancestors(nodes_at: list[np.ndarray], level: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The nodes at the given levels on the paths of the given words."""
    result = np.empty(len(word), np.int64)
    for one in np.unique(level):
        rows = np.flatnonzero(level == one)
        result[rows] = nodes_at[one][word[rows]]
    return result


class Counter:
    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.rows, self.counts = pieces, {}, np.empty(0, np.int64)

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and pre-tokens of each text."""
        if len(self.rows) > MOST_PRETOKENS:
            self.rows, self.counts = {}, np.empty(0, np.int64)
        rows, found, sizes = self.rows, [], []
        for text in texts:
            own = self.pieces.chunks(text or "")
            found.extend(own)
            sizes.append(len(own))
        known = len(rows)
        fresh = [word for word in dict.fromkeys(found) if word not in rows]
        rows.update(zip(fresh, range(known, known + len(fresh)), strict=True))
        self.counts = np.append(self.counts, trie_counts(self.pieces, fresh))
        tokens = self.counts[np.fromiter(map(rows.__getitem__, found), np.int64, len(found))]
        sums = np.concatenate([[0], np.cumsum(tokens)])[np.cumsum([0, *sizes])]
        return np.diff(sums), np.array(sizes, np.int64)


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and n_pretokens in place of text.

    Counts are those of ``sentencepieces.encode_texts`` with the same vocabulary, without making
    the ids. Null and empty texts have none. Each task keeps a trie's results for the distinct
    pre-tokens it meets, up to a bound; nothing is shuffled. Input columns of the two names are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    held: list[Counter] = []

    def each(texts: list[str | None]) -> list[pa.Array]:
        if not held:
            held.append(Counter(shared.value))
        return [pa.array(values) for values in held[0].count(texts)]

    added = T.StructType.fromDDL("n_tokens bigint, n_pretokens bigint")
    return map_texts(docs, added, each, drop=("text",))
