"""A piece vocabulary as an Aho-Corasick automaton in arrays, and best paths through it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import sentencepiece

# Added to the lowest score for a character that no piece covers; it is written as its bytes.
UNKNOWN = -10.0
# Longer chunks are walked one by one.
LONG = 256
_WHOLE = re.compile(r"(?s).+")
_CHUNK = re.compile(r" *[^ \n]+| +|\n")


class Path(NamedTuple):
    """Best paths of some chunks: piece ids one after the other, and how many each chunk has."""

    ids: np.ndarray
    counts: np.ndarray


@dataclass
class Pieces:
    """Pieces (blank as a blank, not as its printed sign) and the automaton over their characters.

    Nodes are numbered breadth first from the root 0. ``keys`` holds ``node * width + symbol`` of
    each trie edge, ascending, ``ends`` the node it leads to. ``fail`` is a node's longest proper
    suffix that is a node. ``output`` is its longest suffix, itself included, that is a piece, and
    ``link`` the longest shorter one; 0 stands for none.
    """

    texts: list[bytes]
    byte_ids: np.ndarray
    symbols: dict[str, int]
    table: np.ndarray
    keys: np.ndarray
    ends: np.ndarray
    fail: np.ndarray
    output: np.ndarray
    link: np.ndarray
    piece: np.ndarray
    depth: np.ndarray
    score: np.ndarray
    single: np.ndarray
    unknown: float
    chunk: re.Pattern[str]

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read a SentencePiece model file; every piece that is not a byte or control piece counts."""
        with open(path, "rb") as file:
            model = sentencepiece.SentencePieceProcessor(model_proto=file.read())
        size = model.get_piece_size()
        texts, byte_ids, normal = [b""] * size, np.zeros(256, np.int32), {}
        for i in range(size):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                texts[i] = bytes([int(name[1:-1], 16)])
                byte_ids[texts[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain = name.replace("▁", " ")
                texts[i] = plain.encode()
                normal.setdefault(plain, (i, model.get_score(i)))
        return cls.build(normal, texts, byte_ids)

    @classmethod
    def build(
        cls, normal: dict[str, tuple[int, float]], texts: list[bytes], byte_ids: np.ndarray
    ) -> Pieces:
        symbols = {c: k + 1 for k, c in enumerate(sorted({c for name in normal for c in name}))}
        width = len(symbols) + 1
        children: list[dict[int, int]] = [{}]
        depth, piece, score = [0], [-1], [0.0]
        # breadth first: all prefixes by length
        node_of = {"": 0}
        for name in sorted({n[:k] for n in normal for k in range(1, len(n) + 1)}, key=lambda n: (len(n), n)):
            node = len(depth)
            node_of[name] = node
            children[node_of[name[:-1]]][symbols[name[-1]]] = node
            children.append({})
            depth.append(len(name))
            number, value = normal.get(name, (-1, 0.0))
            piece.append(number)
            score.append(value)
        fail = [0] * len(depth)
        output, link = [0] * len(depth), [0] * len(depth)
        for node in range(len(depth)):
            for symbol, child in children[node].items():
                if node:
                    back = fail[node]
                    while back and symbol not in children[back]:
                        back = fail[back]
                    fail[child] = children[back].get(symbol, 0)
                link[child] = output[fail[child]]
                output[child] = child if piece[child] >= 0 else link[child]
        edges = sorted(
            (node * width + symbol, child)
            for node, own in enumerate(children)
            for symbol, child in own.items()
        )
        table = np.zeros(0x110000, np.int32)
        for c, k in symbols.items():
            table[ord(c)] = k
        single = np.zeros(width, bool)
        for name in normal:
            if len(name) == 1:
                single[symbols[name]] = True
        split = all(" " not in name.lstrip(" ") and "\n" not in name for name in normal)
        return cls(
            texts,
            byte_ids,
            symbols,
            table,
            np.array([key for key, _ in edges], np.int64),
            np.array([child for _, child in edges], np.int32),
            np.array(fail, np.int32),
            np.array(output, np.int32),
            np.array(link, np.int32),
            np.array(piece, np.int32),
            np.array(depth, np.int32),
            np.array(score),
            single,
            min(value for _, value in normal.values()) + UNKNOWN,
            _CHUNK if split else _WHOLE,
        )

    def chunks(self, text: str) -> list[str]:
        """The text, after a blank, cut where no piece can lie across: before blanks, at line ends."""
        return self.chunk.findall(" " + text) if text else []

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The automaton's next node for each pair; symbol 0 is in no piece."""
        at, result = nodes.astype(np.int64), np.zeros(len(nodes), np.int32)
        todo = np.flatnonzero(symbols > 0)
        width = len(self.symbols) + 1
        while len(todo):
            key = at[todo] * width + symbols[todo]
            place = np.searchsorted(self.keys, key)
            place[place == len(self.keys)] = 0
            hit = self.keys[place] == key
            result[todo[hit]] = self.ends[place[hit]]
            todo = todo[~hit & (at[todo] > 0)]
            at[todo] = self.fail[at[todo]]
        return result

    def relax(self, nodes, here, best_before, best, back) -> None:
        """Improve ``best[here]`` by every piece that ends there, longest first, along output links.

        ``best_before(rows, length)`` gives the best score ``length`` characters earlier; ``back``
        receives the node of the chosen piece. Ties stay with the longest piece.
        """
        out = self.output[nodes]
        rows = np.flatnonzero(out)
        out = out[rows]
        while len(rows):
            value = best_before(rows, self.depth[out]) + self.score[out]
            better = value > best[here[rows]]
            place = here[rows[better]]
            best[place] = value[better]
            back[place] = out[better]
            out = self.link[out]
            alive = out > 0
            rows, out = rows[alive], out[alive]

    def symbols_of(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and code points of all chunks one after the other."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        return self.table[points], points

    def best_paths(self, chunks: list[str]) -> Path:
        """The highest-scoring pieces of each chunk, in one pass over positions for all chunks."""
        if not chunks:
            return Path(np.empty(0, np.int32), np.empty(0, np.int64))
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-lengths, kind="stable")
        symbol, point = self.symbols_of(chunks)
        start = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        base = start + order  # a chunk of n characters has n + 1 positions
        best = np.full(len(symbol) + len(chunks), -np.inf)
        back = np.zeros(len(best), np.int32)
        best[base] = 0.0
        nodes = np.zeros(len(chunks), np.int32)
        alone = int(np.searchsorted(-size, -LONG))
        for i in range(alone):
            self._walk(symbol, int(start[i]), int(size[i]), best, back, int(base[i]))
        for t in range(int(size[alone]) if alone < len(size) else 0):
            n = int(np.searchsorted(-size, -t))
            now = slice(alone, n)
            read = symbol[start[now] + t]
            nodes[now] = self.step(nodes[now], read)
            here = base[now] + t + 1
            self.relax(nodes[now], here, lambda rows, length: best[here[rows] - length], best, back)
            lone = np.flatnonzero(~self.single[read])
            value = best[here[lone] - 1] + self.unknown
            better = value > best[here[lone]]
            place = here[lone[better]]
            best[place], back[place] = value[better], 0
        return self._trace(chunks, order, size, base, start, back, point)

    def _walk(self, symbol, start, size, best, back, base) -> None:
        """One long chunk by itself."""
        node = np.zeros(1, np.int32)
        for t in range(size):
            read = symbol[start + t : start + t + 1]
            node = self.step(node, read)
            here = base + t + 1
            out = int(self.output[node[0]])
            while out:
                value = best[here - self.depth[out]] + self.score[out]
                if value > best[here]:
                    best[here], back[here] = value, out
                out = int(self.link[out])
            if not self.single[read[0]] and best[here - 1] + self.unknown > best[here]:
                best[here], back[here] = best[here - 1] + self.unknown, 0

    def _trace(self, chunks, order, size, base, start, back, point) -> Path:
        rows, position = np.arange(len(size)), size.copy()
        found_rows, found_nodes, found_points = [], [], []
        while len(rows):
            node = back[base[rows] + position[rows]]
            found_rows.append(order[rows])
            found_nodes.append(node)
            found_points.append(point[start[rows] + position[rows] - 1])
            position[rows] -= np.where(node > 0, self.depth[node], 1)
            rows = rows[position[rows] > 0]
        owner = np.concatenate(found_rows)
        node, code = np.concatenate(found_nodes), np.concatenate(found_points)
        turn = np.concatenate([np.full(len(r), k) for k, r in enumerate(found_rows)])
        forward = np.lexsort((-turn, owner))
        owner, node, code = owner[forward], node[forward], code[forward]
        as_bytes = np.where(
            node > 0, 1, 1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000)
        )
        ids = np.repeat(self.piece[node], as_bytes)
        starts = np.cumsum(as_bytes) - as_bytes
        for i in np.flatnonzero(node == 0):
            raw = np.frombuffer(chr(code[i]).encode(), np.uint8)
            ids[starts[i] : starts[i] + len(raw)] = self.byte_ids[raw]
        counts = np.bincount(owner, as_bytes, len(chunks)).astype(np.int64)
        return Path(ids.astype(np.int32), counts)
