"""Piece encoding, token counts and token files, against the libraries and plain search."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from barloom.llm import pieces, sentencepieces, token_counts, token_files
from tests.llm.cases import LONG, ODD, by_id, no_documents, odd_documents

TEXTS = [text or "" for _, text, _, _ in ODD] + ["  two  blanks\n", "naïve façade, don't!", "a\tb"]


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.load()


def plain_best(vocabulary, scores, text):
    """Best path by trying every piece at every place; the longest last piece wins ties."""
    best, back = [0.0] + [-np.inf] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            value = scores.get(text[start:end])
            if value is None and start == end - 1:
                value = vocabulary.unknown
            if value is not None and best[start] + value > best[end]:
                best[end], back[end] = best[start] + value, start
    parts, end = [], len(text)
    while end:
        parts.append(text[back[end] : end])
        end = back[end]
    return parts[::-1]


def test_small_vocabularies(vocabulary):
    chance = random.Random(3)
    for _ in range(30):
        names = {"".join(chance.choices("ab c", k=chance.randint(1, 4))) for _ in range(12)}
        normal = {name: (i, -float(chance.randint(1, 9))) for i, name in enumerate(sorted(names))}
        own = pieces.Pieces.build(normal, [name.encode() for name in sorted(names)], np.arange(256) + 100)
        scores = {name: score for name, (_, score) in normal.items()}
        texts = ["".join(chance.choices("abc d", k=chance.randint(1, 40))) for _ in range(20)]
        found = own.best_paths(texts)
        ends = np.cumsum(found.counts)
        for text, end, count in zip(texts, ends, found.counts, strict=True):
            wanted = [
                normal[part][0] if part in normal else 100 + ord(part)
                for part in plain_best(own, scores, text)
            ]
            assert found.ids[end - count : end].tolist() == wanted
        assert token_counts.trie_counts(own, texts).tolist() == found.counts.tolist()


def test_same_as_the_library(vocabulary, tmp_path):
    """The library's unigram search over the same pieces and scores."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path(sentencepieces.VOCABULARY), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -60_000.0)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    encoder = sentencepieces.Encoder(sentencepieces.load(str(path)))
    texts = [text for text in TEXTS if "▁" not in text]
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    for text, end, count in zip(texts, ends, counts, strict=True):
        assert ids[end - count : end].tolist() == library.encode(text)


def test_pieces_round_trip(spark, vocabulary):
    docs = odd_documents(spark)
    encoded = sentencepieces.encode_texts(docs, check=True)
    assert encoded.where("NOT round_trip").isEmpty() and "text" not in encoded.columns
    assert "n_ids" in encoded.columns and encoded.count() == len(ODD)
    decoded = by_id(sentencepieces.decode_ids(encoded))
    wanted = {d: t or "" for d, t, _, _ in ODD}
    assert {d: row.text for d, row in decoded.items()} == {d: wanted[d] for d in decoded}
    assert sentencepieces.encode_texts(no_documents(spark)).isEmpty()
    assert sentencepieces.decode_ids(sentencepieces.encode_texts(no_documents(spark))).isEmpty()


def test_counts_are_those_of_the_ids(spark, vocabulary):
    counted = by_id(token_counts.count_tokens(odd_documents(spark)))
    encoded = by_id(sentencepieces.encode_texts(odd_documents(spark)))
    assert {d: r.n_tokens for d, r in counted.items()} == {d: len(r.ids) for d, r in encoded.items()}
    assert counted[2].n_tokens == counted[3].n_tokens == 0
    assert token_counts.count_tokens(no_documents(spark)).isEmpty()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
def test_blocks(n):
    chance = np.random.default_rng(n)
    for ids in (
        chance.integers(0, 49_000, n),
        chance.integers(0, 2**32, n),
        np.where(chance.random(n) < 0.05, 2**32 - 1, chance.integers(0, 9, n)),
        np.full(n, 7),
    ):
        ids = ids.astype(np.uint32)
        starts, raw = token_files.encode_blocks(ids)
        assert len(starts) == -(-n // token_files.BLOCK)
        assert (token_files.decode_blocks(starts, np.frombuffer(raw, np.uint8), n) == ids).all()


def test_outliers_become_exceptions():
    ids = np.arange(128, dtype=np.uint32) % 4
    ids[5] = 1 << 20
    _, raw = token_files.encode_blocks(ids)
    assert len(raw) == 6 + 128 * 2 // 8 + 5


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(odd_documents(spark), path, segment=5000)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    wanted = {}
    for doc_id, text, _, _ in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids + [token_files.END]
        wanted.setdefault(doc_id, []).append(np.array(ids, "<u4").tobytes())
    found = {}
    for row in rows:
        found.setdefault(row.doc_id, []).append(bytes(row.ids))
        assert row.n_tokens * 4 == len(row.ids)
    assert {d: sorted(v) for d, v in found.items()} == {d: sorted(v) for d, v in wanted.items()}
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and rows[0].doc_id is None
    assert zlib.crc32(rows[0].ids) >= 0 and any(r.n_tokens > 40_000 for r in rows) and LONG
    empty = str(tmp_path / "none")
    token_files.write_token_files(no_documents(spark), empty)
    assert token_files.read_token_files(spark, empty).isEmpty()


def test_a_full_store_forgets_late_words(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_WORDS", 3)
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as file:
        encoder = token_files.WordEncoder(file.read())
    library = encoder.tokenizer
    for text in ("one two three four", "four five six. Two", "don't stop, 42 times! <|endoftext|>"):
        ids, _ = encoder.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [1]
        assert len(encoder.words.rows) <= 3


def test_words_end_where_the_tokenizer_says():
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as file:
        encoder = token_files.WordEncoder(file.read())
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    forms = ("a_b", "x_", "_", "End._ _two")
    texts = [form.replace("_", blank) for blank in blanks for form in forms]
    texts += ["\u0130. x", "\u0958! x"]  # taken apart into a letter and a sign that joins the mark
    ids, counts = encoder.encode(texts)
    for text, end, count in zip(texts, np.cumsum(counts), counts, strict=True):
        wanted = encoder.tokenizer.encode(text, add_special_tokens=False).ids + [token_files.END]
        assert ids[end - count : end].tolist() == wanted, ascii(text)


def test_plain_words_reach_the_model_as_they_are():
    """Only words that NFC, lower-casing or a cut may change go through the whole library."""
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as file:
        encoder = token_files.WordEncoder(file.read())
    library, asked = encoder.tokenizer, []

    class Watched:
        def encode_batch_fast(self, words, **options):
            asked.extend(words)
            return library.encode_batch_fast(words, **options)

    encoder.tokenizer = Watched()
    letters = [chr(c) for c in range(0x180) if chr(c).isalpha()]
    marked = "ond### Th\u00f1$$$ end,*** \u00dfe.%%% x&&& e|#|"
    texts = [marked, "Stra\u00dfe \u00c4RGER, na\u00efve. \u00f1and\u00fa End", *letters, *(f"a{c}B{c}." for c in letters)]
    plain = [word for text in texts for word in text.split() if max(word) < "\u0130"]
    odd = ["don't <|endoftext|>", "x<|endoftext|>y 42", "", "a\u0301b e\u0301. 3rd"]
    for batch in (texts, odd, texts + odd):
        ids, counts = encoder.encode(batch)
        wanted = [library.encode(text, add_special_tokens=False).ids + [token_files.END] for text in batch]
        assert np.split(ids, np.cumsum(counts))[:-1] and counts.tolist() == list(map(len, wanted))
        assert ids.tolist() == [i for own in wanted for i in own]
    sent = {word for words in asked for word in (words if isinstance(words, list) else words.split())}
    whole = {word.rstrip(encoder.marks) for word in plain}
    assert len(whole) > 300 and not sent & {*plain, *whole, *map(str.lower, whole)}


def test_a_word_of_many_texts_is_looked_up_once(monkeypatch):
    with open(public_tokenizers.path(token_files.VOCABULARY), encoding="utf-8") as file:
        encoder = token_files.WordEncoder(file.read())
    asked, places = [], encoder.words.places
    monkeypatch.setattr(encoder.words, "places", lambda keys: asked.extend(keys) or places(keys))
    texts = [f"  the same words again, text{k} \u00e9t\u00e9... " for k in range(50)]
    ids, counts = encoder.encode(texts)
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [token_files.END] for t in texts]
    assert ids.tolist() == [i for own in wanted for i in own] and counts.tolist() == list(map(len, wanted))
    assert sorted(set(asked)) == sorted(asked) and len(asked) <= 50 + 6


def test_blocks_hold_bounded_text(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 10)
    texts = pa.array(["abcd", None, "efgh", "x" * 30, "", "y", "z" * 9, "w"], pa.string())
    runs = list(token_files.blocks(texts))
    assert [start for start, _ in runs] == np.cumsum([0, *[n for _, n in runs]])[:-1].tolist()
    assert sum(n for _, n in runs) == len(texts)
    for start, n in runs:
        assert n == 1 or sum(len(t or "") for t in texts.slice(start, n).to_pylist()) <= 10
    assert list(token_files.blocks(texts.slice(0, 0))) == []
