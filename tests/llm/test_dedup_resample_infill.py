"""Exact dedup, importance resampling and fill-in-middle against plain versions, and on odd input."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, importance, infill
from tests.llm.cases import CLASHING, ODD, no_documents, odd_documents


def with_clashes(docs):
    for name in [*CLASHING, "rows", "class", "sha", "ids", "n", "form", "output", "rank", "weight", "Text_"]:
        docs = docs.withColumn(name, F.lit("x"))
    return docs


# exact dedup


def plain_groups(rows):
    groups = {}
    for doc_id, text in rows:
        key = re.sub("[\x20\x09-\x0d]", "", text or "")
        groups.setdefault(key, []).append((-len(text or ""), doc_id is None, doc_id or 0))
    found = []
    for key, members in groups.items():
        best = min(members)
        for n, none, doc_id in members:
            found.append(
                (
                    None if none else doc_id,
                    None if best[1] else best[2],
                    len(members),
                    hashlib.sha256(key.encode()).hexdigest(),
                )
            )
    return sorted(found, key=str)


def spark_groups(docs):
    rows = exact_dedup.exact_groups(docs).collect()
    kept = {}
    for row in rows:
        kept[row.text_sha256] = kept.get(row.text_sha256, 0) + row.kept
        assert not row.kept or row.doc_id == row.keep_id
    assert set(kept.values()) <= {1}
    found = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows]
    return sorted(found, key=str)


def test_groups_of_odd_documents(spark):
    expected = plain_groups([(row[0], row[1]) for row in ODD])
    assert spark_groups(with_clashes(odd_documents(spark)).repartition(3)) == expected
    assert exact_dedup.exact_groups(no_documents(spark)).isEmpty()


@pytest.mark.parametrize("rows_a_sender", [1 << 17, 2048])
def test_groups_with_a_hot_text(spark, monkeypatch, rows_a_sender):
    monkeypatch.setattr(exact_dedup, "SENDER_ROWS", rows_a_sender)
    monkeypatch.setattr(exact_dedup, "OWNER_LEAST", 64)
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", 4000)
    spaces = " \t\n\x0b\x0c\r"
    rows = []
    for i in range(9000):
        text = "hot text" if i % 3 == 0 else f"text {i // 4 % 1500}"
        rows.append((i, text.replace(" ", spaces[i % 6] * (1 + i % 2))))
    rows.append((9001, "text\x1c7"))
    rows.append((9002, "text\x857"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert spark_groups(docs) == plain_groups(rows)


def test_golomb_codes_round_trip():
    chance = np.random.default_rng(3)
    for n, below in ((0, 10), (1, 1), (1, 1 << 40), (5, 5), (1000, 1 << 30), (1000, 1200), (300, 1 << 61)):
        values = np.sort(chance.integers(0, below, n))
        divisor, quotients, remainders = exact_dedup.encode_golomb(values, below)
        found = exact_dedup.decode_golomb(n, divisor, quotients, remainders)
        assert found.tolist() == values.tolist()
    values = np.sort(chance.integers(0, 1 << 30, 10_000))
    _, quotients, remainders = exact_dedup.encode_golomb(values, 1 << 30)
    entropy = math.log2((1 << 30) / 10_000) + math.log2(math.e)
    assert 8 * (len(quotients) + len(remainders)) < 10_000 * (entropy + 0.2)


def test_differing_texts_of_one_hash_fail(spark, monkeypatch):
    rows = [(1, "one"), (2, "two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    sent = exact_dedup._send(docs, exact_dedup.Exchange.of(2, 1))
    schema, collected = sent.schema, [
        row.asDict() | ({"sha": b"\1" * 32} if row["sha"] else {}) for row in sent.collect()
    ]
    # make both rows members of one class
    for row in collected:
        if row["text"] is not None:
            row["class"] = 0
        if row["twice"] is not None:
            row["order"], row["twice"] = [0] * len(row["order"]), [True] * len(row["twice"])
    forged = spark.createDataFrame(collected, schema)
    monkeypatch.setattr(exact_dedup, "_send", lambda *_: forged)
    with pytest.raises(Exception, match="different texts share"):
        exact_dedup.exact_groups(docs).collect()


# importance resampling


def plain_features(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_resample(rows, target, percent, least):
    def counts(texts):
        held = [0] * 10_000
        for text in texts:
            for feature in plain_features(text)[1]:
                held[zlib.crc32(feature.encode()) % 10_000] += 1
        return held

    s, t = counts(text for _, text in rows), counts(target)
    total_s, total_t = sum(s), sum(t)
    gain = [
        math.floor(1000 * math.log((b + 1) * (total_s + 10_000) / ((a + 1) * (total_t + 10_000))))
        for a, b in zip(s, t, strict=True)
    ]
    found, drawable = {}, []
    for doc_id, text in rows:
        words, features = plain_features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in features)
        weight = weight // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))
        found[doc_id] = [len(words), len(features), weight, score, None]
        if len(words) >= least:
            drawable.append((-score, doc_id))
    for rank, (_, doc_id) in enumerate(sorted(drawable)[: percent * len(drawable) // 100], 1):
        found[doc_id][4] = rank
    return found


def test_resample_equals_a_plain_version(spark):
    chance = np.random.default_rng(2)
    pool = ["Apple", "bear", "x1", "Über", "日本", "e\x00f", "a-b", "w" * 90, "é" * 40, "C", "z9", "don't"]
    rows = [
        (i, " ".join(chance.choice(pool[: 4 + i % 9], int(chance.integers(0, 60))))) for i in range(300)
    ]
    rows += [(500, None), (501, ""), (502, "lone"), (503, "word " * 50_000), (504, "Straße ÀÉ " * 30)]
    target = ["bear apple bear x1", None, "日本 über"] * 5
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string")).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string").withColumn("doc_id", F.lit("t"))
    got = importance.resample(docs, wanted, percent=30, least=10).collect()
    assert {r.doc_id: list(r)[1:] for r in got} == plain_resample(rows, target, 30, 10)


def test_resample_of_odd_documents(spark):
    docs = odd_documents(spark)
    target = docs.select("doc_id", "text")
    got = importance.resample(docs, target, percent=100, least=1).collect()
    assert len(got) == len(ODD)
    with_words = sum(bool(plain_features(text)[0]) for _, text, *_ in ODD)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, with_words + 1))
    assert {r.weight for r in got} == {0}
    assert importance.resample(no_documents(spark), target).isEmpty()
    nothing = importance.resample(docs, no_documents(spark)).collect()
    assert len(nothing) == len(ODD)


def test_crc_of_pairs_comes_from_words():
    words = importance.Words()
    text = "a bb  ccc-" + "d" * 200 + " " + "é" * 33 + " e"
    n, found = words.buckets(text)
    features = plain_features(text)[1]
    assert n == 6
    assert found.tolist() == [zlib.crc32(f.encode()) % 10_000 for f in features]


# fill in middle


def plain_infill(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def checked_infill(docs):
    made = infill.fill_in_middle(docs)
    return made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()


def test_infill_equals_a_plain_version(spark):
    chance = np.random.default_rng(8)
    pool = list("aZ9 \n\t.<>PSM'") + ["é", "日", "\U0001f389", "\x00", "word", "\r\n", "<S", "<P>", "\xff"]
    rows = [(i, "".join(chance.choice(pool, int(chance.integers(0, 40))))) for i in range(400)]
    rows += [(900 + i, "<S<P<M" * i + "P>S>M>" * i) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = checked_infill(with_clashes(docs))
    texts = dict(rows)
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_infill(
            r.doc_id, texts[r.doc_id]
        )
        assert r.back == texts[r.doc_id]


def test_infill_of_odd_documents(spark):
    got = checked_infill(odd_documents(spark))
    found = sorted(((r.doc_id, r.back, r.n, r.form) for r in got), key=str)
    expected = [(d, t or "", *plain_infill(d, t or "")[:2]) for d, t, *_ in ODD]
    assert found == sorted(expected, key=str)
    assert infill.fill_in_middle(no_documents(spark)).isEmpty()


def test_blocks_hold_whole_rows():
    texts = pa.array([b"a" * n for n in (10, 3 << 20, 5, 1 << 20, 1 << 20, 7)], pa.binary())
    cut = list(infill.blocks(texts))
    assert [(c.start, c.stop) for c in cut] == [(0, 1), (1, 2), (2, 4), (4, 6)]
    assert list(infill.blocks(pa.array([], pa.binary()))) == []
