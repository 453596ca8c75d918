"""The Jaccard join against all pairs."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from barloom.llm import jaccard_join
from tests.llm.cases import ODD, by_id, no_documents, odd_documents


def plain_sets(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def plain_components(texts, n, percent):
    sets = {d: plain_sets(t, n) for d, t in texts.items()}
    lowest = {d: d for d in texts}

    def find(d):
        while lowest[d] != d:
            d = lowest[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                lowest[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}


def copies(seed):
    """Groups of near copies at all likenesses, chains, shared passages, short texts."""
    chance = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = {}
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(chance.choice((5, 9, 20, 60, 150)))]
        for _ in range(chance.randint(1, 14)):
            words = list(base)
            for _ in range(chance.randint(0, max(1, len(base) // 12))):
                words[chance.randrange(len(words))] = f"e{chance.randrange(50)}"
            if chance.random() < 0.3:
                words += passage.split()
            texts[len(texts)] = " ".join(words)
            if chance.random() < 0.3:
                base = words
    return texts


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_components(spark, seed, n, percent):
    texts = copies(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    found = jaccard_join.linked_components(docs, n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(
        texts, n, percent
    )


def test_odd_documents(spark):
    rows = jaccard_join.linked_components(odd_documents(spark), 4, 85)
    everyone = rows.collect()
    assert len(everyone) == len(ODD)
    found = by_id(rows)
    assert [found[d].n_shingles for d in (2, 3, 4)] == [0, 0, 0]
    assert [found[d].component_id for d in (2, 3, 4)] == [2, 3, 4]
    assert [found[d].component_id for d in (6, 7, 8)] == [6, 6, 6]
    assert {r.component_id for r in everyone if r.doc_id in (9, 10)} == {9}
    assert found[5].n_shingles == 4 and found[12].n_shingles == 1
    assert jaccard_join.linked_components(no_documents(spark), 4, 85).isEmpty()


def test_bins_never_exceed_the_difference():
    chance = np.random.default_rng(5)
    for width in (20, 40):
        for _ in range(30):
            pool = chance.integers(0, 1 << width, 400)
            a, b = (np.unique(chance.choice(pool, 200)) for _ in range(2))
            for bins in (jaccard_join.COARSE_BINS, jaccard_join.FINE_BINS):
                one, other = (np.array(jaccard_join.bins_of(s, width, bins, 127)) for s in (a, b))
                assert len(one) == bins and one.sum() == len(a)
                assert np.abs(one - other).sum() <= len(np.setxor1d(a, b))
            one, other = (np.array(jaccard_join.parities_of(s, width)) for s in (a, b))
            bits = sum(int(x).bit_count() for x in (one ^ other).view(np.uint64))
            assert len(one) == 64 and bits <= len(np.setxor1d(a, b))


def test_prefix_length():
    sizes = np.array([1, 2, 20, 100, 101])
    assert jaccard_join.prefix_length(sizes, 85).tolist() == [1, 1, 4, 16, 16]


@pytest.mark.parametrize("items", [1 << 21, 40, 1])
def test_lone_items_and_pivots_against_plain_counts(spark, monkeypatch, items):
    monkeypatch.setattr(jaccard_join, "SENDER_ITEMS", items)
    texts = copies(7)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    nodes, points = jaccard_join.nodes_of(docs, 4, 85)
    assert sorted(d for r in nodes.collect() for d in r.ids) == sorted(texts)
    sets = {d: plain_sets(t, 4) for d, t in texts.items()}
    held = Counter(s for own in set(sets.values()) for s in own)
    copied = Counter(sets.values())
    placed = {r.first: r for r in points.collect()}
    for doc_id, own in sets.items():
        lone = sum(held[s] == 1 for s in own)
        row = placed.get(doc_id)
        if row is not None:
            assert row.size == len(own)
            # copies in other senders and chance collisions only make an item look shared
            assert row.lone <= lone
        elif copied[own] == 1:
            assert lone > len(own) - -(-85 * len(own) // 100)


@pytest.mark.parametrize("edits", [9, 14])
def test_a_large_group_near_the_threshold(spark, edits):
    """500 copies of one text, each edited in places of its own, around a similarity of 0.85."""
    chance = random.Random(edits)
    base = [f"b{i}" for i in range(240)]
    texts = {}
    for k in range(500):
        words = list(base)
        for place in chance.sample(range(240), chance.randint(1, edits)):
            words[place] = f"e{k}x{place}" if k % 3 else f"e{place}"
        texts[k] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    found = jaccard_join.linked_components(docs, 4, 85).collect()
    plain = plain_components(texts, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain


def test_a_dense_group_of_links_is_read_once(spark, monkeypatch):
    """Links of a clique whose smallest node hangs on a long chain are not joined anew in every round."""
    clique = [(a, b) for a in range(100, 140) for b in range(a + 1, 140)]
    chain = [90, 100, 50, 95, 20, 60, 10, 99, 5, 80, 7, 70, 3]
    edges = spark.createDataFrame(clique + list(itertools.pairwise(chain)) + [(200, 201), (201, 202)], "a long, b long")
    joined, join = [], type(edges).join

    def counted(self, other, *args, **options):
        joined.append(self.count())
        return join(self, other, *args, **options)

    monkeypatch.setattr(type(edges), "join", counted)
    found = {r.node: r.root for r in jaccard_join.components(edges).collect()}
    assert found == {**{n: 3 for n in [*range(100, 140), *chain]}, 200: 200, 201: 200, 202: 200}
    assert sum(joined) < 3 * len(clique)


def test_further_links_join_components(spark):
    links, rest = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (11, 30), (40, 41), (41, 45)]
    frames = [spark.createDataFrame(rows, "a long, b long") for rows in (links, rest)]
    roots = jaccard_join.components(frames[0])
    found = {r.node: r.root for r in jaccard_join.extended(roots, frames[1]).collect()}
    assert found == {r.node: r.root for r in jaccard_join.components(frames[0].union(frames[1])).collect()}
    assert jaccard_join.extended(roots, frames[1].where("false")) is roots


def test_without_pairs_no_text_is_read_again(spark, monkeypatch):
    """Sets that share words but no region's centre, or all in one component, need no second pass over the texts."""
    calls, read = [], jaccard_join.sets_of
    monkeypatch.setattr(jaccard_join, "sets_of", lambda *args: calls.append(1) or read(*args))
    apart = [(k, " ".join(f"d{k}w{i}" for i in range(30))) for k in range(20)]
    docs = spark.createDataFrame(apart, "doc_id bigint, text string")
    assert {r.component_id for r in jaccard_join.linked_components(docs, 4, 85).collect()} == set(range(20))
    assert not calls
    copies = [(100 + k, " ".join(f"w{i}" for i in range(40 + k))) for k in range(2)]
    docs = spark.createDataFrame(apart + copies, "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.linked_components(docs, 4, 85).collect()}
    assert found[101] == found[100] == 100 and len(calls) == 1


def test_small_inputs_take_few_jobs(spark):
    """Small tables are known to be small before a join is planned, so that neither side is shuffled."""
    texts = [(10 * k + j, " ".join(f"d{k}w{i}" for i in range(40 + j))) for k in range(8) for j in range(3)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "few jobs")
    found = jaccard_join.linked_components(docs, 4, 85).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("few-jobs"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert all(r.component_id == r.doc_id // 10 * 10 for r in found)
    assert jobs <= 90, jobs


def test_linked_copies_take_fewer_jobs_and_broadcasts(spark):
    """Pairs carry the doc_ids of their sets and bins need no join of their own; nothing is planned for regions in one component."""
    texts = [(10 * k + j, " ".join(f"d{k}w{i}" for i in range(40 + j))) for k in range(8) for j in range(3)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    context = spark.sparkContext
    context.setJobGroup("linked-copies", "linked copies")
    found = jaccard_join.linked_components(docs, 4, 85).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("linked-copies"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert all(r.component_id == r.doc_id // 10 * 10 for r in found)
    assert jobs <= 56, jobs
