"""Shards, fingerprints and mixing."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import fingerprints, mixing, sharding
from tests.llm.cases import LONG, ODD, by_id, no_documents, odd_documents


def test_shards(spark):
    rows = sharding.shard_by_bytes(odd_documents(spark), 4).collect()
    assert len(rows) == len(ODD)
    found = by_id(sharding.shard_by_bytes(odd_documents(spark), 4))
    assert (found[2].size, found[2].text_crc32) == (1, 0)
    assert found[5].text_crc32 == zlib.crc32(LONG.encode())
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known) and ordered[0].doc_id is None
    for shard in {r.shard for r in rows}:
        assert [r.slot for r in ordered if r.shard == shard] == list(
            range(sum(r.shard == shard for r in rows))
        )
    assert sharding.shard_by_bytes(no_documents(spark), 4).isEmpty()


def test_even_shards(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text")
    )
    sizes = sharding.shard_by_bytes(docs, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(sizes) == 8 and max(r.n for r in sizes) - min(r.n for r in sizes) <= 100


def test_one_id_on_most_rows_is_split(spark):
    docs = spark.range(2000).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.col("id").cast("string").alias("text"),
    )
    from barloom.llm.common import with_order_bucket

    dealt = with_order_bucket(docs.withColumn("t", F.xxhash64("text")), "doc_id", "t", "b")
    largest = dealt.groupBy("b").count().agg(F.max("count")).first()[0]
    assert largest < 200
    rows = sharding.shard_by_bytes(docs, 8).orderBy("shard", "slot").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_edited_texts(spark):
    rows = by_id(fingerprints.edit_likeness(odd_documents(spark)))
    texts = {d: t or "" for d, t, _, _ in ODD if d is not None}
    order = sorted((d for d, *_ in ODD if d is not None), reverse=True)
    for doc_id in (12, 8, 7, 6, 5, 4, 3, 2):
        text = texts[doc_id]
        following = texts[order[order.index(doc_id) + 1]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert rows[doc_id].n_chars == len(text)
        assert rows[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[2].fingerprint == rows[3].fingerprint == rows[4].fingerprint == ""
    assert rows[7].near_next > 0.9 > rows[6].near_next
    everyone = fingerprints.edit_likeness(odd_documents(spark)).collect()
    assert len(everyone) == len(ODD)
    same = {r.fingerprint for r in everyone if r.doc_id in (9, 10)}
    assert len(same) == 1
    assert fingerprints.edit_likeness(no_documents(spark)).isEmpty()


def test_sketches_merge(spark):
    left = " ".join(f"a{i}" for i in range(400))
    right = " ".join(f"b{i}" for i in range(30))
    rows = spark.createDataFrame([(left, right)], "left string, right string")
    one, other = fingerprints.sketch(F.col("left")), fingerprints.sketch(F.col("right"))
    row = rows.select(
        one.alias("l"),
        other.alias("r"),
        fingerprints.merge(one, other).alias("both"),
        fingerprints.containment(other, fingerprints.merge(one, other)).alias("inside"),
    ).first()
    limit = -(1 << 63) + (1 << 64) // fingerprints.SCALE
    kept = {h for h in row.l + row.r if h < limit} | {min(row.l + row.r)}
    assert set(row.both) == kept and row.both == sorted(row.both)
    assert 20 < len(row.l) < 90


def test_mix(spark):
    rows = mixing.pareto_mix(odd_documents(spark)).collect()
    assert len(rows) == len(ODD)
    sizes = {}
    for _, text, _, source in ODD:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert {r.source: r.source_size for r in rows} == sizes
    assert all(r.copies in (0, 1, 2) and r.taken == r.copies * r.size for r in rows)
    assert all(r.target <= 2 * r.source_size for r in rows)
    again = mixing.pareto_mix(odd_documents(spark).repartition(5)).collect()
    key = lambda r: (r.doc_id or 0, r.size, r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.pareto_mix(no_documents(spark)).isEmpty()


@pytest.mark.parametrize("weights", [(3, 1, 2), (1, 1, 50)])
def test_mix_meets_targets(spark, weights):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (1 + F.col("id") % 37).cast("int")).alias("text"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("source"),
    )
    rows = mixing.pareto_mix(docs, weights)
    per_source = rows.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")
    ).collect()
    assert sum(r.target for r in per_source) == pytest.approx(1.5 * sum(r.size for r in per_source))
    assert all(abs(r.taken - r.target) <= 37 for r in per_source)


def test_mix_goes_on_past_a_long_text(spark):
    """One text of a third of its source, early in rank, and a plain fill to compare with."""
    ranked = sorted(range(630), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:12])
    for long_id in (ranked[0], ranked[40], ranked[90]):
        size = F.when(F.col("id") == long_id, 6000).otherwise(1 + F.col("id") % 37).cast("int")
        docs = spark.range(640).select(
            F.col("id").alias("doc_id"),
            F.repeat(F.lit("w "), size).alias("text"),
            F.when(F.col("id") < 630, "big").otherwise("small").alias("source"),
        )
        rows = mixing.pareto_mix(docs, (1, 5), 0.2, rounds=mixing.ROUNDS).withColumn(
            "u", mixing.uniform(F.col("doc_id"))
        ).collect()
        big = sorted((r for r in rows if r.source == "big"), key=lambda r: r.u)
        left, taken = big[0].target, set()
        for r in big:
            if r.size <= left:
                left -= r.size
                taken.add(r.doc_id)
        found = {r.doc_id for r in big if r.copies}
        assert taken <= found and len(found - taken) <= 1
        assert abs(sum(r.taken for r in big) - big[0].target) <= 37


def test_the_end_of_a_sample_takes_no_join_of_its_own(spark):
    """Where a sample ends and what fits before it are one aggregate: fewer jobs and broadcasts a round."""
    rows = [(i, "w " * (1 + i * 7919 % 97), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    context = spark.sparkContext
    context.setJobGroup("mix", "mix")
    mix = mixing.pareto_mix(docs, rounds=mixing.ROUNDS).collect()
    jobs = len(context.statusTracker().getJobIdsForGroup("mix"))
    context.setLocalProperty("spark.jobGroup.id", None)
    taken = {s: (sum(r.taken for r in mix if r.source == s), max(r.target for r in mix if r.source == s)) for s in "abc"}
    assert all(abs(got - target) < 100 for got, target in taken.values()), taken
    assert jobs <= 37, jobs
