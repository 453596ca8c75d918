"""Quality classifier, toxicity and quality rules."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import quality_classifier, quality_rules, toxicity
from barloom.llm.labels import Rows, labelled_sample
from barloom.llm.queries import QUERIES
from tests.llm.cases import ODD, by_id, no_documents, odd_documents

FOLDER = "/root/testdata/sf0.01"


def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def odd_labels(spark):
    rows = [(d, i % 2, i % 2) for i, (d, *_) in enumerate(ODD)] + [(None, 1, 0), (77, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(
    ("module", "score"),
    [(quality_classifier, "score_quality"), (toxicity, "score_toxicity")],
)
def test_scores_of_odd_documents(spark, module, score):
    for labels in (no_labels(spark), odd_labels(spark)):
        model = module.train(odd_documents(spark), labels)
        rows = getattr(module, score)(odd_documents(spark), model)
        assert rows.columns.count("score") == 1 and "text" not in rows.columns
        found = rows.collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
        assert all(r.predicted == (r.score >= module.THRESHOLD) for r in found)
        assert len({r.score for r in found if r.doc_id in (9, 10)}) == 1
        kept = getattr(module, score)(odd_documents(spark), model, keep_text=True)
        assert kept.where("text IS NOT NULL").count() == sum(t is not None for _, t, _, _ in ODD)
        assert getattr(module, score)(no_documents(spark), model).isEmpty()
    assert module.train(no_documents(spark), odd_labels(spark))


def held_out(spark, name, label):
    scored = QUERIES[name](spark, FOLDER).where("held_out").select("doc_id", "score", "predicted")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col(label).alias("label"))
    return scored.join(labels, "doc_id").toPandas()


def test_quality_on_held_out_documents(spark):
    rows = held_out(spark, "op8_quality_nbsvm", "quality")
    assert (rows.predicted == rows.label).mean() >= 0.93


def test_toxicity_on_held_out_documents(spark):
    rows = held_out(spark, "op9_toxicity_mil", "toxic")
    assert (rows.predicted == rows.label).mean() >= 0.93
    assert rows[rows.label == 0].predicted.mean() <= 0.02


def test_dual_coordinate_descent_separates():
    chance = np.random.default_rng(0)
    rows = [np.unique(chance.integers(0, 50, 20) + 50 * (i % 2)) for i in range(60)]
    signs = np.array([1 if i % 2 else -1 for i in range(60)])
    held, everyone = Rows.of(rows), np.arange(60)
    ratio = quality_classifier.log_count_ratio(held, everyone, signs, bits=7)
    weights, bias = quality_classifier.dual_coordinate_descent(held, everyone, signs, ratio)
    margins = np.array([weights[row] @ ratio[row] + bias for row in rows])
    assert (np.sign(margins) == signs).all()


def test_log_count_ratio_and_dual_optimum_against_plain_versions():
    chance = np.random.default_rng(4)
    rows = [np.unique(chance.integers(0, 30, 12)) for _ in range(40)]
    signs = np.where(chance.random(40) < 0.4, 1, -1)
    held, chosen = Rows.of(rows), np.arange(3, 40)
    ratio = quality_classifier.log_count_ratio(held, chosen, signs, bits=5)
    counts = {1: [1] * 32, -1: [1] * 32}
    for i in chosen:
        for feature in rows[i]:
            counts[signs[i]][feature] += 1
    for j in range(32):
        plain = math.log(counts[1][j] / sum(counts[1])) - math.log(counts[-1][j] / sum(counts[-1]))
        assert ratio[j] == pytest.approx(plain)
    weights, bias = quality_classifier.dual_coordinate_descent(held, chosen, signs, ratio, rounds=400)
    # a plain solver of the same dual: projected gradient on a dense matrix
    x = np.zeros((len(chosen), 33))
    for k, i in enumerate(chosen):
        x[k, rows[i]] = ratio[rows[i]] / np.sqrt((ratio[rows[i]] ** 2).sum())
    x[:, 32] = 1.0
    y = signs[chosen]
    upper = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == -1).sum()))
    gram = (x @ x.T) * np.outer(y, y)
    alpha, pace = np.zeros(len(y)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha - pace * (gram @ alpha - 1), 0, upper)
    plain = (alpha * y) @ x

    def primal(w):
        return 0.5 * w @ w + (upper * np.maximum(1 - y * (x @ w), 0)).sum()

    ours = np.append(weights, bias)
    assert primal(ours) == pytest.approx(primal(plain), rel=1e-3)
    assert primal(ours) == pytest.approx(alpha.sum() - 0.5 * alpha @ gram @ alpha, rel=2e-3)
    assert ours == pytest.approx(plain, abs=2e-2)


def test_noisy_or_and_its_gradient_against_plain_versions():
    texts = [("bad one. good two three.", 1), ("good two. fine. bad fine.", 0), ("fine bad bad!", 1), ("", 0)]
    sample = toxicity.Sample.of(texts)
    number = np.full(1 << toxicity.BITS, -1, np.int32)
    used = np.unique(np.concatenate([sample.features[i] for i in range(4)]))
    number[used] = np.arange(len(used))
    theta = np.append(np.random.default_rng(1).random(len(used)), -2.0)

    def plain_loss(theta):
        total = 0.0
        for text, label in texts:
            clean = 1.0
            for start, end in toxicity.sentences(text):
                margin = theta[-1]
                for word in dict.fromkeys(text[start:end].split()):
                    own = toxicity.Bags.of([word]).features
                    margin += sum(theta[number[f]] for f in own)
                none = 1 / (1 + math.exp(-theta[-1]))
                clean *= 1 - (1 / (1 + math.exp(-margin)) - none) / (1 - none)
            whole = 1 - clean
            whole = toxicity.UNEXPLAINED + (1 - toxicity.UNEXPLAINED) * whole
            total -= math.log(whole if label else 1 - whole)
        return total

    for size in (1, 5, 1 << 19):
        found = [toxicity.loss_slopes(block, theta) for block in toxicity._blocks(sample, number, size)]
        assert sum(loss for loss, _ in found) == pytest.approx(plain_loss(theta))
        slopes = sum(slope for _, slope in found)
        for j in range(len(theta)):
            step = np.zeros(len(theta))
            step[j] = 1e-5
            numeric = (plain_loss(theta + step) - plain_loss(theta - step)) / 2e-5
            assert slopes[j] == pytest.approx(numeric, abs=1e-5)


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"),
        F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" x" * 40)).alias("text"),
    )
    rows = [(i, i % 2, i % 2) for i in range(3000)] + [(7, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    sample = labelled_sample(docs, labels, "quality", F.lit(True), 2500)
    found = sample.collect()
    # of the hot doc_id one text, under both of its labels where both are chosen
    hot = [r for r in found if int(r.text.split()[1]) % 3 == 0]
    assert len(hot) <= 2 and len(found) > 1500
    few = labelled_sample(docs, labels, "quality", F.lit(True), 2500, most_bytes=9_000).collect()
    assert 60 <= len(few) and sum(len(t) for t in {r.text for r in few}) <= 9_000
    assert sorted(few) == sorted(
        labelled_sample(docs.repartition(5), labels, "quality", F.lit(True), 2500, 9_000).collect()
    )
    assert len(labelled_sample(docs, labels, "toxic", F.lit(True), 100).collect()) <= 100


def labelled(clean, toxic):
    return toxicity.Sample.of([(t, 0) for t in clean] + [(t, 1) for t in toxic])


def test_offending_sentences_are_found():
    clean = [f"The river is wide. You are a friend {i}. Boats go by." for i in range(30)]
    toxic = [f"The river is wide. You are a moron {i}. Boats go by." for i in range(30)]
    model = toxicity.fit(labelled(clean, toxic))
    text = "Boats go by. The moron sleeps. The river bends."
    spans = toxicity.sentences(text)
    scores = model.sentence_scores(toxicity.Bags.of([text], [spans]))
    start, end = spans[int(np.argmax(scores))]
    assert text[start:end].strip() == "The moron sleeps." and scores.max() > 0.5


def test_neutral_sentences_do_not_add_up():
    clean = [f"The river is wide. You are a friend {i}. Boats go by." for i in range(30)]
    toxic = [f"The river is wide. You are a moron {i}. Boats go by." for i in range(30)]
    model = toxicity.fit(labelled(clean, toxic))
    long = "The river is wide. Boats go by. " * 25_000
    bags = toxicity.Bags.of([long, long + "The moron sleeps."])
    assert bags.sentences.tolist() == [50_000, 50_001]
    scores = toxicity.noisy_or(bags, model.sentence_scores(bags))
    assert scores[0] < 0.01 and scores[1] >= toxicity.THRESHOLD


def test_clean_texts_stay_clean_when_joined(spark):
    """10,000 and 50,000 sentences of documents judged clean one by one, of the held-out fold."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert 0 < model.floor <= toxicity.SENTENCE_THRESHOLD
    scored = toxicity.score_toxicity(docs, model, keep_text=True).where("held_out AND predicted = 0")
    clean = scored.join(labels.where("toxic = 0").select("doc_id"), "doc_id").toPandas()
    texts = [text for text in clean["text"] if text]
    for least in (10_000, 50_000):
        joined, n = [], 0
        while n < least:
            for text in texts:
                joined.append(text)
                n += len(toxicity.sentences(text))
        bags = toxicity.Bags.of(["\n".join(joined)])
        score = toxicity.noisy_or(bags, model.sentence_scores(bags), model.floor)
        assert bags.sentences[0] >= least and score[0] < toxicity.THRESHOLD


def test_sentences_cover_all_words():
    text = "one two. three\n\nfour" + " five" * 100
    spans = toxicity.sentences(text)
    assert [w for a, b in spans for w in text[a:b].split()] == text.split()
    assert max(len(text[a:b].split()) for a, b in spans) <= toxicity.LONGEST
    assert toxicity.sentences("  \n. !") == [(0, 4), (4, 6)] or toxicity.sentences(None) == []


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_ledger(spark):
    more = [
        (20, "a b c a b c a b c x", "en", "a"),
        (21, "|||| ## a\nb\nb\n \nb", "en", "a"),
        (22, "a a a a", "en", "a"),
        (23, "a b a b a b", "en", "a"),
    ]
    docs = odd_documents(spark).select("doc_id", "text").union(
        spark.createDataFrame([(d, t) for d, t, _, _ in more], "doc_id bigint, text string")
    )
    rows = by_id(quality_rules.apply_policy(quality_rules.ledger(docs)))
    for doc_id, text, _, _ in [*ODD, *more]:
        if doc_id in rows:
            r = rows[doc_id]
            found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert found == measured(text), doc_id
            base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == base and not (base and r.kept)
    assert quality_rules.ledger(no_documents(spark)).isEmpty()
    assert quality_rules.ledger(odd_documents(spark)).count() == len(ODD)


def test_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (32,), (33,)], "failures int")
    found = {r.rule: (r.failed, r.failed_alone) for r in quality_rules.ablation(rows, "v1").collect()}
    assert found["few_words"] == (4, 2) and found["symbols"] == (2, 1)
    assert found["repeated_words"] == (1, 0) and found["capitals"] == (0, 0)


def test_the_driver_fits_nothing(spark, monkeypatch):
    """Texts, features and the fit stay in a task; the driver gets the model."""
    rows = [(d, f"{'you fool' if d % 2 else 'a plain line'} number {d}.") for d in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS quality", "CAST(doc_id % 2 AS int) AS toxic")

    def refuse(*args, **options):
        raise AssertionError("the driver must not do this")

    for module, seen in ((quality_classifier, ("features", "fit")), (toxicity, ("Sample", "fit"))):
        with monkeypatch.context() as patched:
            for name in seen:
                patched.setattr(module, name, refuse)
            model = module.train(docs, labels)
        assert isinstance(model, module.Model)
