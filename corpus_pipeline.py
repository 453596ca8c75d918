"""The corpus pipeline: stages over documents, each written as Parquet and read again.

A stage is ``function(spark, docs, sf_dir)``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import jaccard_join, mixing, quality_classifier, sentencepieces, toxicity
from barloom.llm.common import documents
from barloom.session import materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.train(docs, _labels(spark, sf_dir))
    scored = quality_classifier.score_quality(docs, model, keep_text=True)
    return scored.where("predicted = 1").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a toxic sentence, as far as the model can tell."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    scored = toxicity.score_toxicity(docs, model, keep_text=True)
    return scored.where("predicted = 0").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word runs, Jaccard 0.8), the document with the lowest doc_id.

    Rows that repeat a doc_id stay or go together; a row without doc_id stays unless it belongs to
    a group with one.
    """
    grouped = jaccard_join.linked_components(docs)
    kept = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows that repeat a doc_id are taken alike, as often as the luckiest of them.
    """
    mix = mixing.pareto_mix(docs, rounds=mixing.ROUNDS).where("copies > 0")
    mix = mix.groupBy(F.col("doc_id").alias("__id")).agg(F.max("copies").alias("__copies"))
    taken = docs.join(mix, F.col("doc_id").eqNullSafe(F.col("__id")))
    repeats = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    return taken.select(*docs.columns, repeats).drop("__copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the piece ids of every text."""
    rows = sentencepieces.encode_texts(docs.select("doc_id", "lang", "source", "text"))
    return rows.withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", keep_good_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]
# Trained models and best paths are not SQL; each operator has plain versions in its own tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
