"""From raw documents to packed sequences: each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.llm import exact_dedup, packing, quality, similar, suffix_dedup
from lograft.llm.common import load, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model rejects. Null texts count as empty; repeated rows are judged alike."""
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, COLUMNS).where("predicted = 1").select(*COLUMNS)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id stays; rows that repeat it stay with it."""
    kept = exact_dedup.dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct()
    digest = F.sha2(exact_dedup.normalised(F.coalesce("text", F.lit(""))), 256)
    return docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left_semi")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 of their five-word shingles, the document with the smallest doc_id stays; so do documents without an id, and rows that share an id that stays."""
    found = similar.near_dedup(docs)
    first = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    gone = first.where("not first").select(F.col("doc_id").alias("_id"))
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("_id"), "left_anti")


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 200 bytes that repeat, and documents of which nothing is left; characters that lose a byte go whole."""
    found = suffix_dedup.dedup(docs, carry=("lang", "source"), texts=("kept_text",))
    found = found.where((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL can train the classifier, hash shingles or tokenise; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
