"""A corpus pipeline of five stages over the documents table: toxicity, near-duplicates, repeated passages, source mix, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all that the stage before it kept; ``run`` writes every
stage's result to the shared scratch folder and reads it again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlens.llm import jaccard_join, mixing, packing, repeats, toxicity
from strandlens.llm.catalog import tokenizer_path
from strandlens.llm.frames import stage


PASSAGE = 51  # words of a repeated passage that goes, at least


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar, fitted on labelled documents, scores below its threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones (five words, 0.8): the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 51 words or more, or of 400 bytes or more, that occur twice or more."""
    return repeats.remove(docs, passage=PASSAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths: a row per piece, see ``packing.pack``."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

# Learned scores and byte-pair tokens have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
