"""A training-corpus pipeline: drop poor documents, keep one of each group of near-duplicates, cut repeated passages, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.llm import packing, quality, repeats, similar
from sparkassay.llm.common import Scratch, read
from sparkassay.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones, doesn't reject; texts are unchanged."""
    machine = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs.select(*COLUMNS), machine, keep=COLUMNS[1:]).filter("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id."""
    return similar.keep_one(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents that had words and lost all of them go."""
    cut = repeats.remove(docs.select(*COLUMNS), keep=("lang", "source", "n_chars"))
    left = cut.filter("n_words = 0 or n_removed < n_words")
    return left.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality classifier", good_quality), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]

#: Fitting, fingerprints and tokens can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
