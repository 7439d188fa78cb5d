"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.llm import backoff, licences, neighbours, packing, quality, repeats, simhash, sketch, tokens, warc
from sparkassay.llm.common import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, laid out as a tree of files; the columns of ``licences.scan``. Null texts have none."""
    return licences.scan(licences.as_files(read(spark, sf_dir, "documents")), "doc_id")


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edited texts; the columns of ``sketch.compare_edited``."""
    return sketch.compare_edited(read(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; the columns of ``simhash.near_duplicates``."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and class of every document by a machine that learns from labelled rows not held out; the columns of ``quality.classify``."""
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def op5_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens; the columns of ``packing.pack_documents``."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), TOKENIZER)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an archive of all pages gives back; the columns of ``warc.resolve_read``."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the n-grams of all others; the columns of ``backoff.scores``."""
    return backoff.scores(read(spark, sf_dir, "documents"))


def op8_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector among all; the columns of ``neighbours.search``."""
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of those kept; the columns of ``repeats.digests``."""
    return repeats.digests(repeats.remove(read(spark, sf_dir, "documents")))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to; the columns of ``tokens.round_trip``."""
    return tokens.round_trip(read(spark, sf_dir, "documents"), TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_scaled_sketch,
        op3_simhash_near_dedup,
        op4_factorisation_machine,
        op5_min_slack_packing,
        op6_warc_revisits,
        op7_stupid_backoff,
        op8_adaptive_scan,
        op9_repeated_phrases,
        op10_bpe_round_trip,
    )
}

SQL: dict[str, str] = {
    "op1_license_scan": licences.sql(),
    "op6_warc_revisits": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        o AS (SELECT payload_digest, payload_bytes, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
        FROM p LEFT JOIN o USING (payload_digest, payload_bytes)""",
}
