"""Threshold-scaled sketches of documents.

A sketch retains every hash of a text's five-word shingles that lies below a fixed fraction of the range. The choice
depends on the hash alone, so sketches of parts merge by union, and the share of one sketch found in another estimates
containment however unequal the documents are. A text whose shingles all lie above the fraction retains its least hash,
marked as such: it says whether two such texts are alike, and is dropped when a merge brings a hash below the fraction.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import text_of, width
from sparkassay.llm.words import run_hashes, word_hashes

SHINGLE = 5
#: The retained fraction of hashes is one in so many.
SCALE = 4


def sketch(text: str, shingle: int = SHINGLE, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct retained hashes; none for a text without words. Fewer words than a shingle are one shingle."""
    words = word_hashes(text.encode())
    if not len(words):
        return words
    h = np.unique(run_hashes(words, min(shingle, len(words))))
    below = h[: np.searchsorted(h, np.uint64((1 << 64) // scale))]
    return below if len(below) else h[:1]


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the two documents' shingles together."""
    h = np.union1d(a, b)
    below = h[: np.searchsorted(h, np.uint64((1 << 64) // scale))]
    return below if len(below) else h[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b holds; 1 if a has none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of both that each has; 1 if neither has any."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def as_text(sketched: np.ndarray) -> str:
    """A sketch as a string: Base64 of its hashes, each as eight bytes, most significant first."""
    return base64.b64encode(sketched.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def sketches(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``doc_id, fingerprint`` for each row; null and empty texts have an empty one. One pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([as_text(sketch(x.as_py(), shingle, scale)) for x in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"], text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edited(text: str, other: str) -> str:
    """``text`` with its last half (rounded down) replaced by as much of the start of ``other``."""
    n = len(text) // 2
    return text[: len(text) - n] + other[:n]


def _cuts(docs: DataFrame, parts: int) -> list[float]:
    """At most ``parts - 1`` ids that cut the table into ranges of about the same size."""
    found = docs.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted(set(found))


def _part(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """Adds ``part``, the range that the id is in, found by binary search: 0 has the largest ids, the last one also rows without an id."""
    if not cuts:
        return rows.withColumn("part", F.lit(0))
    # Ids beyond 2**53 meet in doubles, so the same id is never in two ranges.
    bins = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_at", outputCol="_bin", handleInvalid="keep")
    found = bins.transform(rows.withColumn("_at", F.coalesce(F.col("id").cast("double"), F.lit(-math.inf))))
    return found.withColumn("part", (F.lit(len(cuts)) - F.col("_bin")).cast("int")).drop("_at", "_bin")


def compare_edited(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Sketches of each text and of its edited text, which ends in the start of the next document (by descending id; after the last, the first).

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_by_edited`` (the last:
    the estimated share of the text's shingles that the edited text holds). Rows are dealt into
    ranges of ids and streamed in order; each range also gets the first row of the next one, so no row needs the whole
    order. Ids are numbers. Null ids come last, repeated ids in the order of their texts; a single row is its own next. Null texts are empty.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    parts = width(spark)
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    cuts = _cuts(docs, parts)
    rows = _part(rows, cuts)
    firsts = {r["part"]: r["id"] for r in rows.groupBy("part").agg(F.max("id").alias("id")).collect()}  # one small row a part
    order = sorted(firsts)
    # The first rows of each part go to the part before it as well (the very first to the last).
    before = {p: order[i - 1] for i, p in enumerate(order)}
    halo = rows.join(F.broadcast(spark.createDataFrame([(p, firsts[p], before[p]) for p in order], "part int, first long, target int")), "part").filter("id <=> first")
    # Of rows with the same first id only the least text is the next.
    halo = halo.groupBy("target").agg(F.min("text").alias("text")).select(F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("id"), "text", F.col("target").alias("part"), F.lit(True).alias("halo"))
    dealt = rows.withColumn("halo", F.lit(False)).unionByName(halo).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "halo", F.col("id").desc_nulls_last(), "text").select("part", "halo", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "held_by_edited"]
        waits: list[tuple] = []  # the row whose next isn't known yet

        def finish(row: tuple, text: str, mine: np.ndarray) -> tuple:
            key, own, own_sketch = row
            changed = edited(own, text)
            other = sketch(changed, shingle, scale)
            return key, len(own), hashlib.sha256(changed.encode()).hexdigest(), as_text(own_sketch), as_text(other), resemblance(own_sketch, other), resemblance(own_sketch, mine), containment(own_sketch, other)

        for batch in batches:
            out = []
            for halo_row, key, x in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                text = x.as_py()
                mine = sketch(text, shingle, scale)
                if waits:
                    out.append(finish(waits.pop(), text, mine))
                if not halo_row.as_py():
                    waits.append((key, text, mine))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array([k.as_py() for k in cols[0]], batch.column(2).type), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], names=names)

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_by_edited double")
