"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified, links are contracted.

Equal fingerprints are one class. Classes meet in buckets: of ``segments`` parts of a fingerprint, two that differ in at
most ``radius`` bits have at least ``segments - radius`` in common, so each combination of that many parts is a key and
no link is lost. A bucket with more than ``bucket`` classes isn't compared: its members go on to finer keys over the bits
the key has left open, again and again; with so few bits open, the last ones are small by construction. The pivot
distance table holds each class's Hamming distances to many reference fingerprints, taken once and kept with the class.
Distances to a pivot differ by no more than the distance of the two, so in a bucket a pair with any coordinate further
apart than ``radius`` is discarded; what is left is verified on the fingerprints. A bucket gives the edges of a spanning
forest only, never all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import Scratch, text_of, width
from sparkassay.llm.components import components

RADIUS = 3
SEGMENTS = 5
#: Classes that are compared with each other in one bucket.
BUCKET = 1024
PIVOTS = 24
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text: bit b is set if over half of its shingles' XXH64 (seed 42) have it."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only the six ASCII white spaces part words
    if not words:
        return 0
    runs = [b" ".join(words)] if len(words) < shingle else [b" ".join(x) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in runs), "<u8", len(runs))
    total, step = np.zeros(64, np.int64), 1 << 14
    for at in range(0, len(h), step):
        total += np.unpackbits(h[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((_BITS[2 * total > len(h)]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits). Null and empty texts have no words and the fingerprint zero."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"], text_of().alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, fixed by their number: hashes of it, each with its complement left out as it says the same."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", 7) for i in range(n)], np.uint64)


def _masks(open_bits: list[int], radius: int) -> list[int]:
    """Masks of the keys over ``open_bits``: all combinations of segments that two fingerprints at ``radius`` may share."""
    n = min(SEGMENTS if len(open_bits) == 64 else 2 * radius, len(open_bits))
    parts = [sum(1 << b for b in open_bits[i::n]) for i in range(n)]
    return [sum(x) for x in itertools.combinations(parts, n - radius)] if n > radius else []


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The pivot distance table: a row for each fingerprint, a byte for each reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.uint8)


def _table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with their row of the pivot distance table."""
    refs = pivots()
    for batch in batches:
        table = distances(batch.column(0).to_numpy().view(np.uint64), refs)
        yield pa.record_batch([batch.column(0), pa.array([row.tobytes() for row in table], pa.binary())], names=["fp", "pivots"])


def _local_edges(fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one bucket."""
    n = len(fps)
    table = table.astype(np.int8)
    root = np.arange(n)
    us, vs = [], []
    for i in range(n - 1):
        near = np.flatnonzero(np.abs(table[i + 1 :, 0] - table[i, 0]) <= radius) + i + 1
        for k in range(1, table.shape[1]):
            if not len(near):
                break
            near = near[np.abs(table[near, k] - table[i, k]) <= radius]
        for j in near[np.bitwise_count(fps[near] ^ fps[i]) <= radius] if len(near) else ():
            a, b = root[i], root[j]
            if a != b:
                root[root == max(a, b)] = min(a, b)
                us.append(i)
                vs.append(int(j))
    return us, vs


def _compare(radius: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``mask, key, fp, pivots`` sorted by mask and key: links of the buckets that fit, members of those that don't."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key, size, over = None, 0, False
        out: list[tuple[np.ndarray, np.ndarray, int, np.ndarray | None]] = []

        def flush():
            nonlocal held, size
            if held:
                fps, table = (np.concatenate(x) for x in zip(*held, strict=True))
                if over:
                    out.append((fps, fps, key[0], table))
                elif len(fps) > 1:
                    u, v = _local_edges(fps, table, radius)
                    out.append((fps[u], fps[v], 0, None))
            held, size = [], 0

        def batch_of():
            nonlocal out
            rows, out = out, []
            u, v = (np.concatenate([x[c] for x in rows]).view(np.int64) for c in (0, 1))
            masks = np.concatenate([np.full(len(x[0]), x[2], np.int64) for x in rows])
            tables = [b for x in rows for b in ([None] * len(x[0]) if x[3] is None else [row.tobytes() for row in x[3]])]
            return pa.record_batch([pa.array(u), pa.array(v), pa.array(masks), pa.array(tables, pa.binary())], names=["u", "v", "mask", "pivots"])

        for batch in batches:
            masks, keys, fps = (batch.column(i).to_numpy() for i in range(3))
            fps = fps.view(np.uint64)
            table = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(fps), -1)
            cut = np.flatnonzero((masks[1:] != masks[:-1]) | (keys[1:] != keys[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(fps)], strict=True):
                if key != (masks[a], keys[a]):
                    flush()
                    key, over = (masks[a], keys[a]), False
                held.append((fps[a:b], table[a:b]))
                size += b - a
                if size > bucket:
                    over = True
                    flush()
            if out:
                yield batch_of()
        flush()
        if out:
            yield batch_of()

    return run


def links(classes: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``u, v`` that connect just the distinct fingerprints ``fp`` that differ in at most ``radius`` bits, by paths."""
    spark = classes.sparkSession
    table = scratch.table(classes.select("fp").mapInArrow(_table_rows, "fp long, pivots binary"), "pivots")
    todo, found, level = table.withColumn("mask", F.lit(0).cast("long")), [], 0
    masks = {0: _masks(list(range(64)), radius)}
    while True:
        rows = [(old, new) for old, news in masks.items() for new in news]
        keyed = todo.join(F.broadcast(spark.createDataFrame([(o, _signed(o | n)) for o, n in rows], "mask long, next long")), "mask")
        keyed = keyed.select(F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("next")).alias("key"), "fp", "pivots")
        if level:
            keyed = keyed.distinct()
        # Buckets of one need no visit.
        busy = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        keyed = keyed.join(busy, ["mask", "key"], "left_semi")
        limit = bucket if level < 3 else 1 << 62  # by then at most some hundred fingerprints share a key
        dealt = keyed.repartition(width(spark), "mask", "key").sortWithinPartitions("mask", "key").select("mask", "key", "fp", "pivots")
        done = scratch.table(dealt.mapInArrow(_compare(radius, limit), "u long, v long, mask long, pivots binary"), f"level{level}")
        found.append(done.filter("mask = 0").select("u", "v"))
        over = [r["mask"] for r in done.filter("mask <> 0").select("mask").distinct().collect()]  # at most as many as there are masks
        if not over:
            break
        masks = {m: _masks([b for b in range(64) if not m >> b & 1], radius) for m in over}
        todo = done.filter("mask <> 0").select(F.col("u").alias("fp"), "pivots", "mask")
        level += 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id`` (least doc_id reachable over links, its own included).

    One row for each row of ``docs``: repeated rows and ids stay; a null doc_id has a fingerprint and counts as the
    largest, so it names no component that holds another. Texts without words link at fingerprint zero like any other.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, shingle), "fingerprints")
    classes = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = components(links(classes, scratch, radius), scratch)
    named = classes.join(nodes, classes["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(least, "component").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
