"""Packing by minimum bin slack: token pieces into sequences of a fixed length with little padding.

A document's ids are cut into whole windows and a rest. Only the number of rests of each length matters for packing, and
that histogram has at most ``window`` entries whatever the corpus holds, so the plan is made from it on the driver: take
the longest rest, find by a bitset subset-sum which multiset of the others fills the window closest to capacity, track
back how many of each length it takes, and use the pattern as often as the counts allow. The plan says which ranks of a
length go where; pieces find their rank by a count over salted groups, so no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.bpe import RankEncoder, encoder
from sparkassay.llm.common import Scratch, text_of, width

WINDOW = 1024
#: Texts whose words are held at once.
ROWS = 256


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum is closest to ``room`` from below.

    ``reach`` has bit s set if s is the sum of some multiset of the lengths so far. Of equal sums the one with more of
    the longer lengths is taken, which leaves short pieces for later gaps.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    seen: list[tuple[int, int, int]] = []
    for length in sorted(x for x, n in counts.items() if n and x <= room):
        most = min(counts[length], room // length)
        seen.append((length, most, reach))
        step, left = 1, most
        while left:  # binary parts of the count
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
    total, out = reach.bit_length() - 1, {}
    for length, most, before in reversed(seen):
        take = next(m for m in range(min(most, total // length), -1, -1) if before >> (total - m * length) & 1)
        if take:
            out[length] = take
            total -= take * length
    return out


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to number) and how often each is used; together they use up the counts exactly."""
    left = {x: n for x, n in counts.items() if n}
    out = []
    while left:
        first = max(left)
        rest = {**left, first: left[first] - 1}
        pattern = fill(window - first, rest)
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[x] // n for x, n in pattern.items())
        out.append((pattern, times))
        left = {x: m for x, n in left.items() if (m := n - times * pattern.get(x, 0))}
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, number in a sequence, offset) in order of rank."""
    ranks: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of the windows and the rest of each document's ids and ``end_id``."""
    kind = docs.schema["doc_id"].dataType
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, RankEncoder)
        for batch in batches:
            rows, starts, sizes, crcs, totals = [], [], [], [], []
            for i, ids in enumerate(x for at in range(0, batch.num_rows, ROWS) for x in enc.encode_many(batch.column(1).slice(at, ROWS).to_pylist())):
                ids += last
                n = len(ids) // 4
                for at in range(0, n, window):
                    rows.append(i)
                    starts.append(at)
                    sizes.append(min(window, n - at))
                    crcs.append(zlib.crc32(ids[4 * at : 4 * (at + window)]))
                    totals.append(n)
            if rows:
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in (starts, sizes, crcs, totals))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(docs["doc_id"], text_of().alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` from 1 to ``window``.

    Every piece is placed, repeated rows and ties included (they count as pieces of their own). A sequence's pieces lie
    gapless from offset 0; no sequence exceeds the window. Sequences are numbered from 0, those of one whole window each
    above the others and with gaps between tasks. An empty table gives an empty one.
    """
    salts = max(64, width(cut.sparkSession))
    rest = cut.filter(F.col("length") < window).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    groups = scratch.table(rest.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "groups")
    sizes = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `window` rows
    patterns = plan(sizes, window)
    places = cut.sparkSession.sparkContext.broadcast(_places(patterns))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = groups.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = rest.withColumn("_rank", F.row_number().over(within) - 1).join(first, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    kept = cut.columns
    ranked = ranked.select(*kept, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for x in np.unique(size):
                at = np.flatnonzero(size == x)
                rows = places.value[int(x)]
                start, seq, n, off = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
                sequence[at], offset[at] = seq + (rank[at] - start) // n, off + (rank[at] - start) % n * x
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in kept)
    packed = ranked.mapInArrow(run, f"{names}, sequence_id long, offset long")
    # A whole window is a sequence of its own: no rank, no shuffle.
    used = sum(times for _, times in patterns)
    whole = cut.filter(F.col("length") == window).select(*kept, (F.monotonically_increasing_id() + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """All documents packed: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for each piece.

    Null and empty texts have just the end id; very long texts give as many whole windows as they hold.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.table(pieces(docs, path, window), "pieces"), scratch, window)
