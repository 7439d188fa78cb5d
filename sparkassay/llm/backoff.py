"""Stupid-backoff scores of documents under an n-gram model of all the others.

Documents are dealt, in compressed parcels, into blocks of bounded size. A block hashes its n-grams of all orders, counts the distinct ones and
sends them, packed by hash, to the partitions of the count tables: a row of the n-gram table holds the n-grams of one block
in one range of hashes, as columns of hashes and counts. A frequent n-gram so comes once from a block, never once from an
occurrence, and there are never more rows than n-grams. A partition sums the counts and joins them back to the blocks that hold the n-grams. The block
then scores every word of its documents and sums up each document's.

A document's own occurrences don't count for it: the count of an n-gram is that in all other rows. A word scores
count(n-gram) / count(context) for the longest n-gram that others hold, times ``alpha`` for each order given up; one that
no other document holds scores as if another held it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import Scratch, text_of
from sparkassay.llm.words import run_hashes, word_hashes

ORDER = 3
ALPHA = 0.4
#: Bytes of text in a block, about, and partitions of the count tables for each block: both bound what a task holds.
BLOCK, PARTS = 8 << 20, 2


def _grams(texts: list[bytes], order: int) -> tuple[list[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
    """Each document's n-gram hashes by order, and each order's distinct ones in the block with their counts."""
    docs = [[run_hashes(words, n) >> np.uint64(64 - 8 * BYTES) for n in range(1, order + 1)] for words in map(word_hashes, texts)]
    return docs, [np.unique(np.concatenate([d[n] for d in docs]), return_counts=True) for n in range(order)]


#: Bytes of a hash that are sent: 56 bits tell 10**13 n-grams apart but for one in some thousands.
BYTES = 7


def _pack(numbers: np.ndarray, width: int = 8) -> bytes:
    """Numbers as planes of bytes, most significant first: sorted or small numbers leave planes that the shuffle's codec removes."""
    return numbers.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T.tobytes()


def _unpack(data, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - width :] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def _ends(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted hashes leave each of ``parts`` equal ranges."""
    return np.searchsorted(hashes, np.array([(k << 8 * BYTES) // parts for k in range(1, parts)], np.uint64))


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch for each block as one compressed parcel: half of what the shuffle's own codec makes of texts."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order])) + 1
        rows = batch.select(["doc_id", "text"])
        out, which = [], []
        for at in np.split(order, cuts) if len(order) else ():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(rows.take(pa.array(at)))
            out.append(sink.getvalue().to_pybytes())
            which.append(int(blocks[at[0]]))
        yield pa.record_batch([pa.array(which, pa.int32()), pa.array(out, pa.binary())], names=["block", "parcel"])


def _open(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a block's parcels."""
    ids, texts = [], []
    for x in table["parcel"]:
        rows = pa.ipc.open_stream(x.as_buffer()).read_all()
        ids += rows["doc_id"].to_pylist()
        texts += [t.encode() for t in rows["text"].to_pylist()]
    return ids, texts


def _count(order: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, distinct = _grams(_open(table)[1], order)
        rows = []
        for n, (h, c) in enumerate(distinct):
            ends = [0, *_ends(h, parts).tolist(), len(h)]
            rows += [(k, block, n, _pack(h[a:b], BYTES), _pack(c[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
        part, blocks, orders, hs, cs = zip(*rows, strict=True) if rows else ([],) * 5
        return pa.table([pa.array(part, pa.int32()), pa.array(blocks, pa.int32()), pa.array(orders, pa.int32()), pa.array(hs, pa.binary()), pa.array(cs, pa.binary())], names=["part", "block", "n", "hashes", "counts"])

    return run


def _join(table: pa.Table) -> pa.Table:
    """One partition of the count tables: sums the blocks' counts and gives each block those of its own n-grams."""
    out = []
    order = np.array(table["n"].to_pylist())
    for n in np.unique(order):
        rows = np.flatnonzero(order == n)
        hs = [_unpack(table["hashes"][int(i)].as_buffer(), BYTES) for i in rows]
        cs = np.concatenate([_unpack(table["counts"][int(i)].as_buffer()) for i in rows])
        sizes = [len(h) for h in hs]
        distinct, at = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(at, weights=cs, minlength=len(distinct)).astype(np.int64)[at]
        for i, t in zip(rows, np.split(total, np.cumsum(sizes)[:-1]), strict=True):
            out.append((table["part"][int(i)].as_py(), table["block"][int(i)].as_py(), int(n), _pack(t)))
    part, block, n, totals = zip(*out, strict=True)
    return pa.table([pa.array(part, pa.int32()), pa.array(block, pa.int32()), pa.array(n, pa.int32()), pa.array(totals, pa.binary())], names=["part", "block", "n", "totals"])


def _score(order: int, alpha: float, key: pa.DataType):
    def one(grams: list[np.ndarray], distinct: list[np.ndarray], totals: list[np.ndarray]) -> tuple[int, float, int]:
        """Words, sum of logs without the size of the corpus, and how many words it is to be divided into."""
        words = len(grams[0])
        if not words:
            return 0, 0.0, 0
        others = []
        for n in range(order):
            own, at, times = np.unique(grams[n], return_inverse=True, return_counts=True)
            others.append((totals[n][np.searchsorted(distinct[n], own)] - times)[at])
        log = np.log(np.maximum(others[0], 1))
        steps = np.minimum(np.arange(words), order - 1)  # orders above the first that a word has
        log += steps * np.log(alpha)
        plain = np.ones(words, bool)
        for n in range(1, order):
            seen = np.flatnonzero(others[n] > 0)
            last = seen + n  # the n-gram's last word
            log[last] = np.log(others[n][seen]) - np.log(others[n - 1][seen]) + (steps[last] - n) * np.log(alpha)
            plain[last] = False
        return words, float(log.sum()), int(plain.sum())

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        ids, plain_texts = _open(texts)
        docs, found = _grams(plain_texts, order)
        totals: list[np.ndarray] = []
        ns = np.array(counts["n"].to_pylist(), int)
        parts = np.array(counts["part"].to_pylist(), int)
        for n in range(order):
            rows = np.flatnonzero(ns == n)
            rows = rows[np.argsort(parts[rows])]
            totals.append(np.concatenate([np.empty(0, np.int64), *(_unpack(counts["totals"][int(i)].as_buffer()).astype(np.int64) for i in rows)]))
        out = [one(d, [h for h, _ in found], totals) for d in docs]
        words, logs, plain = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(ids, key), pa.array(words, pa.int64()), pa.array(logs, pa.float64()), pa.array(plain, pa.int64())], names=["doc_id", "n_words", "logs", "plain"])

    return run


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, score`` (mean of the words' natural logs), ``log_total`` (their sum) for each row.

    Words are parted by ASCII white space. Null and empty texts have no words and score 0; repeated rows are documents of
    their own, so each counts for the others. A text longer than a block is one of its own. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "backoff")
    size = docs.agg(F.sum(F.octet_length(text_of()).cast("long")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block))
    dealt = docs.select("doc_id", text_of().alias("text"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(_parcels, "block int, parcel binary")
    counted = dealt.groupBy("block").applyInArrow(_count(order, PARTS * blocks), "part int, block int, n int, hashes binary, counts binary")
    joined = counted.groupBy("part").applyInArrow(_join, "part int, block int, n int, totals binary")
    kind = docs.schema["doc_id"].dataType
    scored = dealt.groupBy("block").cogroup(joined.groupBy("block")).applyInArrow(_score(order, alpha, _arrow(kind)), f"doc_id {kind.simpleString()}, n_words long, logs double, plain long")
    scored = scratch.table(scored, "scored")
    total = scored.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    rest = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double")
    log = F.col("logs") - F.col("plain") * F.log(rest)
    return scored.select("doc_id", "n_words", F.when(F.col("n_words") > 0, log / F.col("n_words")).otherwise(0.0).alias("score"), log.alias("log_total"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
