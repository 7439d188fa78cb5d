"""A factorisation machine that scores the quality of whole texts.

Features are a text's distinct words, hashed, and its structure: shares of capitals, digits, marks and spaces, repetition
of words and lines, lengths, each cut into bins. Besides linear weights each feature has a short vector, and the products
of all pairs of vectors count; by the identity  sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2
that takes time in proportion to the features. The model is fitted on the driver on a bounded sample of labelled rows
and is a few megabytes whatever the corpus; scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.common import text_of
from sparkassay.llm.words import bounds, word_hashes

#: Labelled rows that are fitted on, at most: those with the least hashes of their ids.
SAMPLE = 12_000
BITS, RANK, EPOCHS, RATE, DECAY = 15, 6, 8, 0.05, 2e-5
#: Steps that a fit takes at least, however few rows there are.
STEPS = 1500
THRESHOLD = 0.3
BINS = 16
_WORDS = 1 << BITS
_CLASS = np.zeros((256, 6), np.int64)
_CLASS[65:91, 0] = _CLASS[48:58, 1] = _CLASS[10, 2] = _CLASS[32, 3] = _CLASS[128:, 5] = 1
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _CLASS[_a:_b, 4] = 1
STATISTICS = 16
FEATURES = _WORDS + STATISTICS * (BINS + 1) + 1


def statistics(data: bytes, hashes: np.ndarray) -> np.ndarray:
    """``STATISTICS`` numbers from 0 to 1 about a text's make-up, with its size as the only metadata."""
    n, words = len(data), len(hashes)
    out = np.zeros(STATISTICS)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS
    out[:6] = counts / n
    out[6], out[7] = np.log1p(n) / 16, np.log1p(words) / 14
    if words:
        start, end = bounds(data)
        sizes = end - start
        distinct, times = np.unique(hashes, return_counts=True)
        b = np.frombuffer(data, np.uint8)
        last, first = b[end - 1], b[start]
        out[8] = len(distinct) / words
        out[9] = times.max() / words
        out[10] = (hashes[1:] == hashes[:-1]).mean() if words > 1 else 0
        out[11] = min(1, sizes.mean() / 16)
        out[12] = _CLASS[last, 4].mean()
        out[13] = (_CLASS[last, 4] & (sizes > 1) & _CLASS[b[np.maximum(end - 2, start)], 4]).mean()
        out[14] = ((sizes == 1) & (_CLASS[first, 4] > 0)).mean()
        out[15] = _CLASS[first, 0].mean()
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: words share one unit of weight among them, and each statistic is split between its two nearest bins."""
    data = text.encode()
    hashes = word_hashes(data)
    words = np.unique(hashes >> np.uint64(64 - BITS)).astype(np.int64)
    place = statistics(data, hashes) ** 0.5 * BINS  # finer near 0
    low = np.minimum(place.astype(np.int64), BINS - 1)
    base = _WORDS + np.arange(STATISTICS) * (BINS + 1)
    empty = np.array([FEATURES - 1] if not len(words) else [], np.int64)
    index = np.concatenate([words, base + low, base + low + 1, empty])
    value = np.concatenate([np.full(len(words), 1 / np.sqrt(max(1, len(words)))), 1 - (place - low), place - low, np.ones(len(empty))])
    return index, value * np.concatenate([np.ones(len(words)), np.full(len(value) - len(words), 0.5)])


@dataclass
class Machine:
    """Bias, linear weights and vectors of a fitted factorisation machine."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margin(self, index: np.ndarray, value: np.ndarray) -> float:
        v = self.vectors[index] * value[:, None]
        total = v.sum(0)
        return self.bias + self.weights[index] @ value + 0.5 * float(total @ total - (v * v).sum())

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Machine:
    """Adaptive gradient descent on the log loss, in small batches; without rows, a machine that scores one half."""
    rng = np.random.default_rng(seed)
    bias, weights, vectors = 0.0, np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, RANK))
    if not len(rows):
        return Machine(0.0, weights, vectors * 0)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    g_bias, g_weights, g_vectors = 1e-6, np.full(FEATURES, 1e-6), np.full((FEATURES, RANK), 1e-6)
    for _ in range(max(EPOCHS, -(-STEPS * 64 // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            picked = order[at : at + 64]
            index = np.concatenate([rows[i][0] for i in picked]).astype(np.int64)
            value = np.concatenate([rows[i][1] for i in picked]).astype(np.float64)
            cuts = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in picked])[:-1]])
            v = vectors[index] * value[:, None]
            total = np.add.reduceat(v, cuts)
            margin = bias + np.add.reduceat(weights[index] * value, cuts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((v**2).sum(1), cuts))
            wrong = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[picked]
            each = np.repeat(wrong, np.diff(np.append(cuts, len(index))))
            rep = np.repeat(total, np.diff(np.append(cuts, len(index))), axis=0)
            used, where = np.unique(index, return_inverse=True)
            gw = np.bincount(where, each * value) + DECAY * weights[used] * len(picked)
            gv = np.stack([np.bincount(where, each * value * (rep[:, f] - v[:, f])) for f in range(RANK)], 1) + DECAY * vectors[used] * len(picked)
            g_weights[used] += gw**2
            g_vectors[used] += gv**2
            weights[used] -= RATE * gw / np.sqrt(g_weights[used])
            vectors[used] -= RATE * gv / np.sqrt(g_vectors[used])
            g_bias += wrong.sum() ** 2
            bias -= RATE * wrong.sum() / np.sqrt(g_bias)
    return Machine(bias, weights, vectors)


def held_out(key: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is a multiple of five. A null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Machine:
    """Fits a machine on at most ``most`` labelled rows that aren't held out.

    Rows with a null id or label teach nothing; of a document with several labels each counts. Of rows that share an id
    one teaches, that with the least text hash. Only the sample's ids are sent to the texts, and only its features come
    back: at most ``most`` rows, however often an id is repeated. No labelled rows give a machine that scores one half.
    """
    known = labels.select("doc_id", F.col(label).cast("double").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))], names=["doc_id", "y", "i", "v"])

    chosen = chosen.withColumn("n", F.monotonically_increasing_id())
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    one = Window.partitionBy("n").orderBy(F.xxhash64("text"), "text")
    sample = sample.withColumn("at", F.row_number().over(one)).filter("at = 1").select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text")
    rows = sample.mapInArrow(run, "doc_id string, y double, i array<int>, v array<float>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks()
    if not rows.num_rows:
        return fit([], np.empty(0))
    # Views into the table's buffers: the driver holds the sample's features once.
    parts = [[(x := rows[c].chunk(0)).flatten().to_numpy(), x.offsets.to_numpy() - x.offsets[0].as_py()] for c in ("i", "v")]
    views = [[values[a:b] for a, b in zip(ends, ends[1:], strict=False)] for values, ends in parts]
    return fit(list(zip(*views, strict=True)), rows["y"].to_numpy())


def classify(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the columns in ``keep`` for each row; null texts score as empty ones.

    Equal texts have equal scores, repeated rows stay, a null id is kept and not held out, an empty table gives an empty
    one. Only the named columns are read, so others may have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = ["doc_id", "held_out", "score", *keep]
    text = "text" if "text" in keep else "_text"  # sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            scores = pa.array([machine.score(x.as_py() or "") for x in batch.column(text)], pa.float64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), scores, *(batch.column(c) for c in keep)], names=names)

    rows = docs.select("doc_id", held_out().alias("held_out"), *([] if text in keep else [text_of().alias(text)]), *keep)
    scored = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, held_out boolean, score double" + "".join(f", `{c}` {kinds[c]}" for c in keep))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *keep)
