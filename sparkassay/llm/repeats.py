"""Substring dedup by repeated-phrase automata.

Which words to remove: those in a window of ``window`` words that also starts in a document with a smaller id. Every
window has an anchor: the run of ``phrase`` words in it with the least hash, the leftmost of equals. Equal windows have
equal anchors, so only windows whose anchor occurs in two documents can recur; that leaves few words to move.

1. Each document's anchor hashes are reduced to (hash, least id, greatest id); those with two ids are candidates.
2. Each document gives, for each candidate anchor it holds, the segment that the anchor's windows cover. Equal segments of
   a batch of documents become one row that names them all, before they are dealt to shards by anchor.
3. A shard confirms on the words which phrases occur in two documents, compiles them into an Aho-Corasick automaton and
   streams the segments of all documents through it. A match says which phrase stands where; a window is known by that
   phrase, its place in the window and the hashes of what stands before and after it. Segments come sorted by anchor and
   least id, so the first window of a kind is in the least document; in documents with larger ids it is to go. Memory
   holds one slice of segments and the distinct windows of one anchor.
4. An anchor that many documents hold is dealt to many shards, which locate its occurrences in the same way but give out
   the windows; the least id of each kind of window is then a partial aggregate, joined back to them.
5. Documents are joined with their removed ranges.

The texts are shuffled once: both joins are on the id and share an exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import text_of, width
from sparkassay.llm.words import bounds, mix, run_hashes, span_hashes, word_hashes

WINDOW = 50
PHRASE = 26
#: Segments that a shard holds at once.
SLICE = 1024
#: Documents whose segments around one anchor meet in one shard, about: the most that a shard holds of a hot one.
SHARD = 512
_LAST = (1 << 63) - 1


def anchors(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes in order of place, each with the first and last window that it is the anchor of."""
    runs = run_hashes(hashes, phrase)
    if len(hashes) < window:
        return runs[:0], np.empty(0, np.int64), np.empty(0, np.int64)
    span = window - phrase + 1
    least = np.arange(len(hashes) - window + 1) + np.lib.stride_tricks.sliding_window_view(runs, span).argmin(axis=1)
    first = np.flatnonzero(np.diff(least, prepend=-1))
    return runs[least[first]], first, np.append(first[1:], len(least)) - 1


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _anchor_rows(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, x in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
                h = np.unique(anchors(word_hashes(x.as_py().encode()), window, phrase)[0])
                hs.append(h.view(np.int64))
                ids.append(np.full(len(h), i))
            yield pa.record_batch([pa.array(np.concatenate(hs)), pa.array(np.concatenate(ids))], names=["h", "id"])

    return run


_REFS = "array<struct<id: long, tk: long, starts: array<int>>>"


def _refs(rows: list[list[tuple]]) -> pa.ListArray:
    """For each row its documents, as (id, text hash, starts of the segment)."""
    flat = [r for x in rows for r in x]
    struct = pa.StructArray.from_arrays([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int64()), pa.array([r[2] for r in flat], pa.list_(pa.int32()))], names=["id", "tk", "starts"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), struct)


def _segments(window: int, phrase: int):
    """For each batch of documents its distinct segments, each with the documents of the batch that hold it.

    A passage that many documents share so leaves a batch as one row, however hot its anchor is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, dict[tuple, list[int]]] = {}
            for i, tk, x, wanted in zip(*(batch.column(c).to_pylist() for c in ("id", "tk", "text", "hs")), strict=True):
                parts = {c["h"]: c["parts"] for c in wanted}
                text = x.encode()
                words, hashes = text.split(), word_hashes(text)
                h, first, last = anchors(hashes, window, phrase)
                runs = run_hashes(hashes, phrase)
                for k in np.flatnonzero(np.isin(h, np.array(list(parts), np.int64).view(np.uint64))):
                    a, b = int(first[k]), int(last[k]) + window
                    at = int(np.flatnonzero(runs[a : b - phrase + 1] == h[k])[0])
                    key = int(h[k].astype(np.int64))
                    held.setdefault((key, parts[key], b" ".join(words[a:b]), at), {}).setdefault((i, tk), []).append(a)
            rows = []
            for (h, parts, segment, at), refs in held.items():
                lo = min(refs)[0]
                rows.append((h, parts, xxhash.xxh64_intdigest(lo.to_bytes(8, "little", signed=True)) % parts, lo, segment, at, [(i, tk, starts) for (i, tk), starts in refs.items()]))
            for at in range(0, len(rows), SLICE):
                h, parts, salt, lo, segment, place, refs = zip(*rows[at : at + SLICE], strict=True)
                yield pa.record_batch([pa.array(h, pa.int64()), pa.array(parts, pa.int32()), pa.array(salt, pa.int32()), pa.array(lo, pa.int64()), pa.array(segment, pa.binary()), pa.array(place, pa.int32()), _refs(refs)], names=["h", "parts", "salt", "lo", "segment", "at", "refs"])

    return run


class _Slice:
    """A slice of a shard's segments, streamed through the automaton of its confirmed phrases."""

    def __init__(self, rows: pa.RecordBatch, window: int, phrase: int, before: int | None) -> None:
        """``before`` is the anchor that the last slice ended with."""
        self.rows, self.window = rows, window
        self.h, self.lo = rows.column("h").to_numpy(), rows.column("lo").to_numpy()
        segments, refs = rows.column("segment").to_pylist(), rows.column("refs")
        sizes = np.array([x.count(b" ") + 1 for x in segments])
        first = np.concatenate([[0], np.cumsum(sizes)])  # each segment's first word in the stream
        stream = b" " + b" \n ".join(segments) + b" "
        start, end = bounds(stream)
        hashes = word_hashes(stream)
        # Confirmation: the phrase is in two documents, or perhaps in another slice or shard.
        at = first[:-1] + rows.column("at").to_numpy()
        phrases = [stream[a - 1 : b + 1] for a, b in zip(start[at].tolist(), end[at + phrase - 1].tolist(), strict=True)]
        number = {p: i for i, p in enumerate(dict.fromkeys(phrases))}
        own = np.array([number[p] for p in phrases], np.int64)
        least, most = np.full(len(number), _LAST), np.full(len(number), -_LAST)
        ends = refs.offsets.to_numpy()
        self.ids = refs.flatten().field("id").to_numpy()
        self.cuts = ends - ends[0]
        self.most = np.maximum.reduceat(self.ids, self.cuts[:-1])
        np.minimum.at(least, own, self.lo)
        np.maximum.at(most, own, self.most)
        confirmed = least < most
        confirmed[own[(self.h == self.h[-1]) | (rows.column("parts").to_numpy() > 1)]] = True
        if before is not None:
            confirmed[own[self.h == before]] = True
        automaton = ahocorasick.Automaton()
        for p, i in number.items():
            if confirmed[i]:
                automaton.add_word(p.decode("latin-1"), i)
        found: list[tuple[int, int]] = []
        if len(automaton):
            automaton.make_automaton()
            found = list(automaton.iter(stream.decode("latin-1")))
        last, which = np.array(found, np.int64).reshape(-1, 2).T
        # A match ends at the space after its last word.
        place = np.searchsorted(start, last) - phrase
        row = np.searchsorted(first, place, "right") - 1
        mine = which == own[row]
        place, row = place[mine], row[mine]
        # A window is known by the leftmost place of its segment's phrase in it: equal windows agree on that.
        located = np.unique(row)
        count = sizes[located] - window + 1
        self.row = np.repeat(located, count)
        self.k = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count, count)
        k = first[self.row] + self.k
        at = np.append(place, len(hashes))[np.searchsorted(place, k)]
        holds = at + phrase <= k + window
        self.row, self.k, k, at = self.row[holds], self.k[holds], k[holds], at[holds]
        seeds = np.array([(xxhash.xxh64_intdigest(p, 1), xxhash.xxh64_intdigest(p, 2)) for p in number], np.uint64).reshape(-1, 2)[own[self.row]].T
        offset = (at - k).astype(np.uint64)
        self.w1 = mix(span_hashes(hashes, k, at) + mix(offset + seeds[0]))
        self.w2 = mix(span_hashes(hashes, at + phrase, k + window) + mix(offset + seeds[1]))


def _late(least: np.ndarray, k: np.ndarray, i: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the ranges that the windows starting at ``k`` cover whose least id is below ``i``."""
    gone = k[least < i]
    cut = np.flatnonzero(np.diff(gone) > window)
    return gone[np.concatenate([[0], cut + 1])], gone[np.append(cut, len(gone) - 1)] + window


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))


def _shard(window: int, phrase: int):
    """Rows sorted by anchor and least id: the ranges to remove from each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, held = None, (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))  # the distinct windows of the anchor at hand, with their least ids
        for rows in _slices(batches):
            s = _Slice(rows, window, phrase, anchor)
            if s.h[0] != anchor:
                held = tuple(x[:0] for x in held)
            w1, w2, lo = np.concatenate([held[0], s.w1]), np.concatenate([held[1], s.w2]), np.concatenate([held[2], s.lo[s.row]])
            # Of windows of a kind the first has the least id; the sort is stable.
            order = np.lexsort((w2, w1))
            new = np.ones(len(order), bool)
            new[1:] = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
            least = np.empty(len(order), np.int64)
            least[order] = lo[order[new]][np.cumsum(new) - 1]
            of = np.concatenate([np.full(len(held[0]), s.h[0] if s.h[0] == anchor else 0), s.h[s.row]])
            kept = order[new][of[order[new]] == s.h[-1]]
            least = least[len(held[0]) :]
            anchor, held = s.h[-1], (w1[kept], w2[kept], lo[kept])
            late = least < s.most[s.row]
            ids, tks, starts, ends = [], [], [], []
            refs = rows.column("refs")
            for r in np.unique(s.row[late]).tolist():
                a, b = np.searchsorted(s.row, [r, r + 1])
                for x in refs[r].as_py():
                    if (least[a:b] < x["id"]).any():
                        p, q = _late(least[a:b], s.k[a:b], x["id"], window)
                        ids.append(x["id"])
                        tks.append(x["tk"])
                        starts.append([i + y for i in x["starts"] for y in p.tolist()])
                        ends.append([i + y for i in x["starts"] for y in q.tolist()])
            if ids:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(tks, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=["id", "tk", "a", "b"])

    return run


def _hot_windows(window: int, phrase: int):
    """The windows of anchors that are dealt to several shards, in any order, with the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches):
            s = _Slice(rows, window, phrase, None)
            yield pa.record_batch([pa.array(s.w1.view(np.int64)), pa.array(s.w2.view(np.int64)), pa.array(s.k.astype(np.int32)), rows.column("refs").take(pa.array(s.row))], names=["w1", "w2", "k", "refs"])

    return run


def repeated(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, keep: tuple[str, ...] = (), shard: int = SHARD) -> DataFrame:
    """``id, cuts``: for each document that has any, the word ranges that are to go, as ``struct<tk, a, b>`` (tk: its text's hash; a and b: starts and ends).

    Texts travel with the columns in ``keep``, so that a later join of the same rows on the id finds them dealt out already.
    """
    spark = docs.sparkSession
    texts = docs.select(_id().alias("id"), text_of().alias("text"))
    rows = texts.mapInArrow(_anchor_rows(window, phrase), "h long, id long")
    twice = rows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("h", F.ceil(F.col("n") / shard).cast("int").alias("parts"))
    held = rows.join(twice, "h").groupBy("id").agg(F.collect_set(F.struct("h", "parts")).alias("hs"))  # at most the document's own anchors
    mine = _dealt(docs, keep).join(held, "id")
    segments = mine.mapInArrow(_segments(window, phrase), f"h long, parts int, salt int, lo long, segment binary, at int, refs {_REFS}")
    shards = segments.repartition(width(spark), "h", "salt")
    # A column that the optimiser can't see through keeps the filters above the exchange, which both sides share.
    shards = shards.withColumn("_parts", F.col("parts") + F.monotonically_increasing_id() % 1)
    cuts = shards.filter("_parts = 1").sortWithinPartitions("h", "lo").mapInArrow(_shard(window, phrase), "id long, tk long, a array<int>, b array<int>")
    hot = shards.filter("_parts > 1").mapInArrow(_hot_windows(window, phrase), f"w1 long, w2 long, k int, refs {_REFS}")
    ids = F.transform("refs", lambda x: x["id"])
    least = hot.groupBy("w1", "w2").agg(F.min(F.array_min(ids)).alias("lo"), F.max(F.array_max(ids)).alias("hi")).filter("lo < hi").drop("hi")
    # Joined on half of the key, so that both sides are shuffled for the join and Spark can split a hot window.
    least = least.select("w1", F.col("w2").alias("other"), "lo")
    late = hot.join(least.hint("merge"), "w1").filter(F.col("w2").bitwiseXOR(F.col("other")) == 0).select("lo", "k", F.explode("refs").alias("r")).filter("r.id > lo")
    places = lambda n: F.transform("r.starts", lambda s: s + F.col("k") + n)
    cuts = cuts.unionByName(late.select("r.id", "r.tk", places(0).alias("a"), places(window).alias("b")))
    return cuts.groupBy("id").agg(F.collect_list(F.struct("tk", "a", "b")).alias("cuts"))


def _dealt(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(_id().alias("id"), "doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("tk"), *keep)


def _without(text: bytes, lost: np.ndarray) -> str:
    """The text without the lost words, each with the white space after it (at the end of a text: before it)."""
    start, end = bounds(text)
    change = np.diff(lost.astype(np.int8), prepend=0, append=0)
    out, at = [], 0
    for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True):
        out.append(text[at : start[a]] if b < len(start) else text[at : end[a - 1] if a else 0])
        at = start[b] if b < len(start) else len(text)
    return b"".join([*out, text[at:]]).decode()


def remove(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, n_words, n_removed`` and the columns named in ``keep``: what is left of each text.

    What stands between kept words stays as it is, line breaks included. One row for each row of
    ``docs``, whose ids are numbers. Null and empty texts have no words. Rows that share an id don't take words from each other; a null id
    counts as larger than all others. Only the named columns of ``docs`` are read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    cuts = repeated(docs, window, phrase, keep)
    joined = _dealt(docs, keep).join(cuts, "id", "left").select("doc_id", "text", "tk", "cuts", *keep)
    names = ["doc_id", "text", "n_words", "n_removed", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, gone = [], [], []
            for x, tk, cut in zip(*(batch.column(c).to_pylist() for c in ("text", "tk", "cuts")), strict=True):
                words = x.encode().split()
                counts.append(len(words))
                lost = np.zeros(len(words), bool)
                for c in cut or ():
                    if c["tk"] == tk:
                        for a, b in zip(c["a"], c["b"], strict=True):
                            lost[a:b] = True
                gone.append(int(lost.sum()))
                texts.append(_without(x.encode(), lost) if gone[-1] else x)
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), *(batch.column(c) for c in keep)], names=names)

    return joined.mapInArrow(run, f"doc_id {kinds['doc_id']}, text string, n_words long, n_removed long" + "".join(f", `{c}` {kinds[c]}" for c in keep))


def digests(removed: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (of the kept words, joined by one space) of what ``remove`` returns."""
    kept = F.trim(F.regexp_replace("text", "[ \\t-\\r]+", " "))
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))
