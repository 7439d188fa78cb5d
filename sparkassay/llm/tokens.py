"""Token ids of whole texts on the cluster, by the backtracking encoder of ``bpe``."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkassay.llm.bpe import encoder
from sparkassay.llm.common import text_of

#: Rows whose ids are held at once.
ROWS = 256


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int): each whole text as the ``tokenizers`` file at ``path`` encodes it, special tokens not added.

    Null texts are empty and give no ids; strings of added tokens in a text become those tokens; repeated rows stay
    repeated; a null key stays null. No shuffle: one pass over the texts.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                ids = [np.frombuffer(enc.encode(x), "<u4") for x in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32))
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[key, "ids"])

    return docs.select(docs[key], text_of(text).alias("text")).mapInArrow(run, f"{key} {kind.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``text``: each array of ids decoded through the offset table, invalid UTF-8 replaced; null ids give an empty text."""
    kind = coded.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return coded.select(coded[key], coded[ids]).mapInArrow(run, f"{key} {kind.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """For each row of ``docs`` the digests of its ids and of what they decode to: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Encodes and decodes in one pass, so ids never leave the worker. Nulls, empty texts and repeated rows as in ``encode``.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for x in batch.column(1):
                ids = enc.encode(x.as_py())
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                text = enc.decode_bytes(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"], text_of().alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
