"""WARC archives without repeated payloads: revisit resolution when writing, and the way back when reading.

Writing: each page becomes a response record, compressed as a gzip member of its own, before anything is shuffled.
Headers (id, address, size and SHA-1 of the payload) are shuffled by digest to find, of the records with equal payloads of
at least ``least`` bytes, the one with the largest id; that stays a response, the others become revisits that refer to it.
The payloads that repeat are broadcast if they are few, so that records are written where they are; beyond ``FEW`` of
them the compressed records are shuffled by digest, once. Archives are written by Spark's text sink, so they go to any file system and
survive lost executors as any Spark output does: a gzip member ends in its size, whose last byte is zero below 16 MB, so
the sink's line separator is that byte and a file is a plain sequence of members. Reading streams the archives member by
member, takes size and digest from the payload itself, and joins revisits to their responses by record id.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.llm.common import Scratch

LEAST = 1000
#: Records and compressed bytes in one archive file, about at most; a reader holds one file's compressed bytes.
RECORDS, BYTES = 2000, 64 << 20
#: Records that a task holds at once.
ROWS = 64
#: Payloads with several records, up to which their table (some hundred bytes for each) is broadcast.
FEW = 200_000
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes) -> bytes:
    """A gzip member, with the same bytes for the same data."""
    return gzip.compress(data, 6, mtime=0)


_EMPTY = member(b"")


def _line(packed: bytes) -> bytes:
    """The members as a line whose separator, a zero byte, completes them."""
    return packed[:-1] if packed[-1] == 0 else packed + _EMPTY[:-1]


def _record_id(kind: str, page: int | None, digest: str) -> str:
    """A name-based UUID as a URN."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}|{page}|{digest}').urn}>"


def _uri(url: str | None) -> str:
    """An address without spaces and control characters."""
    return "urn:no-url" if url is None else "".join(c for c in url if c > " ")


def record(kind: str, date: str, page: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: int | None = None, refers_to_url: str | None = None) -> bytes:
    """One uncompressed WARC record with fresh headers; a revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(kind, page, digest)}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Date: {date}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_record_id('response', refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_uri(refers_to_url)}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def information(date: str, name: str) -> bytes:
    """The record that an archive file begins with."""
    block = b"software: sparkassay\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + END


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def resolve(pages: DataFrame, least: int = LEAST, date: str | None = None) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, refers_to_url, member`` for each row of ``pages``.

    ``member`` is the row's response record, compressed; a revisit has none. A null html is an empty payload. Rows that
    share the largest id of a payload are all responses; a null id is the smallest, and a response only where no row with
    the payload has an id.
    """
    date = date or _now()
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.encode("html", "UTF-8"))})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            members = []
            for page, url, html, size, digest in zip(*(batch.column(c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest")), strict=True):
                members.append(member(record("response", date, page.as_py(), url.as_py(), digest.as_py(), size.as_py(), html.as_py().encode())))
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "url", "payload_bytes", "payload_digest")), pa.array(members, pa.binary())], names=["page_id", "url", "payload_bytes", "payload_digest", "member"])

    packed = rows.mapInArrow(pack, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, payload_bytes long, payload_digest string, member binary")
    headers = rows.select("page_id", "url", "payload_bytes", "payload_digest").filter(F.col("payload_bytes") >= least)
    first = headers.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "url")).alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = Scratch(pages.sparkSession, "warc").table(first, "originals")
    few = first.limit(FEW + 1).count() <= FEW
    joined = packed.join(F.broadcast(first) if few else first.hint("merge"), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    if_revisit = lambda c: F.when(revisit, F.col(c))
    return joined.select("page_id", "url", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), if_revisit("original.page_id").alias("refers_to"), if_revisit("original.url").alias("refers_to_url"), F.when(~revisit, F.col("member")).alias("member"))


def write(resolved: DataFrame, path: str, date: str | None = None) -> None:
    """Archives in the folder ``path``: gzip members, one for each record, of which the first of a file describes it.

    A file has at most ``RECORDS`` members; where their bytes reach ``BYTES`` before that, empty members fill it up.
    """
    date, run_id = date or _now(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = size = files = 0
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            out = []
            for r in batch.to_pylist():
                if written % RECORDS == 0:
                    files += 1
                    out.append(_line(member(information(date, f"{run_id}|{r['page_id']}|{r['payload_digest']}|{files}"))))
                    written, size = 1, 0
                packed = r["member"]
                if packed is None:
                    packed = member(record("revisit", date, r["page_id"], r["url"], r["payload_digest"], r["payload_bytes"], b"", r["refers_to"], r["refers_to_url"]))
                out.append(_line(packed))
                written, size = written + 1, size + len(packed)
                if size >= BYTES:
                    out += [_EMPTY[:-1]] * (-written % RECORDS)
                    written = 0
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    lines = resolved.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("record"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(len(END)) != END:
            raise ValueError(f"a WARC record of {size} bytes doesn't end there")
        yield headers, block


FIELDS = "record_id string, record_type string, page_id long, url string, refers_to_record string, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The responses and revisits of the archives in ``path``; size and digest of responses are those of the payload that was read.

    A revisit has its stated digest and no size or payload. ``payload=False`` leaves payloads null.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def row(h: dict[str, str], block: bytes) -> tuple:
        body = block.partition(END)[2] if h["warc-type"] == "response" else None
        digest = h["warc-payload-digest"].removeprefix("sha1:") if body is None else hashlib.sha1(body).hexdigest()
        page = h.get("x-page-id")
        return h["warc-record-id"], h["warc-type"], None if page is None else int(page), h["warc-target-uri"], h.get("warc-refers-to"), None if body is None else len(body), digest, body if payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    if h["warc-type"] in ("response", "revisit"):
                        rows.append(row(h, block))
                    if len(rows) == ROWS:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, FIELDS)


def resolve_read(found: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``: revisits joined to the responses they refer to."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = found.filter("record_type = 'response'")
    originals = responses.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("bytes"))
    revisits = found.filter("record_type = 'revisit'").drop("payload_bytes").join(originals, "refers_to_record", "left").withColumnRenamed("bytes", "payload_bytes")
    return responses.select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*names, "refers_to"))


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes a deduplicated archive of ``pages`` to the shared folder, reads it back and resolves its revisits."""
    scratch = Scratch(pages.sparkSession, "warc")
    date = _now()
    write(resolve(pages, least, date), scratch.path("archives"), date)
    found = scratch.table(read(pages.sparkSession, scratch.path("archives"), payload=False).drop("payload"), "headers")
    scratch.drop("archives")
    return resolve_read(found)
