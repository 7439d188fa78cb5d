"""Near-duplicates at a Jaccard similarity of 0.8 on sets of five-word shingles: SimHash and pivots filter, the sets decide.

A 64-bit fingerprint can't tell a similarity of 0.8 (about ten bits apart) from one of 0.6 (about fifteen), so this
variant of ``simhash`` has 256 bits: 0.8 is 39 +- 6 bits apart (48 +- 6 for sets of a few shingles), unrelated texts 128
+- 8. The radius is wide, so that no such pair is lost to it. At such distances no exact key exists, so documents meet in
buckets that share a band of least shingle hashes: of twelve bands of four, a pair at 0.8 shares one with probability 0.998.

1. Equal sets are one class. Classes that share a band key with another are met; only their sets are shuffled, once.
2. Each met class is compared with the least class of one of its buckets (a star): fingerprints first, then the sets. Most
   groups of copies are connected after that, at a cost in proportion to their size.
3. What is left are buckets whose members are still in several components. Large ones are cut into cells that hold any two
   members together; in a cell the pivot distance table discards pairs with a coordinate further apart than the radius,
   then come the fingerprints. Only members with a near one in another component have their sets sent, and their links
   are decided on the sets. A cell gives the edges of a spanning forest only.

Sets hold 40 bits of each shingle's hash: among 10,000 shingles 0.00005 of a collision is expected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.common import Scratch, text_of, width
from sparkassay.llm.components import components
from sparkassay.llm.words import mix, run_hashes, word_hashes

SHINGLE, LANES, RADIUS = 5, 4, 80
#: The least Jaccard similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 12, 4
PIVOTS = 16
#: Members of a bucket that are dealt to one part, about; a cell holds two parts.
CELL = 256
#: Bytes of a shingle's hash that a set holds.
BYTES = 5
#: Texts whose sets are held at once.
TEXTS = 512
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_LANE = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1) for k in range(LANES)]
_NAMES = [f"f{k}" for k in range(LANES)]


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``LANES`` 64-bit words: a bit is set if over half of the shingle hashes, mixed for its lane, have it."""
    if not len(hashes):
        return np.zeros(LANES, np.uint64)
    wide = np.stack([mix(hashes ^ x) for x in _LANE], 1)
    total = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(wide), 4096):
        total += np.unpackbits(np.ascontiguousarray(wide[at : at + 4096]).view(np.uint8).reshape(-1, 8 * LANES), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ((2 * total > len(hashes)).reshape(LANES, 64) * _BITS).sum(1, dtype=np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: the least hashes of ``ROWS`` ranges; an empty range takes that of the next one that isn't."""
    h = np.unique(hashes)
    n = BANDS * ROWS
    if not len(h):
        return np.zeros(BANDS, np.uint64)
    edges = np.array([(k << 64) // n for k in range(n)], np.uint64)
    at = np.searchsorted(h, edges)
    least = h[at % len(h)]  # the first hash from the range's start on, around the end if need be
    return mix(np.add.reduce(mix(least.reshape(BANDS, ROWS) + np.arange(ROWS, dtype=np.uint64)) * _PLACE, axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


_PLACE = np.array([0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5, 0xF7C2EBC08F67F2B5], np.uint64)


def pack(hashes: np.ndarray) -> bytes:
    """A set of hashes as ``BYTES`` planes of their leading bytes: sorted, so the first plane compresses away."""
    return np.unique(hashes >> np.uint64(64 - 8 * BYTES)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The sorted numbers of a packed set."""
    planes = np.frombuffer(data, np.uint8).reshape(BYTES, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - BYTES :] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def _fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            fps, keys, nodes, sizes, sets = [np.empty((0, LANES), np.uint64)], [], [], [], []
            for x in batch.column(2):
                words = word_hashes(x.as_py().encode())
                h = np.unique(run_hashes(words, min(shingle, len(words))) if len(words) else words)
                fps.append(fingerprint(h)[None])
                keys.append(bands(h).view(np.int64))
                nodes.append(int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True))
                sets.append(pack(h))
                sizes.append(len(sets[-1]) // BYTES)
            fp = np.concatenate(fps).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(LANES)), pa.array(keys, pa.list_(pa.int64())), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())], names=["doc_id", "tk", *_NAMES, "keys", "node", "size", "shingles"])

    lanes = ", ".join(f"{x} long" for x in _NAMES)
    return docs.select("doc_id", F.xxhash64(text_of()).alias("tk"), text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, tk long, {lanes}, keys array<long>, node long, size int, shingles binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets, as sorted arrays, is at least ``SIMILAR``."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return SIMILAR[1] * common >= SIMILAR[0] * (len(both) - common)


class _Members:
    """The members of a cell: who is near whom by size, pivot distances and fingerprints."""

    def __init__(self, rows: pa.Table, radius: int) -> None:
        self.fps = np.stack([rows[c].to_numpy() for c in _NAMES], 1).view(np.uint64)
        self.sizes, self.root = rows["size"].to_numpy().astype(np.int64), rows["root"].to_numpy().copy()
        self.radius = radius
        refs = self.fps[:: max(1, len(self.fps) // PIVOTS)][:PIVOTS] if len(self.fps) > PIVOTS else self.fps[:0]
        self.table = np.stack([np.bitwise_count(self.fps ^ r).sum(1, dtype=np.int16) for r in refs], 1) if len(refs) else None

    def near(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` in another component than i's whose sets could be similar enough to i's."""
        others = others[self.root[others] != self.root[i]]
        others = others[SIMILAR[1] * np.minimum(self.sizes[others], self.sizes[i]) >= SIMILAR[0] * np.maximum(self.sizes[others], self.sizes[i])]
        if self.table is not None:
            for k in range(self.table.shape[1]):
                if not len(others):
                    return others
                others = others[np.abs(self.table[others, k] - self.table[i, k]) <= self.radius]
        return others[np.bitwise_count(self.fps[others] ^ self.fps[i]).sum(1, dtype=np.int16) <= self.radius] if len(others) else others


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell; rows come sorted by their first three columns, which name it."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
        cut = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
        for a, b in zip([0, *cut], [*cut, len(names)], strict=True):
            if held and tuple(names[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(names[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(radius: int):
    """Of each cell's rows those with a near one in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            root = rows["root"].to_numpy()
            if (root == root[0]).all():
                continue
            members, every = _Members(rows, radius), np.arange(rows.num_rows)
            keep = [i for i in range(rows.num_rows) if len(members.near(i, every))]
            yield from rows.take(pa.array(keep, pa.int64())).combine_chunks().to_batches()

    return run


def _links(radius: int):
    """A spanning forest of each cell's links, on top of the components that its members are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            members, nodes = _Members(rows, radius), rows["node"].to_numpy()
            sets = [unpack(x) for x in rows["shingles"].to_pylist()]
            us, vs = [], []
            for i in range(len(nodes)):
                for j in members.near(i, np.arange(i + 1, len(nodes))):
                    a, b = members.root[i], members.root[j]
                    if a != b and alike(sets[i], sets[j]):
                        members.root[members.root == b] = a
                        us.append(nodes[i])
                        vs.append(nodes[j])
            if us:
                yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _alike_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs ``node, lead`` whose sets are similar enough."""
    for batch in batches:
        pairs = zip(batch.column("shingles"), batch.column("other"), strict=True)
        yes = pa.array([alike(unpack(a.as_py()), unpack(b.as_py())) for a, b in pairs], pa.bool_())
        yield batch.select(["node", "lead"]).rename_columns(["u", "v"]).filter(yes)


def _bits(a: str, b: str) -> Column:
    """The Hamming distance of two fingerprints, whose columns have these prefixes."""
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(LANES)), F.lit(0))


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """``doc_id, tk``: one row of each group of near-duplicates, that with the least id (ties: the least text hash ``tk``).

    Null and empty texts form one group; texts of fewer words than a shingle are near only to equal ones. A null id counts
    as the largest. Repeated rows give one representative. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    fps = scratch.table(_fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tk")).alias("first")
    classes = scratch.table(fps.groupBy("node").agg(F.first("size").alias("size"), *(F.first(x).alias(x) for x in _NAMES), F.first("keys").alias("keys"), first), "classes")
    keyed = classes.select(F.explode(F.array_distinct("keys")).alias("key"), "node", "size", *_NAMES)
    busy = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1")
    met = scratch.table(keyed.join(busy, "key"), "met")
    wanted = met.select("node").distinct()
    sets = scratch.table(fps.groupBy("node").agg(F.first("shingles").alias("shingles")).join(wanted, "node", "left_semi"), "sets")

    # Stars: one near lead for each class that has one.
    leads = met.filter("node = lead").select("lead", F.col("size").alias("lead_size"), *(F.col(x).alias(f"g{k}") for k, x in enumerate(_NAMES))).distinct()
    close = (F.least("size", "lead_size") * SIMILAR[1] >= F.greatest("size", "lead_size") * SIMILAR[0]) & (_bits("f", "g") <= radius)
    stars = scratch.table(met.filter("node <> lead").join(leads, "lead").filter(close).groupBy("node").agg(F.min("lead").alias("lead")), "stars")
    lead_sets = sets.join(stars.select(F.col("lead").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("lead"), F.col("shingles").alias("other"))
    starred = stars.join(sets, "node").select("node", "lead", "shingles").join(lead_sets, "lead").select("node", "lead", "shingles", "other")
    edges = scratch.table(starred.mapInArrow(_alike_rows, "u long, v long"), "star_edges")
    nodes = components(edges, Scratch(spark, "similar"))

    # The rest: buckets that hold several components.
    rooted = met.join(nodes, "node", "left").withColumn("root", F.coalesce("component", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    parts = F.ceil(F.col("n") / cell).cast("long")
    mine, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.col("other")
    dealt = rooted.join(mixed, "key", "left_semi").withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = dealt.select("key", F.least("mine", other).alias("a"), F.greatest("mine", other).alias("b"), "node", "root", "size", *_NAMES)
    named, by = "key long, a long, b long, node long, root long, size int, " + ", ".join(f"{x} long" for x in _NAMES), ["key", "a", "b"]
    together = lambda df: df.repartition(width(spark), *by).sortWithinPartitions(*by)
    near = scratch.table(together(cells).mapInArrow(_candidates(radius), named), "near")
    more = together(near.join(sets, "node").select(*by, "node", "root", "size", *_NAMES, "shingles")).mapInArrow(_links(radius), "u long, v long")
    more = scratch.table(more, "more_edges")
    nodes = components(edges.unionByName(more), scratch)

    of = classes.select("node", "first").join(nodes, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first"))
    return of.select("first.doc_id", "first.tk")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` (all their columns) without those whose group of near-duplicates has an earlier one."""
    names = docs.columns
    zero = F.lit("0").cast(docs.schema["doc_id"].dataType)
    key = {"_similar_no": F.col("doc_id").isNull(), "_similar_id": F.coalesce("doc_id", zero)}
    kept = representatives(docs, shingle, radius).withColumns(key).select(*key, F.col("tk").alias("_similar_tk"))
    joined = docs.withColumns(key | {"_similar_tk": F.xxhash64(text_of())}).join(kept, [*key, "_similar_tk"], "left_semi")
    # Repeated rows share id and text: one stays. They lie together already.
    one = Window.partitionBy(*key, "_similar_tk").orderBy(F.lit(0))
    return joined.withColumn("_similar_n", F.row_number().over(one)).filter("_similar_n = 1").select(*names)
