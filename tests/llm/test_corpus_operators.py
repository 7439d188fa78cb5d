"""The corpus operators against brute force, round trips and held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkassay.llm import backoff, bpe, components, licences, neighbours, packing, quality, repeats, similar, simhash, sketch, tokens, warc
from sparkassay.llm.common import Scratch
from sparkassay.llm.queries import QUERIES, SQL, TOKENIZER

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(20000))
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, None, None, None, None), (None, "a b c", "en", None, 5), (None, None, None, None, None), (3, "", "de", "s", 0), (4, long, "en", "s", len(long)), (5, long, "en", "s", len(long)), (6, "é ß x\x00́", "fr", "s", 8), (7, "  \n\t ", "en", "s", 5), (7, "other text of the same id", "en", "s", 25)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("id", "fp", "text_", "key", "block", "part", "tk", "cuts", "h", "node", "length", "held_out", "score", "y"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# --- encoding ----------------------------------------------------------------------------------------------------------


def test_encoder_equals_the_library(docs):
    from tokenizers import Tokenizer

    lib, enc, fast = Tokenizer.from_file(TOKENIZER), bpe.Encoder(TOKENIZER), bpe.RankEncoder(TOKENIZER)
    rnd = random.Random(1)
    alphabet = " \n\t\r\x0b\x1c\x85\xa0 'stremdlvaAé1٣²½中́𝟘😀.,<|>_Ɤ꟎"
    cases = [t for _, t in texts(docs)] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(3000)] + ["", "a<|endoftext|>b<|endoftext|>", "<|unit|> x", "x" * 3000, "   ", "a \n \n b"]
    expected = [x.ids for x in lib.encode_batch(cases, add_special_tokens=False)]
    assert [np.frombuffer(enc.encode(x), "<u4").tolist() for x in cases] == expected
    assert [np.frombuffer(x, "<u4").tolist() for x in fast.encode_many(cases)] == expected
    assert all(enc.decode(i) == lib.decode(i, skip_special_tokens=False) for i in expected)
    some = [[rnd.randrange(50257) for _ in range(5)] for _ in range(300)]
    assert all(enc.decode(i) == lib.decode(i, skip_special_tokens=False) for i in some)


def test_round_trip(spark, docs, odd):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    for df in (docs, odd, docs.limit(0)):
        rows = tokens.round_trip(df, TOKENIZER).collect()
        assert len(rows) == df.count()
        assert Counter(r.decoded_sha256 for r in rows) == Counter(hashlib.sha256(t.encode()).hexdigest() for _, t in texts(df))
        coded = [(d, lib.encode(t, add_special_tokens=False).ids) for d, t in texts(df)]
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows) == Counter((d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, i in coded)
    coded = tokens.encode(odd, TOKENIZER)
    assert Counter(r.text for r in tokens.decode(coded, TOKENIZER).collect()) == Counter(t for _, t in texts(odd))


# --- packing -----------------------------------------------------------------------------------------------------------


def brute_fill(room, counts):
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
    return max(sums)


def test_fill_is_the_closest_sum():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 40): rnd.randint(1, 4) for _ in range(rnd.randint(0, 6))}
        room = rnd.randint(0, 90)
        got = packing.fill(room, counts)
        assert sum(x * n for x, n in got.items()) == brute_fill(room, counts)
        assert all(n <= counts[x] for x, n in got.items())


def test_plan_uses_the_counts_up():
    rnd = random.Random(3)
    counts = {rnd.randint(1, 1024): rnd.randint(1, 500) for _ in range(300)} | {400: 20000}
    plan = packing.plan(counts)
    used = Counter()
    for pattern, times in plan:
        assert sum(x * n for x, n in pattern.items()) <= 1024
        for x, n in pattern.items():
            used[x] += n * times
    assert used == Counter(counts)


def test_packing(spark, docs, odd):
    enc = bpe.Encoder(TOKENIZER)
    for df in (docs, odd, docs.limit(0)):
        rows = packing.pack_documents(df, TOKENIZER).collect()
        seqs = defaultdict(list)
        for r in rows:
            seqs[r.sequence_id].append((r.offset, r.length))
        for parts in seqs.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        sizes = Counter(len(enc.encode(t)) // 4 + 1 for _, t in texts(df))
        assert Counter(r.doc_tokens for r in rows if r.start == 0) == sizes
        assert sum(r.length for r in rows) == sum(k * n for k, n in sizes.items())
        # Pieces tile each document's ids, in order, and hold them.
        expected = Counter()
        for d, t in texts(df):
            ids = enc.encode(t) + (0).to_bytes(4, "little")
            expected.update((d, at, min(1024, len(ids) // 4 - at), zlib.crc32(ids[4 * at : 4 * (at + 1024)]), len(ids) // 4) for at in range(0, len(ids) // 4, 1024))
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
        # Little padding: hardly more sequences than the ids fill.
        total = sum(r.length for r in rows)
        assert len(seqs) <= -(-total // 1024) + 3


# --- near-duplicates ---------------------------------------------------------------------------------------------------


def linked(values, near):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in near(i):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def plain_fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text.translate(table))]
    if not words:
        return 0
    runs = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, docs, odd):
    for df in (docs, odd, docs.limit(0)):
        rows = simhash.near_duplicates(df).collect()
        known = texts(df)
        order = sorted(range(len(known)), key=lambda i: (known[i][0] is None, known[i][0] or 0))
        known = [known[i] for i in order]
        fps = np.array([plain_fingerprint(t) for _, t in known], np.uint64)
        roots = linked(fps, lambda i: np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3))
        expected = sorted(((i, f"{int(f):016x}", known[r][0]) for (i, _), f, r in zip(known, fps, roots, strict=True)), key=repr)
        assert sorted((tuple(r) for r in rows), key=repr) == expected


@pytest.mark.parametrize("bucket", [16, 1024])
def test_hot_buckets_lose_no_link(spark, bucket):
    rng = np.random.default_rng(bucket)
    xs = set()
    for b in rng.integers(0, 2**63, 2, dtype=np.uint64):
        for _ in range(250):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            xs.add(x)
    xs = np.array(sorted(xs), np.uint64)
    scratch = Scratch(spark, "test")
    df = spark.createDataFrame([(simhash._signed(int(x)),) for x in xs], "fp long")
    found = components.components(simhash.links(df, scratch, 3, bucket), scratch).collect()
    groups, expected = defaultdict(set), defaultdict(set)
    for r in found:
        groups[r.component].add(r.node)
    for x, r in zip(xs, linked(xs, lambda i: np.flatnonzero(np.bitwise_count(xs ^ xs[i]) <= 3)), strict=True):
        expected[r].add(simhash._signed(int(x)))
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in expected.values() if len(g) > 1}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(None, 3), (7, 7)]
    scratch = Scratch(spark, "test")
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    nodes = sorted(near)
    roots = linked(nodes, lambda i: [nodes.index(b) for b in near[nodes[i]]])
    assert found == {n: nodes[r] for n, r in zip(nodes, roots, strict=True)}
    assert components.components(spark.createDataFrame([], "u long, v long"), scratch).count() == 0


def test_similar_texts_are_found_and_others_left_alone(spark, odd):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for g in range(60):
        base = [rnd.choice(vocabulary) for _ in range(400)]
        rows.append((10 * g, " ".join(base)))
        for k, edits in ((1, 3), (2, 6), (3, 200)):  # about 0.93, 0.86 and 0.1 alike
            copy = list(base)
            for at in rnd.sample(range(400), edits):
                copy[at] = rnd.choice(vocabulary)
            rows.append((10 * g + k, " ".join(copy)))
    kept = {r.doc_id for r in similar.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {10 * g for g in range(60)} <= kept and {10 * g + 3 for g in range(60)} <= kept
    assert len(kept) <= 122
    one = similar.keep_one(odd).select(DOCS_COLUMNS).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:5]) for r in one) == sorted([(False, 1, "a b c"), (False, 2, ""), (True, 0, "a b c"), (False, 4, "w0 w1"), (False, 6, "é ß x"), (False, 7, "other")])
    assert similar.keep_one(odd.limit(0)).count() == 0


def test_similar_texts_are_linked_from_the_threshold_on(spark):
    """Pairs at exactly 0.75, 0.8 and 0.82: ``common`` of ``n`` shingles in each text."""
    for n, common, least, most in ((182, 156, 0, 0), (180, 160, 59, 60), (182, 164, 59, 60)):
        rows = []
        for g in range(60):
            base = [f"n{n}c{common}g{g}w{i}" for i in range(n + 4)]
            rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: common + 4] + [f"{x}new" for x in base[common + 4 :]]))]
        kept = {r.doc_id for r in similar.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert {2 * g for g in range(60)} <= kept
        assert least <= 120 - len(kept) <= most


def brute_similar(known):
    """Least ids of the components of all pairs whose sets of five-word shingles are 0.8 alike."""
    sets = []
    for _, t in known:
        w = t.encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = linked(known, lambda i: [j for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    least = {}
    for (d, _), g in zip(known, group, strict=True):
        least[g] = min(least.get(g, d), d)
    return set(least.values())


@pytest.mark.parametrize("cell", [2, 512])
def test_similar_groups_equal_brute_force(spark, docs, cell):
    """Chains of growing edits: members are similar to some of their group only; cells of two parts split every bucket."""
    rnd = random.Random(9)
    rows = []
    for _ in range(6):
        text = [f"c{rnd.randrange(500)}" for _ in range(300)]
        for _ in range(12):
            text = list(text)
            for at in rnd.sample(range(300), rnd.choice([1, 4, 9, 14])):
                text[at] = f"c{rnd.randrange(500)}"
            rows.append((len(rows), " ".join(text)))
    known = rows + [(1000 + i, t) for i, t in texts(docs)]
    got = {r.doc_id for r in similar.representatives(spark.createDataFrame(known, "doc_id long, text string"), cell=cell).collect()}
    assert got == brute_similar(known)


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# --- sketches ----------------------------------------------------------------------------------------------------------


def test_sketches_merge_and_estimate():
    rnd = random.Random(6)
    words = [f"q{rnd.randint(0, 10**6)}" for _ in range(6000)]
    whole, part, joined = " ".join(words), " ".join(words[:600]), sketch.sketch(" ".join(words[:3000]))
    a, b = sketch.sketch(whole), sketch.sketch(part)
    assert sketch.containment(b, a) == 1.0 and sketch.containment(a, b) == pytest.approx(0.1, abs=0.03)
    merged = sketch.merge(joined, sketch.sketch(" ".join(words[2996:])))
    assert np.array_equal(merged, a)
    assert np.array_equal(sketch.from_text(sketch.as_text(a)), a)
    assert len(sketch.sketch("one two")) == 1 and not len(sketch.sketch(" \n"))


def test_edited_neighbours(spark, docs, odd):
    shingles = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(t.encode().split())
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for df in (docs, odd, docs.limit(1), docs.limit(0)):
        known = sorted(texts(df), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
        rows = sketch.compare_edited(df).collect()
        expected, errors = [], []
        found = {(r.doc_id, r.edited_sha256): r for r in rows}
        for i, (d, t) in enumerate(known):
            e = sketch.edited(t, known[(i + 1) % len(known)][1])
            h = hashlib.sha256(e.encode()).hexdigest()
            expected.append((d, len(t), h))
            mine, edit, after = sketch.sketch(t), sketch.sketch(e), sketch.sketch(known[(i + 1) % len(known)][1])
            r = found[d, h]
            assert (r.fingerprint, r.edited_fingerprint) == (sketch.as_text(mine), sketch.as_text(edit))
            assert (r.near_edited, r.near_next, r.held_by_edited) == (sketch.resemblance(mine, edit), sketch.resemblance(mine, after), sketch.containment(mine, edit))
            if len(t) > 2000:
                errors.append(abs(found[d, h].near_edited - like(shingles(t), shingles(e))))
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=repr) == sorted(expected, key=repr)
        assert not errors or np.mean(errors) < 0.05
        # Equal texts have equal fingerprints.
        by_text = defaultdict(set)
        for (d, t), r in zip(known, sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0))), strict=True):
            by_text[t].add(r.fingerprint) if df is docs else None
        assert all(len(x) == 1 for x in by_text.values())


# --- quality -----------------------------------------------------------------------------------------------------------


def test_machine_uses_the_identity():
    rng = np.random.default_rng(7)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 3)))
    i, x = np.array([3, 99, 2000]), np.array([0.5, 2.0, -1.0])
    pairs = sum(m.vectors[i[a]] @ m.vectors[i[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert m.margin(i, x) == pytest.approx(0.3 + m.weights[i] @ x + pairs)


def test_classifier_is_right_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    machine = quality.learn(d, labels)
    rows = quality.classify(d, machine).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    scored = quality.classify(odd, machine).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.classify(d.limit(0), quality.learn(d.limit(0), labels.limit(0))).count() == 0
    assert quality.classify(d.limit(2), quality.learn(d, labels.limit(0))).first().score == 0.5


# --- archives ----------------------------------------------------------------------------------------------------------


def test_archives(spark):
    html = "<p>é</p>\r\n\r\nWARC/1.1\r\n" + "x" * 1000
    rows = [(1, "http://a b\n", html), (2, None, html), (None, "u", html), (3, "u", None), (4, "u", ""), (2, "u", html), (9, "z", "x" * 999), (10, "z", "x" * 999), (5, "v", "y" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record_type": F.lit("clash"), "original": F.lit(0)})
    out = sorted((tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    assert out == sorted([(1, 1023, "revisit", 2), (2, 1023, "response", None), (None, 1023, "revisit", 2), (3, 0, "response", None), (4, 0, "response", None), (2, 1023, "response", None), (9, 999, "response", None), (10, 999, "response", None), (5, 200_000, "response", None)], key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0
    scratch = Scratch(spark, "test")
    warc.write(warc.resolve(df), scratch.path("w"))
    read = warc.read(spark, scratch.path("w")).collect()
    assert Counter(bytes(r.payload).decode() for r in read if r.record_type == "response") == Counter([html, html, "", "", "x" * 999, "x" * 999, "y" * 200_000])


@pytest.mark.parametrize("few", [0, 1000])
def test_archive_files(spark, monkeypatch, tmp_path, few):
    """Many copies of a payload, more records than a file holds, records of over 16 MB; each record is a gzip member after the file's own."""
    import gzip
    import io

    monkeypatch.setattr(warc, "RECORDS", 50)
    monkeypatch.setattr(warc, "FEW", few)
    monkeypatch.setattr(warc, "BYTES", 30_000)
    rnd = random.Random(3)
    rows = [(i, f"http://x/{i}", "c" * 2000) for i in range(300)] + [(1000 + i, "u", "".join(rnd.choices("abcdef", k=9000))) for i in range(40)] + [(2000, "big", "b" * (17 << 20))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3, "page_id")
    warc.write(warc.resolve(df, date="2020-01-02T03:04:05Z"), str(tmp_path / "w"), "2020-01-02T03:04:05Z")
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 7
    seen = Counter()
    for f in files:
        data = f.read_bytes()
        records = list(warc.parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data)))))
        assert [h["warc-type"] for h, _ in records].index("warcinfo") == 0 and sum(h["warc-type"] == "warcinfo" for h, _ in records) == 1
        assert len(records) <= 50 and (len(data) < 60_000 or len(records) < 20)
        for h, _ in records:
            seen[h["warc-type"]] += 1
            if h["warc-type"] == "revisit":
                assert (h["warc-refers-to-target-uri"], h["warc-refers-to-date"]) == ("http://x/299", "2020-01-02T03:04:05Z")
        at, members = 0, 0
        while at < len(data):
            d = zlib.decompressobj(31)
            out = d.decompress(data[at:])
            members += out.startswith(b"WARC/1.1") and out.endswith(b"\r\n\r\n")
            at = len(data) - len(d.unused_data)
        assert members == len(records)
    assert (seen["response"], seen["revisit"]) == (42, 299)
    back = warc.resolve_read(warc.read(spark, str(tmp_path / "w"), payload=False)).collect()
    assert Counter(r.refers_to for r in back) == {None: 42, 299: 299} and {r.payload_bytes for r in back} == {2000, 9000, 17 << 20}


def test_archive_parser_rejects_what_is_none():
    import io

    for bad in (b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


# --- language model ----------------------------------------------------------------------------------------------------


def test_backoff(spark, docs, odd):
    long = spark.createDataFrame([(i, " ".join(f"w{(j * j + i) % 97}" for j in range(60_000 if i == 3 else 40))) for i in range(12)], "doc_id long, text string")
    for df, block in ((docs.filter("doc_id < 120"), 60_000), (odd, 1 << 20), (long, 5_000), (docs.limit(0), 100)):
        got = backoff.scores(df, block=block).collect()
        known = texts(df)
        counts, own = [Counter() for _ in range(4)], []
        for _, t in known:
            w = t.encode().split()
            own.append([None, *(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for n in (1, 2, 3))])
            for n in (1, 2, 3):
                counts[n].update(own[-1][n])
        total = sum(counts[1].values())
        expected = []
        for (d, t), mine in zip(known, own, strict=True):
            w, score = t.encode().split(), 0.0
            for k in range(len(w)):
                top = min(3, k + 1)
                for n in range(top, 0, -1):
                    g = tuple(w[k - n + 1 : k + 1])
                    c = counts[n][g] - mine[n][g]
                    if n == 1:
                        score += math.log(max(c, 1) / max(total - len(w), 1)) + (top - 1) * math.log(0.4)
                    elif c > 0:
                        score += math.log(c / (counts[n - 1][g[:-1]] - mine[n - 1][g[:-1]])) + (top - n) * math.log(0.4)
                        break
            expected.append((repr(d), len(w), pytest.approx(score, rel=1e-9, abs=1e-9)))
        assert sorted(((repr(r.doc_id), r.n_words, r.log_total) for r in got)) == sorted(expected, key=lambda x: (x[0], x[1], x[2].expected))
        assert all(r.score == pytest.approx(r.log_total / max(r.n_words, 1)) for r in got)


# --- nearest neighbours ------------------------------------------------------------------------------------------------


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    u = np.stack(p["embedding"]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = p["vec_id"].to_numpy()
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hits = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        best = ids[np.argsort(-s)[:5]].tolist()
        rows = got[ids[q]]
        assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and all(r.score == pytest.approx(s[list(ids).index(r.vec_id)]) for r in rows)
        hits += len(set(best) & {r.vec_id for r in rows})
        n += 5
    assert hits / n >= 0.9


def test_recall_beyond_a_few_lists(spark):
    """20,000 vectors without clusters: 39 lists, and the nearest lie in any of them."""
    u = np.random.default_rng(3).standard_normal((20_000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(u.tolist())), "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.search(df, F.col("vec_id") % 200 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(u), 200):
        s = u @ u[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 500 >= 0.9, hits / 500


def test_odd_vectors(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [inf, 1.0]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (7, [1.0, 1.0]), (None, [1.0, 2.0]), (8, [1.0]), (6, [2.0, 0.0]), (50, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "list": F.lit(2)})
    out = neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in out] == [(0, 1, 6), (0, 2, 6), (0, 3, 50), (0, 4, 7), (50, 1, 0), (50, 2, 6), (50, 3, 6), (50, 4, 7)]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_queries_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), *((i, [math.cos(i / 4), math.sin(i / 4)]) for i in range(1, 7))]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    got = sorted((r["rank"], r.vec_id) for r in out)
    assert [x for x, _ in got] == sorted([1, 2, 3, 4, 5] * 2)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (1, 6), (2, 5), (3, 4), (4, 3), (5, 2)])
    out = neighbours.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in out) == [(1, 1), (1, 1), (2, 50), (2, 50)]  # each is a candidate for the other


def test_very_large_and_small_components(spark):
    rows = [(50, [1e200, 1e200]), (1, [1e-200, 2e-200]), (2, [3.0, 3.0]), (3, [-1e300, 1e300]), (4, [5e-324, 0.0]), (5, [1e308, -1e308])]
    out = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 9)) for r in out] == [(2, 1.0), (1, round(3 / math.sqrt(10), 9)), (4, round(math.sqrt(0.5), 9)), (3, 0.0), (5, 0.0)]


@pytest.mark.parametrize("part, group", [(64, 4), (300, 1)])
def test_hot_lists_and_groups_lose_nothing(spark, monkeypatch, part, group):
    """Most vectors in one cluster: its list is cut into parts, and the queries into groups."""
    monkeypatch.setattr(neighbours, "PART", part)
    monkeypatch.setattr(neighbours, "GROUP", group)
    monkeypatch.setattr(neighbours, "PER_LIST", 100)
    rnd = np.random.default_rng(2)
    v = rnd.standard_normal((1500, 16)) * 0.2 + np.where(np.arange(1500)[:, None] % 10 > 0, 1.0, rnd.standard_normal((1500, 16)))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in neighbours.search(spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits / 150 >= 0.9


# --- repeated passages -------------------------------------------------------------------------------------------------


def brute_repeats(known, w=50):
    first, ws = {}, []
    for d, t in known:
        ws.append(t.encode().split())
        for k in range(len(ws[-1]) - w + 1):
            key = tuple(ws[-1][k : k + w])
            first[key] = min(first.get(key, math.inf), math.inf if d is None else d)
    out = []
    for (d, _), x in zip(known, ws, strict=True):
        lost = [False] * len(x)
        for k in range(len(x) - w + 1):
            if first[tuple(x[k : k + w])] < (math.inf if d is None else d):
                lost[k : k + w] = [True] * w
        out.append((d, len(x), sum(lost), hashlib.sha256(b" ".join(a for a, gone in zip(x, lost, strict=True) if not gone)).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(spark, docs, odd):
    rnd = random.Random(8)
    made = []
    for _ in range(100):
        t = []
        for _ in range(rnd.randint(0, 6)):
            q = rnd.randint(0, 4)
            t += [f"w{(q * 37 + k) % 90 if q else 1}" for k in range(rnd.randint(1, 40))]
        made.append((rnd.choice([None, *range(60)]), rnd.choice([" ", "\n", " \t"]).join(t)))
    for df in (docs, odd, spark.createDataFrame(made, "doc_id long, text string"), docs.limit(0)):
        got = sorted((tuple(r) for r in repeats.digests(repeats.remove(df)).collect()), key=repr)
        assert got == brute_repeats(texts(df))


@pytest.mark.parametrize("shard", [1, 3])
def test_hot_anchors_are_dealt_to_many_shards(spark, docs, monkeypatch, shard):
    """Passages in nearly all documents, in the same and in differing contexts, and the driver's documents."""
    monkeypatch.setattr(repeats.repeated, "__defaults__", (repeats.WINDOW, repeats.PHRASE, (), shard))
    rnd = random.Random(4)
    passages = [[f"p{k}x{i}" for i in range(60)] for k in range(2)] + [[f"q{i}" for i in range(30)]]
    made = []
    for d in range(80):
        own = lambda n: [f"own{rnd.randrange(4)}" for _ in range(n)]
        made.append((d, " ".join(own(30) + rnd.choice(passages) + own(30) + rnd.choice(passages))))
    for df in (docs, spark.createDataFrame(made, "doc_id long, text string")):
        got = sorted((tuple(r) for r in repeats.digests(repeats.remove(df)).collect()), key=repr)
        assert got == brute_repeats(texts(df))


def test_removal_keeps_line_breaks(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\nb {passage}\tc\nd"), (2, f"e\n\nf {passage}\ng  h\n"), (3, f"i\nj\n{passage}\n"), (4, passage)]
    assert {r.doc_id: r.text for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: rows[0][1], 2: "e\n\nf g  h\n", 3: "i\nj", 4: ""}


def test_matches_of_the_automaton_decide(spark, monkeypatch):
    """Without its matches nothing is located, so nothing goes."""
    import pyarrow as pa

    row = {"h": 1, "parts": 1, "salt": 0, "segment": " ".join(f"w{i}" for i in range(50)).encode(), "at": 3}
    kinds = pa.schema([("h", pa.int64()), ("parts", pa.int32()), ("salt", pa.int32()), ("lo", pa.int64()), ("segment", pa.binary()), ("at", pa.int32()), ("refs", pa.list_(pa.struct([("id", pa.int64()), ("tk", pa.int64()), ("starts", pa.list_(pa.int32()))])))])
    batch = pa.RecordBatch.from_pylist([row | {"lo": i, "refs": [{"id": i, "tk": 0, "starts": [7]}]} for i in (1, 2)], kinds)
    cuts = [r for out in repeats._shard(50, 26)(iter([batch])) for r in out.to_pylist()]
    assert [(r["id"], r["a"], r["b"]) for r in cuts] == [(2, [7], [57])]

    class Blind(list):
        add_word = lambda self, word, value: self.append(word)
        make_automaton = lambda self: None
        iter = lambda self, text: iter(())

    monkeypatch.setattr(repeats.ahocorasick, "Automaton", Blind)
    assert [r for out in repeats._shard(50, 26)(iter([batch])) for r in out.to_pylist()] == []


@pytest.mark.parametrize("rows_at_once", [1, 3, 4096])
def test_slices_carry_an_anchor_over(docs, monkeypatch, rows_at_once):
    """The shard's work is the same however its sorted segments are sliced."""
    import pyarrow as pa

    monkeypatch.setattr(repeats, "SLICE", rows_at_once)
    known = texts(docs)
    hs = [[{"h": h, "parts": 1} for h in np.unique(repeats.anchors(repeats.word_hashes(t.encode()), 50, 26)[0]).view(np.int64).tolist()] for _, t in known]
    batch = pa.record_batch([pa.array([d for d, _ in known]), pa.array([0] * len(known)), pa.array([t for _, t in known]), pa.array(hs, pa.list_(pa.struct([("h", pa.int64()), ("parts", pa.int32())])))], names=["id", "tk", "text", "hs"])
    cut = [batch.slice(at, 40) for at in range(0, len(known), 40)]
    table = pa.Table.from_batches(list(repeats._segments(50, 26)(iter(cut)))).sort_by([("h", "ascending"), ("lo", "ascending")])
    lost = defaultdict(set)
    for out in repeats._shard(50, 26)(iter(table.combine_chunks().to_batches())):
        for r in out.to_pylist():
            for a, b in zip(r["a"], r["b"], strict=True):
                lost[r["id"]] |= set(range(a, b))
    assert {d: len(lost[d]) for d, _ in known} == {r[0]: r[2] for r in brute_repeats(known)}


# --- licences ----------------------------------------------------------------------------------------------------------


def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, apache = licences.TEMPLATES["MIT"][1], licences.TEMPLATES["Apache-2.0"][1]
    rows = [("a/LICENSE", mit), ("a/b/x.py", "code\nno words"), ("a/b/c/LICENCE.txt", f"# {apache}\n"), ("a/b/c/d/y.py", ""), ("a/b/c/d/z.py", f"x\n{mit.upper()}"), ("q/w.py", None), ("LICENSE", "All rights reserved"), (None, mit), ("a/b/x.py", "code\nno words"), ("ab/x.py", "plain")]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({"licence": F.lit("clash"), "line": F.lit("clash"), "best": F.lit("clash"), "home": F.lit("clash")})
    out = {(r.path, r.own_licence, r.licence, r.inherited_from) for r in licences.scan(df).collect()}
    assert out == {("a/LICENSE", "MIT", "MIT", None), ("a/b/x.py", None, "MIT", "a"), ("a/b/c/LICENCE.txt", "Apache-2.0", "Apache-2.0", None), ("a/b/c/d/y.py", None, "Apache-2.0", "a/b/c"), ("a/b/c/d/z.py", "MIT", "MIT", None), ("q/w.py", None, None, None), ("LICENSE", None, None, None), (None, None, None, None), ("ab/x.py", None, None, None)}
    assert licences.scan(df).count() == len(rows)
    assert licences.scan(df.limit(0)).count() == 0


def test_texts_that_are_not_the_templates(spark):
    """Wrapped headers, identifiers, titles, whole licences, and statements within lines; none of them a template."""
    mit = licences.TEMPLATES["MIT"][4].split()
    rows = [
        ("mpl line", "This Source Code Form is subject to the terms of the Mozilla Public", "MPL-2.0"),
        ("bsd line", "Use of this source code is governed by a BSD-style", "BSD-3-Clause"),
        ("mit line", "x\nReleased under the MIT.", "MIT"),
        ("plain", "the cat is in the house and this is all there is to say", None),
        ("wrapped", "# Licensed under the Apache\n# License, Version 2.0 (the \"License\");\n# and more here\n\nimport os", "Apache-2.0"),
        ("wrapped sentence", "A tool to count things. Licensed under the Apache\nLicense, Version 2.0. It runs anywhere you like.", "Apache-2.0"),
        ("within a line", "The parser of that grammar, fast and small. Released under the MIT License. Patches are welcome at any time.", "MIT"),
        ("spdx mit", "// SPDX-License-Identifier: MIT\npackage main", "MIT"),
        ("spdx apache", "# SPDX-License-Identifier: Apache-2.0\n", "Apache-2.0"),
        ("spdx gpl", "/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"),
        ("unknown identifier", "SPDX-License-Identifier: EUPL-1.2", None),
        ("gpl title", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0"),
        ("gpl2 title", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
        ("bsd title", "BSD 3-Clause License\n\nCopyright (c) 2020, A. Uthor", "BSD-3-Clause"),
        ("apache title", "                                 Apache License\n                           Version 2.0, January 2004", "Apache-2.0"),
        ("mit body", "Copyright (c) 2021 A. Uthor\n\n" + "\n".join(" ".join(mit[i : i + 11]) for i in range(0, len(mit), 11)), "MIT"),
        ("gpl header", " * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version.\n */", "GPL-2.0"),
        ("one term", "MIT", None),
        ("no name", "This work is licensed under the License", "LicenseRef-other"),
        ("null", None, None),
    ]
    out = {r.path: r.own_licence for r in licences.scan(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()}
    assert out == {r[0]: r[2] for r in rows}


def test_no_passage_left_out_could_match(spark):
    """Of each template, what the everyday terms hold is below the threshold; and passages at it are reachable."""
    tells, held = set(licences.telling()), Counter()
    for i, _, t, w, _ in licences.vectors():
        held[i] += 0 if t in tells else w * w
    assert max(held.values()) < licences.THRESHOLD**2
    rnd, rows = random.Random(2), []
    for text in (v for vs in licences.TEMPLATES.values() for v in vs):
        for _ in range(12):
            words = [w for w in text.split() if rnd.random() < 0.8] * rnd.choice([1, 1, 3]) + [f"x{rnd.randrange(99)}" for _ in range(rnd.randrange(1 + len(text.split()) // 4))]
            rnd.shuffle(words)
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "id long, passage string")
    at = {r.key for r in licences.match(df.withColumnRenamed("id", "key"), "key").collect()}
    left = {r.id for r in licences.passages(df.withColumnRenamed("passage", "text"), "id").collect()}
    assert len(at) > 150 and at <= left


def test_licence_scan_is_native(spark):
    plan = QUERIES["op1_license_scan"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


# --- queries and the pipeline ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    r = con.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(x[names.index(c)] for c in df.columns) for x in r.fetchall()) == Counter(tuple(x) for x in df.collect())


def test_pipeline(spark):
    import corpus_pipeline as P

    rows = P.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = P.good_quality(spark, docs, SF)
    assert good.columns == list(P.COLUMNS)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in good.collect()}
    assert np.mean([(d in left) == bool(q) for d, q in labels.items()]) > 0.9
    one = P.near_dedup(spark, good, SF)
    assert one.columns == list(P.COLUMNS) and {r.doc_id for r in one.collect()} <= left
    cut = P.substring_dedup(spark, one, SF)
    assert cut.columns == list(P.COLUMNS)
    again = {r[0]: r for r in brute_repeats(texts(one))}
    for r in cut.collect():
        assert hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() == again[r.doc_id][3] or not r.text.isascii()
        assert r.n_chars == len(r.text) or again[r.doc_id][2] == 0
    assert {r.doc_id for r in rows} == {r.doc_id for r in cut.collect()}
