"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are normalised, rotated by a random orthogonal matrix and assigned to the lists of a coarse quantiser, which is
fitted on a bounded sample. How many lists a query visits is measured, not assumed: for some of the queries the nearest
rows of the whole table are found in one pass, and as many lists are probed as hold ``SHARE`` of those, in the order of
their centroids. With clusters these are few; without any, a neighbour may lie in most of them. Within a list the rotated
vectors lie in blocks of columns: the scan adds up squared distances block by block, and after each one tests the
hypothesis that the full distance is still below that of the fifth nearest found so far. For a random rotation the partial
distance over d of D columns, scaled by D/d, is within a factor 1 +- epsilon/sqrt(d) of the full one with high
probability; candidates beyond that are abandoned. Those that last are scored exactly, in double precision, on the
original vectors.

Lists are cut into parts of bounded size, and a list's queries into groups, so a hot list is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.common import Scratch

#: Vectors that the quantiser is fitted on, at most.
SAMPLE = 16_384
#: Vectors in a part of a list and queries in a group, at most about.
PART, GROUP = 4096, 1 << 16
#: Vectors per list aimed at, and lists at most.
PER_LIST, LISTS = 512, 1024
#: Queries whose nearest rows are found by brute force, and the share of those that the probed lists are to hold.
TUNE, SHARE = 256, 0.97
COLUMNS = 16
#: How sure the test is: larger abandons later.
EPSILON = 2.1


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of ``lists`` clusters of the rows of ``sample`` (unit vectors), by k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        for k in range(len(centres)):
            mine = sample[nearest == k]
            if len(mine):
                centres[k] = mine.mean(0)
                centres[k] /= max(np.linalg.norm(centres[k]), 1e-12)
    return centres


def scan(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, at_row: np.ndarray, own: np.ndarray, q_full: np.ndarray, v_full: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON):
    """For each query the ``k`` nearest rows of one part as (row, score); ``queries`` and ``vectors`` are rotated unit vectors.

    Rows are taken in slices; the first slice sets the distance to beat. Ties go to the smaller id, and the row of
    ``at_row`` that is a query's ``own`` is never its candidate.
    """
    dim, step = vectors.shape[1], max(64, 16 * k)
    blocks = [np.ascontiguousarray(vectors[:, c : c + columns]) for c in range(0, dim, columns)]
    norms = np.sqrt((v_full * v_full).sum(1))
    out = []
    for q, me, full in zip(queries, own, q_full, strict=True):
        best_rows, best_scores, beat = np.empty(0, np.int64), np.empty(0), np.inf
        size = np.sqrt((full * full).sum())
        at = 0
        while at < len(ids):
            to = min(len(ids), at + step)
            rows = np.arange(at, to)
            at, step = to, min(2 * step, 1024)
            rows = rows[at_row[rows] != me]
            part = np.zeros(len(rows), np.float32)
            for b, block in enumerate(blocks):
                d = min((b + 1) * columns, dim)
                diff = block[rows] - q[b * columns : d]
                part += np.einsum("ij,ij->i", diff, diff)
                if beat < np.inf:
                    slack = 1.0 if d == dim else (1 + epsilon / np.sqrt(d)) ** 2
                    stay = part * (dim / d) <= beat * slack + 1e-5
                    if not stay.all():
                        rows, part = rows[stay], part[stay]
                if not len(rows):
                    break
            if not len(rows):
                continue
            scores = (v_full[rows] * full).sum(1) / (norms[rows] * size)
            all_rows, all_scores = np.concatenate([best_rows, rows]), np.concatenate([best_scores, scores])
            order = np.lexsort((ids[all_rows], -all_scores))[:k]
            best_rows, best_scores = all_rows[order], all_scores[order]
            if len(order) == k:
                beat = 2 - 2 * best_scores[-1]  # squared distance of unit vectors
        out.append((best_rows, best_scores))
    return out


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component to about one: cosines stay, squares don't overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = _scaled(vectors)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``row, vec_id, v``: rows that take part, those of the commonest length (the longer of equals) with no null, infinite or zero vector."""
    v = F.col(vector).cast("array<double>")
    whole = F.col(id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(whole).select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("vec_id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("v") == (size["size"] if size else 0))


def probes(asked: DataFrame, lists_of: DataFrame, turn: np.ndarray, centres: np.ndarray, k: int, tune: int = TUNE, share: float = SHARE) -> int:
    """How many lists hold ``share`` of the nearest rows of ``tune`` queries, in the order in which these would visit them.

    One pass over all vectors: a task keeps ``k`` rows for each of these queries, and ``tune`` times ``k`` rows reach the driver.
    """
    sample = asked.orderBy(F.xxhash64("row", F.lit(9)), "row").limit(tune).select("row", "v").toPandas()
    if not len(sample) or len(centres) == 1:
        return 1
    unit, own = _unit(np.stack(sample["v"])), sample["row"].to_numpy()
    shared = asked.sparkSession.sparkContext.broadcast((unit, own))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, own = shared.value
        scores, lists = np.full((len(own), 0), -2.0), np.empty((len(own), 0), np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            s = unit @ _unit(np.stack(pdf["v"])).T
            s[own[:, None] == pdf["row"].to_numpy()] = -2
            scores, lists = np.hstack([scores, s]), np.hstack([lists, np.tile(pdf["list"].to_numpy(), (len(own), 1))])
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            scores, lists = (np.take_along_axis(x, top, 1) for x in (scores, lists))
        q, _ = np.nonzero(scores > -2)
        yield pd.DataFrame({"q": q, "list": lists[scores > -2], "score": scores[scores > -2]})

    near = lists_of.mapInPandas(best, "q long, list int, score double")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "list")
    near = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).select("q", "list").toPandas()
    order = np.argsort(-(unit @ turn.T @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)[near["q"].to_numpy(), near["list"].to_numpy()]
    return int(np.sort(place)[max(0, int(np.ceil(share * len(place))) - 1)]) + 1 if len(place) else 1


def search(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest other rows by cosine, found in the lists it visits.

    ``is_query`` is a condition on ``vec_id``. Rows with a null id, an unusable vector or another length than most take
    no part. Repeated ids are rows of their own: each is a candidate for all other rows, and each that is a query has
    ranks from 1. Ties go to the smaller id. A query without other rows gives none; an empty table an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = scratch.table(usable(vectors, id, vector), "rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(LISTS, n // PER_LIST))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "row").limit(SAMPLE).toPandas()
    turn = rotation(len(sample["v"][0]))
    centres = fit_lists(_unit(np.stack(sample["v"])) @ turn.T, lists)
    shared = spark.sparkContext.broadcast((turn, centres))  # at most LISTS centroids

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, centres = shared.value
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(list=((_unit(np.stack(pdf["v"])) @ turn.T) @ centres.T).argmax(1))

    lists_of = scratch.table(rows.mapInPandas(assign, "row long, vec_id long, v array<double>, list int"), "lists")
    asked = lists_of.filter(is_query)
    visited = probes(asked, lists_of, turn, centres, k)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, centres = shared.value
        for pdf in batches:
            if len(pdf):
                order = np.argsort(-((_unit(np.stack(pdf["v"])) @ turn.T) @ centres.T), axis=1, kind="stable")[:, :visited]
                yield pdf.assign(visits=list(order.astype(np.int32)))[["row", "vec_id", "v", "visits"]]

    routed = scratch.table(asked.mapInPandas(route, "row long, vec_id long, v array<double>, visits array<int>"), "asked")
    visits = routed.select(F.explode("visits").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    sizes = F.broadcast(lists_of.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).join(visits, "list"))  # at most LISTS rows
    spread = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    deal = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    held = lists_of.join(sizes, "list").select("list", deal("parts").alias("part"), spread("group", "groups"), "row", "vec_id", "v")
    asking = routed.select("row", "vec_id", "v", F.explode("visits").alias("list")).join(sizes, "list").select("list", spread("part", "parts"), deal("groups").alias("group"), "row", "vec_id", "v")

    def visit(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(part):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype({"row": "int64", "query_id": "int64", "vec_id": "int64"})
        turn = shared.value[0]
        part = part.sort_values(["vec_id", "row"])
        q, v = _scaled(np.stack(queries["v"])), _scaled(np.stack(part["v"]))
        ids, at = part["vec_id"].to_numpy(), queries["row"].to_numpy()
        found = scan((_unit(q) @ turn.T).astype(np.float32), (_unit(v) @ turn.T).astype(np.float32), ids, part["row"].to_numpy(), at, q, v, k)
        times = [len(r) for r, _ in found]
        return pd.DataFrame({"row": np.repeat(at, times), "query_id": np.repeat(queries["vec_id"].to_numpy(), times), "vec_id": np.concatenate([ids[r] for r, _ in found]), "score": np.concatenate([s for _, s in found])})

    keys = ["list", "part", "group"]
    found = asking.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(visit, "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
