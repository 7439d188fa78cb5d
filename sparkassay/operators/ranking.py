"""Ranks, top-k, sampling, splitting and quotas.

Random choices order rows by ``sha1(seed|id)``, so they are the same on every cluster and in SQL. Ranks within strata that
hold a share of the table (sources, difficulties, all rows) are counted in pieces: ``spread_rank``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces that a stratum is cut into where it may be too large to be sorted by one task.
PIECES = 64


def last(*cols: tuple[str, str] | str) -> list[Column]:
    """Sort keys with nulls last in both directions: a name, or (name, "desc")."""
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else (F.col(c[0]).desc_nulls_last() if c[1] == "desc" else F.col(c[0]).asc_nulls_last()) for c in cols]


def rank(df: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each partition, with their rank ``rn``; Spark prunes before the shuffle."""
    return rank(df, by, order).filter(F.col("rn") <= k)


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, by, order, 1).drop("rn")


def join_strata(df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their stratum, nulls being a stratum like any other."""
    if not by:
        return df.crossJoin(small)  # one row
    renamed = small.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return df.join(renamed, reduce(and_, [df[c].eqNullSafe(renamed[f"_by_{c}"]) for c in by])).drop(*[f"_by_{c}" for c in by])


def spread_rank(df: DataFrame, by: list[str], order: list[Column], piece: Column, rank: str = "rn", size: str = "n") -> DataFrame:
    """Rank and size of each row's stratum without sorting a stratum in one task.

    ``piece`` cuts the order into consecutive pieces: a number that doesn't fall along it and depends on the row alone.
    Rows are ranked within their piece; what lies before it is a sum over the pieces' counts.
    """
    cut = df.withColumn("_piece", piece)
    counts = cut.groupBy(*by, "_piece").agg(F.count("*").alias("_rows"))
    part = Window.partitionBy(*by)  # a row for each piece
    first = counts.select(*by, "_piece", F.coalesce(F.sum("_rows").over(part.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_rows").over(part).alias(size))
    ranked = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(*order)))
    return join_strata(ranked, first, [*by, "_piece"]).withColumn(rank, F.col("_at") + F.col("_before")).drop("_piece", "_at", "_before")


def ranked_strata(df: DataFrame, by: list[str], order: list[tuple[str, str] | str], spread: bool = True) -> DataFrame:
    """``rn`` and ``n`` by the named columns, nulls last.

    With ``spread`` strata are cut into pieces of equal width in the leading column, which has to be a number to gain from it.
    """
    name, down = (order[0], False) if isinstance(order[0], str) else (order[0][0], order[0][1] == "desc")
    if not (spread and isinstance(df.schema[name].dataType, T.NumericType)):
        part = Window.partitionBy(*by)
        return df.withColumns({"rn": F.row_number().over(part.orderBy(*last(*order))), "n": F.count("*").over(part)})
    value = F.col(name).cast("double")
    ends = join_strata(df, df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")), by)
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((value - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PIECES)).otherwise(F.lit(0))
    piece = F.coalesce(PIECES - place if down else place, F.lit(PIECES + 1))
    return spread_rank(ends, by, last(*order), piece).drop("_lo", "_hi")


def thirds(df: DataFrame, by: list[str], order: list[tuple[str, str] | str], name: str = "difficulty_bucket") -> DataFrame:
    """easy, medium, hard by the middle of each row's rank within its partition."""
    place = (F.col("rn") - 0.5) / F.col("n")
    return ranked_strata(df, by, order).withColumn(name, F.when(place < 1 / 3, "easy").when(place < 2 / 3, "medium").otherwise("hard")).drop("rn", "n")


def ends(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """All rows of a partition of at most ``k``; else the first ``k - 1`` and the last (the first ``k`` if k < 3)."""
    part = Window.partitionBy(*by)
    ranked = df.withColumns({"rn": F.row_number().over(part.orderBy(*order)), "n": F.count("*").over(part)})
    keep = (F.col("rn") <= k) if k < 3 else (F.col("n") <= k) | (F.col("rn") <= k - 1) | (F.col("rn") == F.col("n"))
    return ranked.filter(keep)


def nearest_median(df: DataFrame, by: list[str], value: str, id: str, k: int) -> DataFrame:
    """The ``k`` rows of each partition nearest its median ``mid``, which is aggregated first: one row for each partition."""
    mids = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("mid"))
    with_mid = join_strata(df, mids, by).withColumn("gap", F.round(F.abs(F.col(value) - F.col("mid")), 9))
    return top_k(with_mid, by, last("gap", id), k)


def halves(df: DataFrame, by: list[str], order: list[tuple[str, str] | str], name: str = "tier", spread: bool = False) -> DataFrame:
    """The first ceil(n/2) of each partition are strong, the rest ordinary; a single row is ``singleton``. Tasks are small partitions; ``spread`` is for large ones."""
    ranked = ranked_strata(df, by, order, spread)
    return ranked.withColumn(name, F.when(F.col("n") == 1, "singleton").when(F.col("rn") <= F.ceil(F.col("n") / 2), "strong").otherwise("ordinary"))


def extremes(df: DataFrame, by: list[str], score: str, id: str, k: int) -> DataFrame:
    """The ``k`` highest of each partition, and the ``k`` lowest of those left."""
    ranked = rank(df, by, last((score, "desc"), id), "hi")
    high = ranked.filter(F.col("hi") <= k).withColumn("margin", F.lit("high")).withColumnRenamed("hi", "rn")
    low = top_k(ranked.filter(F.col("hi") > k).drop("hi"), by, last(score, id), k).withColumn("margin", F.lit("low"))
    return high.unionByName(low)


def alternate(df: DataFrame, by: list[str], order: list[Column], name: str = "swapped") -> DataFrame:
    return df.withColumn(name, F.pmod(F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1, F.lit(2)) == 1)


def cycle(base: DataFrame, position: str, n_base: int, n: int) -> DataFrame:
    """``n`` rows that repeat the base rows (``position`` from 0) in turn."""
    return base.sparkSession.range(n).select(F.col("id").alias("slot"), F.pmod("id", F.lit(n_base)).alias(position)).join(base, position)


def round_robin(df: DataFrame, by: list[str], bucket: str, order: list[Column], name: str = "turn") -> DataFrame:
    """Order within ``by`` that takes one row of each bucket a round, buckets in sorted order."""
    ranked = rank(df, [*by, bucket], order, "_round")
    return rank(ranked, by, last("_round", bucket), name).drop("_round")


def shuffle_key(seed: int | str, id: Column | str) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}|"), (F.col(id) if isinstance(id, str) else id).cast("string")))


def sample(df: DataFrame, by: list[str], id: str, k: int, seed: int) -> DataFrame:
    """At most ``k`` rows of each partition (nulls are one), in hash order."""
    return top_k(df.withColumn("_h", shuffle_key(seed, id)), by, last("_h", id), k).drop("_h")


def hash_piece(seed: int | str, id: Column | str) -> Column:
    """The first two digits of the shuffle key: 256 consecutive pieces of a hash order, of about the same size."""
    return F.conv(F.substring(shuffle_key(seed, id), 1, 2), 16, 10).cast("int")


def shuffled(df: DataFrame, id: str, seed: int, name: str = "pos") -> DataFrame:
    """A total order by hash."""
    return spread_rank(df, [], [shuffle_key(seed, id), F.col(id)], hash_piece(seed, id), name, "_n").drop("_n")


def split(df: DataFrame, by: list[str], id: str, seed: int, ratios: Mapping[str, float]) -> DataFrame:
    """``split`` by hash order within each stratum: floors of the shares, the last split takes the remainder."""
    ranked = spread_rank(df, by, [shuffle_key(seed, id), F.col(id)], hash_piece(seed, id), "_rn", "_n")
    names, edge, case = list(ratios), F.lit(0), None
    for s in names[:-1]:
        edge = edge + F.floor(F.col("_n") * F.lit(float(ratios[s])))
        here = F.col("_rn") <= edge
        case = F.when(here, s) if case is None else case.when(here, s)
    return ranked.withColumn("split", case.otherwise(names[-1])).drop("_rn", "_n")


def quota_report(df: DataFrame, taken: DataFrame, dims: DataFrame, by: list[str], quota: int) -> DataFrame:
    """``available, taken, shortfall`` for every combination of ``dims``, empty ones included."""
    have = df.groupBy(*by).agg(F.count("*").alias("available"))
    got = taken.groupBy(*by).agg(F.count("*").alias("taken"))
    return dims.join(have, by, "left").join(got, by, "left").na.fill(0, ["available", "taken"]).withColumn("shortfall", F.lit(quota) - F.col("taken"))


def all_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """All combinations of the values of two category columns."""
    return df.select(a).distinct().crossJoin(df.select(b).distinct())


def largest_remainder(counts: DataFrame, name: str, n: str, total: int) -> DataFrame:
    """``quota``: shares of ``total`` in proportion to ``n``, floors first, then one each by (fraction, raw, name) descending."""
    whole = counts.agg(F.sum(n).alias("_all"))
    raw = counts.crossJoin(F.broadcast(whole)).withColumn("raw", F.lit(float(total)) * F.col(n) / F.col("_all")).withColumn("base", F.floor("raw"))
    every = Window.partitionBy()  # one row for each group
    placed = raw.withColumns({"_left": F.lit(total) - F.sum("base").over(every), "_rn": F.row_number().over(Window.orderBy(F.desc(F.round(F.col("raw") - F.col("base"), 9)), F.desc("raw"), F.desc(name)))})
    return placed.withColumn("quota", F.col("base") + (F.col("_rn") <= F.col("_left")).cast("long")).drop("_left", "_rn", "_all")


def two_tier_fill(rows: DataFrame, by: list[str], tier: str, id: str, order: list[Column], k: int) -> DataFrame:
    """``k`` rows a partition: those of the strict tier (0) first, the relaxed tier (1) fills what is missing.

    A row may come in both tiers with different scores; the strict one counts. One shuffle for the choice of tier, one
    for the rank.
    """
    one = first_per_key(rows, [*by, id], last(tier))
    return top_k(one, by, [*last(tier), *order], k)


def balance(left: DataFrame, right: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Both cut to the smaller count, in order."""
    n = min(left.count(), right.count())
    return left.orderBy(*order).limit(n), right.orderBy(*order).limit(n)


def _nearest(anchors: DataFrame, pool: DataFrame, by: list[str], near: int) -> DataFrame:
    """For each anchor (``anchor_id, _v`` and ``by``) the ``near`` other pool rows (``_id, _v`` and ``by``) with the nearest value, ties to the smaller id.

    In order of value the nearest lie around the anchor, so only the few rows on either side of its place are joined to it.
    """
    below = Window.partitionBy(*by).orderBy("_v", "_kind", F.desc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*by).orderBy("_v", "_id")
    rows = pool.withColumn("_kind", F.lit(0)).unionByName(anchors.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    placed = rows.withColumn("_at", F.sum(1 - F.col("_kind")).over(below))
    sides = [
        (placed.filter("_kind = 0").select(*by, "_id", F.col("_v").alias("_pv"), "_at"), F.sequence(F.col("_at") - near, F.col("_at"))),
        (pool.withColumn("_at", F.row_number().over(above).cast("long")).select(*by, "_id", F.col("_v").alias("_pv"), "_at"), F.sequence(F.col("_at") + 1, F.col("_at") + near + 1)),
    ]
    found = None
    for side, places in sides:
        asked = placed.filter("_kind = 1").select(*by, "anchor_id", "_v", F.explode(places).alias("_at"))
        one = asked.join(side, [*by, "_at"]).filter(F.col("anchor_id") != F.col("_id")).select("anchor_id", "_id", F.abs(F.col("_pv") - F.col("_v")).alias("gap"))
        found = one if found is None else found.unionByName(one)
    return top_k(found, ["anchor_id"], last("gap", "_id"), near)


def matched_random(anchors: DataFrame, pool: DataFrame, levels: list[list[str]], id: str, value: str, seed: int, near: int = 5) -> DataFrame:
    """For each anchor another row of the pool: of the ``near`` ones with the nearest ``value``, one by hash.

    ``levels`` lists the columns that have to agree, strictest first and perhaps none at last; the first level with any
    candidate counts. Rows without an id, a value or a column of the level take no part in it. Anchors have distinct ids.
    """
    dims = sorted({c for level in levels for c in level})
    have = lambda df, names: df.filter(reduce(and_, [F.col(c).isNotNull() for c in names]))
    left = have(anchors.select(F.col(id).alias("anchor_id"), F.col(value).alias("_v"), *dims), ["anchor_id", "_v"])
    rows = have(pool.select(F.col(id).alias("_id"), F.col(value).alias("_v"), *dims), ["_id", "_v"])
    out = None
    for n, level in enumerate(levels):
        by = level or ["_all"]
        all_rows = lambda df: df.select("_v", df.columns[0], *level) if level else df.select("_v", df.columns[0], F.lit(0).alias("_all"))
        best = _nearest(have(all_rows(left), by), have(all_rows(rows), by), by, near).withColumn("level", F.lit(n))
        out = best if out is None else out.unionByName(best)
        left = left.join(best.select("anchor_id").distinct(), "anchor_id", "left_anti") if n + 1 < len(levels) else left
    part = Window.partitionBy("anchor_id")
    picked = out.withColumn("_n", F.count("*").over(part)).withColumn("_pick", F.pmod(F.conv(F.substring(shuffle_key(seed, "anchor_id"), 1, 8), 16, 10).cast("long"), F.col("_n")) + 1)
    return picked.filter("rn = _pick").select("anchor_id", F.col("_id").alias("match_id"), "gap", "level")


def running_mean(df: DataFrame, by: list[str], order: list[Column], value: str, n: int = 6, name: str = "recent_mean") -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - n, 0)))


def running_max(df: DataFrame, by: list[str], order: list[Column], value: str, name: str = "progress") -> DataFrame:
    """Progress that never moves back."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def signed_order(group: Column | str, descending: Mapping[str, bool], score: str) -> Column:
    """A key that sorts each group by score in its own direction."""
    g = F.col(group) if isinstance(group, str) else group
    case = F
    for name, down in descending.items():
        case = case.when(g == name, -F.col(score) if down else F.col(score))
    return case


def fallback_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first table; of each further one only those whose key is still missing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.join(out.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return out


def priority_union(parts: Mapping[str, DataFrame], key: str, order: list[Column] | None = None) -> DataFrame:
    """Union by name with ``origin``; of rows with one key that of the earliest table stays."""
    out = None
    for n, (name, df) in enumerate(parts.items()):
        tagged = df.withColumns({"origin": F.lit(name), "_p": F.lit(n)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return first_per_key(out, [key], [F.col("_p"), *(order or [])]).drop("_p")
