"""Statistical operators: z-scores, cut points, intervals, rank correlation, factorial effects and their tests."""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def weighted_z(df: DataFrame, weights: Mapping[str, float], name: str, by: list[str] | None = None) -> DataFrame:
    """Sum of weight times sample z-score; nulls count as 0 first, a constant column scores 0.

    All means and deviations come from one aggregate, joined back as one small row (or a row for each of ``by``).
    """
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in weights}
    aggs = [f(x).alias(f"_{k}_{c}") for c, x in filled.items() for k, f in (("m", F.avg), ("s", F.stddev_samp))]
    stats = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    joined = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))
    z = lambda c: F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 0.0).otherwise((filled[c] - F.col(f"_m_{c}")) / F.col(f"_s_{c}"))
    total = reduce(lambda a, b: a + b, [z(c) * w for c, w in weights.items()])
    return joined.withColumn(name, total).drop(*[f"_{k}_{c}" for c in weights for k in "ms"])


def fitted_score(df: DataFrame, train: Column, weights: Mapping[str, float], name: str) -> DataFrame:
    """Weighted z-score fitted on the training rows and applied to all: median for nulls, population deviation, 0 as 1.

    ``imputed_<column>`` tells what was filled in.
    """
    fit = df.filter(train).agg(*[F.median(c).alias(f"_d_{c}") for c in weights])
    filled = df.crossJoin(F.broadcast(fit)).withColumns({**{f"imputed_{c}": F.col(c).isNull() for c in weights}, **{f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.col(f"_d_{c}")) for c in weights}})
    stats = filled.filter(train).agg(*[f(f"_x_{c}").alias(f"_{k}_{c}") for c in weights for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    scored = filled.crossJoin(F.broadcast(stats))
    total = reduce(lambda a, b: a + b, [(F.col(f"_x_{c}") - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) * w for c, w in weights.items()])
    return scored.withColumn(name, total).drop(*[f"_{k}_{c}" for c in weights for k in ("d", "x", "m", "s")])


def cut_points(df: DataFrame, value: str, where: Column, qs: tuple[float, float] = (0.33, 0.67)) -> DataFrame:
    """One row ``q1, q2``: exact quantiles with linear interpolation."""
    return df.filter(where).agg(F.percentile(value, F.lit(qs[0])).alias("q1"), F.percentile(value, F.lit(qs[1])).alias("q2"))


def mean_ci(value: str, policy: str = "null") -> dict[str, Column]:
    """Aggregates ``n, mean, std, ci_low, ci_high`` of a metric, nulls dropped.

    What a single value has for a deviation: ``null`` (no interval either), ``mean`` (the interval is the mean) or ``zero``.
    """
    n, m, s = F.count(value), F.avg(value), F.stddev_samp(value)
    half = F.lit(1.96) * s / F.sqrt(n)
    std = F.when(n > 1, s).otherwise(F.lit(0.0) if policy == "zero" else F.lit(None).cast("double"))
    one = {"null": F.lit(None).cast("double"), "mean": m, "zero": m}[policy]
    return {"n": n, "mean": m, "std": F.when(n > 0, std), "ci_low": F.when(n > 1, m - half).otherwise(one), "ci_high": F.when(n > 1, m + half).otherwise(one)}


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, h = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1))
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``n, rho, p`` of each group: average ranks of rows where both are there; null for n < 3 or a constant side.

    Ranks are within groups; with ``by`` empty, the one group is sorted as a whole.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    part = lambda c: Window.partitionBy(*by, c)
    ranks = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(part(c)) - 1) / 2
    ranked = both.withColumns({"_rx": ranks(x), "_ry": ranks(y)})
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("_c"), F.min("_rx").alias("_a"), F.max("_rx").alias("_b"), F.min("_ry").alias("_d"), F.max("_ry").alias("_e"))
    rho = F.when((F.col("n") >= 3) & (F.col("_a") < F.col("_b")) & (F.col("_d") < F.col("_e")), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c"))))
    out = out.withColumn("rho", rho)
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))
    p = F.when(F.abs("rho") >= 1 - 1e-12, 0.0).otherwise(t_pvalue(F.when(F.abs("rho") < 1 - 1e-12, t), (F.col("n") - 2).cast("double")))
    return out.withColumn("p", F.when(F.col("rho").isNotNull(), p)).select(*by, "n", "rho", "p")


def effects(df: DataFrame, by: list[str], cell: str, value: str) -> DataFrame:
    """``pos_main, neg_main, interaction, hh_minus_ll`` from the means of the cells LL, HL, LH, HH."""
    m = {c: F.avg(F.when(F.col(cell) == c, F.col(value))) for c in ("LL", "HL", "LH", "HH")}
    return df.groupBy(*by).agg(
        ((m["HL"] + m["HH"]) / 2 - (m["LL"] + m["LH"]) / 2).alias("pos_main"),
        ((m["LH"] + m["HH"]) / 2 - (m["LL"] + m["HL"]) / 2).alias("neg_main"),
        (m["HH"] - m["HL"] - m["LH"] + m["LL"]).alias("interaction"),
        (m["HH"] - m["LL"]).alias("hh_minus_ll"),
    )


def factorial_tests(df: DataFrame, cell: str, value: str) -> tuple[list[dict], list[dict]]:
    """Coefficients of ``y ~ p + n + p:n`` and the Type II table with eta squared, from the four cells' sums alone.

    Works for unequal cells: nested least-squares fits on the cells' counts, means and sums of squares.
    """
    import numpy as np

    rows = df.filter(F.col(value).isNotNull() & F.col(cell).isin("LL", "HL", "LH", "HH")).groupBy(cell).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).collect()
    x = np.array([[1, r[cell][0] == "H", r[cell][1] == "H", r[cell] == "HH"] for r in rows], float)
    n, m = (np.array([r[k] for r in rows], float) for k in "nm")
    within = float(sum(r["n"] * r["v"] for r in rows))

    def rss(cols: list[int]) -> float:
        a = x[:, cols] * np.sqrt(n)[:, None]
        b, *_ = np.linalg.lstsq(a, m * np.sqrt(n), rcond=None)
        return within + float(((m * np.sqrt(n) - a @ b) ** 2).sum())

    dof = float(n.sum()) - 4
    a = x * np.sqrt(n)[:, None]
    beta, *_ = np.linalg.lstsq(a, m * np.sqrt(n), rcond=None)
    s2 = rss([0, 1, 2, 3]) / dof
    se = np.sqrt(np.diag(np.linalg.pinv(a.T @ a)) * s2)
    coefficients = [{"term": t, "coef": float(b), "se": float(e), "t": float(b / e) if e else math.inf, "p": t_two_sided(float(b / e) if e else math.inf, dof)} for t, b, e in zip(("intercept", "p", "n", "p:n"), beta, se, strict=True)]
    ss = {"p": rss([0, 2]) - rss([0, 1, 2]), "n": rss([0, 1]) - rss([0, 1, 2]), "p:n": rss([0, 1, 2]) - rss([0, 1, 2, 3]), "residual": rss([0, 1, 2, 3])}
    total = sum(ss.values())
    table = [{"term": t, "sum_sq": v, "df": dof if t == "residual" else 1.0, "f": None if t == "residual" else v / s2, "p": None if t == "residual" else f_tail(v / s2, 1, dof), "eta_sq": v / total if total else None} for t, v in ss.items()]
    return coefficients, table


def bootstrap_effects(df: DataFrame, cell: str, value: str, seed: str, exact_up_to: int = 6, draws: int = 20_000, random_seed: int = 20260609) -> DataFrame:
    """``effect, lo, hi``: 95 % percentile intervals over resamples of seeds (clusters).

    There are ``draws`` resamples, each of as many seeds as there are, chosen by hash; where all resamples of up to
    ``exact_up_to`` seeds are fewer than that anyway, each counts once, which is what the draws tend to.
    """
    spark = df.sparkSession
    sums = df.filter(F.col(value).isNotNull()).groupBy(F.col(seed).cast("string").alias("seed"), F.col(cell).alias("cell")).agg(F.avg(value).alias("m"))
    seeds = sums.select("seed").distinct().withColumn("pick", F.row_number().over(Window.orderBy("seed")) - 1)  # a row for each run
    n = seeds.count()
    exact = n <= exact_up_to and n**n <= draws
    spot = F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("spot")
    resamples = spark.range(n**n if exact else draws).select(F.col("id").alias("draw"), spot)
    pick = F.floor(F.col("draw") / F.pow(F.lit(float(n)), "spot")) if exact else F.xxhash64("draw", "spot", F.lit(random_seed))
    drawn = resamples.withColumn("pick", F.pmod(pick, F.lit(max(n, 1))).cast("int")).join(seeds, "pick").join(sums, "seed").groupBy("draw", "cell").agg(F.avg("m").alias("m"))
    out = effects(drawn, ["draw"], "cell", "m").unpivot(["draw"], ["pos_main", "neg_main", "interaction", "hh_minus_ll"], "effect", "v")
    return out.groupBy("effect").agg(F.percentile("v", F.lit(0.025)).alias("lo"), F.percentile("v", F.lit(0.975)).alias("hi"))


def rubric(scores: Mapping[str, Column]) -> Column:
    """Ten times the share of the two points of each dimension that applies; null if none does."""
    given = [F.coalesce(s, F.lit(0.0)) for s in scores.values()]
    applies = [s.isNotNull().cast("int") for s in scores.values()]
    total, n = reduce(lambda a, b: a + b, given), reduce(lambda a, b: a + b, applies)
    return F.when(n > 0, total * 10.0 / (n * 2))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """``n, rate, kappa`` of two raters' labels, rows with a missing one left out."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    cells = both.groupBy("a", "b").agg(F.count("*").alias("c"))
    side = cells.groupBy(F.col("a").alias("k")).agg(F.sum("c").alias("x")).join(cells.groupBy(F.col("b").alias("k")).agg(F.sum("c").alias("y")), "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    whole = cells.agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)) / F.sum("c")).alias("rate"))
    chance = F.col("xy") / (F.col("n") * F.col("n"))
    return whole.crossJoin(side).select("n", "rate", F.when(chance < 1, (F.col("rate") - chance) / (1 - chance)).alias("kappa"))
