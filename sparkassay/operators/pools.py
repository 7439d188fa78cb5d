"""Filters of candidate pools, pairs and their surface checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import scalars as S
from sparkassay.functions import statistics as ST

#: Quotas and weights of the pool scores.
ANCHOR_WEIGHTS = {"mutation_score": 0.45, "branch_coverage": 0.20, "line_coverage": 0.15, "boundary_coverage": 0.10, "exception_path_coverage": 0.10, "assert_density": 0.10, "num_asserts": 0.05, "failure_log_count": -0.20, "pos_soft_gap_count": -0.25}
TEACHING_PROXY = {"assert_density": 0.35, "num_asserts": 0.20, "num_exception_checks": 0.15, "avg_asserts_per_test_function": 0.10, "num_bare_expression_calls": -0.10, "logical_nesting_depth": -0.10, "failure_log_count": -0.15}
TEACHING = {"mutation_score": 0.35, "branch_coverage": 0.15, "line_coverage": 0.10, "boundary_coverage": 0.10, "exception_path_coverage": 0.10, "pos_soft_gap_count": -0.20, "failure_log_count": -0.15}
PROVISIONAL = {"mutation_score": 1.0, "branch_coverage": 0.6, "line_coverage": 0.4, "boundary_coverage": 0.5, "exception_path_coverage": 0.5, "num_asserts": 0.2, "assert_density": 0.2, "failure_log_count": -0.6, "neg_logic_signal_count": -0.8}
PROBE = {"mutation_score": 1.0, "branch_coverage": 1.0, "line_coverage": 1.0, "assert_density": 1.0, "failure_log_count": -1.0}
NEGATIVE_FLAGS = {"has_mutation_survival": 1.2, "has_exception_gap": 0.9, "has_boundary_gap": 0.9, "has_branch_gap": 0.9, "has_weak_assert": 0.9, "has_assertion_mismatch": 0.9, "has_call_contract": 0.9}
NEGATIVE_TERMS = {"failure_log_count": 0.35, "mutation_score": -0.80, "branch_coverage": -0.20, "boundary_coverage": -0.15, "exception_path_coverage": -0.15}


@dataclass(frozen=True)
class Positive:
    """Thresholds of a positive tier."""

    mutation: float
    line: float
    branch: float
    asserts: int
    soft_gaps: int


STRICT, RELAXED = Positive(0.90, 0.90, 0.90, 2, 0), Positive(0.72, 0.80, 0.70, 1, 1)


def all_of(*conditions: Column) -> Column:
    return reduce(and_, conditions)


def usable_exec() -> Column:
    return all_of(F.col("syntax_pass") == 1, F.col("execution_pass") == 1, F.col("invalid_candidate_flag") == 0, F.col("redefines_target_flag") == 0)


def text_ready() -> Column:
    return (F.trim(F.coalesce("candidate_test_code", F.lit(""))) != "") & (F.trim(F.coalesce("prompt", F.lit(""))) != "")


def status_or_metric(df: DataFrame, status: str, metric: str) -> Column:
    """``status = 'ok'`` where the table's status column has any value at all, else that the metric is there."""
    known = status in df.columns and df.filter(F.col(status).isNotNull()).limit(1).count() > 0
    return F.coalesce(F.col(status) == "ok", F.lit(False)) if known else F.col(metric).isNotNull()


def usable_eval(df: DataFrame) -> Column:
    return all_of(usable_exec(), status_or_metric(df, "coverage_status", "line_coverage"), status_or_metric(df, "mutation_status", "mutation_score"), F.col("mutation_unavailable") == 0)


def usable_text() -> Column:
    """Usable by execution, with code and a prompt that aren't blank."""
    return usable_exec() & text_ready()


#: Flags that count as logic signals of a natural negative.
LOGIC_SIGNALS = tuple(NEGATIVE_FLAGS)


def natural_negative(df: DataFrame, signals: tuple[str, ...] = LOGIC_SIGNALS) -> Column:
    """Usable by evaluation, with at least one logic signal."""
    return usable_eval(df) & (signal_count(*signals) >= 1)


def programmatic_valid(df: DataFrame) -> Column:
    """The five flags of a usable programmatic negative; what is missing or no number counts as 0, so an unknown pass fails."""
    value = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    return all_of(*[value(c) == 1 for c in ("syntax_pass", "execution_pass")], *[value(c) == 0 for c in ("invalid_candidate_flag", "redefines_target_flag", "mutation_unavailable")])


def select_cells(df: DataFrame, tiers: tuple[str, ...], sources: tuple[str, ...]) -> DataFrame:
    """Pairs whose positive is of one of the tiers and whose negative is of one of the sources."""
    return df.filter(F.col("pos_tier").isin(*tiers) & F.col("neg_source").isin(*sources))


def select_runs(df: DataFrame, groups: tuple[str, ...], split: str) -> DataFrame:
    return df.filter(F.col("group").isin(*groups) & (F.col("split") == split))


def owned(df: DataFrame, project: str, user: str) -> DataFrame:
    """A user's rows in a project."""
    return df.filter((F.col("project") == project) & (F.col("user") == user))


def zero(*flags: str) -> Column:
    return all_of(*[F.coalesce(F.col(c), F.lit(0)) == 0 for c in flags])


def positive(t: Positive) -> Column:
    return all_of(F.col("mutation_score") >= t.mutation, F.col("line_coverage") >= t.line, F.col("branch_coverage") >= t.branch, F.col("num_asserts") >= t.asserts, F.col("pos_soft_gap_count") <= t.soft_gaps)


def signal_count(*flags: str) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in flags])


def members(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(key), key, "left_semi")


def non_members(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(key), key, "left_anti")


def strength(group: Column | str, count: Column | str) -> Column:
    """Cells LH and HH need a logic flag on the negative; LL and HL need none."""
    g, n = (F.col(x) if isinstance(x, str) else x for x in (group, count))
    return F.when(g.isin("LH", "HH"), n >= 1).when(g.isin("LL", "HL"), n <= 0).otherwise(False)


def in_ids(ids: str, c: str = "id", most: int = 200) -> Column:
    """Membership in a comma-separated list of distinct positive numbers."""
    parsed = F.slice(F.array_distinct(F.filter(F.transform(F.split(F.lit(ids), ","), lambda x: F.trim(x).try_cast("long")), lambda x: x > 0)), 1, most)
    return F.array_contains(parsed, F.col(c))


def delete(df: DataFrame, where: Column) -> DataFrame:
    """What a delete leaves: rows for which the condition isn't true."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def anchor_score(df: DataFrame, name: str = "positive_anchor_score", by: list[str] | None = None) -> DataFrame:
    return ST.weighted_z(df, ANCHOR_WEIGHTS, name, by)


def teaching_scores(df: DataFrame) -> DataFrame:
    """Proxy and teaching score over all rows, before any filter."""
    both = ST.weighted_z(ST.weighted_z(df, TEACHING_PROXY, "teaching_proxy_score"), TEACHING, "_t")
    return both.withColumn("positive_teaching_score", F.col("_t") + F.col("teaching_proxy_score") * 0.20).drop("_t")


def negative_score(df: DataFrame, name: str = "natural_negative_score") -> DataFrame:
    flags = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) * w for c, w in NEGATIVE_FLAGS.items()])
    return ST.weighted_z(df, NEGATIVE_TERMS, "_z").withColumn(name, flags + F.col("_z")).drop("_z")


def diagnostic_score() -> Column:
    flags = signal_count("has_assertion_mismatch", "has_call_contract", "has_weak_assert", "has_boundary_gap", "has_exception_gap")
    return flags + (F.coalesce(F.col("mutation_score"), F.lit(1.0)) <= 0.85).cast("int") + (F.coalesce(F.col("failure_log_count"), F.lit(0)) >= 2).cast("int")


def pairs(pos: DataFrame, neg: DataFrame, key: str = "task_id") -> DataFrame:
    """Positives with negatives of the same task; other columns get their side's suffix."""
    p = pos.select(key, *[F.col(c).alias(f"{c}_pos") for c in pos.columns if c != key])
    n = neg.select(key, *[F.col(c).alias(f"{c}_neg") for c in neg.columns if c != key])
    return p.join(n, key)


def attach(pairs: DataFrame, surface: DataFrame, columns: list[str], id: str = "candidate_id") -> DataFrame:
    """Surface columns of both sides; pairs without a surface row keep nulls."""
    for side in ("pos", "neg"):
        right = surface.select(F.col(id).alias(f"{id}_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(right, f"{id}_{side}", "left")
    return pairs


def attach_metadata(pairs: DataFrame, candidates: DataFrame, columns: list[str], id: str = "candidate_id", task: str = "task_id") -> DataFrame:
    """Columns of both sides' candidates: the positive's by id and task, the negative's by id alone, as its task may be spelt otherwise."""
    pos = candidates.select(F.col(id).alias(f"{id}_pos"), task, *[F.col(c).alias(f"{c}_pos") for c in columns])
    neg = candidates.select(F.col(id).alias(f"{id}_neg"), *[F.col(c).alias(f"{c}_neg") for c in columns])
    return pairs.join(pos, [f"{id}_pos", task], "left").join(neg, f"{id}_neg", "left")


@dataclass(frozen=True)
class Surface:
    """Thresholds of the pair filter; all are exceeded strictly."""

    token_ratio: float = 2.0
    token_diff: float = 80
    assert_diff: float = 4
    function_diff: float = 2
    comment_ratio_diff: float = 0.25
    density_diff: float = 0.25
    structure_diff: float = 2.0
    mild_allowed: int = 1


def over(a: Column, limit: float) -> Column:
    """1 if above; a missing value is not above."""
    return F.coalesce(a > limit, F.lit(False)).cast("int")


def not_one(c: str) -> Column:
    """1 unless the flag is 1; a missing flag is not 1."""
    return F.coalesce(F.col(c) != 1, F.lit(True)).cast("int")


def surface_flags(df: DataFrame, t: Surface = Surface()) -> DataFrame:
    """Hard and mild fails of pairs that carry ``*_pos``/``*_neg`` surface columns, their counts, and whether to keep the pair."""
    diff = lambda c: F.abs(F.col(f"{c}_pos") - F.col(f"{c}_neg"))
    hard = {
        "hard_fail_exec_or_syntax": F.greatest(not_one("execution_pass_pos"), not_one("execution_pass_neg"), not_one("syntax_pass_pos"), not_one("syntax_pass_neg")),
        "hard_fail_tokens": F.greatest(over(S.ratio(F.col("token_length_pos").cast("double"), F.col("token_length_neg").cast("double")), t.token_ratio) * over(diff("token_length"), t.token_diff), F.lit(0)),
        "hard_fail_asserts": over(diff("num_asserts"), t.assert_diff),
        "hard_fail_functions": over(diff("num_test_functions"), t.function_diff),
    }
    mild = {"mild_fail_comments": over(diff("comment_ratio"), t.comment_ratio_diff), "mild_fail_density": over(diff("assert_density"), t.density_diff), "mild_fail_structure": over(diff("surface_structural_complexity"), t.structure_diff)}
    out = df.withColumns(hard | mild)
    out = out.withColumns({"hard_fail_count": reduce(lambda a, b: a + b, map(F.col, hard)), "mild_fail_count": reduce(lambda a, b: a + b, map(F.col, mild))})
    return out.withColumn("surface_filter_keep", ((F.col("hard_fail_count") == 0) & (F.col("mild_fail_count") <= t.mild_allowed)).cast("int"))


def pair_validity(df: DataFrame, negative: Column | None = None) -> DataFrame:
    """Execution-valid, logic-valid and high-information pairs by what the negative side shows."""
    exec_ok = negative if negative is not None else all_of(F.col("syntax_pass_neg") == 1, F.col("execution_pass_neg") == 1, F.col("invalid_candidate_flag_neg") == 0, F.col("redefines_target_flag_neg") == 0)
    exec_ok = F.coalesce(exec_ok, F.lit(False))
    gain = F.coalesce(F.col("mutation_score_pos") - F.col("mutation_score_neg"), F.lit(-999.0)) > 0
    signals, logs = F.coalesce(F.col("neg_logic_signal_count_neg"), F.lit(0)), F.coalesce(F.col("failure_log_count_neg"), F.lit(0))
    return df.withColumns({"pair_exec_valid": exec_ok.cast("int"), "pair_logic_valid": (exec_ok & (gain | (signals > 0) | (logs > 0))).cast("int"), "pair_high_info": (exec_ok & gain & (signals >= 1)).cast("int")})


def bottleneck() -> Column:
    """Why a task yields no usable pair, the first reason that fits."""
    c = F.col
    return (
        F.when((c("n_pos") == 0) & (c("n_neg") == 0), "no_candidates")
        .when(c("n_pos") == 0, "no_positive")
        .when(c("n_neg") == 0, "no_negative")
        .when(c("n_pairs") == 0, "no_pairs")
        .when(c("n_hard_ok") == 0, "all_hard_fail")
        .when(c("n_mild1") > 0, "ok")
        .when(c("n_mild2") > 0, "needs_mild_2")
        .otherwise("needs_mild_3")
    )


def scope(df: DataFrame, user: str, selected: list[int] | None = None) -> DataFrame:
    """The rows that an analysis is about: the selected ones if any are, else the user's own."""
    return df.filter(F.col("id").isin(*selected)) if selected else df.filter(F.col("user") == user)


def probes(df: DataFrame, chosen: DataFrame, id: str, k: int) -> DataFrame:
    """The ``k`` best boundary probes among the usable rows that no pool has taken."""
    left = non_members(df, chosen, id)
    return ST.weighted_z(left, PROBE, "boundary_probe_score").orderBy(F.round("boundary_probe_score", 9).desc(), id).limit(k)


def combinations(atoms: dict[str, list], most: int, spark) -> DataFrame:
    """All combinations of a few fixed values for each argument, the first ``most`` in order."""
    out = spark.range(1).select(F.lit(1).alias("_"))
    for name, values in atoms.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out.drop("_").orderBy(*atoms).limit(most)
