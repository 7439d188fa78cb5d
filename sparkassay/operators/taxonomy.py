"""Failure taxonomy: rules over joined stage tables, primary failures and roll-ups."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import scalars as S
from sparkassay.schema import CATEGORY_PRIORITY, SEVERITY_PRIORITY, STAGE_PRIORITY, STRENGTH_PRIORITY


@dataclass(frozen=True)
class Rule:
    """When it holds, a candidate gets a log row with these labels. ``evidence`` is a text, or JSON of several values."""

    id: str
    stage: str
    category: str | Column
    subtype: str | Column
    severity: str
    strength: str
    review: bool
    provenance: str
    when: Column
    evidence: Column | None = None


#: Version of the rules, coverage below which there is a gap, and survived mutants from which they count: fixed values.
RULES_VERSION = "ftx_v3"
LINE_GAP, BRANCH_GAP, SURVIVED = 0.80, 0.80, 1
#: Exceptions that a wrong call raises: fixed values.
CALL_ERRORS = ("TypeError", "ValueError", "IndexError", "KeyError", "AttributeError")
#: Columns that ``join_stages`` gives, null where a stage table lacks them.
STAGE_COLUMNS = {
    "execution_status": "string", "exception_type": "string", "traceback_snippet": "string", "stderr": "string",
    "redefines_target_flag": "int", "entry_point": "string", "redefines_target_symbol": "string", "candidate_validity_status": "string",
    "prompt": "string", "canonical_solution": "string", "base_tests": "string", "candidate_test_code": "string",
    "num_asserts": "int", "num_try_except": "int", "num_raise_statements": "int", "num_pytest_raises": "int", "has_pytest_raises": "boolean", "test_style": "string", "num_test_functions": "int",
    "coverage_status": "string", "line_coverage": "double", "branch_coverage": "double", "coverage_error_type": "string", "coverage_error_msg": "string",
    "mutation_status": "string", "mutation_error_type": "string", "mutation_error_msg": "string", "mutants_total": "int", "mutants_killed": "int", "mutants_survived": "int", "mutation_score": "double", "survived_mutant_ids": "string",
}


def join_stages(execution: DataFrame, static: DataFrame, coverage: DataFrame, mutation: DataFrame, candidates: DataFrame, key: str = "candidate_id") -> DataFrame:
    """One row for each candidate that was run or mutated, with the columns of ``STAGE_COLUMNS`` from the table they belong to.

    ``has_execution`` and ``has_static`` say whether the stage has a row; a candidate without either gets no logs of them.
    The key is unique in each table; rows with a null key stay out.
    """
    taken: set[str] = set()

    def of(df: DataFrame, mark: str | None = None) -> DataFrame:
        names = [c for c in STAGE_COLUMNS if c in df.columns and c not in taken]
        taken.update(names)
        marks = [F.lit(True).alias(mark)] if mark else []
        return df.filter(F.col(key).isNotNull()).select(key, *(F.col(c).cast(STAGE_COLUMNS[c]).alias(c) for c in names), *marks)

    joined = of(execution, "has_execution").join(of(mutation), key, "full")
    for df, mark in ((static, "has_static"), (coverage, None), (candidates, None)):
        joined = joined.join(of(df, mark), key, "left")
    lacking = {c: F.lit(None).cast(kind) for c, kind in STAGE_COLUMNS.items() if c not in taken}
    return joined.withColumns(lacking | {c: F.coalesce(c, F.lit(False)) for c in ("has_execution", "has_static")})


def stage_rules() -> list[Rule]:
    """The thirteen rules over a row that ``join_stages`` gives."""
    c, status, mutation, ran = F.col, F.col("execution_status"), F.col("mutation_status"), F.col("has_execution")
    static = ran & c("has_static")
    kind = S.clip("exception_type", 1200)
    count = lambda x: F.coalesce(c(x), F.lit(0))
    text = S.clip(F.coalesce(F.when(c("traceback_snippet") != "", c("traceback_snippet")), c("stderr")), 1200)
    said = lambda *names, **more: F.to_json(F.struct(*(S.clip(x, 1200).alias(x) if STAGE_COLUMNS[x] == "string" else c(x) for x in names), *(v.alias(k) for k, v in more.items())), {"ignoreNullFields": "false"})
    call = kind.isin(*CALL_ERRORS)
    failed = F.when(kind == "AssertionError", "execution_assertion_mismatch").when(call, "execution_call_contract_error").otherwise("test_runtime_failure")
    failed_as = F.when(kind == "AssertionError", F.lit("assertion_error")).otherwise(F.coalesce(kind, F.lit("execution_failed")))
    exceptions = S.mentions_exception(F.concat_ws("\n", "prompt", "canonical_solution", "base_tests", "candidate_test_code")) | (count("num_pytest_raises") > 0) | (count("num_try_except") > 0) | (count("num_raise_statements") > 0)
    unchecked = ~F.coalesce(c("has_pytest_raises"), F.lit(False)) & (count("num_try_except") == 0)
    measured = static & (c("coverage_status") == "ok")
    full = lambda x: F.when(c(x) != "", c(x))
    return [
        Rule("exec.invalid_candidate_redefines_target", "execution", "invalid_candidate_redefines_target", "redefines_target_symbol", "major", "strong", False, "generated_candidates", ran & (c("redefines_target_flag") > 0), said("entry_point", "redefines_target_symbol", "candidate_validity_status")),
        Rule("exec.syntax_error", "syntax", "syntax_error", "parse_failed", "major", "strong", False, "execution", status == "syntax_error", text),
        Rule("exec.timeout", "execution", "execution_timeout", "subprocess_timeout", "major", "strong", False, "execution", status == "timeout", text),
        Rule("exec.infra_error", "execution", "import_or_env_error", F.coalesce(kind, F.lit("infra_error")), "major", "strong", True, "execution", status == "infra_error", text),
        Rule("exec.failed", "execution", failed, failed_as, "major", "moderate", True, "execution", status == "failed", text),
        Rule("static.no_assertions", "static_structure", "assertion_weak_or_missing", "no_assertions", "major", "strong", True, "static_features", static & (count("num_asserts") == 0), said("test_style", "num_test_functions", num_asserts=count("num_asserts"))),
        Rule("static.exception_path_gap", "static_structure", "exception_path_gap", "no_exception_checks", "moderate", "heuristic", True, "static_features", static & exceptions & unchecked, said("num_pytest_raises", num_try_except=F.lit(0), has_pytest_raises=F.lit(False))),
        Rule("coverage.low_line_coverage", "coverage", "boundary_case_gap", "low_line_coverage", "moderate", "heuristic", True, "coverage_results", measured & (c("line_coverage") < LINE_GAP), said("line_coverage", threshold=F.lit(LINE_GAP))),
        Rule("coverage.low_branch_coverage", "coverage", "branch_distinguishing_gap", "low_branch_coverage", "moderate", "heuristic", True, "coverage_results", measured & (c("branch_coverage") < BRANCH_GAP), said("branch_coverage", threshold=F.lit(BRANCH_GAP))),
        Rule("coverage.tool_error", "coverage", "other", "coverage_tool_error", "minor", "moderate", True, "coverage_results", static & (c("coverage_status") == "tool_error"), said("coverage_error_type", "coverage_error_msg")),
        Rule("mutation.timeout", "mutation", "mutation_timeout", "mutation_tool_timeout", "major", "strong", False, "mutation_results", mutation == "timeout", S.clip("mutation_error_msg", 1200)),
        Rule("mutation.tool_error", "mutation", "mutation_unavailable", F.coalesce(full("mutation_error_msg"), full("mutation_error_type"), F.lit("mutation_tool_error")), "moderate", "strong", True, "mutation_results", mutation == "tool_error", said("mutation_error_type", "mutation_error_msg")),
        Rule("mutation.survival_major", "mutation", "mutation_survival_major", "survived_mutants_present", "major", "strong", True, "mutation_results", (mutation == "ok") & (count("mutants_survived") >= SURVIVED), said("mutants_total", "mutants_killed", "mutants_survived", "mutation_score", "survived_mutant_ids")),
    ]


def explode_rules(df: DataFrame, rules: list[Rule], keys: list[str], version: str = RULES_VERSION) -> DataFrame:
    """A log row for each rule that a row meets: one pass, no join. Conditions that are null don't hold."""
    label = lambda x: x if isinstance(x, Column) else F.lit(x)
    log = lambda r: F.struct(
        F.lit(r.stage).alias("stage"),
        label(r.category).alias("failure_category"),
        label(r.subtype).alias("failure_subtype"),
        (r.evidence if r.evidence is not None else F.lit(None).cast("string")).alias("evidence"),
        F.lit(True).alias("auto_detected"),
        F.lit(r.review).alias("needs_manual_review"),
        F.lit(version).alias("taxonomy_rule_version"),
        F.lit(r.id).alias("rule_id"),
        F.lit(r.strength).alias("rule_strength"),
        F.lit(r.severity).alias("severity"),
        F.lit(r.provenance).alias("provenance"),
    )
    hits = F.filter(F.array(*[F.when(F.coalesce(r.when, F.lit(False)), log(r)) for r in rules]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(hits).alias("l")).select(*keys, "l.*")


def log_counts(logs: DataFrame) -> DataFrame:
    """``kind, value, n``: logs by stage, by category and by whether they need a review, in one pass."""
    review = F.when(F.col("needs_manual_review"), "needs_manual_review").otherwise("auto_only")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("stage", F.col("stage")), ("category", F.col("failure_category")), ("review", review))])
    return logs.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def dedup_logs(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Logs that say the same about a candidate (evidence included) stay once."""
    return logs.dropDuplicates([*keys, "stage", "failure_category", "failure_subtype", "rule_id", "evidence"])


def sort_keys() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("candidate_id", "stage", "failure_category", "failure_subtype", "rule_id")]


def _priority(c: str, table: Mapping[str, int]) -> Column:
    return F.coalesce(S.lookup(c, table), F.lit(-1))


def primary(logs: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Each candidate's foremost log: by category, severity, strength, stage, then the later rule id."""
    order = F.struct(_priority("failure_category", CATEGORY_PRIORITY), _priority("severity", SEVERITY_PRIORITY), _priority("rule_strength", STRENGTH_PRIORITY), _priority("stage", STAGE_PRIORITY), F.col("rule_id"))
    row = F.struct("failure_category", "failure_subtype", "severity", "stage", "rule_id", "rule_strength")
    best = logs.groupBy(key).agg(F.max_by(row, order).alias("p"))
    return best.select(key, *[F.col(f"p.{c}").alias(f"primary_{c}") for c in ("failure_category", "failure_subtype", "severity", "stage", "rule_id", "rule_strength")])


def roll_up(logs: DataFrame, key: str = "candidate_id", flags: Mapping[str, str] | None = None) -> DataFrame:
    """Count, distinct labels in log order joined by ``|``, and a 0/1 column for each flag's category."""
    flags = flags or {f"has_{c}": c for c in ("mutation_survival_major", "branch_distinguishing_gap", "exception_path_gap", "boundary_case_gap", "assertion_weak_or_missing", "execution_assertion_mismatch", "execution_call_contract_error", "syntax_error")}
    place = F.struct("stage", "failure_category", "failure_subtype", "rule_id")
    in_order = F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col("failure_category").alias("c"), F.col("stage").alias("s"), F.col("rule_id").alias("r"))))
    out = logs.groupBy(key).agg(F.count("*").alias("failure_log_count"), in_order.alias("_l"), *[F.max((F.col("failure_category") == c).cast("int")).alias(f) for f, c in flags.items()], F.max((F.col("failure_category") == "mutation_unavailable").cast("int")).alias("mutation_unavailable"))
    distinct = lambda k: F.array_join(F.array_distinct(F.transform("_l", lambda x: x[k])), "|")
    lists = {f"failure_{name}_list": distinct(k) for name, k in (("category", "c"), ("stage", "s"), ("rule", "r"))}
    return out.withColumns(lists).drop("_l")
