"""Types, orders and enumerations of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Ranks of ordered categories, stage statuses and taxonomy priorities.
SOURCE_RANK = {"mbpp": 0, "humaneval": 1}
DIFFICULTY_RANK = {"easy": 0, "medium": 1, "hard": 2}
EXECUTION_STATUS = ("passed", "failed", "timeout", "infra_error", "syntax_error")
CATEGORY_PRIORITY = {
    "mutation_survival_major": 100,
    "branch_distinguishing_gap": 95,
    "exception_path_gap": 90,
    "boundary_case_gap": 85,
    "assertion_weak_or_missing": 80,
    "execution_assertion_mismatch": 78,
    "execution_call_contract_error": 77,
    "invalid_candidate_redefines_target": 76,
    "execution_behavior_mismatch": 75,
    "test_runtime_failure": 70,
    "syntax_error": 65,
    "execution_timeout": 60,
    "mutation_unavailable": 56,
    "mutation_timeout": 55,
    "mutation_pipeline_unstable": 50,
    "import_or_env_error": 40,
    "other": 0,
}
SEVERITY_PRIORITY = {"critical": 4, "major": 3, "moderate": 2, "minor": 1, "info": 0}
STRENGTH_PRIORITY = {"strong": 3, "moderate": 2, "heuristic": 1, "weak": 0}
STAGE_PRIORITY = {"mutation": 4, "static_structure": 3, "coverage": 2, "execution": 1, "syntax": 0}

TEST = T.StructType([T.StructField(c, T.StringType()) for c in ("test_id", "source", "code")])
TASK = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("task_id", "source", "origin_id", "task_type", "language", "split", "role", "prompt", "entry_point", "signature", "canonical_solution", "context_code")),
        T.StructField("imports", T.ArrayType(T.StringType())),
        T.StructField("base_tests", T.ArrayType(TEST)),
        T.StructField(
            "difficulty_features",
            T.StructType(
                [
                    *(T.StructField(c, T.LongType()) for c in ("prompt_length", "prompt_line_count", "loc", "branch_count")),
                    T.StructField("has_exception_path", T.BooleanType()),
                    *(T.StructField(c, T.LongType()) for c in ("arg_count", "base_test_count", "cyclomatic_complexity")),
                    T.StructField("has_docstring_examples", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("difficulty_bucket", T.StringType()),
        T.StructField("metadata", T.StructType([T.StructField(c, T.StringType()) for c in ("normalization_version", "source_file", "source_path")] + [T.StructField("raw_record_index", T.LongType())])),
    ]
)
MBPP = T.StructType([T.StructField("task_id", T.LongType()), T.StructField("prompt", T.StringType()), T.StructField("code", T.StringType()), T.StructField("test_list", T.ArrayType(T.StringType())), T.StructField("test_imports", T.ArrayType(T.StringType()))])
HUMANEVAL = T.StructType([T.StructField(c, T.StringType()) for c in ("task_id", "prompt", "canonical_solution", "test", "entry_point")])
LOG = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("run_id", "task_id", "candidate_id", "stage", "failure_category", "failure_subtype", "evidence")),
        T.StructField("auto_detected", T.BooleanType()),
        T.StructField("needs_manual_review", T.BooleanType()),
        *(T.StructField(c, T.StringType()) for c in ("taxonomy_rule_version", "rule_id", "rule_strength", "severity", "provenance")),
    ]
)
EVALUATION = "id long, user string, project string, role string, target string, mode string, framework string, status string, score int, passed int, line double, branch double, mutation double, asserts int, failures int, payload string, result string, created string, mutationvalid int"
EXTERNAL_PROJECTS = "projects array<struct<project: string, repo_url: string, ref: string, project_src: string, include_globs: array<string>, exclude_globs: array<string>, max_functions: int, preferred_targets: array<struct<module: string, rel_path: string, `function`: string>>>>"
