"""Data-quality validation: rules to error rows, uniqueness, run ids, splits and cardinalities."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ValidationError(ValueError):
    """Raised after the report has been made; ``report`` holds it."""

    def __init__(self, message: str, report: list | None = None) -> None:
        super().__init__(message)
        self.report = report or []


def present(c: Column | str) -> Column:
    """A string that isn't null or blank."""
    x = F.col(c) if isinstance(c, str) else c
    return x.isNotNull() & (F.trim(x.cast("string")) != "")


def broken_rules(df: DataFrame, key: str, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """``key, rule, level`` for each rule that a row breaks. A rule is a level and a condition that is true where it holds.

    A condition that comes out null counts as broken. One pass over the rows.
    """
    marks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level"))) for name, (level, ok) in rules.items()])
    return df.select(F.col(key), F.explode(F.filter(marks, lambda x: x.isNotNull())).alias("b")).select(key, "b.rule", "b.level")


def rule_counts(broken: DataFrame) -> DataFrame:
    return broken.groupBy("rule", "level").agg(F.count("*").alias("n"))


def task_rules(splits: Iterable[str] = ("train_pool", "main_test", "capability_retention")) -> dict[str, tuple[str, Column]]:
    """The rules that a unified task has to keep."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    return {
        "task_id_required": ("error", present("task_id")),
        "source_known": ("error", F.col("source").isin("mbpp", "humaneval")),
        "origin_id_required": ("error", present("origin_id")),
        "language_python": ("error", F.col("language") == "python"),
        "prompt_required": ("error", present("prompt")),
        "entry_point_required": ("error", present("entry_point")),
        "solution_required": ("error", present("canonical_solution")),
        "solution_defines_entry_point": ("warning", F.contains("canonical_solution", F.concat(F.lit("def "), F.col("entry_point")))),
        "tests_required": ("error", size("base_tests") > 0),
        "tests_have_code": ("error", F.forall("base_tests", lambda t: F.trim(t["code"]) != "")),
        "test_ids_distinct": ("error", F.size(F.array_distinct(F.transform("base_tests", lambda t: t["test_id"]))) == size("base_tests")),
        "prompt_length_matches": ("warning", F.col("difficulty_features.prompt_length") >= F.length(F.trim("prompt"))),
        "test_count_matches": ("error", F.col("difficulty_features.base_test_count") == size("base_tests")),
    }


def duplicates(df: DataFrame, key: str, top: int = 20) -> DataFrame:
    """The ``top`` most repeated keys and their counts; ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), F.col(key).asc_nulls_last()).limit(top)


def require_unique(df: DataFrame, key: str) -> DataFrame:
    found = duplicates(df, key).collect()
    if found:
        raise ValidationError(f"{key} is not unique", [r.asDict() for r in found])
    return df


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValidationError(f"missing columns: {missing}")
    return df


def run_ids(tables: Mapping[str, DataFrame], column: str = "run_id") -> DataFrame:
    """``table_name, n_run_ids, first_run_id`` for each table that has the column."""
    parts = [df.agg(F.count_distinct(column).alias("n_run_ids"), F.min(column).alias("first_run_id")).select(F.lit(name).alias("table_name"), "n_run_ids", "first_run_id") for name, df in tables.items() if column in df.columns]
    return reduce(DataFrame.unionByName, parts)


def require_one_run(tables: Mapping[str, DataFrame], column: str = "run_id") -> str | None:
    """The run id that all tables share; raises if one has several or two differ."""
    rows = run_ids(tables, column).collect()
    if any(r["n_run_ids"] > 1 for r in rows) or len({r["first_run_id"] for r in rows if r["first_run_id"]}) > 1:
        raise ValidationError("run ids differ", [r.asDict() for r in rows])
    return next((r["first_run_id"] for r in rows if r["first_run_id"]), None)


def inferred_run_id(c: Column | str) -> Column:
    """An aggregate: the one run id of a group, ``unknown_run`` for none, ``mixed_runs`` for several."""
    x = F.nullif(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(""))
    n = F.count_distinct(x)
    return F.when(n == 0, "unknown_run").when(n == 1, F.min(x)).otherwise("mixed_runs")


def check_weights(weights: Mapping[str, float], features: Iterable[str]) -> None:
    if set(weights) != set(features) or abs(sum(weights.values()) - 1) > 1e-8:
        raise ValidationError("weights must cover the features and sum to 1")


def split_faults(pool: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """``fault, n``: ids in several splits, pool ids in none, split ids outside the pool. All zero for a sound manifest."""
    several = splits.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").agg(F.count("*").alias("n")).select(F.lit("in_several_splits").alias("fault"), "n")
    missing = pool.select(key).distinct().join(splits.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("not_covered").alias("fault"), "n")
    extra = splits.select(key).distinct().join(pool.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit("not_in_pool").alias("fault"), "n")
    return several.unionByName(missing).unionByName(extra)


def require_sound_splits(pool: DataFrame, splits: DataFrame, key: str) -> None:
    bad = [r.asDict() for r in split_faults(pool, splits, key).collect() if r["n"]]
    if bad:
        raise ValidationError("splits are not disjoint and covering", bad)


def join_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that raises unless both keys are unique and every row finds its match."""
    require_unique(left, key)
    require_unique(right, key)
    n, matched = left.count(), left.join(right.select(key), key, "left_semi").count()
    if matched != n:
        raise ValidationError(f"{n - matched} rows of the left side have no match")
    return left.join(right, key)


def match_flags(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``matched, unmatched`` counts of a left join."""
    found = left.join(right.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    return found.agg(F.count("_k").alias("matched"), (F.count("*") - F.count("_k")).alias("unmatched"))


def annotation_faults(df: DataFrame) -> DataFrame:
    """Counts of what makes an annotation pack unusable: blank ids, code or prompts, repeated ids, several runs."""
    return df.agg(
        F.count_if(~present("sample_id")).alias("blank_id"),
        F.count_if(~present("candidate_test_code")).alias("blank_code"),
        F.count_if(~present("prompt")).alias("blank_prompt"),
        (F.count("sample_id") - F.count_distinct("sample_id")).alias("repeated_id"),
        (F.count_distinct("run_id") - 1).alias("extra_runs"),
    )


def report_then_raise(broken: DataFrame, preview: int = 50) -> list[dict]:
    """Counts by rule; raises with them if any is an error."""
    report = [r.asDict() for r in rule_counts(broken).orderBy("level", "rule").limit(preview).collect()]
    if any(r["level"] == "error" for r in report):
        raise ValidationError("validation failed", report)
    return report
