"""Parsers of tool output: coverage JSON and mutation text, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkassay.functions import scalars as S

_FILE = "struct<summary: struct<covered_lines: long, num_statements: long, covered_branches: long, num_branches: long>, executed_lines: array<long>, missing_lines: array<long>, executed_branches: array<array<long>>, missing_branches: array<array<long>>>"


def _sorted_distinct(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array()), lambda x: x.isNotNull())))


def coverage(text: Column | str, suffix: str = "solution.py") -> Column:
    """The file of a coverage report whose name ends in ``suffix``: ratios to six digits and sorted line and branch sets; null without one."""
    x = F.col(text) if isinstance(text, str) else text
    files = F.from_json(F.get_json_object(x, "$.files"), f"map<string, {_FILE}>")
    hit = F.try_element_at(F.map_entries(F.map_filter(files, lambda k, v: F.endswith(k, F.lit(suffix)))), F.lit(1))
    f = hit["value"]
    ratio = lambda a, b: F.round(F.coalesce(f["summary"][a], F.lit(0)) / F.nullif(f["summary"][b], F.lit(0)), 6)
    found = F.struct(
        hit["key"].alias("coverage_file_key"),
        ratio("covered_lines", "num_statements").alias("line_coverage"),
        ratio("covered_branches", "num_branches").alias("branch_coverage"),
        F.coalesce(ratio("covered_branches", "num_branches"), ratio("covered_lines", "num_statements")).alias("DDR_or_BRC"),
        _sorted_distinct(f["executed_lines"]).alias("covered_lines"),
        _sorted_distinct(f["missing_lines"]).alias("missing_lines"),
        _sorted_distinct(f["executed_branches"]).alias("covered_branches"),
        _sorted_distinct(f["missing_branches"]).alias("missing_branches"),
    )
    return F.when(hit.isNotNull(), found)


def mutation(text: Column | str) -> Column:
    """Counts, ids and score of a mutation tool's result text: lines ``<mutant id>: <status>``, or else a summary with a number for each status.

    The score is killed over total, 0 without mutants; ``invalid_reason`` says why it can't be used.
    """
    x = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ids = lambda status: _sorted_distinct(F.regexp_extract_all(x, F.lit(rf"(?m)^\s*([\w.$ǁ]+__mutmut_\d+|\d+)\s*:\s*{status}\s*$"), F.lit(1)))
    said = lambda name: F.coalesce(F.nullif(F.regexp_extract(x, rf"(?i)\b{name}\s*[:=]?\s*(\d+)", 1), F.lit("")).try_cast("long"), F.lit(0))
    names = {"killed": "killed", "survived": "survived", "timeout": "timeout", "suspicious": "suspicious", "not_checked": "not checked"}
    lists = {k: ids(v) for k, v in names.items()}
    listed = sum((F.size(v) for v in lists.values()), F.lit(0))
    count = {k: F.when(listed > 0, F.size(lists[k]).cast("long")).otherwise(said(v)) for k, v in names.items()}
    total = count["killed"] + count["survived"] + count["timeout"] + count["suspicious"]
    return F.struct(
        total.alias("mutants_total"),
        *[count[k].alias(f"mutants_{k}") for k in names],
        *[lists[k].alias(f"{k}_mutant_ids") for k in names],
        F.when(total > 0, F.round(count["killed"] / total, 6)).otherwise(0.0).alias("mutation_score"),
        F.when(F.trim(x) == "", "empty_output").when(total == 0, "no_mutants").when(count["not_checked"] > 0, "not_checked").alias("invalid_reason"),
    )


def consistent(m: Column) -> Column:
    return m["mutants_killed"] + m["mutants_survived"] + m["mutants_timeout"] + m["mutants_suspicious"] == m["mutants_total"]


def pytest_report(log: Column | str) -> Column:
    """Numbers of passed, failed and erroneous tests, those collected (their sum if not said), and the exception type."""
    n = {k: S.pytest_count(log, k) for k in ("passed", "failed", "errors?")}
    parts = F.coalesce(n["passed"], F.lit(0)) + F.coalesce(n["failed"], F.lit(0)) + F.coalesce(n["errors?"], F.lit(0))
    said = F.nullif(F.regexp_extract(F.col(log) if isinstance(log, str) else log, r"collected\s+(\d+)\s+item", 1), F.lit("")).try_cast("int")
    return F.struct(F.coalesce(said, F.when(parts > 0, parts)).alias("collected"), n["passed"].alias("passed"), n["failed"].alias("failed"), n["errors?"].alias("errors"), S.exception_type(log).alias("exception_type"))
