"""Scalar functions on columns, all within the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists: fixed values.
BOUNDARY_WORDS = ("empty", "none", "null", "zero", "negative", "min", "max", "boundary", "invalid")
EXCEPTION_WORDS = ("raise", "raises", "raised", "error", "exception", "invalid", "illegal", "fail", "fails", "failure", "overflow", "underflow", "zerodivision", "typeerror", "valueerror", "keyerror", "indexerror", "runtimeerror")
STRICT_ADOPT = {"score": 75, "mutation": 0.6, "line": 0.8}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.when(F.trim(_c(c)) != "", _c(c))


def clip(c: Column | str, n: int) -> Column:
    """Trimmed and cut to ``n`` characters; empty is null."""
    x = F.substring(F.trim(_c(c)), 1, n)
    return F.when(x != "", x)


def nonblank_lines(c: Column | str) -> Column:
    return F.size(F.filter(F.split(_c(c), "\n"), lambda x: F.trim(x) != ""))


def loc(c: Column | str) -> Column:
    """Lines that are neither blank nor a comment; null for blank code."""
    kept = F.filter(F.split(_c(c), "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))
    return F.when(F.trim(_c(c)) != "", F.size(kept))


def entry_point(c: Column | str) -> Column:
    """The name of the first function that the code defines."""
    return F.nullif(F.regexp_extract(_c(c), r"def\s+([a-zA-Z_]\w*)\s*\(", 1), F.lit(""))


def has_doctest(c: Column | str) -> Column:
    return F.contains(_c(c), F.lit(">>>"))


def clean_list(c: Column | str) -> Column:
    """Trimmed non-blank strings of a list; null gives an empty one."""
    return F.filter(F.transform(F.coalesce(_c(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def tests(c: Column | str) -> Column:
    """Test structs, numbered from 1 after blank ones are dropped."""
    return F.transform(clean_list(c), lambda x, i: F.struct(F.concat(F.lit("base_"), (i + 1).cast("string")).alias("test_id"), F.lit("base").alias("source"), x.alias("code")))


def difficulty_features(prompt: Column, code: Column, tests: Column) -> Column:
    return F.struct(
        F.length(prompt).cast("long").alias("prompt_length"),
        nonblank_lines(prompt).cast("long").alias("prompt_line_count"),
        loc(code).cast("long").alias("loc"),
        tests.cast("long").alias("base_test_count"),
        has_doctest(prompt).alias("has_docstring_examples"),
    )


def join_blocks(c: Column | str) -> Column:
    """Distinct non-blank code blocks, in order, parted by a blank line."""
    return F.array_join(F.array_distinct(clean_list(c)), "\n\n")


def safe_name(c: Column | str, default: str = "item", n: int = 180) -> Column:
    x = F.substring(F.regexp_replace(F.regexp_replace(F.trim(_c(c)), r"[^A-Za-z0-9_.-]+", "_"), r"^[_.]+|[_.]+$", ""), 1, n)
    return F.coalesce(F.when(x != "", x), F.lit(default))


def mentions_exception(c: Column | str) -> Column:
    return F.coalesce(_c(c).rlike(r"(?i)\b(" + "|".join(EXCEPTION_WORDS) + r")\b"), F.lit(False))


def exception_type(log: Column | str) -> Column:
    """The last line-leading exception name of a log, else the first known name in it."""
    last = F.try_element_at(F.regexp_extract_all(_c(log), F.lit(r"(?m)^(?:E\s+)?([A-Za-z_]\w*(?:Error|Exception|Exit|Interrupt))(?::|\b)"), F.lit(1)), F.lit(-1))
    known = ("AssertionError", "TypeError", "ValueError", "NameError", "AttributeError", "IndexError", "KeyError", "ImportError", "ModuleNotFoundError", "SyntaxError", "IndentationError", "ZeroDivisionError", "RuntimeError")
    return F.coalesce(last, *[F.when(F.contains(_c(log), F.lit(k)), F.lit(k)) for k in known])


def pytest_count(log: Column | str, what: str) -> Column:
    """``n passed`` and the like in a test report, null if it isn't there."""
    return F.nullif(F.regexp_extract(_c(log), rf"(\d+)\s+{what}", 1), F.lit("")).try_cast("int")


def boundary_hits(c: Column | str) -> Column:
    return F.regexp_count(_c(c), F.lit(r"(?i)\b(" + "|".join(BOUNDARY_WORDS) + r")\b"))


def capped_ratio(n: Column, whole: float) -> Column:
    return F.round(F.least(n / F.lit(float(whole)), F.lit(1.0)), 6)


def first_metric(*metrics: Column | str) -> Column:
    """The first of the metrics that is there, such as branch coverage else line coverage."""
    return F.coalesce(*map(_c, metrics))


def percent_to_ratio(c: Column | str) -> Column:
    return F.round(_c(c) / 100, 6)


def word_count(c: Column | str) -> Column:
    x = F.trim(F.regexp_replace(_c(c), r"\s+", " "))
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def occurrences(c: Column | str, token: str) -> Column:
    return ((F.length(_c(c)) - F.length(F.replace(_c(c), F.lit(token), F.lit("")))) / len(token)).cast("int")


def lookup(c: Column | str, table: Mapping) -> Column:
    return F.create_map(*[F.lit(v) for p in table.items() for v in p])[_c(c)]


def applicability(c: Column | str) -> Column:
    """1/0 from the ways raters write it; anything else is null."""
    x = F.lower(F.trim(_c(c)))
    return F.when(x.isin("1", "1.0", "yes", "y", "true", "applicable"), 1).when(x.isin("0", "0.0", "no", "n", "false", "n/a", "na", "not applicable"), 0)


def audit_log(c: Column | str) -> Column:
    """At most five findings of a log, by keyword rules in order."""
    rules = {"timeout": "timed? ?out", "import": "importerror|modulenotfounderror", "syntax": "syntaxerror|indentationerror", "assertion": "assertionerror", "permission": "permission denied", "memory": "memoryerror|out of memory", "network": "connection|socket", "traceback": "traceback"}
    hits = F.filter(F.array(*[F.when(_c(c).rlike(f"(?i){p}"), F.lit(k)) for k, p in rules.items()]), lambda x: x.isNotNull())
    return F.slice(hits, 1, 5)


def redact(c: Column | str, n: int = 2400) -> Column:
    """The end of a log without secrets and local paths."""
    x = F.regexp_replace(_c(c), r"(?i)(token|password|secret|key)\s*[=:]\s*\S+", "$1=***")
    return F.right(F.regexp_replace(x, r"(/home|/root|/tmp)/\S+", "<path>"), F.lit(n))


def signals(c: Column | str, topics: Mapping[str, str], default: str = "general") -> Column:
    """Labels of the topics whose pattern occurs, or the default."""
    found = F.filter(F.array(*[F.when(_c(c).rlike(f"(?i){p}"), F.lit(k)) for k, p in topics.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def quality_score(mutation: Column, line: Column, branch: Column, asserts: Column, fails: Column) -> Column:
    """20 to 99, rounded half to even."""
    raw = mutation * 42 + line * 22 + branch * 18 + F.least(asserts, F.lit(12)) * 1.2 - fails * 18
    return F.bround(F.greatest(F.lit(20.0), F.least(F.lit(99.0), raw))).cast("int")


def status(score: Column, failures: Column, mutation_valid: Column, mutation: Column, line: Column) -> Column:
    adopt = (mutation_valid > 0) & (score >= STRICT_ADOPT["score"]) & (mutation >= STRICT_ADOPT["mutation"]) & (line >= STRICT_ADOPT["line"])
    return F.when(failures > 0, F.when((score >= 45) & (failures <= 3), "review").otherwise("drop")).when(adopt, "adopt").when(score >= 55, "review").otherwise("drop")


def risk(of: Column) -> Column:
    return F.when(of == "adopt", "low").when(of == "review", "medium").otherwise("high")


def defect(failures: Column, mutation_valid: Column, mutation: Column, branch: Column, score: Column) -> Column:
    """Class and advice, the first that fits."""
    both = lambda a, b: F.struct(F.lit(a).alias("defect"), F.lit(b).alias("advice"))
    return (
        F.when(failures > 0, both("failing_tests", "fix or prune failing assertions"))
        .when(mutation_valid == 0, both("mutation_invalid", "repair the mutation run"))
        .when(mutation < 0.45, both("weak_mutation", "assert on results, not on types"))
        .when(branch < 0.55, both("missing_branches", "add cases for untaken branches"))
        .when((score >= 75) & (mutation >= 0.6), both("stable", "keep"))
        .otherwise(both("weak_assertions", "add boundary assertions"))
    )


def boundary_proxy(asserts: Column) -> Column:
    return F.least(F.lit(1.0), asserts / 8)


def is_test_path(path: Column | str) -> Column:
    return _c(path).rlike(r"(^|/)(tests?/|test_[^/]*\.py$|[^/]*_test\.py$|conftest\.py$)")


def clean_path(path: Column | str, n: int = 240) -> Column:
    """Forward slashes, no drive, root, dot or parent parts; null if nothing or too much is left."""
    parts = F.filter(F.split(F.regexp_replace(_c(path), r"\\", "/"), "/"), lambda x: ~x.isin("", ".", "..") & ~x.rlike("^[A-Za-z]:$"))
    out = F.array_join(parts, "/")
    return F.when((out != "") & (F.length(out) <= n), out)


def wrap(c: Column | str, width: int = 58) -> Column:
    """A text's lines of at most ``width`` characters."""
    pieces = F.transform(F.split(_c(c), "\n"), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(x) - 1) / width)).cast("int")), lambda i: F.substr(x, i * width + 1, F.lit(width))))
    return F.flatten(pieces)


def bucket(score: Column, q1: Column, q2: Column) -> Column:
    """Difficulty by cut points, each bucket including its upper one."""
    return F.when(score <= q1, "easy").when(score <= q2, "medium").otherwise("hard")


def quantile_group(score: Column, q1: Column, q2: Column, eligible: Column, signals: Column) -> Column:
    """Annotation group by cut points, each group including its lower one."""
    return F.when(~eligible, "unusable").when(signals > 0, "flagged").when(score >= q2, "high").when(score >= q1, "medium").otherwise("low")


def ratio(a: Column, b: Column) -> Column:
    """Larger over smaller; null where the smaller is zero."""
    return F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0))


def test_style(functions: Column, top_asserts: Column, asserts: Column, raises: Column) -> Column:
    return F.when((functions > 0) & (top_asserts > 0), "mixed").when(functions > 0, "pytest_function").when(top_asserts > 0, "top_level_assert").when((asserts > 0) | (raises > 0), "other_assertion_style").otherwise("none")


def generator_size(name: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(name), r"(?i)(\d+(?:\.\d+)?b)", 1)), F.lit(""))


def last_query_value(url: Column | str, key: str) -> Column:
    """The last value of a key in a URL's query."""
    return F.try_element_at(F.regexp_extract_all(_c(url), F.lit(rf"[?&]{key}=([^&#]*)"), F.lit(1)), F.lit(-1))
