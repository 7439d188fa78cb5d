"""Projections: schema shaping, coercion, ids, prompts and normalised tasks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions import scalars as S


def keep_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def ensure_columns(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Adds the columns that are missing, filled with their default."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def first_alias(df: DataFrame, names: Iterable[str], required: bool = False) -> str | None:
    found = next((c for c in names if c in df.columns), None)
    if found is None and required:
        raise ValueError(f"none of the columns {list(names)} exists")
    return found


def with_side(df: DataFrame, side: str, keys: Iterable[str] = ()) -> DataFrame:
    """All columns but the keys renamed with a side's suffix."""
    keys = set(keys)
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}_{side}") for c in df.columns])


def number(c: Column | str) -> Column:
    """Text, flags or numbers as double; what doesn't parse, and NaN, is null."""
    x = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(x), x)


def integer(c: Column | str) -> Column:
    return number(c).try_cast("long")


def flag(c: Column | str) -> Column:
    """0/1 for booleans, ``True``/``False`` text and numbers (1 if above 0); null and the rest are 0."""
    x = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(x.try_cast("boolean").cast("int"), (x.try_cast("double") > 0).cast("int"), F.lit(0))


def text(c: Column | str) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.coalesce(x.cast("string"), F.lit(""))


def coerce(df: DataFrame, numbers: Iterable[str] = (), flags: Iterable[str] = ()) -> DataFrame:
    return df.withColumns({**{c: number(c) for c in numbers}, **{c: flag(c) for c in flags}})


def fill_aggregates(df: DataFrame, counts: Iterable[str], lists: Iterable[str]) -> DataFrame:
    """0 for counts and '' for lists where a candidate has none."""
    return df.na.fill({**dict.fromkeys(counts, 0), **dict.fromkeys(lists, "")})


def coalesce_duplicates(df: DataFrame, name: str) -> DataFrame:
    """The row-wise maximum over ``name``, ``name.1``, ... as one 0/1 column."""
    same = [c for c in df.columns if c == name or c.startswith(f"{name}.") and c[len(name) + 1 :].isdigit()]
    if not same:
        return df.withColumn(name, F.lit(0))
    flags = [flag(F.col(f"`{c}`")) for c in same]
    best = F.greatest(*flags) if len(flags) > 1 else flags[0]
    return df.withColumn("_best", best).drop(*[c for c in same if c != name]).withColumn(name, F.col("_best")).drop("_best")


def derive_passes(df: DataFrame, status: str = "execution_status") -> DataFrame:
    """``syntax_pass`` and ``execution_pass`` from the status where the columns are absent."""
    derived = {"syntax_pass": F.when(F.col(status).isNotNull(), (F.col(status) != "syntax_error").cast("int")), "execution_pass": F.when(F.col(status).isNotNull(), (F.col(status) == "passed").cast("int"))}
    return df.withColumns({k: v for k, v in derived.items() if k not in df.columns})


def sample_id(c: Column | str, prefix: str = "a1_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.trim(text(c))), 1, 10))


def remap_ids(df: DataFrame, prefix: str) -> DataFrame:
    """Prefixed candidate ids; the old one stays as ``parent_candidate_id``."""
    return df.withColumn("parent_candidate_id", F.col("candidate_id")).withColumn("candidate_id", F.concat(F.lit(prefix), F.col("candidate_id")))


def candidate_id(*parts: Column, index: Column) -> Column:
    return F.concat(F.concat_ws("__", *parts), F.lit("__c"), F.lpad(index.cast("string"), 2, "0"))


def group_key(source: Column, difficulty: Column) -> Column:
    return F.concat_ws("__", source, difficulty)


def prompt(task: Column, entry: Column, signature: Column, description: Column) -> Column:
    """The instruction a preference row carries; null parts are blank."""
    return F.concat(F.lit("Write unit tests for the task.\nTask: "), text(task), F.lit("\nEntry point: "), text(entry), F.lit("\nSignature: "), text(signature), F.lit("\nDescription:\n"), text(description))


def evidence(c: Column | str, limit: int = 1200) -> Column:
    return S.clip(c, limit)


def normal_evidence(value: Column, kind: T.DataType, limit: int = 1200) -> Column:
    """Evidence of any type: texts trimmed and clipped, within arrays, maps and structs too; blank texts are null, the rest stays."""
    if isinstance(kind, T.StringType):
        return S.clip(value, limit)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: normal_evidence(x, kind.elementType, limit))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: normal_evidence(x, kind.valueType, limit))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[normal_evidence(value[f.name], f.dataType, limit).alias(f.name) for f in kind]))
    return value


def guard(c: Column | str, allowed: Iterable[str], other: str = "other") -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isin(*allowed), x).otherwise(other)


def trim_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.trim(text(c)) for c in names})


def blind(df: DataFrame, keep: Iterable[str], blanks: Iterable[str]) -> DataFrame:
    """Only what a rater may see, and blank columns to fill in."""
    return df.select(*keep, *[F.lit("").alias(c) for c in blanks])


def wide_left_join(base: DataFrame, others: Iterable[DataFrame], key: str) -> DataFrame:
    """First writer wins: each table adds only the columns that aren't there yet. Keys on the right are to be unique."""
    return reduce(lambda df, other: df.join(other.select(key, *[c for c in other.columns if c not in df.columns]), key, "left"), others, base)


def ordered_category(c: Column | str, rank: Mapping[str, int]) -> Column:
    """Rank of an ordered category, unknown values last."""
    x = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[F.lit(v) for pair in rank.items() for v in pair])
    return F.coalesce(table[x], F.lit(len(rank)))


def normalise_mbpp(df: DataFrame) -> DataFrame:
    """Raw records (``task_id, prompt, code, test_list, test_imports``, ``raw_record_index``) as tasks."""
    tests = S.tests("test_list")
    return df.select(
        F.concat(F.lit("mbpp_"), F.col("task_id")).alias("task_id"),
        F.lit("mbpp").alias("source"),
        F.col("task_id").cast("string").alias("origin_id"),
        F.lit("function_completion").alias("task_type"),
        F.lit("python").alias("language"),
        F.trim(text("prompt")).alias("prompt"),
        S.entry_point("code").alias("entry_point"),
        F.col("code").alias("canonical_solution"),
        S.clean_list("test_imports").alias("imports"),
        tests.alias("base_tests"),
        S.difficulty_features(F.col("prompt"), F.col("code"), F.size(tests)).alias("difficulty_features"),
        F.struct(F.lit("v1").alias("normalization_version"), F.col("raw_record_index").cast("long").alias("raw_record_index")).alias("metadata"),
    )


def normalise_humaneval(df: DataFrame) -> DataFrame:
    """Raw records (``task_id, prompt, canonical_solution, test, entry_point``, ``raw_record_index``) as tasks."""
    tests = S.tests(F.array("test"))
    code = F.concat(text("prompt"), text("canonical_solution"))
    return df.select(
        F.regexp_replace("task_id", "[^A-Za-z0-9]+", "_").alias("task_id"),
        F.lit("humaneval").alias("source"),
        F.col("task_id").alias("origin_id"),
        F.lit("function_completion").alias("task_type"),
        F.lit("python").alias("language"),
        F.trim(text("prompt")).alias("prompt"),
        F.coalesce(S.blank_to_null("entry_point"), S.entry_point(code)).alias("entry_point"),
        code.alias("canonical_solution"),
        F.array().cast("array<string>").alias("imports"),
        tests.alias("base_tests"),
        S.difficulty_features(F.col("prompt"), code, F.size(tests)).alias("difficulty_features"),
        F.struct(F.lit("v1").alias("normalization_version"), F.col("raw_record_index").cast("long").alias("raw_record_index")).alias("metadata"),
    )


def assign_split(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """The split's role written over the task's."""
    return df.withColumn("role", F.create_map(*[F.lit(v) for p in roles.items() for v in p])[F.col("split")])


def strip_common_root(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Drops the first part of every path of a group that shares it, as archives of one project do."""
    first = F.element_at(F.split(path, "/"), 1)
    roots = df.groupBy(*by).agg(F.count_distinct(first).alias("_roots"), F.min(F.size(F.split(path, "/"))).alias("_least"))
    joined = df.join(roots, by)
    stripped = F.when((F.col("_roots") == 1) & (F.col("_least") > 1), F.regexp_replace(path, "^[^/]*/", "")).otherwise(F.col(path))
    return joined.withColumn(path, stripped).drop("_roots", "_least")
