"""Queries that run code functions, parsers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkassay.functions import code as K
from sparkassay.functions import parsers as PS
from sparkassay.plans.registry import query, table
from sparkassay.sources import files as FS
from sparkassay.streaming import events as EV

_CODE = [
    (1, "import pytest\n\ndef test_a():\n    assert f(1) == 2\n    with pytest.raises(ValueError):\n        f(-1)\n\ndef test_empty():\n    assert f('') is None\n", "f"),
    (2, "def f(x):\n    return x\n", "f"),
    (3, "assert f(0) == 0  # zero\n", "f"),
    (4, "def broken(:\n", "f"),
    (5, "", "f"),
    (6, "class A:\n    @staticmethod\n    def go(x):\n        if x > 0 and not x == 3:\n            return x + 1\n        return 'no'\n\n    def _in(self):\n        def deep():\n            pass\n", "go"),
]


def _code(spark):
    return spark.createDataFrame(_CODE, "id long, code string, entry string")


# What the code rows above have, counted by hand.
_FEATURES = ("num_asserts", "num_test_functions", "num_pytest_raises", "num_exception_checks", "num_imports_in_test", "logical_nesting_depth", "num_bare_expression_calls")


@query(
    "udf_02_static_features",
    f"""SELECT * FROM (VALUES (1, 2, 2, 2, 2, 1, 1, 1, 'pytest_function'), (2, 0, 0, 0, 0, 0, 0, 0, 'none'), (3, 1, 0, 0, 0, 0, 0, 0, 'top_level_assert'), (4, 0, 0, 0, 0, 0, 0, 0, 'none'), (5, 0, 0, 0, 0, 0, 0, 0, 'none'), (6, 0, 0, 0, 0, 0, 1, 0, 'none')) t(id, {", ".join(_FEATURES)}, test_style)""",
)
def _(spark, sf):
    return _code(spark).select(F.col("id").cast("int").alias("id"), K.udfs()["static_features"]("code").alias("s")).select("id", *[F.col(f"s.{c}").cast("int").alias(c) for c in _FEATURES], "s.test_style")


@query("udf_03_logic_proxies", "SELECT * FROM (VALUES (1, 2, 2, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, NULL, NULL, NULL), (5, NULL, NULL, NULL), (6, 0, 0, 0)) t(id, tests, checked, exceptions)")
def _(spark, sf):
    r = _code(spark).select(F.col("id").cast("int").alias("id"), K.udfs()["logic_proxies"]("code").alias("s"))
    return r.select("id", *[F.col(f"s.{c}").cast("int").alias(n) for n, c in (("tests", "num_test_functions"), ("checked", "num_test_functions_with_checks"), ("exceptions", "exception_signal_count"))])


@query("udf_05_validity", "SELECT * FROM (VALUES (1, 'ok', 0), (2, 'invalid_redefines_target', 1), (3, 'ok', 0), (4, 'syntax_error', 0), (5, 'empty_code', 1), (6, 'weak_no_assert_like_check', 0)) t(id, status, invalid)")
def _(spark, sf):
    r = _code(spark).select(F.col("id").cast("int").alias("id"), K.udfs()["validity"]("code", "entry").alias("s"))
    return r.select("id", "s.status", F.col("s.invalid").cast("int").alias("invalid"))


@query("udf_09_variants", "SELECT * FROM (VALUES (1, 1, 'drop_targeted_test', false, true), (1, 2, 'weaken_target_asserts', true, true), (1, 4, 'keep_first_test_and_weaken_rest', true, true)) t(id, variant, kind, has_first_test, has_second_test)")
def _(spark, sf):
    r = _code(spark).select(F.col("id").cast("int").alias("id"), F.explode(K.udfs()["variants"]("code")).alias("v")).select("id", "v.*")
    return r.select("id", F.col("variant").cast("int").alias("variant"), "kind", F.contains("code", F.lit("def test_a")).alias("has_first_test"), F.contains("code", F.lit("def test_empty")).alias("has_second_test"))


@query(
    "udf_10_discovery",
    "SELECT * FROM (VALUES (1, 'test_a', 'function', 3, 'test_a'), (1, 'test_empty', 'function', 8, 'test_empty'), (2, 'f', 'function', 1, 'f'), (6, 'A.go', 'method:static', 3, 'A.go'), (6, 'A._in', 'internalmethod:instance', 8, 'A._in'), (6, 'A._in.deep', 'nested', 9, 'A._in')) t(id, name, kind, line, effective)",
)
def _(spark, sf):
    r = _code(spark).select(F.col("id").cast("int").alias("id"), F.explode(K.udfs()["discover"]("code")).alias("v")).select("id", "v.*")
    return r.withColumn("line", F.col("line").cast("int"))


@query(
    "udf_11_mutation_sites",
    """SELECT * FROM (VALUES (1, 'compare', 4, 'eq', 'NotEq'), (1, 'compare', 9, 'is', 'IsNot'), (1, 'constant', 4, '2', '3'), (1, 'constant', 4, '1', '2'), (1, 'constant', 6, '1', '2'), (2, 'return', 2, 'value', 'None'),
    (3, 'compare', 1, 'eq', 'NotEq'), (3, 'constant', 1, '0', '1'), (3, 'constant', 1, '0', '1'), (6, 'return', 6, 'value', 'None'), (6, 'boolop', 4, 'and', 'Or'), (6, 'return', 5, 'value', 'None'), (6, 'constant', 6, '''no''', '''nox'''),
    (6, 'compare', 4, 'gt', 'GtE'), (6, 'unary', 4, 'not', 'identity'), (6, 'binop', 5, 'add', 'Sub'), (6, 'constant', 4, '0', '1'), (6, 'compare', 4, 'eq', 'NotEq'), (6, 'constant', 5, '1', '2'), (6, 'constant', 4, '3', '4')) t(id, kind, line, old, new)""",
)
def _(spark, sf):
    found = _code(spark).select(F.col("id").cast("int").alias("id"), F.explode(K.udfs()["sites"]("code")).alias("v")).select("id", "v.*")
    return found.select("id", "kind", F.col("line").cast("int").alias("line"), "old", "new")


@query("fn_15_pytest_report", "SELECT 1 AS id, 7 AS collected, 5 AS passed, 2 AS failed, 'ValueError' AS exception_type UNION ALL SELECT 2, 3, 3, NULL, NULL")
def _(spark, sf):
    logs = spark.createDataFrame([(1, "collected 7 items\nE   TypeError: x\nValueError: bad\n2 failed, 5 passed in 0.1s"), (2, "3 passed in 0.01s")], "id int, log string")
    return logs.select("id", PS.pytest_report("log").alias("r")).select("id", "r.collected", "r.passed", "r.failed", "r.exception_type")


@query("fn_16_mutation_report", "SELECT 1 AS id, CAST(4 AS BIGINT) AS total, CAST(2 AS BIGINT) AS killed, 0.5::DOUBLE AS score, NULL AS invalid_reason, true AS consistent UNION ALL SELECT 2, 10, 8, 0.8, NULL, true UNION ALL SELECT 3, 0, 0, 0.0, 'empty_output', true")
def _(spark, sf):
    rows = [(1, "m.f__mutmut_1: killed\nm.f__mutmut_2: survived\nm.f__mutmut_3: killed\nm.f__mutmut_4: timeout\n"), (2, "killed: 8 survived: 2 timeout: 0"), (3, "")]
    r = spark.createDataFrame(rows, "id int, text string").select("id", PS.mutation("text").alias("m"))
    return r.select("id", F.col("m.mutants_total").alias("total"), F.col("m.mutants_killed").alias("killed"), F.col("m.mutation_score").alias("score"), F.col("m.invalid_reason").alias("invalid_reason"), PS.consistent(F.col("m")).alias("consistent"))


@query("fn_18_coverage_report", "SELECT 1 AS id, 0.75::DOUBLE AS line, 0.5::DOUBLE AS branch, [1, 2, 3]::BIGINT[] AS covered UNION ALL SELECT 2, NULL, NULL, NULL")
def _(spark, sf):
    good = '{"files": {"a/solution.py": {"summary": {"covered_lines": 3, "num_statements": 4, "covered_branches": 1, "num_branches": 2}, "executed_lines": [3, 1, 2, 1], "missing_lines": [4]}}}'
    r = spark.createDataFrame([(1, good), (2, '{"files": {}}')], "id int, text string").select("id", PS.coverage("text").alias("c"))
    return r.select("id", F.col("c.line_coverage").alias("line"), F.col("c.branch_coverage").alias("branch"), F.col("c.covered_lines").alias("covered"))


def _stream(spark, sf):
    """The events as a stream, and a fresh place for its state."""
    path = f"{sf}/events.parquet"
    root = FS.shared_dir(spark)
    return EV.read_stream(spark, path, table(spark, sf, "events").schema), f"{root}/stream-{uuid.uuid4().hex}", f"s{uuid.uuid4().hex}"


@query("stream_01_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    ev, at, name = _stream(spark, sf)
    return EV.drain(EV.tumbling(ev, late="2 hours"), at, name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_02_sliding", "SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1")
def _(spark, sf):
    ev, at, name = _stream(spark, sf)
    return EV.drain(EV.sliding(ev, late="2 hours"), at, name).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    "stream_03_sessions",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM r GROUP BY user_id, k""",
)
def _(spark, sf):
    ev, at, name = _stream(spark, sf)
    return EV.drain(EV.sessions(ev, late="2 hours"), at, name).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("stream_04_distinct", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def _(spark, sf):
    ev, at, name = _stream(spark, sf)
    seen = EV.drain(EV.distinct_events(ev.unionByName(ev)).select("event_id"), at, name, "append")
    return seen.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
