"""Queries for single operators that no other query shows on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import code as K
from sparkassay.functions import scalars as S
from sparkassay.functions import statistics as ST
from sparkassay.operators import checks as C
from sparkassay.operators import datasets as D
from sparkassay.operators import pools as PL
from sparkassay.operators import ranking as R
from sparkassay.operators import reports as RP
from sparkassay.operators import shape as P
from sparkassay.plans.analytics import _CELL, _cells
from sparkassay.plans.registry import query, table


@query("prj_19_split_roles", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'train' WHEN 'MACHINERY' THEN 'test' END AS role FROM customer")
def _(spark, sf):
    return P.assign_split(table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "split"), {"BUILDING": "train", "MACHINERY": "test"}).select("c_custkey", "role")


@query("prj_23_trimmed", "SELECT p_partkey, trim('  ' || p_name || ' ') AS p_name FROM part")
def _(spark, sf):
    return P.trim_columns(table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name")), ["p_name"])


@query("val_10_task_rules", "SELECT rule, 'error' AS level, (SELECT count(*) FROM benchmark) AS n FROM (SELECT unnest(['source_known', 'language_python']) AS rule)")
def _(spark, sf):
    i = F.col("item_id").cast("string")
    raw = table(spark, sf, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("prompt"), F.concat(F.lit("def f"), i, F.lit("(x):\n    return x")).alias("code"), F.array(F.lit("assert f(1)")).alias("test_list"), F.array().cast("array<string>").alias("test_imports"), F.lit(1).alias("raw_record_index"))
    tasks = P.normalise_mbpp(raw).withColumns({"source": F.lit("elsewhere"), "language": F.lit("cobol")})
    return C.rule_counts(C.broken_rules(tasks, "task_id", C.task_rules()))


@query("flt_03_status_or_metric", "SELECT count(*) FILTER (event_type = 'click') AS by_status, count(*) FILTER (value > 50) AS by_metric FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "click", "ok").otherwise("no").alias("s"), F.lit(None).cast("string").alias("none"), F.when(F.col("value") > 50, F.col("value")).alias("m"))
    return e.agg(F.count_if(PL.status_or_metric(e, "s", "m")).alias("by_status"), F.count_if(PL.status_or_metric(e, "none", "m")).alias("by_metric"))


@query("flt_26_scope", "SELECT 'own' AS kind, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'selected', count(*) FROM orders WHERE o_orderkey IN (1, 2, 3)")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("user"))
    both = ((k, PL.scope(o, "F", ids)) for k, ids in (("own", None), ("selected", [1, 2, 3])))
    a, b = (d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in both)
    return a.unionByName(b)


@query("join_19_combinations", "SELECT a, b FROM (SELECT unnest([0, 1, -1]) AS a), (SELECT unnest(['', 'x']) AS b) ORDER BY a, b LIMIT 5")
def _(spark, sf):
    return PL.combinations({"a": [0, 1, -1], "b": ["", "x"]}, 5, spark)


@query("agg_30_cell_statistics", f"SELECT cell, count(*) AS n, round(avg(o_custkey), 6) AS mean, round(stddev_samp(o_custkey), 6) AS std FROM (SELECT *, {_CELL} AS cell FROM orders) GROUP BY 1")
def _(spark, sf):
    g = RP.group_ci(_cells(spark, sf).withColumn("v", F.col("o_custkey").cast("double")), ["cell"], "v", "null")
    return g.select("cell", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("agg_27_bucket_sums", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("lines"), F.sum("l_suppkey").alias("suppliers"))


@query("agg_38_batch_result", "SELECT count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_passed, CAST(round_even(avg(o_custkey % 100), 0) AS INT) AS score FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("n_passed"), F.bround(F.avg(F.col("o_custkey") % 100)).cast("int").alias("score"))


@query("win_02_partition_z", "SELECT event_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def _(spark, sf):
    return ST.weighted_z(table(spark, sf, "events"), {"value": 1.0}, "z", ["event_type"]).select("event_id", F.round("z", 6).alias("z"))


@query("smp_13_plain_sample", "SELECT o_orderkey FROM orders ORDER BY sha1('9|' || o_orderkey), o_orderkey LIMIT 25")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy(R.shuffle_key(9, "o_orderkey"), "o_orderkey").limit(25)


@query(
    "sta_05_boundary_probes",
    """WITH l AS (SELECT event_id, value FROM events WHERE event_type <> 'click'), s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM l) SELECT event_id FROM l, s ORDER BY round((value - m) / d, 9) DESC, event_id LIMIT 6""",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumns({"mutation_score": F.col("value"), **{c: F.lit(0.0) for c in PL.PROBE if c != "mutation_score"}})
    return PL.probes(e, e.filter("event_type = 'click'"), "event_id", 6).select("event_id")


@query("fn_09_test_structs", "SELECT item_id, ['base_1', 'base_2'] AS ids, [trim(text), 'x'] AS codes FROM benchmark")
def _(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", S.tests(F.array("text", F.lit("  "), F.lit(" x "))).alias("t"))
    return t.select("item_id", F.col("t.test_id").alias("ids"), F.col("t.code").alias("codes"))


@query("fn_11_joined_blocks", "SELECT p_partkey, p_name || chr(10) || chr(10) || p_brand AS code FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.join_blocks(F.array("p_name", "p_brand", F.lit(" "), "p_name")).alias("code"))


@query("fn_37_common_root", "SELECT r_name, n_name, n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.strip_common_root(n.select("r_name", "n_name", F.concat_ws("/", "r_name", "n_name").alias("path")), "path", ["r_name"])


@query("fn_44_generator_size", "SELECT 1 AS id, '7b' AS size UNION ALL SELECT 2, '1.5b' UNION ALL SELECT 3, NULL")
def _(spark, sf):
    m = spark.createDataFrame([(1, "org/Model-7B-Instruct"), (2, "m-1.5b"), (3, "plain")], "id int, name string")
    return m.select("id", S.generator_size("name").alias("size"))


@query("gen_01_presets", "SELECT DISTINCT o_orderpriority AS preset FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(spark, sf):
    return D.select_presets(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("preset")).distinct(), "1-URGENT, 5-LOW,,none")


@query("gen_02_chat_prompt", "SELECT r_regionkey, 'user' AS last_role, r_name || chr(10) || 'Focus: edge' AS content FROM region")
def _(spark, sf):
    r = table(spark, sf, "region").select("r_regionkey", F.element_at(D.chat_prompt("be brief", F.col("r_name"), F.lit("edge")), -1).alias("m"))
    return r.select("r_regionkey", F.col("m.role").alias("last_role"), F.col("m.content").alias("content"))


@query(
    "ds_05_fixed_budget_cells",
    f"""WITH o AS (SELECT *, {_CELL} AS cell FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY cell, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rr FROM o)
    SELECT o_orderkey, cell FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rr, o_orderstatus) AS turn FROM t) WHERE turn <= 7""",
)
def _(spark, sf):
    turned = R.round_robin(_cells(spark, sf), ["cell"], "o_orderstatus", R.last(("o_totalprice", "desc"), "o_orderkey"))
    return turned.filter("turn <= 7").select("o_orderkey", "cell")


@query("app_07_references", "SELECT 'a' AS name, 'adopt' AS status, 'low' AS risk UNION ALL SELECT 'b', 'review', 'medium' UNION ALL SELECT 'c', 'drop', 'high'")
def _(spark, sf):
    rows = [("a", 90, 0, 1, 0.9, 0.9), ("b", 60, 0, 1, 0.2, 0.9), ("c", 30, 2, 1, 0.9, 0.9)]
    r = RP.with_status(spark.createDataFrame(rows, "name string, score int, failures int, mutationvalid int, mutation double, line double"))
    return r.select("name", "status", S.risk(F.col("status")).alias("risk"))


@query("udf_01_token_statistics")
def _(spark, sf):
    d = table(spark, sf, "benchmark").select("item_id", K.udfs()["token_statistics"]("text").alias("s"))
    return d.select("item_id", "s.*")


@query("udf_13_safety_policy", "SELECT 1 AS id, 'import os' AS violation UNION ALL SELECT 2, NULL UNION ALL SELECT 3, 'name eval'")
def _(spark, sf):
    c = spark.createDataFrame([(1, "import os"), (2, "x = 1"), (3, "eval('1')")], "id int, code string")
    return c.select("id", K.udfs()["violation"]("code").alias("violation"))


@query("udf_14_doctests", "SELECT 1 AS id, 'f(1)' AS call, '2' AS expected UNION ALL SELECT 1, 'f(2)', '3'")
def _(spark, sf):
    c = spark.createDataFrame([(1, "doc\n>>> f(1)\n2\n>>> f(2)\n3\n"), (2, "none")], "id int, text string")
    return c.select("id", F.explode(K.udfs()["doctests"]("text")).alias("d")).select("id", "d.*")


@query("udf_15_segments", "SELECT 1 AS id, CAST(2 AS INT) AS n_setup, CAST(1 AS INT) AS n_asserts")
def _(spark, sf):
    c = spark.createDataFrame([(1, "x = 1\ny = 2\nassert x < y")], "id int, code string").select("id", K.udfs()["segments"]("code").alias("s"))
    return c.select("id", F.size("s.setup").alias("n_setup"), F.size("s.asserts").alias("n_asserts"))


@query("udf_18_parseable_prefix", "SELECT 1 AS id, 'def test_a():|    assert 1' AS code UNION ALL SELECT 2, 'x = 1|y = 2' UNION ALL SELECT 3, NULL")
def _(spark, sf):
    c = spark.createDataFrame([(1, "def test_a():\n    assert 1\ndef broken(:\n    assert 2"), (2, "x = 1\ny = 2"), (3, "assert 1\nif x:\n")], "id int, t string")
    return c.select("id", F.translate(K.udfs()["parseable_prefix"]("t"), "\n", "|").alias("code"))



@query("udf_05_signatures", "SELECT 1 AS id, 'def f(a, *b) -> int:' AS signature, CAST(2 AS BIGINT) AS arg_count")
def _(spark, sf):
    c = spark.createDataFrame([(1, "x\ndef f(a,\n      *b) -> int:\n    pass", "f")], "id int, code string, entry string")
    return c.select("id", K.udfs()["signature"]("code", "entry").alias("s")).select("id", "s.*")
