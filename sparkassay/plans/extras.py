"""Further queries: sources and sinks, shaping, filters, joins, aggregates and text functions, one for each remaining operator."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkassay.functions import scalars as S
from sparkassay.functions import statistics as ST
from sparkassay.operators import checks as C
from sparkassay.operators import datasets as D
from sparkassay.operators import pools as PL
from sparkassay.operators import ranking as R
from sparkassay.operators import reports as RP
from sparkassay.operators import shape as P
from sparkassay.plans.registry import query, table
from sparkassay.sources import files as FS


def _place(spark) -> str:
    """A fresh folder under the shared one."""
    return f"{FS.shared_dir(spark)}/{uuid.uuid4().hex}"


# --- sources and sinks -------------------------------------------------------------------------------------------------

_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*[c.split()[0] for c in _ORDERS.split(", ")])


@query("src_01_jsonl", _ORDERS_SQL)
def _(spark, sf):
    at = _place(spark)
    FS.write_jsonl(_orders(spark, sf), at)
    return FS.read_jsonl(spark, at, _ORDERS, strict=True)


@query("src_03_missing_file", "SELECT o_orderkey FROM orders WHERE false")
def _(spark, sf):
    return FS.read_jsonl(spark, f"{_place(spark)}/none.jsonl", "o_orderkey long", missing_ok=True)


@query("src_05_gzip_jsonl", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    at = _place(spark)
    table(spark, sf, "nation").select("n_nationkey", "n_name").write.option("compression", "gzip").json(at)
    return FS.read_jsonl(spark, at, "n_nationkey int, n_name string")


@query("src_06_record_index", "SELECT r_name, r_regionkey + 1 AS raw_record_index FROM region")
def _(spark, sf):
    return FS.with_record_index(table(spark, sf, "region")).select("r_name", F.col("raw_record_index").cast("int").alias("raw_record_index"))


@query("src_07_csv", "SELECT page_id, url, html FROM pages")
def _(spark, sf):
    at = _place(spark)
    FS.write_csv(table(spark, sf, "pages").select("page_id", "url", "html"), at)
    return FS.read_csv(spark, at, "page_id long, url string, html string")


@query("src_08_csv_pruned", "SELECT o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    at = _place(spark)
    FS.write_csv(_orders(spark, sf), at)
    return FS.read_csv(spark, at, _ORDERS, ["o_custkey", "o_totalprice"])


@query("src_09_csv_text", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(spark, sf):
    at = _place(spark)
    FS.write_csv(table(spark, sf, "nation"), at, ["n_nationkey", "n_name"])
    return FS.read_csv(spark, at)


@query("src_10_summaries", "SELECT 'r' || n_regionkey AS run_folder, count(*) AS n FROM nation GROUP BY 1")
def _(spark, sf):
    at = _place(spark)
    counts = table(spark, sf, "nation").groupBy(F.format_string("r%d", "n_regionkey").alias("run")).agg(F.count("*").alias("n"))
    counts.write.partitionBy("run").json(at)
    return FS.read_summaries(spark, f"{at}/*/*.json", "n long").select(F.substring_index("run_folder", "=", -1).alias("run_folder"), "n")


@query("src_11_run_paths", "SELECT 'run' AS kind, 'b' AS found UNION ALL SELECT 'legacy', 'old.jsonl' UNION ALL SELECT 'alias', 'run1'")
def _(spark, sf):
    at = _place(spark)
    for p in ("stage/b", "old.jsonl", "run1/percandidate.csv"):
        FS.write_report(spark, {}, f"{at}/{p}")
    last = lambda p: p.rsplit("/", 1)[1]
    rows = [("run", last(FS.stage_path(spark, at, "stage", "b", "old.jsonl"))), ("legacy", last(FS.stage_path(spark, at, "stage", "zz", "old.jsonl"))), ("alias", FS.per_run_path(spark, at, "run_1").split("/")[-2])]
    return spark.createDataFrame(rows, "kind string, found string")


@query("src_16_projects", "SELECT 'p1' AS project, 'm' AS module, 'f' AS \"function\", 16 AS max_functions UNION ALL SELECT 'p1', 'm', 'g', 16 UNION ALL SELECT 'p2', NULL, NULL, 4")
def _(spark, sf):
    at = f"{_place(spark)}/p.json"
    target = lambda f: {"module": "m", "rel_path": "m.py", "function": f}
    FS.write_report(spark, {"projects": [{"project": "p1", "max_functions": 16, "preferred_targets": [target("f"), target("g")]}, {"project": "p2", "max_functions": 4, "preferred_targets": []}]}, at)
    return FS.read_projects(spark, at).select("project", "module", "function", "max_functions")


@query("snk_04_nan_to_null", "SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS v FROM orders")
def _(spark, sf):
    at = _place(spark)
    FS.write_jsonl(table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")).otherwise(float("nan")).alias("v")), at)
    return FS.read_jsonl(spark, at, "o_orderkey long, v double")


@query("snk_05_export_csv", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    at = _place(spark)
    FS.write_jsonl(_orders(spark, sf), f"{at}/in")
    FS.export_csv(spark, f"{at}/in", f"{at}/out", _ORDERS, ["o_orderkey", "nothing", "o_orderstatus"])
    return FS.read_csv(spark, f"{at}/out", "o_orderkey long, o_orderstatus string")


@query("snk_06_append_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    from sparkassay.streaming import events as EV

    at = _place(spark)
    ev = EV.read_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema).select("event_id", "event_type")
    EV.append_to(ev, f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("snk_07_refuse_overwrite", "SELECT true AS refused, CAST(5 AS BIGINT) AS n")
def _(spark, sf):
    at, r = _place(spark), table(spark, sf, "region")
    FS.write_jsonl(r, at)
    try:
        FS.write_jsonl(r, at)
        refused = False
    except Exception:
        refused = True
    FS.write_jsonl(r, at, overwrite=True)
    return FS.read_jsonl(spark, at, "r_name string").agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))


# --- projections -------------------------------------------------------------------------------------------------------


@query("prj_03_first_alias", "SELECT o_orderkey, o_orderpriority AS prompt FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return P.keep_existing(o.withColumnRenamed(P.first_alias(o, ["prompt", "o_comment", "o_orderpriority"], required=True), "prompt"), ["o_orderkey", "prompt", "none"])


@query("prj_04_side_suffix", "SELECT p_partkey, p_brand AS p_brand_pos, p_size AS p_size_pos FROM part")
def _(spark, sf):
    return P.with_side(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "pos", ["p_partkey"])


@query("prj_07_safe_numbers", "SELECT event_id, try_cast(substr(event_type, 1, 1) AS DOUBLE) AS bad, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, '') AS t FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", P.number(F.substring("event_type", 1, 1)).alias("bad"), P.integer(F.get_json_object("props", "$.k")).alias("k"), P.text(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("t"))


@query("prj_09_fill_aggregates", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(s, '') AS s FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS s FROM orders WHERE o_totalprice > 450000 GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 450000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("s"))
    return P.fill_aggregates(table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left"), ["n"], ["s"])


@query("prj_10_duplicate_flags", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 30 OR l_discount > 0.05 THEN 1 ELSE 0 END AS flag FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") > 30).alias("flag"), (F.col("l_discount") > 0.05).alias("flag.1"))
    return P.coalesce_duplicates(li, "flag")


@query("prj_11_passes_from_status", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS syntax_pass, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS execution_pass FROM events")
def _(spark, sf):
    status = F.when(F.col("event_type") == "error", "syntax_error").when(F.col("event_type") == "click", "passed").otherwise("failed")
    return P.derive_passes(table(spark, sf, "events").select("event_id", status.alias("execution_status"))).drop("execution_status")


@query("prj_13_remap_ids", "SELECT 'a__' || c_name AS candidate_id, c_name AS parent_candidate_id FROM customer UNION ALL SELECT 'b__' || c_name, c_name FROM customer WHERE c_acctbal > 0")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_name", "candidate_id")
    return D.merge_runs(c, c.filter("c_acctbal > 0")).select("candidate_id", "parent_candidate_id")


@query("prj_16_task_from_raw", "SELECT 'mbpp_' || item_id AS task_id, trim(text) AS prompt, 'f' || item_id AS entry_point, CAST(2 AS BIGINT) AS n_tests, CAST(2 AS BIGINT) AS loc FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    i = F.col("item_id").cast("string")
    raw = b.select(F.col("item_id").alias("task_id"), F.col("text").alias("prompt"), F.concat(F.lit("# c\ndef f"), i, F.lit("(x):\n\n    return x\n")).alias("code"), F.array(F.lit("assert f(1)"), F.lit(" "), F.lit("assert f(2)")).alias("test_list"), F.array(F.lit("import re")).alias("test_imports"), F.lit(1).alias("raw_record_index"))
    t = P.normalise_mbpp(raw)
    return t.select("task_id", "prompt", "entry_point", F.col("difficulty_features.base_test_count").alias("n_tests"), F.col("difficulty_features.loc").alias("loc"))


@query("prj_17_task_from_completion", "SELECT 'HE_' || item_id AS task_id, 'go' AS entry_point, 'def go(x):' || chr(10) || '    return x' AS canonical_solution FROM benchmark")
def _(spark, sf):
    raw = table(spark, sf, "benchmark").select(F.concat(F.lit("HE/"), F.col("item_id")).alias("task_id"), F.lit("def go(x):\n").alias("prompt"), F.lit("    return x").alias("canonical_solution"), F.lit("assert go(1)").alias("test"), F.lit(" ").alias("entry_point"), F.lit(1).alias("raw_record_index"))
    return P.normalise_humaneval(raw).select("task_id", "entry_point", "canonical_solution")


@query("prj_24_blind_pack", "SELECT doc_id, lang, '' AS teaching_value, '' AS rater_note FROM documents")
def _(spark, sf):
    return P.blind(table(spark, sf, "documents"), ["doc_id", "lang"], ["teaching_value", "rater_note"])


# --- checks ------------------------------------------------------------------------------------------------------------


@query("val_11_annotation_faults", "SELECT count(*) FILTER (NOT coalesce(trim(CAST(doc_id AS VARCHAR)) <> '', false)) AS blank_id, count(*) FILTER (trim(text) = '') AS blank_code, count(*) FILTER (lang = 'fr') AS blank_prompt, count(doc_id) - count(DISTINCT doc_id) AS repeated_id, count(DISTINCT source) - 1 AS extra_runs FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("candidate_test_code"), F.when(F.col("lang") != "fr", F.col("lang")).alias("prompt"), F.col("source").alias("run_id"))
    return C.annotation_faults(d)


@query("val_13_report_then_raise", "SELECT 'short' AS rule, 'warning' AS level, count(*) AS n FROM documents WHERE n_chars < 500 HAVING count(*) > 0")
def _(spark, sf):
    report = C.report_then_raise(C.broken_rules(table(spark, sf, "documents"), "doc_id", {"short": ("warning", F.col("n_chars") >= 500), "text": ("error", C.present("text"))}))
    return spark.createDataFrame([(r["rule"], r["level"], r["n"]) for r in report], "rule string, level string, n long")


# --- filters and joins -------------------------------------------------------------------------------------------------


@query("flt_05_zero_flags", "SELECT count(*) AS n FROM lineitem WHERE NOT l_discount > 0.05 AND NOT l_tax > 0.04")
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"a": (F.col("l_discount") > 0.05).cast("int"), "b": F.when(F.col("l_tax") > 0.04, 1)})
    return li.filter(PL.zero("a", "b")).agg(F.count("*").alias("n"))


@query("flt_06_positive_tiers", "SELECT count(*) FILTER (m >= .9 AND l >= .9 AND b >= .9 AND a >= 2 AND g = 0) AS strict, count(*) FILTER (m >= .72 AND l >= .8 AND b >= .7 AND a >= 1 AND g <= 1) AS relaxed FROM (SELECT l_quantity / 50 AS m, 1 - l_discount AS l, 1 - l_tax AS b, l_linenumber AS a, l_suppkey % 3 AS g FROM lineitem)")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("mutation_score"), (1 - F.col("l_discount")).alias("line_coverage"), (1 - F.col("l_tax")).alias("branch_coverage"), F.col("l_linenumber").alias("num_asserts"), (F.col("l_suppkey") % 3).alias("pos_soft_gap_count"))
    return li.agg(F.count_if(PL.positive(PL.STRICT)).alias("strict"), F.count_if(PL.positive(PL.RELAXED)).alias("relaxed"))


@query(
    "flt_11_pair_validity",
    """WITH p AS (SELECT a.l_orderkey AS k, a.l_partkey AS p, b.l_partkey AS n, b.l_tax < 0.07 AND b.l_discount < 0.09 AS e, coalesce(a.l_quantity - CASE WHEN b.l_suppkey % 4 > 0 THEN b.l_quantity END, -999) > 0 AS gain, b.l_linenumber % 3 AS s, b.l_linenumber % 2 AS g FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R')
    SELECT k, p, n, e::INT AS ok, (e AND (gain OR s > 0 OR g > 0))::INT AS logic, (e AND gain AND s >= 1)::INT AS high FROM p""",
)
def _(spark, sf):
    c = F.col
    li = table(spark, sf, "lineitem").select(c("l_orderkey").alias("task_id"), c("l_partkey").alias("id"), "l_returnflag", "l_suppkey", c("l_quantity").alias("q"), F.lit(1).alias("syntax_pass"), F.lit(1).alias("execution_pass"), (c("l_tax") >= 0.07).cast("int").alias("invalid_candidate_flag"), (c("l_discount") >= 0.09).cast("int").alias("redefines_target_flag"), (c("l_linenumber") % 3).alias("neg_logic_signal_count"), (c("l_linenumber") % 2).alias("failure_log_count"))
    pos = li.filter("l_returnflag = 'A'").withColumn("mutation_score", c("q"))
    neg = li.filter("l_returnflag = 'R'").withColumn("mutation_score", F.when(c("l_suppkey") % 4 > 0, c("q")))
    out = PL.pair_validity(PL.pairs(pos, neg))
    return out.select(c("task_id").alias("k"), c("id_pos").alias("p"), c("id_neg").alias("n"), c("pair_exec_valid").alias("ok"), c("pair_logic_valid").alias("logic"), c("pair_high_info").alias("high"))


@query("flt_15_strength_cells", "SELECT cell, count(*) FILTER (CASE WHEN cell IN ('LH', 'HH') THEN f >= 1 ELSE f <= 0 END) AS n FROM (SELECT CASE WHEN o_totalprice > 250000 THEN 'H' ELSE 'L' END || CASE WHEN o_orderpriority < '3' THEN 'H' ELSE 'L' END AS cell, o_custkey % 3 AS f FROM orders) GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumns({"cell": D.cell(F.col("o_totalprice") > 250000, F.col("o_orderpriority") < "3"), "f": F.col("o_custkey") % 3})
    return o.groupBy("cell").agg(F.count_if(PL.strength("cell", "f")).alias("n"))


@query("join_02_dedup_then_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) = 1) ON c_custkey = o_custkey")
def _(spark, sf):
    one = R.first_per_key(table(spark, sf, "orders"), ["o_custkey"], R.last(("o_totalprice", "desc"), "o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, sf, "customer").select("c_custkey").join(one, "c_custkey", "left")


@query("join_06_two_raters", "SELECT a.doc_id, a.quality AS score_r1, b.toxic AS score_r2 FROM labels a JOIN labels b ON a.doc_id = b.doc_id")
def _(spark, sf):
    lab = table(spark, sf, "labels")
    a, b = (P.with_side(lab.select("doc_id", F.col(c).alias("score")), s, ["doc_id"]) for c, s in (("quality", "r1"), ("toxic", "r2")))
    return a.join(b, "doc_id")


@query("join_12_fallback_to_own", "SELECT o_orderkey, coalesce(c_name, 'order ' || o_orderkey) AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000")
def _(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf, "orders").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("order "), F.col("o_orderkey"))).alias("name"))


@query("join_15_lookup_with_default", "SELECT p_partkey, coalesce(CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'PROMO' THEN 'high' END, 'unselected') AS tier FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.coalesce(S.lookup("p_type", {"ECONOMY": "low", "PROMO": "high"}), F.lit("unselected")).alias("tier"))


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("agg_04_counts_with_empty_cells", "SELECT r, t, count(e.event_id) AS n FROM (SELECT DISTINCT user_id % 4 AS r FROM events), (SELECT DISTINCT event_type AS t FROM events) LEFT JOIN (SELECT * FROM events WHERE value > 99) e ON e.user_id % 4 = r AND e.event_type = t GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 4).alias("r"), F.col("event_type").alias("t"), "value")
    few = e.filter("value > 99").groupBy("r", "t").agg(F.count("*").alias("n"))
    return R.all_cells(e, "r", "t").join(few, ["r", "t"], "left").na.fill(0, ["n"])


@query("agg_11_pair_rates", "SELECT source, count(*) AS n, round(avg(quality), 6) AS rate, round(avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0), 4) AS delta FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    of = lambda q: F.avg(F.when(F.col("quality") == q, F.col("n_chars")))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("rate"), F.round(of(1) - of(0), 4).alias("delta"))


@query("agg_22_signal_count", "SELECT event_id, CAST((value > 50)::INT + (event_type = 'error')::INT + coalesce(CASE WHEN user_id % 2 = 0 THEN 1 END, 0) AS INT) AS signals FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") > 50).cast("int").alias("a"), (F.col("event_type") == "error").cast("int").alias("b"), F.when(F.col("user_id") % 2 == 0, 1).alias("c"))
    return e.select("event_id", PL.signal_count("a", "b", "c").alias("signals"))


@query("agg_26_conditional_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS n_hard_ok, count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority <= '2') AS n_mild1, count(DISTINCT o_orderpriority) AS n_kinds FROM orders GROUP BY 1")
def _(spark, sf):
    ok = F.col("o_orderstatus") != "F"
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(ok).alias("n_hard_ok"), F.count_if(ok & (F.col("o_orderpriority") <= "2")).alias("n_mild1"), F.count_distinct("o_orderpriority").alias("n_kinds"))


@query("agg_31_strength_by_task", "SELECT k, count(*) FILTER (t = 'strong') AS n_strong, count(*) FILTER (t = 'ordinary') AS n_ordinary, round(avg(p) FILTER (t = 'strong'), 6) AS mean_strong FROM (SELECT o_custkey AS k, o_totalprice AS p, CASE WHEN count(*) OVER w = 1 THEN 'singleton' WHEN row_number() OVER (w ORDER BY o_totalprice DESC, o_orderkey) <= ceil(count(*) OVER w / 2.0) THEN 'strong' ELSE 'ordinary' END AS t FROM orders WINDOW w AS (PARTITION BY o_custkey)) GROUP BY 1")
def _(spark, sf):
    h = R.halves(table(spark, sf, "orders"), ["o_custkey"], [("o_totalprice", "desc"), "o_orderkey"])
    return h.groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("tier") == "strong").alias("n_strong"), F.count_if(F.col("tier") == "ordinary").alias("n_ordinary"), F.round(F.avg(F.when(F.col("tier") == "strong", F.col("o_totalprice"))), 6).alias("mean_strong"))


@query("sta_08_diagnostic_score", "SELECT event_id, (event_type = 'error')::INT + (value > 80)::INT + (coalesce(CASE WHEN user_id % 3 > 0 THEN value / 100 END, 1.0) <= 0.85)::INT + (user_id % 5 >= 2)::INT AS score FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("has_assertion_mismatch"), (F.col("value") > 80).cast("int").alias("has_call_contract"), *[F.lit(0).alias(c) for c in ("has_weak_assert", "has_boundary_gap", "has_exception_gap")], F.when(F.col("user_id") % 3 > 0, F.col("value") / 100).alias("mutation_score"), (F.col("user_id") % 5).alias("failure_log_count"))
    return e.select("event_id", PL.diagnostic_score().alias("score"))


@query(
    "sta_03_anchor_score_by_tier",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS t, l_quantity AS m, l_discount AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(0.45 * (m - avg(m) OVER w) / stddev_samp(m) OVER w + 0.2 * (b - avg(b) OVER w) / stddev_samp(b) OVER w, 6) AS score FROM x WINDOW w AS (PARTITION BY t)""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"mutation_score": F.col("l_quantity"), "branch_coverage": F.col("l_discount"), **{c: F.lit(0.0) for c in PL.ANCHOR_WEIGHTS if c not in ("mutation_score", "branch_coverage")}})
    return PL.anchor_score(li, "score", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 6).alias("score"))


@query(
    "sta_04_negative_score",
    """WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) SELECT event_id, round(1.2 * (event_type = 'error')::INT + 0.9 * (user_id % 2) - 0.8 * (value - m) / d, 6) AS score FROM events, s""",
)
def _(spark, sf):
    flags = {"has_mutation_survival": (F.col("event_type") == "error").cast("int"), "has_exception_gap": (F.col("user_id") % 2).cast("int")}
    e = table(spark, sf, "events").withColumns(flags | {c: F.lit(0) for c in PL.NEGATIVE_FLAGS if c not in flags} | {"mutation_score": F.col("value")} | {c: F.lit(0.0) for c in PL.NEGATIVE_TERMS if c != "mutation_score"})
    return PL.negative_score(e, "score").select("event_id", F.round("score", 6).alias("score"))


@query(
    "sta_06_teaching_score",
    """WITH s AS (SELECT avg(l_tax) mt, stddev_samp(l_tax) st, avg(l_quantity) mq, stddev_samp(l_quantity) sq FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(0.35 * (l_tax - mt) / st, 6) AS proxy, round(0.35 * (l_quantity - mq) / sq + 0.2 * 0.35 * (l_tax - mt) / st, 6) AS score FROM lineitem, s""",
)
def _(spark, sf):
    names = {*PL.TEACHING_PROXY, *PL.TEACHING} - {"assert_density", "mutation_score"}
    li = table(spark, sf, "lineitem").withColumns({"assert_density": F.col("l_tax"), "mutation_score": F.col("l_quantity"), **{c: F.lit(0.0) for c in names}})
    return PL.teaching_scores(li).select("l_orderkey", "l_linenumber", "l_partkey", F.round("teaching_proxy_score", 6).alias("proxy"), F.round("positive_teaching_score", 6).alias("score"))


@query(
    "sta_07_provisional_score",
    "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) SELECT event_id, round((value - m) / d, 6) AS score FROM events, s",
)
def _(spark, sf):
    e = table(spark, sf, "events").withColumns({"mutation_score": F.col("value"), **{c: F.lit(0.0) for c in PL.PROVISIONAL if c != "mutation_score"}})
    return ST.weighted_z(e, PL.PROVISIONAL, "s").select("event_id", F.round("s", 6).alias("score"))


# --- sorts, limits and sets --------------------------------------------------------------------------------------------


@query("sort_01_nulls_last", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) ORDER BY v DESC NULLS LAST, event_id LIMIT 50")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("value")).alias("v"))
    return e.orderBy(*R.last(("v", "desc"), "event_id")).limit(50).select("event_id")


@query("sort_02_category_order", "SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS pos FROM orders)")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("place", P.ordered_category("o_orderstatus", {"P": 0, "O": 1}))
    return R.rank(o, ["o_custkey"], R.last("place", "o_orderkey"), "pos").select("o_orderkey", F.col("pos").cast("long").alias("pos"))


@query("lim_02_balanced_sets", "WITH a AS (SELECT p_partkey FROM part WHERE p_size < 5), b AS (SELECT p_partkey FROM part WHERE p_size > 25), n AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n) SELECT p_partkey, 'a' AS side FROM a QUALIFY row_number() OVER (ORDER BY p_partkey) <= (SELECT n FROM n) UNION ALL SELECT p_partkey, 'b' FROM b QUALIFY row_number() OVER (ORDER BY p_partkey) <= (SELECT n FROM n)")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    a, b = R.balance(p.filter("p_size < 5"), p.filter("p_size > 25"), R.last("p_partkey"))
    return a.select("p_partkey", F.lit("a").alias("side")).unionByName(b.select("p_partkey", F.lit("b").alias("side")))


@query("set_01_union_differing_schemas", "SELECT c_custkey AS id, c_name AS name, NULL AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


@query("set_07_ordered_unique", "SELECT o_custkey, min(o_orderkey) AS first_seen FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_seen"))


@query("app_12_users_upsert", "SELECT 'a' AS name, 'x' AS role, '1' AS created UNION ALL SELECT 'b', 'z', '2' UNION ALL SELECT 'c', 'w', '9'")
def _(spark, sf):
    s = "name string, role string, created string"
    return RP.users_upsert(spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], s), spark.createDataFrame([("b", "z", "9"), ("c", "w", "9")], s))


@query("app_03_record", "SELECT 2 AS id, 'second' AS candidate")
def _(spark, sf):
    rows = [(1, '{"candidates": ["only"]}'), (2, '{"candidates": ["first", "second"]}')]
    return RP.record(spark.createDataFrame(rows, "id int, result string"), 2, 7).select("id", "candidate")


@query("app_13_backfill", "SELECT 1 AS id, 0 AS mutationvalid UNION ALL SELECT 2, 1")
def _(spark, sf):
    return RP.backfill(spark.createDataFrame([(1, '{"metrics": {"mutationvalid": false}}'), (2, "{}")], "id int, result string")).select("id", "mutationvalid")


# --- text functions ----------------------------------------------------------------------------------------------------


@query("fn_03_code_lines", r"SELECT doc_id, CASE WHEN trim(text) <> '' THEN CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS INT) END AS loc, contains(text, '>>>') AS doctest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.loc("text").alias("loc"), S.has_doctest("text").alias("doctest"))


@query("fn_13_exception_words", r"SELECT page_id, regexp_matches(html, '(?i)\b(raise|raises|raised|error|exception|invalid|illegal|fail|fails|failure|overflow|underflow|zerodivision|typeerror|valueerror|keyerror|indexerror|runtimeerror)\b') AS says FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.mentions_exception("html").alias("says"))


@query("fn_29_topic_signals", "SELECT doc_id, array_to_string(CASE WHEN len(f) > 0 THEN f ELSE ['general'] END, '|') AS topics FROM (SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' END, CASE WHEN regexp_matches(text, '@') THEN 'mail' END], lambda x: x IS NOT NULL) AS f FROM documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(S.signals("text", {"licence": "licen[sc]e", "mail": "@"}), "|").alias("topics"))


@query("fn_42_test_style", "SELECT event_id, CASE WHEN user_id % 3 > 0 AND user_id % 2 > 0 THEN 'mixed' WHEN user_id % 3 > 0 THEN 'pytest_function' WHEN user_id % 2 > 0 THEN 'top_level_assert' WHEN event_type = 'error' THEN 'other_assertion_style' ELSE 'none' END AS style FROM events")
def _(spark, sf):
    u = F.col("user_id")
    return table(spark, sf, "events").select("event_id", S.test_style(u % 3, u % 2, F.lit(0), (F.col("event_type") == "error").cast("int")).alias("style"))


@query("fn_33_proxies", "SELECT o_orderkey, least(1.0, (o_custkey % 12) / 8.0)::DOUBLE AS boundary, round((o_custkey % 101) / 100.0::DOUBLE, 6) AS ratio FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.boundary_proxy(F.col("o_custkey") % 12).alias("boundary"), S.percent_to_ratio(F.col("o_custkey") % 101).alias("ratio"))


@query("fn_46_wrapped_lines", "SELECT item_id, i AS line_no, substr(text, i * 58 + 1, 58) AS line FROM (SELECT item_id, text, unnest(range(CAST(greatest(1, ceil(length(text) / 58.0)) AS INT)))::INT AS i FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark))")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.translate("text", "\n", " ").alias("text"))
    return b.select("item_id", F.posexplode(S.wrap("text")).alias("line_no", "line"))
