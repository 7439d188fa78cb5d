"""Queries on shapes, checks, scalar functions, ranks and samples.

The driver's tables stand in for tasks and candidates: orders are tasks, order lines or documents are candidates.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkassay.functions import scalars as S
from sparkassay.functions import statistics as ST
from sparkassay.operators import checks as C
from sparkassay.operators import datasets as D
from sparkassay.operators import ranking as R
from sparkassay.operators import shape as P
from sparkassay.plans.registry import query, table


@query(
    "val_01_rule_counts",
    """WITH b AS (SELECT unnest(list_filter([CASE WHEN NOT coalesce(trim(text) <> '', false) THEN 'text_required' END, CASE WHEN NOT coalesce(lang IN ('en', 'de'), false) THEN 'lang_known' END,
    CASE WHEN NOT coalesce(n_chars >= 500, false) THEN 'long_enough' END, CASE WHEN NOT coalesce(n_chars = length(text), false) THEN 'n_chars_matches' END], lambda x: x IS NOT NULL)) AS rule FROM documents)
    SELECT rule, CASE WHEN rule IN ('text_required', 'n_chars_matches') THEN 'error' ELSE 'warning' END AS level, count(*) AS n FROM b GROUP BY ALL""",
)
def _(spark, sf):
    rules = {"text_required": ("error", C.present("text")), "lang_known": ("warning", F.col("lang").isin("en", "de")), "long_enough": ("warning", F.col("n_chars") >= 500), "n_chars_matches": ("error", F.col("n_chars") == F.length("text"))}
    return C.rule_counts(C.broken_rules(table(spark, sf, "documents"), "doc_id", rules))


@query("val_03_duplicate_keys", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return C.duplicates(table(spark, sf, "conversations"), "conv_id")


@query("val_05_run_ids_by_table", "SELECT 'customer' AS table_name, count(DISTINCT c_mktsegment) AS n_run_ids, min(c_mktsegment) AS first_run_id FROM customer UNION ALL SELECT 'orders', count(DISTINCT o_orderstatus), min(o_orderstatus) FROM orders")
def _(spark, sf):
    return C.run_ids({"customer": table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "run_id"), "orders": table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "run_id")})


@query(
    "val_06_inferred_run_id",
    """SELECT user_id, CASE count(DISTINCT r) WHEN 0 THEN 'unknown_run' WHEN 1 THEN min(r) ELSE 'mixed_runs' END AS run_id
    FROM (SELECT user_id, CASE WHEN event_type IN ('error', 'purchase') THEN event_type END AS r FROM events) GROUP BY 1""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").withColumn("r", F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type")))
    return ev.groupBy("user_id").agg(C.inferred_run_id("r").alias("run_id"))


@query(
    "val_08_split_faults",
    """WITH s AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 < 7 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 10 BETWEEN 6 AND 8 UNION ALL SELECT -1)
    SELECT 'in_several_splits' AS fault, (SELECT count(*) FROM (SELECT c_custkey FROM s GROUP BY 1 HAVING count(*) > 1)) AS n
    UNION ALL SELECT 'not_covered', (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM s))
    UNION ALL SELECT 'not_in_pool', (SELECT count(DISTINCT c_custkey) FROM s WHERE c_custkey NOT IN (SELECT c_custkey FROM customer))""",
)
def _(spark, sf):
    pool = table(spark, sf, "customer").select("c_custkey")
    k = F.col("c_custkey") % 10
    splits = pool.filter(k < 7).unionByName(pool.filter(k.between(6, 8))).unionByName(spark.sql("SELECT -1L AS c_custkey"))
    return C.split_faults(pool, splits, "c_custkey")


@query("val_12_match_flags", "SELECT count(*) FILTER (o_orderkey IS NOT NULL) AS matched, count(*) FILTER (o_orderkey IS NULL) AS unmatched FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey")
def _(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return C.match_flags(table(spark, sf, "lineitem"), orders, "l_orderkey")


@query(
    "prj_02_coerce_and_defaults",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE WHEN try_cast(json_extract_string(props, '$.k') AS DOUBLE) > 50 THEN 1 ELSE 0 END AS high,
    'unknown' AS origin, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed FROM events""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.initcap((F.col("event_type") == "error").cast("string")).alias("failed"))
    ev = P.ensure_columns(P.coerce(ev, numbers=["k"], flags=["failed"]), {"origin": "unknown"})
    return ev.withColumn("high", P.flag(F.col("k") - 50))


@query("prj_12_sample_id", "SELECT doc_id, 'a1_' || substr(sha1(trim(CAST(doc_id AS VARCHAR))), 1, 10) AS sample_id, sha256(text) AS text_sha256 FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.sample_id("doc_id").alias("sample_id"), F.sha2("text", 256).alias("text_sha256"))


@query("prj_14_candidate_id", "SELECT o_orderkey, o_orderstatus || '__' || o_orderpriority || '__' || o_custkey || '__c' || lpad(CAST(o_orderkey % 7 AS VARCHAR), 2, '0') AS candidate_id, o_orderstatus || '__' || o_orderpriority AS task_group FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", P.candidate_id(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string"), index=F.col("o_orderkey") % 7).alias("candidate_id"), P.group_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("task_group"))


@query(
    "prj_20_prompt",
    """SELECT o_orderkey, 'Write unit tests for the task.' || chr(10) || 'Task: ' || o_orderkey || chr(10) || 'Entry point: ' || coalesce(c_name, '') || chr(10) || 'Signature: ' || coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, '') || chr(10) || 'Description:' || chr(10) || coalesce(c_mktsegment, '') AS prompt
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""",
)
def _(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").filter("c_acctbal > 0")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", P.prompt(F.col("o_orderkey"), F.col("c_name"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), F.col("c_mktsegment")).alias("prompt"))


@query(
    "fn_02_text_metrics",
    r"""SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS INT) AS n_lines, length(text) AS n_chars_seen,
    CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS INT) AS n_words FROM documents""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.nonblank_lines("text").alias("n_lines"), F.length("text").cast("long").alias("n_chars_seen"), S.word_count("text").alias("n_words"))


@query(
    "fn_20_keyword_signals",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\b(empty|none|null|zero|negative|min|max|boundary|invalid)\b')) AS INT) AS hits,
    round(least(len(regexp_extract_all(text, '(?i)\b(empty|none|null|zero|negative|min|max|boundary|invalid)\b')) / 3.0, 1.0), 6) AS boundary_coverage, contains(text, 'the') AS says_the,
    CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS INT) AS n_the FROM documents""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.boundary_hits("text").alias("hits"), S.capped_ratio(S.boundary_hits("text"), 3).alias("boundary_coverage"), F.contains("text", F.lit("the")).alias("says_the"), S.occurrences("text", "the").alias("n_the"))


@query("fn_01_evidence_clip", "SELECT page_id, CASE WHEN substr(trim(html), 1, 1200) <> '' THEN substr(trim(html), 1, 1200) END AS evidence, CASE WHEN split_part(url, ':', 1) IN ('https') THEN 'https' ELSE 'other' END AS category FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.evidence("html").alias("evidence"), P.guard(F.split_part("url", F.lit(":"), F.lit(1)), ["https"]).alias("category"))


@query(
    "fn_12_page_names",
    r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, coalesce(nullif(substr(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 1, 180), ''), 'item') AS file_name,
    CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INT) AS n_links, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_no FROM pages""",
)
def _(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), S.safe_name("url").alias("file_name"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("n_links"), F.coalesce(S.last_query_value("url", "page"), F.lit("")).alias("page_no"))


@query(
    "fn_36_paths",
    r"""SELECT page_id, nullif(array_to_string(list_filter(string_split(replace(url, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.', '..') AND NOT regexp_full_match(x, '[A-Za-z]:')), '/'), '') AS path,
    regexp_matches(url, '(^|/)(tests?/|test_[^/]*\.py$|[^/]*_test\.py$|conftest\.py$)') AS is_test FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.clean_path("url").alias("path"), S.is_test_path("url").alias("is_test"))


@query(
    "fn_28_log_audit",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)timed? ?out') THEN 'timeout' END, CASE WHEN regexp_matches(text, '(?i)permission denied') THEN 'permission' END, CASE WHEN regexp_matches(text, '(?i)connection|socket') THEN 'network' END,
    CASE WHEN regexp_matches(text, '(?i)traceback') THEN 'traceback' END], lambda x: x IS NOT NULL), '|') AS findings, right(text, 40) AS tail FROM documents
    WHERE NOT regexp_matches(text, '(?i)importerror|modulenotfounderror|syntaxerror|indentationerror|assertionerror|memoryerror|out of memory')""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").filter(~F.col("text").rlike("(?i)importerror|modulenotfounderror|syntaxerror|indentationerror|assertionerror|memoryerror|out of memory"))
    return d.select("doc_id", F.array_join(S.audit_log("text"), "|").alias("findings"), F.right("text", F.lit(40)).alias("tail"))


@query(
    "sta_03_weighted_z",
    """WITH s AS (SELECT avg(l_quantity) mq, stddev_samp(l_quantity) sq, avg(l_extendedprice) me, stddev_samp(l_extendedprice) se, avg(l_discount) md, stddev_samp(l_discount) sd FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round(0.45 * (l_quantity - mq) / sq + 0.35 * (l_extendedprice - me) / se - 0.2 * (l_discount - md) / sd, 6) AS score FROM lineitem, s""",
)
def _(spark, sf):
    z = ST.weighted_z(table(spark, sf, "lineitem"), {"l_quantity": 0.45, "l_extendedprice": 0.35, "l_discount": -0.2}, "z")
    return z.select("l_orderkey", "l_linenumber", "l_partkey", F.round("z", 6).alias("score"))


_TRAIN = "substr(sha1('7|' || o_orderkey), 1, 1) < 'b'"


@query(
    "sta_01_difficulty_fit_apply",
    f"""WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS c, {_TRAIN} AS train FROM orders),
    d AS (SELECT median(o_totalprice) AS dp, median(c) AS dc FROM o WHERE train), x AS (SELECT o_orderkey, train, o_totalprice AS p, coalesce(c, dc) AS c, c IS NULL AS imputed FROM o, d),
    s AS (SELECT avg(p) mp, stddev_pop(p) sp, avg(c) mc, stddev_pop(c) sc FROM x WHERE train), z AS (SELECT o_orderkey, train, imputed, 0.7 * (p - mp) / sp + 0.3 * (c - mc) / sc AS v FROM x, s),
    q AS (SELECT quantile_cont(v, 0.33) AS q1, quantile_cont(v, 0.67) AS q2 FROM z WHERE train)
    SELECT o_orderkey, train, imputed, round(v, 6) AS score, CASE WHEN v <= q1 THEN 'easy' WHEN v <= q2 THEN 'medium' ELSE 'hard' END AS bucket FROM z, q""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey").cast("double")).alias("c"), (F.substring(R.shuffle_key(7, "o_orderkey"), 1, 1) < "b").alias("train"))
    z = ST.fitted_score(o, F.col("train"), {"o_totalprice": 0.7, "c": 0.3}, "v")
    q = ST.cut_points(z, "v", F.col("train"))
    return z.crossJoin(F.broadcast(q)).select("o_orderkey", "train", F.col("imputed_c").alias("imputed"), F.round("v", 6).alias("score"), S.bucket(F.col("v"), F.col("q1"), F.col("q2")).alias("bucket"))


@query(
    "sta_02_quantile_groups",
    """WITH q AS (SELECT quantile_cont(value, 0.33) AS q1, quantile_cont(value, 0.67) AS q2 FROM events WHERE event_type <> 'error')
    SELECT event_id, CASE WHEN value IS NULL THEN 'unusable' WHEN event_type = 'error' THEN 'flagged' WHEN value >= q2 THEN 'high' WHEN value >= q1 THEN 'medium' ELSE 'low' END AS group_name FROM events, q""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    q = ST.cut_points(e, "value", F.col("event_type") != "error")
    return e.crossJoin(F.broadcast(q)).select("event_id", S.quantile_group(F.col("value"), F.col("q1"), F.col("q2"), F.col("value").isNotNull(), (F.col("event_type") == "error").cast("int")).alias("group_name"))


@query(
    "win_01_thirds",
    """SELECT o_orderkey, CASE WHEN p < 1 / 3.0 THEN 'easy' WHEN p < 2 / 3.0 THEN 'medium' ELSE 'hard' END AS bucket
    FROM (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 0.5) / count(*) OVER (PARTITION BY o_orderstatus) AS p FROM orders)""",
)
def _(spark, sf):
    return R.thirds(table(spark, sf, "orders"), ["o_orderstatus"], ["o_orderkey"], "bucket").select("o_orderkey", "bucket")


@query(
    "smp_01_stratified_split",
    """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1('42|' || c_custkey), c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT c_custkey, c_mktsegment, CASE WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train_pool' WHEN rn <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'main_test' ELSE 'capability_retention' END AS split FROM r""",
)
def _(spark, sf):
    return R.split(table(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", 42, {"train_pool": 0.7, "main_test": 0.2, "capability_retention": 0.1}).select("c_custkey", "c_mktsegment", "split")


@query(
    "smp_02_quota_shortfall",
    """WITH o AS (SELECT * FROM orders WHERE o_totalprice > 490000), t AS (SELECT o_orderstatus, o_orderpriority, least(count(*), 18) AS taken, count(*) AS available FROM o GROUP BY ALL),
    d AS (SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders), (SELECT DISTINCT o_orderpriority FROM orders))
    SELECT o_orderstatus, o_orderpriority, coalesce(available, 0) AS available, coalesce(taken, 0) AS taken, CAST(18 - coalesce(taken, 0) AS BIGINT) AS shortfall FROM d LEFT JOIN t USING (o_orderstatus, o_orderpriority)""",
)
def _(spark, sf):
    all_orders = table(spark, sf, "orders")
    o = all_orders.filter("o_totalprice > 490000")
    by = ["o_orderstatus", "o_orderpriority"]
    taken = R.sample(o, by, "o_orderkey", 18, 42)
    return R.quota_report(o, taken, R.all_cells(all_orders, *by), by, 18)


@query(
    "smp_03_sample_per_cell",
    """SELECT event_id, cell FROM (SELECT event_id, cell, row_number() OVER (PARTITION BY cell, u ORDER BY sha1('13|' || event_id), event_id) AS rn
    FROM (SELECT event_id, user_id % 5 AS u, CASE WHEN event_type <> 'click' THEN event_type END AS cell FROM events)) WHERE rn <= 4""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 5).alias("u"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("cell"))
    return R.sample(e, ["cell", "u"], "event_id", 4, 13).select("event_id", "cell")


@query("smp_04_rater_orders", "SELECT item_id, row_number() OVER (ORDER BY sha1('11|' || item_id), item_id) AS pos_r1, row_number() OVER (ORDER BY sha1('22|' || item_id), item_id) AS pos_r2 FROM benchmark")
def _(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id")
    return R.shuffled(R.shuffled(b, "item_id", 11, "pos_r1"), "item_id", 22, "pos_r2").select("item_id", F.col("pos_r1").cast("long").alias("pos_r1"), F.col("pos_r2").cast("long").alias("pos_r2"))


_LINE = "l_extendedprice DESC NULLS LAST, l_discount DESC NULLS LAST, l_orderkey NULLS LAST, l_linenumber NULLS LAST, l_partkey NULLS LAST, l_suppkey NULLS LAST"
_LINE_BY = (("l_extendedprice", "desc"), ("l_discount", "desc"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("win_03_top_k", f"SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {_LINE}) AS rn FROM lineitem) WHERE rn <= 8")
def _(spark, sf):
    top = R.top_k(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], R.last(*_LINE_BY), 8)
    return top.select("l_returnflag", "l_linestatus", *_KEYS, F.col("rn").cast("long").alias("rn"))


@query(
    "win_04_ends",
    "SELECT event_id, user_id, rn FROM (SELECT event_id, user_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id)) WHERE n <= 3 OR rn <= 2 OR rn = n",
)
def _(spark, sf):
    return R.ends(table(spark, sf, "events"), ["user_id"], R.last(("value", "desc"), "event_id"), 3).select("event_id", "user_id", F.col("rn").cast("long").alias("rn"))


@query(
    "win_05_nearest_median",
    """SELECT event_type, event_id, round(mid, 6) AS mid, rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(abs(value - mid), 9) NULLS LAST, event_id) AS rn FROM
    (SELECT event_type, event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY event_type) AS mid FROM events)) WHERE rn <= 4""",
)
def _(spark, sf):
    return R.nearest_median(table(spark, sf, "events"), ["event_type"], "value", "event_id", 4).select("event_type", "event_id", F.round("mid", 6).alias("mid"), F.col("rn").cast("long").alias("rn"))


@query(
    "win_06_halves",
    """SELECT o_orderkey, o_custkey, CASE WHEN n = 1 THEN 'singleton' WHEN rn <= ceil(n / 2.0) THEN 'strong' ELSE 'ordinary' END AS tier FROM
    (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""",
)
def _(spark, sf):
    return R.halves(table(spark, sf, "orders"), ["o_custkey"], [("o_totalprice", "desc"), "o_orderkey"]).select("o_orderkey", "o_custkey", "tier")


@query(
    "win_07_extremes",
    """WITH h AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rn FROM part)
    SELECT p_brand, p_partkey, rn, 'high' AS margin FROM h WHERE rn <= 3 UNION ALL SELECT p_brand, p_partkey, lo, 'low' FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice NULLS LAST, p_partkey) AS lo FROM h WHERE rn > 3) WHERE lo <= 3""",
)
def _(spark, sf):
    return R.extremes(table(spark, sf, "part"), ["p_brand"], "p_retailprice", "p_partkey", 3).select("p_brand", "p_partkey", F.col("rn").cast("long").alias("rn"), "margin")


@query(
    "win_08_alternate_swap",
    "SELECT item_id, CASE WHEN s THEN 'rejected' ELSE 'chosen' END AS label, s AS swapped FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) - 1) % 2 = 1 AS s FROM benchmark)",
)
def _(spark, sf):
    b = R.alternate(table(spark, sf, "benchmark").withColumn("g", F.col("item_id") % 3), ["g"], R.last("item_id"))
    return b.select("item_id", F.when(F.col("swapped"), "rejected").otherwise("chosen").alias("label"), "swapped")


@query("win_09_cycle", "SELECT i AS slot, item_id FROM range(100) t(i) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS p FROM benchmark) ON i % (SELECT count(*) FROM benchmark) = p")
def _(spark, sf):
    b = R.spread_rank(table(spark, sf, "benchmark").select("item_id"), [], [F.col("item_id")], F.floor(F.col("item_id") / 1000)).withColumn("p", F.col("rn") - 1)
    return R.cycle(b, "p", b.count(), 100).select("slot", "item_id")


@query(
    "win_10_round_robin",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY r, event_type) AS turn FROM
    (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id) AS r FROM events)""",
)
def _(spark, sf):
    return R.round_robin(table(spark, sf, "events"), ["user_id"], "event_type", R.last(("value", "desc"), "event_id")).select("event_id", "user_id", F.col("turn").cast("long").alias("turn"))


@query(
    "win_13_monotone_progress",
    "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM events",
)
def _(spark, sf):
    return R.running_max(table(spark, sf, "events"), ["user_id"], R.last("ts", "event_id"), "value").select("event_id", "progress")


@query("agg_41_recent_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 5 PRECEDING), 6) AS recent_mean FROM events")
def _(spark, sf):
    return R.running_mean(table(spark, sf, "events"), ["user_id"], R.last("ts", "event_id"), "value").select("event_id", F.round("recent_mean", 6).alias("recent_mean"))


@query(
    "smp_05_largest_remainder",
    """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, 101.0::DOUBLE * n / sum(n) OVER () AS raw FROM c), b AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base FROM r)
    SELECT o_orderpriority, n, base + CASE WHEN row_number() OVER (ORDER BY round(raw - base, 9) DESC, raw DESC, o_orderpriority DESC) <= 101 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b""",
)
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return R.largest_remainder(counts, "o_orderpriority", "n", 101).select("o_orderpriority", "n", "quota")


@query(
    "smp_06_fixed_budget",
    """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, 70.0::DOUBLE * n / sum(n) OVER () AS raw FROM c), b AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base FROM r),
    q AS (SELECT o_orderstatus, base + CASE WHEN row_number() OVER (ORDER BY round(raw - base, 9) DESC, raw DESC, o_orderstatus DESC) <= 70 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
    t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rr FROM orders)
    SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY rr, o_orderpriority) AS turn FROM t) JOIN q USING (o_orderstatus) WHERE turn <= quota""",
)
def _(spark, sf):
    return D.fixed_budget(table(spark, sf, "orders"), 70, "o_orderstatus", "o_orderpriority", R.last(("o_totalprice", "desc"), "o_orderkey")).select("o_orderkey", "o_orderstatus")


@query("lim_03_latest", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 200")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id").orderBy(F.desc("event_id")).limit(200)


@query("set_05_id_sets", "(SELECT l_partkey AS k, 'both' AS place FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey, 'both' FROM part WHERE p_size < 10) UNION ALL (SELECT p_partkey, 'part_only' FROM part WHERE p_size < 10 EXCEPT SELECT l_partkey, 'part_only' FROM lineitem WHERE l_quantity > 45)")
def _(spark, sf):
    a = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    b = table(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("k"))
    return a.intersect(b).withColumn("place", F.lit("both")).unionByName(b.subtract(a).withColumn("place", F.lit("part_only")))


@query(
    "set_03_priority_union",
    """SELECT doc_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS rn FROM (SELECT doc_id, 'labelled' AS origin, 0 AS p FROM labels WHERE quality = 1
    UNION ALL SELECT doc_id, 'long', 1 FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 'any', 2 FROM documents WHERE lang = 'en')) WHERE rn = 1""",
)
def _(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    parts = {"labelled": lab.filter("quality = 1").select("doc_id").distinct(), "long": d.filter("n_chars > 3000").select("doc_id"), "any": d.filter("lang = 'en'").select("doc_id")}
    return R.priority_union(parts, "doc_id").select("doc_id", "origin")


@query(
    "set_06_fallback_union",
    """WITH a AS (SELECT DISTINCT o_custkey AS k, 'urgent' AS origin FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k, 'any' AS origin FROM orders), c AS (SELECT c_custkey AS k, 'none' AS origin FROM customer)
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT * FROM c WHERE k NOT IN (SELECT k FROM b)""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    a = o.filter("o_orderpriority = '1-URGENT'").select("k").distinct().withColumn("origin", F.lit("urgent"))
    b = o.select("k").distinct().withColumn("origin", F.lit("any"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).withColumn("origin", F.lit("none"))
    return R.fallback_union([a, b, c], "k")


@query("set_08_sorted_sets", "SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))


@query(
    "set_04_fingerprint_dedup",
    "SELECT role, text, min(conv_id) AS first_conv, count(*) AS n FROM conversations GROUP BY role, text",
)
def _(spark, sf):
    return table(spark, sf, "conversations").groupBy("role", "text").agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("n"))


@query(
    "sort_07_cell_order",
    """SELECT o_orderkey, cell, rn FROM (SELECT o_orderkey, cell, row_number() OVER (PARTITION BY cell ORDER BY CASE WHEN cell IN ('HL', 'HH') THEN -o_totalprice ELSE o_totalprice END, o_orderkey) AS rn
    FROM (SELECT *, CASE WHEN o_totalprice > 250000 THEN 'H' ELSE 'L' END || CASE WHEN o_orderpriority < '3' THEN 'H' ELSE 'L' END AS cell FROM orders)) WHERE rn <= 5""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("cell", D.cell(F.col("o_totalprice") > 250000, F.col("o_orderpriority") < "3"))
    keyed = o.withColumn("k", R.signed_order("cell", D.DESCENDING, "o_totalprice"))
    return R.top_k(keyed, ["cell"], R.last("k", "o_orderkey"), 5).select("o_orderkey", "cell", F.col("rn").cast("long").alias("rn"))


@query("join_20_task_presets", "SELECT r_name, preset, ['plain', 'edge', 'error'][(row_number() OVER (PARTITION BY r_name ORDER BY preset) - 1) % 3 + 1] AS variant FROM region, (SELECT DISTINCT o_orderpriority AS preset FROM orders)")
def _(spark, sf):
    tasks = table(spark, sf, "region").select(F.col("r_name").alias("task_id"))
    presets = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("preset")).distinct()
    return D.expand_tasks(tasks, presets, ["plain", "edge", "error"]).select(F.col("task_id").alias("r_name"), "preset", "variant")
