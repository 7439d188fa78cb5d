"""Queries on pools, pairs, reports, the taxonomy, statistics and datasets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkassay.functions import scalars as S
from sparkassay.functions import statistics as ST
from sparkassay.operators import datasets as D
from sparkassay.operators import pools as PL
from sparkassay.operators import ranking as R
from sparkassay.operators import reports as RP
from sparkassay.operators import shape as P
from sparkassay.operators import taxonomy as TX
from sparkassay.plans.registry import query, table

# --- candidate pools ---------------------------------------------------------------------------------------------------

#: Order lines as candidates of their order: quantity, discount and tax stand for scores, price for the anchor score.
_CAND = """cand AS (SELECT l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS id, l_orderkey AS task_id, l_returnflag AS source, l_linestatus AS bucket, l_extendedprice AS price, l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_partkey AS part
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 ORDER BY l_extendedprice, l_partkey, l_quantity, l_discount, l_tax, l_suppkey) = 1)"""


def _candidates(spark, sf):
    li = table(spark, sf, "lineitem")
    c = li.select((F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("id"), F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("bucket"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_partkey").alias("part"), "l_suppkey")
    return R.first_per_key(c, ["id"], R.last("price", "part", "qty", "disc", "tax", "l_suppkey")).drop("l_suppkey")


TWO_TIER_SQL = f"""WITH {_CAND}, j AS (SELECT cand.*, o_orderstatus FROM cand JOIN orders ON task_id = o_orderkey WHERE o_orderstatus <> 'P'),
    both_tiers AS (SELECT *, 0 AS tier FROM j WHERE qty >= 45 AND disc <= 0.02 UNION ALL SELECT *, 1 FROM j WHERE qty >= 20 AND disc <= 0.05),
    z AS (SELECT *, CASE WHEN coalesce(stddev_samp(price) OVER w, 0) = 0 THEN 0 ELSE (price - avg(price) OVER w) / stddev_samp(price) OVER w END * 0.7 + CASE WHEN coalesce(stddev_samp(qty) OVER w, 0) = 0 THEN 0 ELSE (qty - avg(qty) OVER w) / stddev_samp(qty) OVER w END * 0.3 AS score FROM both_tiers WINDOW w AS (PARTITION BY tier)),
    one AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY source, bucket, id ORDER BY tier) = 1)
    SELECT source, bucket, id, tier, round(score, 6) AS score, rn FROM (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY tier, round(score, 9) DESC, id) AS rn FROM one) WHERE rn <= 50"""


@query("smp_08_two_tier_fill", TWO_TIER_SQL)
def two_tier_fill(spark, sf):
    """Candidates of valid tasks: strict ones by score first, relaxed ones fill each bucket's quota."""
    orders = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("task_id"))
    c = PL.members(_candidates(spark, sf), orders, "task_id")
    tiers = c.filter("qty >= 45 AND disc <= 0.02").withColumn("tier", F.lit(0)).unionByName(c.filter("qty >= 20 AND disc <= 0.05").withColumn("tier", F.lit(1)))
    scored = ST.weighted_z(tiers, {"price": 0.7, "qty": 0.3}, "score", ["tier"]).withColumn("s9", F.round("score", 9))
    out = R.two_tier_fill(scored, ["source", "bucket"], "tier", "id", R.last(("s9", "desc"), "id"), 50)
    return out.select("source", "bucket", "id", "tier", F.round("score", 6).alias("score"), F.col("rn").cast("long").alias("rn"))


@query(
    "smp_09_tier_cascade",
    f"""WITH {_CAND}, h AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY price DESC NULLS LAST, id) AS rn FROM cand),
    rest AS (SELECT *, quantile_cont(price, 0.5) OVER (PARTITION BY source, bucket) AS mid FROM h WHERE rn > 4),
    m AS (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY source, bucket ORDER BY round(abs(price - mid), 9) NULLS LAST, id) <= 4),
    w AS (SELECT * FROM rest WHERE id NOT IN (SELECT id FROM m) QUALIFY row_number() OVER (PARTITION BY source, bucket ORDER BY price NULLS LAST, id) <= 4)
    SELECT source, bucket, id, 'high' AS tier FROM h WHERE rn <= 4 UNION ALL SELECT source, bucket, id, 'medium' FROM m UNION ALL SELECT source, bucket, id, 'weak' FROM w""",
)
def _(spark, sf):
    return D.cascade(_candidates(spark, sf), ["source", "bucket"], "price", "id", 4).select("source", "bucket", "id", "tier")


@query(
    "smp_10_overlap_first",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 450000) SELECT c_custkey, c_mktsegment, overlap, rn FROM (SELECT c_custkey, c_mktsegment, overlap, row_number() OVER (PARTITION BY c_mktsegment ORDER BY overlap DESC, c_acctbal NULLS LAST, c_custkey) AS rn
    FROM (SELECT *, CASE WHEN c_custkey IN (SELECT k FROM a) THEN 1 ELSE 0 END AS overlap FROM customer)) WHERE rn <= 20""",
)
def _(spark, sf):
    anchors = table(spark, sf, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    out = D.overlap_first(table(spark, sf, "customer"), anchors, ["c_mktsegment"], "c_custkey", "c_acctbal", "c_custkey", 20)
    return out.select("c_custkey", "c_mktsegment", "overlap", F.col("rn").cast("long").alias("rn"))


@query(
    "flt_01_usable",
    f"""WITH {_CAND}, f AS (SELECT id, 1 AS syntax_pass, CASE WHEN qty > 5 THEN 1 ELSE 0 END AS execution_pass, CASE WHEN tax > 0.07 THEN 1 ELSE 0 END AS invalid, CASE WHEN disc > 0.09 THEN 1 ELSE 0 END AS redefines, CASE WHEN part % 7 <> 0 THEN disc * 10 END AS line, CASE WHEN part % 5 <> 0 THEN tax * 12 END AS mut FROM cand)
    SELECT execution_pass = 1 AND invalid = 0 AND redefines = 0 AS usable_exec, execution_pass = 1 AND invalid = 0 AND redefines = 0 AND line IS NOT NULL AND mut IS NOT NULL AS usable_eval, count(*) AS n, count(*) FILTER (mut >= 0.9 AND line >= 0.9) AS strict FROM f GROUP BY ALL""",
)
def _(spark, sf):
    c = _candidates(spark, sf).withColumns({"syntax_pass": F.lit(1), "execution_pass": (F.col("qty") > 5).cast("int"), "invalid_candidate_flag": (F.col("tax") > 0.07).cast("int"), "redefines_target_flag": (F.col("disc") > 0.09).cast("int"), "line_coverage": F.when(F.col("part") % 7 != 0, F.col("disc") * 10), "mutation_score": F.when(F.col("part") % 5 != 0, F.col("tax") * 12), "mutation_unavailable": F.lit(0)})
    return c.groupBy(PL.usable_exec().alias("usable_exec"), PL.usable_eval(c).alias("usable_eval")).agg(F.count("*").alias("n"), F.count_if((F.col("mutation_score") >= 0.9) & (F.col("line_coverage") >= 0.9)).alias("strict"))


@query("flt_17_semi_anti", "SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)) AS n_in, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)) AS n_out FROM customer GROUP BY 1")
def _(spark, sf):
    c = table(spark, sf, "customer")
    big = table(spark, sf, "orders").filter("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey"))
    inside = PL.members(c, big, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n_in"))
    outside = PL.non_members(c, big, "c_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n_out"))
    return inside.join(outside, "c_mktsegment", "full_outer").na.fill(0)


@query("flt_23_id_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (3, 17, 99)")
def _(spark, sf):
    return table(spark, sf, "orders").filter(PL.in_ids("17, 3,x,-4,3,99,", "o_orderkey")).select("o_orderkey", "o_orderstatus")


@query("flt_24_delete", "SELECT count(*) AS n_left FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 2 = 0)")
def _(spark, sf):
    return PL.delete(table(spark, sf, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 2 == 0)).agg(F.count("*").alias("n_left"))


@query(
    "join_01_first_writer_wins",
    """SELECT o_orderkey, o_custkey, o_orderstatus, c_name, c_acctbal AS balance FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 500) ON o_custkey = c_custkey""",
)
def _(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    one = table(spark, sf, "customer").filter("c_acctbal > 500").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_acctbal").alias("balance"))
    two = one.select("o_custkey", F.lit("late").alias("c_name"), F.lit("late").alias("o_orderstatus"))
    return P.wide_left_join(base, [one, two], "o_custkey")


@query(
    "join_03_pairs",
    """SELECT u.conv_id, u.turn AS turn_pos, a.turn AS turn_neg, CAST(length(a.text) - length(u.text) AS BIGINT) AS delta, round(greatest(length(a.text), length(u.text)) * 1.0 / nullif(least(length(a.text), length(u.text)), 0), 6) AS ratio
    FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant'""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").withColumn("n", F.length("text").cast("double"))
    p = PL.pairs(c.filter("role = 'user'"), c.filter("role = 'assistant'"), "conv_id")
    return p.select("conv_id", "turn_pos", "turn_neg", (F.col("n_neg") - F.col("n_pos")).cast("long").alias("delta"), F.round(S.ratio(F.col("n_pos"), F.col("n_neg")), 6).alias("ratio"))


_SURFACE = """s AS (SELECT doc_id, doc_id // 40 AS task, source, quality, CASE WHEN doc_id % 13 <> 0 THEN 1 END AS ok, CAST(n_chars / 5 AS BIGINT) AS tokens, doc_id % 9 AS asserts, doc_id % 4 AS fns, (doc_id % 10) / 20.0::DOUBLE AS comm, (doc_id % 8) / 16.0::DOUBLE AS dens, (doc_id % 6)::DOUBLE AS struct_c FROM documents JOIN labels USING (doc_id)),
    p AS (SELECT a.doc_id AS pos, b.doc_id AS neg, a.source, CASE WHEN b.doc_id % 2 = 0 THEN 'natural' ELSE 'program' END AS neg_source,
      CASE WHEN coalesce(a.ok <> 1, true) OR coalesce(b.ok <> 1, true) THEN 1 ELSE 0 END AS h1, CASE WHEN coalesce(greatest(a.tokens, b.tokens)::DOUBLE / nullif(least(a.tokens, b.tokens), 0) > 2.0, false) AND abs(a.tokens - b.tokens) > 80 THEN 1 ELSE 0 END AS h2,
      CASE WHEN abs(a.asserts - b.asserts) > 4 THEN 1 ELSE 0 END AS h3, CASE WHEN abs(a.fns - b.fns) > 2 THEN 1 ELSE 0 END AS h4, CASE WHEN abs(a.comm - b.comm) > 0.25 THEN 1 ELSE 0 END AS m1, CASE WHEN abs(a.dens - b.dens) > 0.25 THEN 1 ELSE 0 END AS m2, CASE WHEN abs(a.struct_c - b.struct_c) > 2 THEN 1 ELSE 0 END AS m3
      FROM s a JOIN s b ON a.task = b.task AND a.quality = 1 AND b.quality = 0)"""


def _surface_pairs(spark, sf):
    i = F.col("doc_id")
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(i.alias("candidate_id"), F.floor(i / 40).alias("task_id"), "source", "quality")
    feats = table(spark, sf, "documents").select(i.alias("candidate_id"), F.when(i % 13 != 0, 1).alias("execution_pass"), F.lit(1).alias("syntax_pass"), F.expr("CAST(round(n_chars / 5) AS BIGINT)").alias("token_length"), (i % 9).alias("num_asserts"), (i % 4).alias("num_test_functions"), ((i % 10) / 20.0).alias("comment_ratio"), ((i % 8) / 16.0).alias("assert_density"), (i % 6).cast("double").alias("surface_structural_complexity"))
    pairs = PL.pairs(d.filter("quality = 1").drop("quality"), d.filter("quality = 0").drop("quality"))
    pairs = PL.attach(pairs, feats, [c for c in feats.columns if c != "candidate_id"])
    return PL.surface_flags(pairs).withColumn("neg_source", F.when(F.col("candidate_id_neg") % 2 == 0, "natural").otherwise("program"))


@query("flt_13_surface_filter", f"WITH {_SURFACE} SELECT pos, neg, h1 + h2 + h3 + h4 AS hard, m1 + m2 + m3 AS mild, CASE WHEN h1 + h2 + h3 + h4 = 0 AND m1 + m2 + m3 <= 1 THEN 1 ELSE 0 END AS keep FROM p")
def _(spark, sf):
    return _surface_pairs(spark, sf).select(F.col("candidate_id_pos").alias("pos"), F.col("candidate_id_neg").alias("neg"), F.col("hard_fail_count").alias("hard"), F.col("mild_fail_count").alias("mild"), F.col("surface_filter_keep").alias("keep"))


@query("agg_12_surface_summary", f"WITH {_SURFACE}, k AS (SELECT *, CASE WHEN h1 + h2 + h3 + h4 = 0 AND m1 + m2 + m3 <= 1 THEN 1 ELSE 0 END AS keep FROM p) SELECT source, neg_source, count(*) AS n_before, CAST(sum(keep) AS BIGINT) AS n_after, round(avg(keep), 6) AS keep_rate, round(avg(h2), 6) AS tokens_rate, round(avg(m3), 6) AS structure_rate FROM k GROUP BY ALL")
def _(spark, sf):
    s = RP.pair_summary(_surface_pairs(spark, sf), ["source_pos", "neg_source"], ["hard_fail_tokens", "mild_fail_structure"])
    return s.select(F.col("source_pos").alias("source"), "neg_source", "n_before", "n_after", F.round("keep_rate", 6).alias("keep_rate"), F.round("hard_fail_tokens_rate", 6).alias("tokens_rate"), F.round("mild_fail_structure_rate", 6).alias("structure_rate"))


@query(
    "fn_38_bottleneck",
    """WITH p AS (SELECT o_custkey AS k, count(*) AS n_pos FROM orders WHERE o_totalprice > 400000 GROUP BY 1), n AS (SELECT o_custkey AS k, count(*) AS n_neg, count(*) FILTER (o_orderstatus <> 'P') AS n_hard_ok, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_mild1, count(*) FILTER (o_orderpriority <= '3') AS n_mild2 FROM orders WHERE o_totalprice < 100000 GROUP BY 1),
    j AS (SELECT coalesce(p.k, n.k) AS k, coalesce(n_pos, 0) AS n_pos, coalesce(n_neg, 0) AS n_neg, coalesce(n_hard_ok, 0) AS n_hard_ok, coalesce(n_mild1, 0) AS n_mild1, coalesce(n_mild2, 0) AS n_mild2 FROM p FULL JOIN n ON p.k = n.k)
    SELECT k, n_pos, n_neg, CASE WHEN n_pos = 0 THEN 'no_positive' WHEN n_neg = 0 THEN 'no_negative' WHEN n_hard_ok = 0 THEN 'all_hard_fail' WHEN n_mild1 > 0 THEN 'ok' WHEN n_mild2 > 0 THEN 'needs_mild_2' ELSE 'needs_mild_3' END AS bottleneck FROM j""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    pos = o.filter("o_totalprice > 400000").groupBy("k").agg(F.count("*").alias("n_pos"))
    neg = o.filter("o_totalprice < 100000").groupBy("k").agg(F.count("*").alias("n_neg"), F.count_if(F.col("o_orderstatus") != "P").alias("n_hard_ok"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_mild1"), F.count_if(F.col("o_orderpriority") <= "3").alias("n_mild2"))
    j = pos.join(neg, "k", "full_outer").na.fill(0).withColumn("n_pairs", F.col("n_pos") * F.col("n_neg"))
    return j.select("k", "n_pos", "n_neg", PL.bottleneck().alias("bottleneck"))


@query(
    "smp_07_matched_random",
    """WITH d AS (SELECT doc_id, n_chars, CASE WHEN doc_id = 0 THEN 'rare' ELSE lang END AS lang, CASE WHEN n_chars > 12000 THEN 'long ' || doc_id ELSE source END AS source FROM documents WHERE n_chars IS NOT NULL),
    a AS (SELECT doc_id AS anchor_id, lang, source, n_chars AS av FROM d),
    l0 AS (SELECT a.anchor_id, d.doc_id, abs(d.n_chars - av) AS gap, 0 AS level FROM a JOIN d ON a.lang = d.lang AND a.source = d.source AND a.anchor_id <> d.doc_id),
    l1 AS (SELECT a.anchor_id, d.doc_id, abs(d.n_chars - av) AS gap, 1 AS level FROM a JOIN d ON a.lang = d.lang AND a.anchor_id <> d.doc_id WHERE a.anchor_id NOT IN (SELECT anchor_id FROM l0)),
    l2 AS (SELECT a.anchor_id, d.doc_id, abs(d.n_chars - av) AS gap, 2 AS level FROM a JOIN d ON a.anchor_id <> d.doc_id WHERE a.anchor_id NOT IN (SELECT anchor_id FROM l0 UNION ALL SELECT anchor_id FROM l1)),
    t AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY gap, doc_id) AS rn FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)), n AS (SELECT *, count(*) OVER (PARTITION BY anchor_id) AS n FROM t WHERE rn <= 5)
    SELECT anchor_id, doc_id AS match_id, gap, level FROM n WHERE rn = CAST('0x' || substr(sha1('5|' || anchor_id), 1, 8) AS BIGINT) % n + 1""",
)
def _(spark, sf):
    c = F.col
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.when(c("doc_id") == 0, "rare").otherwise(c("lang")).alias("lang"), F.when(c("n_chars") > 12000, F.concat(F.lit("long "), "doc_id")).otherwise(c("source")).alias("source"))
    return R.matched_random(d, d, [["lang", "source"], ["lang"], []], "doc_id", "n_chars", 5)


# --- reports -----------------------------------------------------------------------------------------------------------

_RUN = "run AS (SELECT l_suppkey AS run, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS passed, CASE WHEN l_linenumber <> 3 THEN l_discount END AS mut, CASE WHEN l_quantity > 40 THEN l_tax END AS logs FROM lineitem)"


def _runs(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_returnflag") != "R").cast("int").alias("passed"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("mut"), F.when(F.col("l_quantity") > 40, F.col("l_tax")).alias("logs"))
    return RP.run_summary(li, ["run"], "passed", ["mut"], ["logs"])


@query("agg_19_run_summary", f"WITH {_RUN} SELECT run, count(*) AS n_candidates, round(avg(passed), 6) AS pass_rate, round(avg(mut), 6) AS mut_mean, round(avg(mut) FILTER (passed = 1), 6) AS mut_valid, round(avg(passed * coalesce(mut, 0)), 6) AS mut_adjusted, round(avg(logs), 6) AS logs_mean FROM run GROUP BY 1")
def _(spark, sf):
    r = _runs(spark, sf)
    return r.select("run", "n_candidates", *[F.round(a, 6).alias(b) for a, b in (("pass_rate", "pass_rate"), ("mut_mean", "mut_mean"), ("mut_valid_mean", "mut_valid"), ("mut_adjusted_mean", "mut_adjusted"), ("logs_mean", "logs_mean"))])


def _ci_sql(policy: str) -> str:
    std = "CASE WHEN count(v) > 1 THEN stddev_samp(v) ELSE 0.0 END" if policy == "zero" else "CASE WHEN count(v) > 1 THEN stddev_samp(v) END"
    one = "NULL" if policy == "null" else "avg(v)"
    return f"""WITH {_RUN}, r AS (SELECT CASE WHEN run = 7 THEN 'solo' ELSE 'g' || run % 4 END AS grp, avg(mut) AS v FROM run GROUP BY run)
    SELECT grp, count(v) AS n, round(avg(v), 6) AS mean, round({std}, 6) AS std, round(CASE WHEN count(v) > 1 THEN avg(v) - 1.96 * stddev_samp(v) / sqrt(count(v)) ELSE {one} END, 6) AS ci_low, round(CASE WHEN count(v) > 1 THEN avg(v) + 1.96 * stddev_samp(v) / sqrt(count(v)) ELSE {one} END, 6) AS ci_high FROM r GROUP BY 1"""


def _ci(policy: str):
    def run(spark, sf):
        runs = _runs(spark, sf).withColumn("grp", F.when(F.col("run") == 7, "solo").otherwise(F.concat(F.lit("g"), (F.col("run") % 4).cast("string"))))
        g = RP.group_ci(runs, ["grp"], "mut_mean", policy)
        return g.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "ci_low", "ci_high")])

    return run


query("agg_06_group_mean_std", _ci_sql("null"))(_ci("null"))
query("agg_07_group_ci95", _ci_sql("mean"))(_ci("mean"))
query("agg_08_group_ci95_zero_std", _ci_sql("zero"))(_ci("zero"))


@query("agg_01_value_counts", "SELECT coalesce(CASE WHEN event_type <> 'click' THEN event_type END, 'NA') AS event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return RP.value_counts(table(spark, sf, "events").withColumn("event_type", F.when(F.col("event_type") != "click", F.col("event_type"))), "event_type")


@query("agg_03_multi_level_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(spark, sf):
    return RP.multi_level_counts(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]).withColumn("level", F.col("level").cast("long"))


@query(
    "agg_13_tier_means_medians",
    "SELECT l_returnflag AS tier, count(*) AS n, round(avg(l_quantity), 6) AS qty_mean, round(median(l_quantity), 6) AS qty_median, round(avg(l_tax), 6) AS tax_mean, round(median(l_tax), 6) AS tax_median FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    t = RP.tier_summary(table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"])
    return t.select(F.col("l_returnflag").alias("tier"), "n", *[F.round(f"l_{a}_{k}", 6).alias(f"{b}_{k}") for a, b in (("quantity", "qty"), ("tax", "tax")) for k in ("mean", "median")])


@query(
    "agg_14_metric_group_summary",
    """WITH l AS (SELECT 'price' AS metric, o_orderstatus AS g, CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice END AS v FROM orders UNION ALL SELECT 'cust', o_orderstatus, CAST(o_custkey AS DOUBLE) FROM orders)
    SELECT metric, coalesce(g, 'ALL') AS group_name, count(*) AS n, count(v) AS n_present, round(1 - count(v) / count(*), 6) AS missing_rate, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(CASE WHEN count(v) > 1 THEN stddev_samp(v) END, 4) AS std, min(v) AS min, max(v) AS max FROM l GROUP BY GROUPING SETS ((metric, g), (metric))""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", F.when(F.col("o_custkey") % 9 != 0, F.col("o_totalprice")).alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    s = RP.metric_summary(o, "o_orderstatus", ["price", "cust"])
    return s.select("metric", "group_name", "n", "n_present", F.round("missing_rate", 6).alias("missing_rate"), *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")], "min", "max")


@query(
    "agg_15_flag_prevalence",
    """WITH l AS (SELECT 'high' AS flag, event_type AS g, CASE WHEN event_id % 6 <> 0 THEN CASE WHEN value > 90 THEN 1 ELSE 0 END END AS v FROM events UNION ALL SELECT 'errors', event_type, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END FROM events),
    o AS (SELECT flag, g, count(v) AS n_present, CAST(coalesce(sum(v), 0) AS BIGINT) AS n_flagged FROM l GROUP BY ALL)
    SELECT flag, g AS group_name, n_present, n_flagged, CAST(NULL AS BIGINT) AS n_groups, NULL AS groups, round(n_flagged / nullif(n_present, 0), 6) AS rate FROM o
    UNION ALL SELECT flag, 'ALL', CAST(sum(n_present) AS BIGINT), CAST(sum(n_flagged) AS BIGINT), count(*) FILTER (n_flagged > 0), string_agg(g, '|' ORDER BY g) FILTER (n_flagged > 0), round(sum(n_flagged) / nullif(sum(n_present), 0), 6) FROM o GROUP BY flag""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 6 != 0, (F.col("value") > 90).cast("int")).alias("high"), (F.col("event_type") == "error").cast("int").alias("errors"))
    p = RP.flag_prevalence(e, "event_type", ["high", "errors"])
    return p.select("flag", "group_name", "n_present", "n_flagged", "n_groups", "groups", F.round("rate", 6).alias("rate"))


_CELL = "CASE WHEN o_totalprice > 250000 THEN 'H' ELSE 'L' END || CASE WHEN o_orderpriority < '3' THEN 'H' ELSE 'L' END"


def _cells(spark, sf):
    return table(spark, sf, "orders").withColumn("cell", D.cell(F.col("o_totalprice") > 250000, F.col("o_orderpriority") < "3"))


@query("agg_23_cell_pivot", f"SELECT o_orderstatus, \"LL\", \"HL\", \"LH\", \"HH\", least(\"LL\", \"HL\", \"LH\", \"HH\") AS quota FROM (SELECT o_orderstatus, count(*) FILTER (c = 'LL') AS \"LL\", count(*) FILTER (c = 'HL') AS \"HL\", count(*) FILTER (c = 'LH') AS \"LH\", count(*) FILTER (c = 'HH') AS \"HH\" FROM (SELECT o_orderstatus, {_CELL} AS c FROM orders) GROUP BY 1)")
def _(spark, sf):
    return RP.cell_pivot(_cells(spark, sf), ["o_orderstatus"])


@query(
    "smp_11_balanced_cells",
    f"""WITH o AS (SELECT *, {_CELL} AS cell FROM orders), n AS (SELECT o_orderstatus, cell, count(*) AS n FROM o GROUP BY ALL), q AS (SELECT o_orderstatus, CASE WHEN count(*) = 4 THEN min(n) ELSE 0 END AS quota FROM n GROUP BY 1),
    r AS (SELECT o_orderkey, o_orderstatus, cell, row_number() OVER (PARTITION BY o_orderstatus, cell ORDER BY CASE WHEN cell IN ('HL', 'HH') THEN -o_totalprice ELSE o_totalprice END, o_orderkey) AS rn FROM o) SELECT o_orderkey, o_orderstatus, cell, rn FROM r JOIN q USING (o_orderstatus) WHERE rn <= quota""",
)
def _(spark, sf):
    out = D.balanced_cells(_cells(spark, sf), ["o_orderstatus"], "o_totalprice", "o_orderkey")
    return out.select("o_orderkey", "o_orderstatus", "cell", F.col("rn").cast("long").alias("rn"))


@query("agg_25_sampling_summary", f"SELECT cell, count(*) AS n, count(DISTINCT o_custkey) AS n_tasks, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max FROM (SELECT *, {_CELL} AS cell FROM orders) GROUP BY 1")
def _(spark, sf):
    s = RP.sampling_summary(_cells(spark, sf), ["cell"], "o_custkey", "o_totalprice")
    return s.select("cell", "n", "n_tasks", F.round("mean", 4).alias("mean"), "min", "max")


#: Orders as evaluations of the application's store.
_EVAL = """ev AS (SELECT o_orderkey AS id, o_orderpriority AS target, CAST(o_custkey % 80 + 20 AS INT) AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS passed, CASE WHEN o_custkey % 17 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS line, (o_orderkey % 50) / 50.0::DOUBLE AS branch, (o_custkey % 100) / 100.0::DOUBLE AS mutation,
    CAST(o_orderkey % 5 AS INT) AS failures, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS mutationvalid FROM orders),
    st AS (SELECT *, CASE WHEN failures > 0 THEN CASE WHEN score >= 45 AND failures <= 3 THEN 'review' ELSE 'drop' END WHEN mutationvalid > 0 AND score >= 75 AND mutation >= 0.6 AND coalesce(line, 0) >= 0.8 THEN 'adopt' WHEN score >= 55 THEN 'review' ELSE 'drop' END AS status FROM ev)"""


def _evaluations(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("target"), (c % 80 + 20).cast("int").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("passed"), F.when(c % 17 != 0, (k % 100) / 100.0).alias("line"), ((k % 50) / 50.0).alias("branch"), ((c % 100) / 100.0).alias("mutation"), (k % 5).cast("int").alias("failures"), (k % 3 != 0).cast("int").alias("mutationvalid"))
    return RP.with_status(o)


@query("agg_32_dashboard", f"WITH {_EVAL} SELECT count(*) AS n, CAST(sum(passed) AS BIGINT) AS n_passed, round(avg(score), 6) AS score, round(avg(coalesce(line, 0)), 6) AS line, round(avg(branch), 6) AS branch, round(avg(mutation) FILTER (mutationvalid = 1), 6) AS mutation FROM st")
def _(spark, sf):
    return RP.dashboard(_evaluations(spark, sf)).select("n", "n_passed", *[F.round(c, 6).alias(c) for c in ("score", "line", "branch", "mutation")])


@query("agg_33_status_counts", f"WITH {_EVAL} SELECT status, count(*) AS n, CAST(list_position(['adopt', 'review', 'drop'], status) AS INT) AS place FROM st GROUP BY 1")
def _(spark, sf):
    return RP.status_counts(_evaluations(spark, sf))


_TARGETS = "SELECT target, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(line), 6) AS mean_line, round(avg(branch), 6) AS mean_branch, round(avg(mutation) FILTER (mutationvalid = 1), 6) AS mean_mutation FROM st GROUP BY 1"


def _rounded(df):
    return df.select("target", "n", *[F.round(c, 6).alias(c) for c in ("mean_score", "mean_line", "mean_branch", "mean_mutation")])


@query("agg_34_targets", f"WITH {_EVAL} {_TARGETS} ORDER BY n DESC, mean_score DESC, target LIMIT 3")
def _(spark, sf):
    return _rounded(RP.targets(_evaluations(spark, sf), top=3))


@query("agg_36_targets_by_score", f"WITH {_EVAL} {_TARGETS} ORDER BY mean_score DESC, n DESC, target LIMIT 3")
def _(spark, sf):
    return _rounded(RP.targets(_evaluations(spark, sf), by_score=True, top=3))


@query("agg_35_project_report", f"WITH {_EVAL} SELECT target, CAST(0 AS INT) AS line_no, target || ' n=' || n || ' score=' || printf('%.2f', mean_score) AS line FROM ({_TARGETS})")
def _(spark, sf):
    return RP.report_lines(_evaluations(spark, sf))


@query(
    "agg_37_quality_gate",
    f"""WITH {_EVAL}, g AS (SELECT target, avg(score) AS score, avg(line) * 100 AS line, avg(branch) * 100 AS branch, coalesce(avg(mutation) FILTER (mutationvalid = 1), 0) * 100 AS mutation, bool_or(status = 'drop') AS d, bool_or(status = 'review') AS r FROM st GROUP BY 1)
    SELECT target, round(score, 6) AS score, round(mutation, 6) AS mutation, CASE WHEN d THEN 'reject' WHEN score >= 75 AND line >= 80 AND branch >= 70 AND mutation >= 60 AND NOT r THEN 'pass' ELSE 'review' END AS verdict FROM g""",
)
def _(spark, sf):
    return RP.gate(_evaluations(spark, sf), ["target"]).select("target", F.round("score", 6).alias("score"), F.round("mutation", 6).alias("mutation"), "verdict")


@query("app_01_history", f"WITH {_EVAL} SELECT id, status, score FROM st WHERE target = '1-URGENT' ORDER BY id DESC LIMIT 200")
def _(spark, sf):
    e = _evaluations(spark, sf).withColumns({"project": F.col("target"), "user": F.lit("u")})
    return RP.history(e, "1-URGENT", "u").select("id", "status", "score")


@query("fn_30_score_and_defect", f"""WITH {_EVAL} SELECT id, CAST(round_even(greatest(20.0, least(99.0, mutation * 42 + coalesce(line, 0) * 22 + branch * 18 + least(id % 15, 12) * 1.2::DOUBLE - failures * 18)), 0) AS INT) AS quality,
    CASE WHEN failures > 0 THEN 'failing_tests' WHEN mutationvalid = 0 THEN 'mutation_invalid' WHEN mutation < 0.45 THEN 'weak_mutation' WHEN branch < 0.55 THEN 'missing_branches' WHEN score >= 75 AND mutation >= 0.6 THEN 'stable' ELSE 'weak_assertions' END AS defect,
    CASE status WHEN 'adopt' THEN 'low' WHEN 'review' THEN 'medium' ELSE 'high' END AS risk FROM st""")
def _(spark, sf):
    c = F.col
    e = _evaluations(spark, sf)
    return e.select("id", S.quality_score(c("mutation"), F.coalesce(c("line"), F.lit(0.0)), c("branch"), c("id") % 15, c("failures")).alias("quality"), S.defect(c("failures"), c("mutationvalid"), c("mutation"), c("branch"), c("score"))["defect"].alias("defect"), S.risk(c("status")).alias("risk"))


@query("agg_39_funnel", "SELECT 0 AS step, 'lines' AS pool, count(*) AS n FROM lineitem UNION ALL SELECT 1, 'returned', count(*) FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 2, 'large', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return RP.funnel({"lines": li, "returned": li.filter("l_returnflag = 'R'"), "large": li.filter("l_returnflag = 'R' AND l_quantity > 40")})


# --- taxonomy ----------------------------------------------------------------------------------------------------------

#: Stage tables made of the candidates; the labels below are typed by hand, not from the rule table.
_STAGES = f"""{_CAND},
    ex AS (SELECT id AS candidate_id, CASE part % 6 WHEN 0 THEN 'failed' WHEN 1 THEN 'timeout' WHEN 2 THEN 'infra_error' WHEN 3 THEN 'syntax_error' ELSE 'passed' END AS execution_status,
        CASE task_id % 4 WHEN 0 THEN 'AssertionError' WHEN 1 THEN 'KeyError' WHEN 2 THEN 'OSError' END AS exception_type, CASE WHEN part % 5 = 0 THEN '' ELSE ' trace ' || part END AS traceback_snippet, 'err' AS stderr FROM cand WHERE id % 11 <> 0),
    st AS (SELECT id AS candidate_id, CASE WHEN qty <= 3 THEN 0 WHEN qty > 5 THEN 2 END AS num_asserts, CASE WHEN part % 3 = 0 THEN 1 ELSE 0 END AS num_try_except, part % 5 = 0 AS has_pytest_raises FROM cand WHERE id % 7 <> 0),
    co AS (SELECT id AS candidate_id, CASE part % 10 WHEN 9 THEN 'tool_error' WHEN 8 THEN 'skipped' ELSE 'ok' END AS coverage_status, disc * 10 AS line_coverage, tax * 12 AS branch_coverage FROM cand WHERE id % 13 <> 0),
    mu AS (SELECT id AS candidate_id, CASE part % 9 WHEN 0 THEN 'timeout' WHEN 1 THEN 'tool_error' ELSE 'ok' END AS mutation_status, CASE WHEN part % 2 = 0 THEN 'boom' ELSE '' END AS mutation_error_msg, CASE WHEN qty < 10 THEN 'E' END AS mutation_error_type, part % 3 AS mutants_survived FROM cand WHERE id % 5 <> 0),
    ca AS (SELECT id AS candidate_id, CASE WHEN disc > 0.09 THEN 1 ELSE 0 END AS redefines, CASE WHEN part % 4 = 0 THEN 'It raises an Error' ELSE 'adds' END AS prompt FROM cand),
    j AS (SELECT coalesce(ex.candidate_id, mu.candidate_id) AS candidate_id, ex.candidate_id IS NOT NULL AS ran, ex.* EXCLUDE candidate_id, mu.* EXCLUDE candidate_id FROM ex FULL JOIN mu ON ex.candidate_id = mu.candidate_id),
    w AS (SELECT j.*, st.candidate_id IS NOT NULL AND ran AS static, st.* EXCLUDE candidate_id, co.* EXCLUDE candidate_id, ca.* EXCLUDE candidate_id FROM j LEFT JOIN st ON j.candidate_id = st.candidate_id LEFT JOIN co ON j.candidate_id = co.candidate_id LEFT JOIN ca ON j.candidate_id = ca.candidate_id),
    t AS (SELECT *, substr(trim(CASE WHEN traceback_snippet <> '' THEN traceback_snippet ELSE stderr END), 1, 1200) AS said FROM w),
    logs AS (
        SELECT candidate_id, 'execution' AS stage, 'invalid_candidate_redefines_target' AS failure_category, 'redefines_target_symbol' AS failure_subtype, 'major' AS severity, 'strong' AS rule_strength, 'exec.invalid_candidate_redefines_target' AS rule_id, 'generated_candidates' AS provenance, false AS needs_manual_review, NULL AS said FROM t WHERE ran AND redefines > 0
        UNION ALL SELECT candidate_id, 'syntax', 'syntax_error', 'parse_failed', 'major', 'strong', 'exec.syntax_error', 'execution', false, said FROM t WHERE execution_status = 'syntax_error'
        UNION ALL SELECT candidate_id, 'execution', 'execution_timeout', 'subprocess_timeout', 'major', 'strong', 'exec.timeout', 'execution', false, said FROM t WHERE execution_status = 'timeout'
        UNION ALL SELECT candidate_id, 'execution', 'import_or_env_error', coalesce(exception_type, 'infra_error'), 'major', 'strong', 'exec.infra_error', 'execution', true, said FROM t WHERE execution_status = 'infra_error'
        UNION ALL SELECT candidate_id, 'execution', CASE exception_type WHEN 'AssertionError' THEN 'execution_assertion_mismatch' WHEN 'KeyError' THEN 'execution_call_contract_error' ELSE 'test_runtime_failure' END, CASE exception_type WHEN 'AssertionError' THEN 'assertion_error' ELSE coalesce(exception_type, 'execution_failed') END, 'major', 'moderate', 'exec.failed', 'execution', true, said FROM t WHERE execution_status = 'failed'
        UNION ALL SELECT candidate_id, 'static_structure', 'assertion_weak_or_missing', 'no_assertions', 'major', 'strong', 'static.no_assertions', 'static_features', true, NULL FROM t WHERE static AND coalesce(num_asserts, 0) = 0
        UNION ALL SELECT candidate_id, 'static_structure', 'exception_path_gap', 'no_exception_checks', 'moderate', 'heuristic', 'static.exception_path_gap', 'static_features', true, NULL FROM t WHERE static AND prompt <> 'adds' AND NOT has_pytest_raises AND num_try_except = 0
        UNION ALL SELECT candidate_id, 'coverage', 'boundary_case_gap', 'low_line_coverage', 'moderate', 'heuristic', 'coverage.low_line_coverage', 'coverage_results', true, NULL FROM t WHERE static AND coverage_status = 'ok' AND line_coverage < 0.8
        UNION ALL SELECT candidate_id, 'coverage', 'branch_distinguishing_gap', 'low_branch_coverage', 'moderate', 'heuristic', 'coverage.low_branch_coverage', 'coverage_results', true, NULL FROM t WHERE static AND coverage_status = 'ok' AND branch_coverage < 0.8
        UNION ALL SELECT candidate_id, 'coverage', 'other', 'coverage_tool_error', 'minor', 'moderate', 'coverage.tool_error', 'coverage_results', true, NULL FROM t WHERE static AND coverage_status = 'tool_error'
        UNION ALL SELECT candidate_id, 'mutation', 'mutation_timeout', 'mutation_tool_timeout', 'major', 'strong', 'mutation.timeout', 'mutation_results', false, nullif(mutation_error_msg, '') FROM t WHERE mutation_status = 'timeout'
        UNION ALL SELECT candidate_id, 'mutation', 'mutation_unavailable', coalesce(nullif(mutation_error_msg, ''), mutation_error_type, 'mutation_tool_error'), 'moderate', 'strong', 'mutation.tool_error', 'mutation_results', true, NULL FROM t WHERE mutation_status = 'tool_error'
        UNION ALL SELECT candidate_id, 'mutation', 'mutation_survival_major', 'survived_mutants_present', 'major', 'strong', 'mutation.survival_major', 'mutation_results', true, NULL FROM t WHERE mutation_status = 'ok' AND mutants_survived >= 1)"""


def _logs(spark, sf):
    c, f = F.col, F.when
    cand = _candidates(spark, sf).withColumnRenamed("id", "candidate_id")
    pick = lambda by, names, other=None: F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), by) if other is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), by), F.lit(other))
    mod = lambda x, n: (c(x) % n).cast("int")
    execution = cand.filter("candidate_id % 11 <> 0").select("candidate_id", pick(mod("part", 6), {0: "failed", 1: "timeout", 2: "infra_error", 3: "syntax_error"}, "passed").alias("execution_status"), pick(mod("task_id", 4), {0: "AssertionError", 1: "KeyError", 2: "OSError"}).alias("exception_type"), f(c("part") % 5 == 0, "").otherwise(F.concat(F.lit(" trace "), "part")).alias("traceback_snippet"), F.lit("err").alias("stderr"))
    static = cand.filter("candidate_id % 7 <> 0").select("candidate_id", f(c("qty") <= 3, 0).when(c("qty") > 5, 2).alias("num_asserts"), f(c("part") % 3 == 0, 1).otherwise(0).alias("num_try_except"), (c("part") % 5 == 0).alias("has_pytest_raises"))
    coverage = cand.filter("candidate_id % 13 <> 0").select("candidate_id", pick(mod("part", 10), {9: "tool_error", 8: "skipped"}, "ok").alias("coverage_status"), (c("disc") * 10).alias("line_coverage"), (c("tax") * 12).alias("branch_coverage"))
    mutation = cand.filter("candidate_id % 5 <> 0").select("candidate_id", pick(mod("part", 9), {0: "timeout", 1: "tool_error"}, "ok").alias("mutation_status"), f(c("part") % 2 == 0, "boom").otherwise("").alias("mutation_error_msg"), f(c("qty") < 10, "E").alias("mutation_error_type"), (c("part") % 3).alias("mutants_survived"))
    candidates = cand.select("candidate_id", (c("disc") > 0.09).cast("int").alias("redefines_target_flag"), f(c("part") % 4 == 0, "It raises an Error").otherwise("adds").alias("prompt"))
    return TX.dedup_logs(TX.explode_rules(TX.join_stages(execution, static, coverage, mutation, candidates), TX.stage_rules(), ["candidate_id"]), ["candidate_id"])


_LABELS = "candidate_id, stage, failure_category, failure_subtype, severity, rule_strength, rule_id, provenance, needs_manual_review"


@query("stg_05_rule_logs", f"WITH {_STAGES} SELECT {_LABELS}, true AS auto_detected, 'ftx_v3' AS taxonomy_rule_version, said FROM logs")
def _(spark, sf):
    said = F.when(~F.col("evidence").startswith("{"), F.col("evidence")).alias("said")
    return _logs(spark, sf).select(*_LABELS.split(", "), "auto_detected", "taxonomy_rule_version", said)


@query(
    "stg_05_log_counts",
    f"""WITH {_STAGES} SELECT kind, value, count(*) AS n FROM (SELECT 'stage' AS kind, stage AS value FROM logs UNION ALL SELECT 'category', failure_category FROM logs
    UNION ALL SELECT 'review', CASE WHEN needs_manual_review THEN 'needs_manual_review' ELSE 'auto_only' END FROM logs) GROUP BY ALL""",
)
def _(spark, sf):
    return TX.log_counts(_logs(spark, sf))


@query("sort_08_log_order", f"WITH {_STAGES} SELECT {_LABELS}, row_number() OVER (PARTITION BY candidate_id ORDER BY stage, failure_category, failure_subtype, rule_id) AS place FROM logs")
def _(spark, sf):
    order = Window.partitionBy("candidate_id").orderBy(*TX.sort_keys())
    return _logs(spark, sf).select(*_LABELS.split(", "), F.row_number().over(order).alias("place"))


#: Ranks of what the stage tables give, typed by hand.
_PRIORITY = """CASE failure_category WHEN 'mutation_survival_major' THEN 100 WHEN 'branch_distinguishing_gap' THEN 95 WHEN 'exception_path_gap' THEN 90 WHEN 'boundary_case_gap' THEN 85 WHEN 'assertion_weak_or_missing' THEN 80
    WHEN 'execution_assertion_mismatch' THEN 78 WHEN 'execution_call_contract_error' THEN 77 WHEN 'invalid_candidate_redefines_target' THEN 76 WHEN 'test_runtime_failure' THEN 70 WHEN 'syntax_error' THEN 65
    WHEN 'execution_timeout' THEN 60 WHEN 'mutation_unavailable' THEN 56 WHEN 'mutation_timeout' THEN 55 WHEN 'import_or_env_error' THEN 40 ELSE 0 END"""


@query("agg_20_primary_failure", f"WITH {_STAGES} SELECT candidate_id, failure_category AS category, failure_subtype AS subtype, severity, rule_id FROM logs QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY {_PRIORITY} DESC) = 1")
def _(spark, sf):
    p = TX.primary(_logs(spark, sf))
    return p.select("candidate_id", F.col("primary_failure_category").alias("category"), F.col("primary_failure_subtype").alias("subtype"), F.col("primary_severity").alias("severity"), F.col("primary_rule_id").alias("rule_id"))


_FLAGS = ("mutation_survival_major", "branch_distinguishing_gap", "exception_path_gap", "boundary_case_gap", "assertion_weak_or_missing", "execution_assertion_mismatch", "execution_call_contract_error", "syntax_error")


@query(
    "agg_21_taxonomy_roll_up",
    f"""WITH {_STAGES}, c AS (SELECT candidate_id, string_agg(failure_category, '|' ORDER BY stage, failure_category) AS categories FROM (SELECT DISTINCT candidate_id, stage, failure_category FROM logs) GROUP BY 1),
    s AS (SELECT candidate_id, string_agg(stage, '|' ORDER BY stage) AS stages FROM (SELECT DISTINCT candidate_id, stage FROM logs) GROUP BY 1)
    SELECT candidate_id, count(*) AS failure_log_count, any_value(categories) AS categories, any_value(stages) AS stages, CAST(max(CASE WHEN failure_category = 'mutation_unavailable' THEN 1 ELSE 0 END) AS INT) AS mutation_unavailable,
    {", ".join(f"CAST(max(CASE WHEN failure_category = '{x}' THEN 1 ELSE 0 END) AS INT) AS has_{x}" for x in _FLAGS)} FROM logs JOIN c USING (candidate_id) JOIN s USING (candidate_id) GROUP BY 1""",
)
def _(spark, sf):
    r = TX.roll_up(_logs(spark, sf))
    return r.select("candidate_id", "failure_log_count", F.col("failure_category_list").alias("categories"), F.col("failure_stage_list").alias("stages"), "mutation_unavailable", *[f"has_{x}" for x in _FLAGS])


# --- statistics --------------------------------------------------------------------------------------------------------


@query(
    "sta_10_spearman",
    """WITH x AS (SELECT o_orderstatus AS g, o_custkey % 50 AS a, CASE WHEN o_custkey % 13 <> 0 THEN round(o_totalprice / 10000) END AS b FROM orders), y AS (SELECT * FROM x WHERE a IS NOT NULL AND b IS NOT NULL),
    r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2.0 AS rb FROM y)
    SELECT g, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r GROUP BY 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("g"), (F.col("o_custkey") % 50).alias("a"), F.when(F.col("o_custkey") % 13 != 0, F.round(F.col("o_totalprice") / 10000)).alias("b"))
    return ST.spearman(o, ["g"], "a", "b").select("g", "n", F.round("rho", 6).alias("rho"))


@query("sta_10_spearman_p")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_custkey").alias("a"), F.col("o_totalprice").alias("b"))
    return ST.spearman(o, ["g"], "a", "b")


@query(
    "sta_13_factorial_effects",
    f"""WITH m AS (SELECT o_orderstatus AS g, avg(o_custkey) FILTER (c = 'LL') AS ll, avg(o_custkey) FILTER (c = 'HL') AS hl, avg(o_custkey) FILTER (c = 'LH') AS lh, avg(o_custkey) FILTER (c = 'HH') AS hh FROM (SELECT *, {_CELL} AS c FROM orders) GROUP BY 1)
    SELECT g, round((hl + hh) / 2 - (ll + lh) / 2, 6) AS pos_main, round((lh + hh) / 2 - (ll + hl) / 2, 6) AS neg_main, round(hh - hl - lh + ll, 6) AS interaction, round(hh - ll, 6) AS hh_minus_ll FROM m""",
)
def _(spark, sf):
    e = ST.effects(_cells(spark, sf).withColumnRenamed("o_orderstatus", "g"), ["g"], "cell", "o_custkey")
    return e.select("g", *[F.round(c, 6).alias(c) for c in ("pos_main", "neg_main", "interaction", "hh_minus_ll")])


@query("sta_11_ols_anova")
def _(spark, sf):
    coefficients, anova = ST.factorial_tests(_cells(spark, sf).withColumn("y", F.col("o_custkey").cast("double")), "cell", "y")
    rows = [("ols", c["term"], c["coef"], c["se"], c["p"]) for c in coefficients] + [("anova", a["term"], a["sum_sq"], a["f"], a["p"]) for a in anova]
    return spark.createDataFrame(rows, "part string, term string, value double, stat double, p double")


@query(
    "smp_12_seed_bootstrap",
    f"""WITH o AS (SELECT o_custkey % 3 AS s, {_CELL} AS c, o_totalprice AS y FROM orders), m AS (SELECT s, c, avg(y) AS m FROM o GROUP BY ALL), d AS (SELECT a.i * 9 + b.i * 3 + e.i AS d, unnest([a.i, b.i, e.i]) AS s FROM range(3) a(i), range(3) b(i), range(3) e(i)),
    x AS (SELECT d, c, avg(m) AS m FROM d JOIN m USING (s) GROUP BY ALL), w AS (SELECT d, max(m) FILTER (c = 'LL') AS ll, max(m) FILTER (c = 'HL') AS hl, max(m) FILTER (c = 'LH') AS lh, max(m) FILTER (c = 'HH') AS hh FROM x GROUP BY 1),
    f AS (SELECT unnest(['pos_main', 'neg_main', 'interaction', 'hh_minus_ll']) AS effect, unnest([(hl + hh) / 2 - (ll + lh) / 2, (lh + hh) / 2 - (ll + hl) / 2, hh - hl - lh + ll, hh - ll]) AS v FROM w)
    SELECT effect, round(quantile_cont(v, 0.025), 4) AS lo, round(quantile_cont(v, 0.975), 4) AS hi FROM f GROUP BY 1""",
)
def _(spark, sf):
    o = _cells(spark, sf).withColumn("s", F.col("o_custkey") % 3)
    return ST.bootstrap_effects(o, "cell", "o_totalprice", "s").select("effect", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query(
    "sta_09_rubric",
    """SELECT doc_id, round(CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT > 0 THEN (coalesce(a, 0) + coalesce(b, 0)) * 10.0 / (((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) * 2) END, 6) AS rubric
    FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN quality * 2 END AS a, CASE WHEN doc_id % 3 <> 0 THEN toxic END AS b FROM labels)""",
)
def _(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "labels").select("doc_id", F.round(ST.rubric({"a": F.when(i % 5 != 0, F.col("quality") * 2.0), "b": F.when(i % 3 != 0, F.col("toxic").cast("double"))}), 6).alias("rubric"))


@query(
    "sta_15_agreement",
    """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS c FROM labels GROUP BY ALL), n AS (SELECT CAST(sum(c) AS BIGINT) AS n, sum(c) FILTER (a = b) / sum(c) AS rate FROM c), e AS (SELECT sum(x.s * y.s) AS xy FROM (SELECT a AS k, sum(c) AS s FROM c GROUP BY 1) x JOIN (SELECT b AS k, sum(c) AS s FROM c GROUP BY 1) y USING (k))
    SELECT n, round(rate, 6) AS rate, round((rate - xy / (n * n)) / (1 - xy / (n * n)), 6) AS kappa FROM n, e""",
)
def _(spark, sf):
    return ST.agreement(table(spark, sf, "labels"), "quality", "toxic").select("n", F.round("rate", 6).alias("rate"), F.round("kappa", 6).alias("kappa"))


# --- datasets ----------------------------------------------------------------------------------------------------------


def _preferences(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("candidate_id"), F.col("conv_id").alias("task_id"), "role", F.col("text").alias("candidate_test_code"))
    p = PL.pairs(c.filter("role = 'assistant'").drop("role"), c.filter("role = 'user'").drop("role"))
    return D.preference_rows(p.withColumns({"source": F.lit("conv"), "difficulty_bucket": F.lit("easy")}), "HH", F.concat(F.lit("Task "), F.col("task_id").cast("string")))


_PAIRS = "p AS (SELECT a.conv_id AS task_id, a.conv_id || '_' || a.turn AS chosen_candidate_id, u.conv_id || '_' || u.turn AS rejected_candidate_id, a.text AS chosen, u.text AS rejected FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.role = 'assistant' AND u.role = 'user' WHERE trim(a.text) <> '' AND trim(u.text) <> '')"


@query("ds_01_preference_rows", f"WITH {_PAIRS} SELECT 'HH' AS \"group\", task_id, 'Task ' || task_id AS prompt, chosen_candidate_id, rejected_candidate_id, md5(chosen) AS chosen_md5 FROM p")
def _(spark, sf):
    return _preferences(spark, sf).select("group", "task_id", "prompt", "chosen_candidate_id", "rejected_candidate_id", F.md5("chosen").alias("chosen_md5"))


@query(
    "ds_04_label_shuffled",
    f"""WITH {_PAIRS}, s AS (SELECT *, (row_number() OVER (ORDER BY task_id, chosen_candidate_id, rejected_candidate_id) - 1) % 2 = 1 AS s FROM p)
    SELECT task_id, CASE WHEN s THEN rejected_candidate_id ELSE chosen_candidate_id END AS chosen_candidate_id, CASE WHEN s THEN chosen_candidate_id ELSE rejected_candidate_id END AS rejected_candidate_id, s AS label_shuffled FROM s""",
)
def _(spark, sf):
    return D.label_shuffled(_preferences(spark, sf)).select("task_id", "chosen_candidate_id", "rejected_candidate_id", "label_shuffled")


@query("ds_01_sft_rows", f"WITH {_PAIRS} SELECT DISTINCT chosen_candidate_id AS candidate_id, task_id, md5('Task ' || task_id || chr(10) || chosen) AS text_md5 FROM p")
def _(spark, sf):
    return D.sft_rows(_preferences(spark, sf)).select("candidate_id", "task_id", F.md5("text").alias("text_md5"))
