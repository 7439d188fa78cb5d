"""One query for each operator that the other modules use only inside larger ones."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkassay.functions import code as K
from sparkassay.functions import parsers as PS
from sparkassay.functions import scalars as S
from sparkassay.functions import statistics as ST
from sparkassay.operators import checks as C
from sparkassay.operators import datasets as D
from sparkassay.operators import pools as PL
from sparkassay.operators import ranking as R
from sparkassay.operators import reports as RP
from sparkassay.operators import shape as P
from sparkassay.plans.analytics import _CAND, _CELL, _EVAL, _SURFACE, _candidates, _cells, _evaluations, _surface_pairs
from sparkassay.plans.extras import _place
from sparkassay.plans.registry import query, table
from sparkassay.sources import files as FS

# --- sources and sinks -------------------------------------------------------------------------------------------------


@query("src_02_strict_jsonl", "SELECT 'good' AS file, (SELECT count(*) FROM customer) AS n, '' AS said UNION ALL SELECT 'bad', 0, 'line 3'")
def _(spark, sf):
    at = _place(spark)
    schema = "c_custkey long, c_name string"
    FS.write_jsonl(table(spark, sf, "customer").select("c_custkey", "c_name"), f"{at}/good")
    n = FS.require_jsonl(spark, f"{at}/good", schema).count()
    FS.write_bytes(spark, b'{"c_custkey": 1}\n\n{"c_custkey": \n{"c_custkey": 2}\n', f"{at}/bad.jsonl")
    try:
        said = f"{FS.require_jsonl(spark, f'{at}/bad.jsonl', schema).count()} rows"
    except ValueError as e:
        said = str(e).split(", ")[1].split(":")[0]
    return spark.createDataFrame([("good", n, ""), ("bad", 0, said)], "file string, n long, said string")


@query("src_04_json_array", "SELECT r_regionkey, r_name FROM region")
def _(spark, sf):
    at = f"{_place(spark)}/regions.json"
    FS.write_report(spark, [r.asDict() for r in table(spark, sf, "region").collect()], at)  # five rows
    return FS.read_json_array(spark, at, "r_regionkey int, r_name string")


@query("src_12_first_existing", "SELECT 'second' AS found, true AS raised")
def _(spark, sf):
    at = _place(spark)
    FS.write_report(spark, {}, f"{at}/second")
    FS.write_report(spark, {}, f"{at}/third")
    found = FS.first_existing(spark, [f"{at}/first", f"{at}/second", f"{at}/third"]).rsplit("/", 1)[1]
    try:
        FS.first_existing(spark, [f"{at}/none"])
        raised = False
    except FileNotFoundError:
        raised = True
    return spark.createDataFrame([(found, raised)], "found string, raised boolean")


@query("src_13_run_file", "SELECT 'run_1' AS run_id, 'run1' AS folder UNION ALL SELECT 'run2', 'run2' UNION ALL SELECT 'run_3', NULL")
def _(spark, sf):
    at = _place(spark)
    for r in ("run1", "run2"):
        FS.write_report(spark, {}, f"{at}/{r}/percandidate.csv")
    found = [(r, FS.per_run_path(spark, at, r)) for r in ("run_1", "run2", "run_3")]
    return spark.createDataFrame([(r, p and p.split("/")[-2]) for r, p in found], "run_id string, folder string")


@query("src_14_record_count", "SELECT count(*) AS n FROM pages")
def _(spark, sf):
    at = _place(spark)
    FS.write_csv(table(spark, sf, "pages"), at)
    return spark.createDataFrame([(FS.record_count(FS.read_csv(spark, at)),)], "n long")


@query("src_15_zip", "SELECT 'good' AS archive, 'a/x.py' AS name, 'x = 1' AS text, NULL AS error UNION ALL SELECT 'good', 'y.py', '', NULL UNION ALL SELECT 'bomb', NULL, NULL, 'too large: z' UNION ALL SELECT 'none', NULL, NULL, 'File is not a zip file'")
def _(spark, sf):
    at = _place(spark)

    def archive(files: dict[str, str]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in files.items():
                z.writestr(name, text)
        return out.getvalue()

    for name, data in (("good", archive({"a/x.py": "x = 1", "y.py": ""})), ("bomb", archive({"z": "0" * 500_000})), ("none", b"no archive")):
        FS.write_bytes(spark, data, f"{at}/{name}.zip")
    return FS.read_zip(spark, at).withColumn("archive", F.regexp_extract("archive", r"(\w+)\.zip$", 1))


_CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("snk_01_jsonl", "SELECT * FROM customer")
def _(spark, sf):
    at = _place(spark)
    FS.write_jsonl(table(spark, sf, "customer"), at)
    return FS.read_jsonl(spark, at, _CUSTOMERS)


@query("snk_02_report", "SELECT count(*) AS n, sum(c_nationkey) AS total FROM customer")
def _(spark, sf):
    at = f"{_place(spark)}/report.json"
    FS.write_report(spark, table(spark, sf, "customer").agg(F.count("*").alias("n"), F.sum("c_nationkey").alias("total")).first().asDict(), at)
    return spark.read.schema("n long, total long").option("multiLine", True).json(at)


@query("snk_03_csv", "SELECT * FROM customer")
def _(spark, sf):
    at = _place(spark)
    FS.write_csv(table(spark, sf, "customer"), at)
    return FS.read_csv(spark, at, _CUSTOMERS)


@query("snk_08_fixed_columns", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def _(spark, sf):
    at = _place(spark)
    FS.write_csv(table(spark, sf, "customer"), at, ["c_custkey", "absent", "c_name"])
    return FS.read_csv(spark, at)


@query("snk_09_plotted_numbers", f"SELECT cell, round(avg(y), 6) AS mean, round(avg(y) - 1.96 * stddev_samp(y) / sqrt(count(y)), 6) AS ci_low, round(avg(y) + 1.96 * stddev_samp(y) / sqrt(count(y)), 6) AS ci_high FROM (SELECT o_custkey::DOUBLE AS y, {_CELL} AS cell FROM orders) GROUP BY 1")
def _(spark, sf):
    out = RP.group_ci(_cells(spark, sf).withColumn("y", F.col("o_custkey").cast("double")), ["cell"], "y")
    return out.select("cell", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])


@query(
    "snk_10_paged_lines",
    """WITH t AS (SELECT page_id, flatten(list_transform(string_split(html, chr(10)), lambda x: list_transform(range(CAST(greatest(1, ceil(length(x) / 58.0)) AS BIGINT)), lambda i: substr(x, CAST(i * 58 + 1 AS BIGINT), 58)))) AS ls FROM pages)
    SELECT page_id, CAST(i // 52 AS INT) AS page, CAST(i % 52 AS INT) AS line_no, ls[i + 1] AS line FROM (SELECT page_id, ls, unnest(range(len(ls))) AS i FROM t)""",
)
def _(spark, sf):
    return RP.paged(table(spark, sf, "pages"), "page_id", "html")


# --- projections -------------------------------------------------------------------------------------------------------


@query("prj_01_keep_existing", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    return P.keep_existing(table(spark, sf, "orders"), ["o_orderkey", "nothing", "o_orderstatus"])


@query("prj_05_numbers", "SELECT c_custkey, try_cast(CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS v FROM customer")
def _(spark, sf):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.col("c_mktsegment")).when(k == 1, F.col("c_acctbal").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", P.number(text).alias("v"))


@query("prj_06_flags", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS number, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS text, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END AS flag FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", P.flag("c_acctbal").alias("number"), P.flag(F.when(k % 2 == 0, "True").otherwise("False")).alias("text"), P.flag(F.when(k % 4 == 3, F.lit(True))).alias("flag"))


@query("prj_08_text", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, '') AS t, CAST(c_nationkey AS VARCHAR) AS n FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", P.text(F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))).alias("t"), P.text("c_nationkey").alias("n"))


@query("prj_15_group_key", "SELECT o_orderkey, o_orderstatus || '__' || o_orderpriority AS k FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.group_key(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("k"))


@query(
    "prj_18_difficulty_features",
    """SELECT doc_id, length(text) AS prompt_length, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS prompt_line_count, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS loc,
    doc_id % 4 AS base_test_count, contains(text, '>>>') AS has_docstring_examples FROM documents WHERE trim(text) <> ''""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").filter("trim(text) <> ''")
    return d.select("doc_id", S.difficulty_features(F.col("text"), F.col("text"), F.col("doc_id") % 4).alias("f")).select("doc_id", "f.*")


@query("prj_21_nested_evidence", "SELECT page_id, nullif(substr(trim(html), 1, 1200), '') AS said, list_transform([url, '  ', html], lambda x: nullif(substr(trim(x), 1, 1200), '')) AS list, page_id AS number FROM pages")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.struct(F.col("html").alias("said"), F.array("url", F.lit("  "), "html").alias("list"), F.col("page_id").alias("number")).alias("e"))
    return p.select("page_id", P.normal_evidence(F.col("e"), p.schema["e"].dataType).alias("e")).select("page_id", "e.*")


@query("prj_22_known_category", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'other' END AS category FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.guard("o_orderpriority", ["1-URGENT", "2-HIGH"]).alias("category"))


# --- validation --------------------------------------------------------------------------------------------------------


def _raised(f) -> bool:
    try:
        f()
    except C.ValidationError:
        return True
    return False


@query("val_02_required_text", "SELECT count(*) FILTER (text IS NULL OR trim(text) = '') AS blank, count(*) FILTER (source IS NULL OR doc_id % 5 = 0 OR trim(source) = '') AS blank_source FROM documents")
def _(spark, sf):
    source = F.when(F.col("doc_id") % 5 == 0, "  ").otherwise(F.col("source"))
    return table(spark, sf, "documents").agg(F.count_if(~C.present("text")).alias("blank"), F.count_if(~C.present(source)).alias("blank_source"))


@query("val_04_required_columns", "SELECT false AS all_there, true AS one_missing")
def _(spark, sf):
    o = table(spark, sf, "orders")
    return spark.createDataFrame([(_raised(lambda: C.require_columns(o, ["o_orderkey"])), _raised(lambda: C.require_columns(o, ["o_orderkey", "nothing"])))], "all_there boolean, one_missing boolean")


@query("val_07_weights", "SELECT false AS sound, true AS short, true AS missing, true AS extra")
def _(spark, sf):
    bad = lambda w: _raised(lambda: C.check_weights(w, ["a", "b"]))
    return spark.createDataFrame([(bad({"a": 0.3, "b": 0.7}), bad({"a": 0.3, "b": 0.6}), bad({"a": 1.0}), bad({"a": 0.5, "b": 0.25, "c": 0.25}))], "sound boolean, short boolean, missing boolean, extra boolean")


@query("val_09_split_invariants", "SELECT false AS sound, true AS overlapping, true AS incomplete")
def _(spark, sf):
    pool = table(spark, sf, "customer").select("c_custkey")
    split = R.split(table(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", 42, {"a": 0.5, "b": 0.5})
    bad = lambda s: _raised(lambda: C.require_sound_splits(pool, s, "c_custkey"))
    return spark.createDataFrame([(bad(split), bad(split.unionByName(split.filter("split = 'a'"))), bad(split.filter("split = 'a'")))], "sound boolean, overlapping boolean, incomplete boolean")


# --- filters -----------------------------------------------------------------------------------------------------------

_FLAGS = f"""{_CAND}, f AS (SELECT *, CASE WHEN qty > 5 THEN 1 ELSE 0 END AS ep, CASE WHEN tax > 0.07 THEN 1 ELSE 0 END AS inv, CASE WHEN disc > 0.09 THEN 1 ELSE 0 END AS red, CASE WHEN part % 9 = 0 THEN '  ' ELSE 'x' END AS code, CASE WHEN part % 8 > 0 THEN 'p' END AS prompt,
    CASE WHEN part % 7 <> 0 THEN disc * 10 END AS line, disc * 9 AS branch, CASE WHEN part % 5 <> 0 THEN tax * 12 END AS mut, CASE WHEN part % 11 = 0 THEN 1 ELSE 0 END AS unav, CAST(qty % 4 AS INT) AS asserts, part % 3 AS gaps, part % 2 AS sig FROM cand)"""
_USABLE = "ep = 1 AND inv = 0 AND red = 0"
_EVALUATED = f"{_USABLE} AND line IS NOT NULL AND mut IS NOT NULL AND unav = 0"


def _flags(spark, sf):
    c, f = F.col, F.when
    names = {"syntax_pass": F.lit(1), "execution_pass": (c("qty") > 5).cast("int"), "invalid_candidate_flag": (c("tax") > 0.07).cast("int"), "redefines_target_flag": (c("disc") > 0.09).cast("int"), "candidate_test_code": f(c("part") % 9 == 0, "  ").otherwise("x"), "prompt": f(c("part") % 8 > 0, "p")}
    names |= {"line_coverage": f(c("part") % 7 != 0, c("disc") * 10), "branch_coverage": c("disc") * 9, "mutation_score": f(c("part") % 5 != 0, c("tax") * 12), "mutation_unavailable": (c("part") % 11 == 0).cast("int"), "num_asserts": (c("qty") % 4).cast("int"), "pos_soft_gap_count": c("part") % 3, "has_branch_gap": c("part") % 2}
    return _candidates(spark, sf).withColumns(names)


@query("flt_02_usable_text", f"WITH {_FLAGS} SELECT id FROM f WHERE {_USABLE} AND trim(code) <> '' AND prompt IS NOT NULL")
def _(spark, sf):
    return _flags(spark, sf).filter(PL.usable_text()).select("id")


@query("flt_04_usable_eval", f"WITH {_FLAGS} SELECT id FROM f WHERE {_EVALUATED}")
def _(spark, sf):
    df = _flags(spark, sf)
    return df.filter(PL.usable_eval(df)).select("id")


@query("flt_07_relaxed_positive", f"WITH {_FLAGS} SELECT id FROM f WHERE mut >= 0.72 AND line >= 0.80 AND branch >= 0.70 AND asserts >= 1 AND gaps <= 1")
def _(spark, sf):
    return _flags(spark, sf).filter(PL.positive(PL.RELAXED)).select("id")


@query("flt_08_natural_negative", f"WITH {_FLAGS} SELECT id FROM f WHERE {_EVALUATED} AND sig >= 1")
def _(spark, sf):
    df = _flags(spark, sf)
    return df.filter(PL.natural_negative(df, ("has_branch_gap",))).select("id")


@query("flt_09_programmatic_valid", f"WITH {_FLAGS} SELECT id FROM f WHERE {_USABLE} AND unav = 0 AND part % 8 > 0")
def _(spark, sf):
    df = _flags(spark, sf).withColumn("syntax_pass", F.when(F.col("part") % 8 > 0, "1").otherwise("unknown"))
    return df.filter(PL.programmatic_valid(df)).select("id")


def _pair_flags(spark, sf):
    i = F.col("l_linenumber")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_partkey") * 10 + i).alias("id"), "l_returnflag", F.lit(1).alias("syntax_pass"), (F.col("l_tax") < 0.07).cast("int").alias("execution_pass"), (F.col("l_discount") >= 0.09).cast("int").alias("invalid_candidate_flag"), F.lit(0).alias("redefines_target_flag"), F.col("l_quantity").alias("mutation_score"), (i % 3).alias("neg_logic_signal_count"), (i % 2).alias("failure_log_count"))
    return PL.pair_validity(PL.pairs(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'")))


_PAIRS = "p AS (SELECT a.l_partkey * 10 + a.l_linenumber AS pos, b.l_partkey * 10 + b.l_linenumber AS neg, (b.l_tax < 0.07 AND b.l_discount < 0.09) AS e, a.l_quantity - b.l_quantity > 0 AS gain, b.l_linenumber % 3 AS s FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R')"


@query("flt_10_pair_exec_valid", f"WITH {_PAIRS} SELECT pos, neg, CAST(e AS INT) AS ok FROM p")
def _(spark, sf):
    return _pair_flags(spark, sf).select(F.col("id_pos").alias("pos"), F.col("id_neg").alias("neg"), F.col("pair_exec_valid").alias("ok"))


@query("flt_12_high_information", f"WITH {_PAIRS} SELECT pos, neg FROM p WHERE e AND gain AND s >= 1")
def _(spark, sf):
    return _pair_flags(spark, sf).filter("pair_high_info = 1").select(F.col("id_pos").alias("pos"), F.col("id_neg").alias("neg"))


@query("flt_14_surface_keep", f"WITH {_SURFACE} SELECT pos, neg FROM p WHERE h1 + h2 + h3 + h4 = 0 AND m1 + m2 + m3 <= 1")
def _(spark, sf):
    return _surface_pairs(spark, sf).filter("surface_filter_keep = 1").select(F.col("candidate_id_pos").alias("pos"), F.col("candidate_id_neg").alias("neg"))


@query("flt_16_cell_selection", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT')")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("pos_tier"), F.col("o_orderpriority").alias("neg_source"))
    return PL.select_cells(o, ("F", "O"), ("1-URGENT",)).select("o_orderkey")


@query("flt_18_non_members", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(spark, sf):
    return PL.non_members(table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


_PREFERENCES = """SELECT o_orderkey AS task_id, 'c' || o_custkey AS chosen_id, CASE WHEN o_custkey % 6 = 0 THEN ' ' ELSE repeat('w ', CAST(o_custkey % 9 AS INT)) || 'x' END AS rejected, o_orderstatus AS source FROM orders"""


def _preferences(spark, sf, group="HH"):
    k = F.col("o_custkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("c"), k).alias("candidate_id_pos"), F.concat(F.lit("r"), k).alias("candidate_id_neg"), F.lit("good").alias("candidate_test_code_pos"), F.when(k % 6 == 0, " ").otherwise(F.concat(F.expr("repeat('w ', CAST(o_custkey % 9 AS INT))"), F.lit("x"))).alias("candidate_test_code_neg"), F.col("o_orderstatus").alias("source"), F.lit("easy").alias("difficulty_bucket"))
    return D.preference_rows(o, group, F.lit("p"))


@query("flt_19_non_blank_sides", f"SELECT task_id, chosen_id, rejected FROM ({_PREFERENCES}) WHERE trim(rejected) <> ''")
def _(spark, sf):
    return _preferences(spark, sf).select("task_id", F.col("chosen_candidate_id").alias("chosen_id"), "rejected")


@query("flt_20_runs", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '2-HIGH'")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("group"), F.col("o_orderpriority").alias("split"))
    return PL.select_runs(o, ("F", "P"), "2-HIGH").select("o_orderkey")


@query("flt_21_ordinary_negatives", f"SELECT task_id, 'HL' AS cell, CAST(len(string_split(trim(rejected), ' ')) AS INT) AS length_words FROM ({_PREFERENCES}) WHERE trim(rejected) <> ''")
def _(spark, sf):
    both = _preferences(spark, sf, "HL").withColumn("neg_kind", F.lit("ordinary")).unionByName(_preferences(spark, sf, "HH").withColumn("neg_kind", F.lit("strong")))
    return D.ordinary_negatives(both).select("task_id", "cell", "length_words")


@query("flt_22_owned_rows", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O'")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("project"), F.col("o_orderstatus").alias("user"))
    return PL.owned(o, "3-MEDIUM", "O").select("o_orderkey")


@query("flt_25_test_paths", r"SELECT page_id, p FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pkg/tests/a.py' WHEN 1 THEN 'src/test_' || page_id || '.py' WHEN 2 THEN 'src/latest.py' ELSE 'a_test.py' END AS p FROM pages) WHERE regexp_matches(p, '(^|/)(tests?/|test_[^/]*\.py$|[^/]*_test\.py$|conftest\.py$)')")
def _(spark, sf):
    k = F.col("page_id") % 4
    p = F.when(k == 0, "pkg/tests/a.py").when(k == 1, F.concat(F.lit("src/test_"), "page_id", F.lit(".py"))).when(k == 2, "src/latest.py").otherwise("a_test.py")
    return table(spark, sf, "pages").select("page_id", p.alias("p")).filter(S.is_test_path("p"))


# --- joins -------------------------------------------------------------------------------------------------------------


@query("join_04_both_sides", "SELECT a.o_orderkey, p.c_name AS pos_name, n.s_name AS neg_name FROM orders a LEFT JOIN customer p ON a.o_custkey = p.c_custkey LEFT JOIN supplier n ON a.o_custkey % 150 = n.s_suppkey")
def _(spark, sf):
    pairs = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("candidate_id_pos"), F.concat(F.lit("s"), F.col("o_custkey") % 150).alias("candidate_id_neg"))
    surface = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("candidate_id"), F.col("c_name").alias("name")).unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("candidate_id"), F.col("s_name").alias("name")))
    return PL.attach(pairs, surface, ["name"]).select("o_orderkey", F.col("name_pos").alias("pos_name"), F.col("name_neg").alias("neg_name"))


@query(
    "join_05_metadata",
    "SELECT o_orderkey, p.c_mktsegment AS segment_pos, n.c_mktsegment AS segment_neg FROM orders LEFT JOIN customer p ON o_custkey = p.c_custkey AND o_custkey % 25 = p.c_nationkey LEFT JOIN customer n ON o_custkey + 1 = n.c_custkey",
)
def _(spark, sf):
    k = F.col("o_custkey")
    pairs = table(spark, sf, "orders").select("o_orderkey", k.alias("candidate_id_pos"), (k + 1).alias("candidate_id_neg"), (k % 25).cast("int").alias("task_id"))
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), F.col("c_nationkey").alias("task_id"), F.col("c_mktsegment").alias("segment"))
    return PL.attach_metadata(pairs, known, ["segment"]).select("o_orderkey", "segment_pos", "segment_neg")


@query("join_07_annotations", "SELECT o_orderkey, o_totalprice, quality FROM orders JOIN labels ON o_orderkey = doc_id")
def _(spark, sf):
    scores = table(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), "quality")
    master = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), "o_totalprice")
    return C.require_unique(scores, "sample_id").join(master, "sample_id").select(F.col("sample_id").alias("o_orderkey"), "o_totalprice", "quality")


@query("join_08_full_counts", "SELECT coalesce(a.k, b.k) AS k, coalesce(n_orders, 0) AS n_orders, coalesce(n_large, 0) AS n_large FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n_large FROM orders WHERE o_totalprice > 400000 GROUP BY 1) b ON a.k = b.k")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    a, b = (RP.count_by(o.filter(where), ["k"], name) for where, name in (("o_orderstatus = 'F'", "n_orders"), ("o_totalprice > 400000", "n_large")))
    return a.join(b, "k", "full_outer").na.fill(0, ["n_orders", "n_large"])


@query("join_09_counts_or_zero", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(spark, sf):
    counts = RP.count_by(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "n")
    return P.fill_aggregates(table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left"), ["n"], [])


@query("join_10_right_suffix", "SELECT o_orderkey, o_custkey, c_name AS c_name_task, c_acctbal AS c_acctbal_task FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def _(spark, sf):
    tasks = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_acctbal")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(P.with_side(tasks, "task", ["o_custkey"]), "o_custkey", "left")


@query("join_11_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000")
def _(spark, sf):
    index = R.first_per_key(table(spark, sf, "customer").filter("c_acctbal > 5000"), ["c_custkey"], R.last("c_name")).select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(index, "o_custkey").drop("o_custkey")


@query("join_13_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, sf):
    return PL.members(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders").filter("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("join_14_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _(spark, sf):
    return PL.non_members(table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "orders").filter("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query(
    "join_16_nearest_match",
    """WITH p AS (SELECT p_partkey, p_brand, p_size FROM part), m AS (SELECT a.p_partkey AS anchor_id, b.p_partkey AS match_id, abs(a.p_size - b.p_size) AS gap, row_number() OVER (PARTITION BY a.p_partkey ORDER BY abs(a.p_size - b.p_size), b.p_partkey) AS rn
    FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey) SELECT anchor_id, match_id, gap, 0 AS level FROM m WHERE rn = 1""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return R.matched_random(p, p, [["p_brand"], []], "p_partkey", "p_size", 1, near=1)


@query("join_17_missing_metrics", "SELECT o_orderkey, round(coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END, m), 2) AS v FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(spark, sf):
    runs = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("v"))
    per_run = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("m"))
    return runs.join(per_run, "o_orderkey", "left").select("o_orderkey", F.round(S.first_metric("v", "m"), 2).alias("v"))


@query("join_18_match_counts", "SELECT count(c_custkey) AS matched, count(*) - count(c_custkey) AS unmatched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def _(spark, sf):
    return C.match_flags(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf, "customer").filter("c_acctbal > 5000"), "c_custkey")


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("agg_02_two_levels", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    return RP.count_by(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "n")


@query("agg_05_count_by_key", "SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1")
def _(spark, sf):
    return RP.count_by(table(spark, sf, "lineitem"), ["l_orderkey"], "n_lines")


@query("agg_09_list_mean_sd", "SELECT o_custkey, round(avg(v), 3) AS mean, CASE WHEN count(v) = 1 THEN 0.0::DOUBLE ELSE round(stddev_samp(v), 3) END AS sd FROM (SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 1000 END AS v FROM orders) GROUP BY 1")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 1000).alias("v"))
    return RP.group_ci(o, ["o_custkey"], "v", "zero").select("o_custkey", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("sd"))


@query("agg_10_rates_by_source", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS high_rate, round(avg(CASE WHEN user_id % 4 > 0 THEN value END), 6) AS mean_value FROM events GROUP BY 1")
def _(spark, sf):
    e = table(spark, sf, "events").withColumns({"high": (F.col("value") > 50).cast("int"), "v": F.when(F.col("user_id") % 4 > 0, F.col("value"))})
    out = RP.rates(e, ["event_type"], ["high"], ["v"])
    return out.select("event_type", "n", F.round("high_rate", 6).alias("high_rate"), F.round("v_mean", 6).alias("mean_value"))


_THREE = "SELECT l_suppkey AS run, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS ok, CASE WHEN l_linenumber <> 3 THEN l_discount END AS v FROM lineitem"


def _three(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), (F.col("l_returnflag") != "R").cast("int").alias("ok"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("v"))


@query("agg_16_adjusted_mean", f"SELECT run, round(avg(ok * coalesce(v, 0)), 6) AS m FROM ({_THREE}) GROUP BY 1")
def _(spark, sf):
    return _three(spark, sf).groupBy("run").agg(F.round(RP.adjusted_mean("v", "ok"), 6).alias("m"))


@query("agg_17_valid_mean", f"SELECT run, round(avg(v) FILTER (ok = 1), 6) AS m FROM ({_THREE}) GROUP BY 1")
def _(spark, sf):
    return _three(spark, sf).groupBy("run").agg(F.round(RP.valid_mean("v", "ok"), 6).alias("m"))


@query("agg_18_plain_mean", f"SELECT run, round(avg(v), 6) AS m FROM ({_THREE}) GROUP BY 1")
def _(spark, sf):
    return _three(spark, sf).groupBy("run").agg(F.round(RP.plain_mean("v"), 6).alias("m"))


@query("agg_24_balanced_quota", f"SELECT o_orderpriority, least(count(*) FILTER (c = 'LL'), count(*) FILTER (c = 'HL'), count(*) FILTER (c = 'LH'), count(*) FILTER (c = 'HH')) AS quota FROM (SELECT o_orderstatus AS o_orderpriority, {_CELL} AS c FROM (SELECT * FROM orders)) GROUP BY 1")
def _(spark, sf):
    return RP.cell_pivot(_cells(spark, sf), ["o_orderstatus"]).select(F.col("o_orderstatus").alias("o_orderpriority"), "quota")


@query("agg_28_distinct_counts", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_custkey, count(DISTINCT o_orderpriority) AS n_priority FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("n_custkey"), F.count_distinct("o_orderpriority").alias("n_priority"))


@query(
    "agg_29_distribution",
    """WITH o AS (SELECT o_custkey, o_orderstatus AS source, CASE WHEN o_orderkey % 10 > 0 THEN o_orderpriority END AS bucket FROM orders)
    SELECT 'orders' AS kind, 'rows' AS field, NULL AS value, count(*) AS n FROM o UNION ALL SELECT 'orders', 'unique_tasks', NULL, count(DISTINCT o_custkey) FROM o UNION ALL SELECT 'orders', 'source', coalesce(source, 'NA'), count(*) FROM o GROUP BY 3 UNION ALL SELECT 'orders', 'bucket', coalesce(bucket, 'NA'), count(*) FROM o GROUP BY 3""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("source"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderpriority")).alias("bucket"))
    return RP.distribution(o, "orders", ("source", "bucket"), "o_custkey")


@query("agg_40_status_counters", "SELECT 'execution' AS stage, coalesce(CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END, 'None') AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'coverage', l_returnflag, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'mutation', event_type, count(*) FROM events GROUP BY 2")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderstatus")))
    return RP.status_counters({"execution": (o, "s"), "coverage": (table(spark, sf, "lineitem"), "l_returnflag"), "mutation": (table(spark, sf, "events"), "event_type")})


# --- windows, orders, sets ---------------------------------------------------------------------------------------------


@query("win_11_position_in_file", "SELECT r_name, r_regionkey AS position FROM region")
def _(spark, sf):
    at = _place(spark)
    FS.write_jsonl(table(spark, sf, "region").coalesce(1).sortWithinPartitions("r_regionkey"), at)
    return FS.with_record_index(FS.read_jsonl(spark, at, "r_name string"), "position", 0).select("r_name", F.col("position").cast("int").alias("position"))


@query("win_12_first_of_key", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey) = 1")
def _(spark, sf):
    return R.first_per_key(table(spark, sf, "orders"), ["o_custkey"], R.last("o_totalprice", "o_orderkey")).select("o_custkey", "o_orderkey")


def _placed(df, by, order, name="place"):
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


@query("sort_03_as_text", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) AS place FROM orders")
def _(spark, sf):
    return _placed(table(spark, sf, "orders"), ["o_custkey"], [P.text("o_orderkey").asc()]).select("o_orderkey", "place")


@query("sort_04_group_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders")
def _(spark, sf):
    return _placed(table(spark, sf, "orders"), ["o_custkey"], [P.ordered_category("o_orderstatus", {"P": 0, "O": 1}), F.col("o_orderkey")]).select("o_orderkey", "place")


@query(
    "sort_05_by_correlation",
    """WITH c AS (SELECT l_returnflag AS target, 'tax' AS metric, corr(l_tax, l_quantity) AS r FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'discount', corr(l_discount, l_quantity) FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'price', corr(l_extendedprice, l_quantity) FROM lineitem GROUP BY 1)
    SELECT target, metric, row_number() OVER (PARTITION BY target ORDER BY round(r, 9) DESC, metric) AS place FROM c""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("target")).agg(*[F.corr(c, "l_quantity").alias(n) for n, c in (("tax", "l_tax"), ("discount", "l_discount"), ("price", "l_extendedprice"))])
    long = rows.unpivot(["target"], ["tax", "discount", "price"], "metric", "r")
    return _placed(long, ["target"], [F.round("r", 9).desc_nulls_last(), F.col("metric")]).select("target", "metric", "place")


@query("sort_06_stable_key", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR), CAST(o_orderkey % 100 AS VARCHAR), CAST(o_orderkey AS VARCHAR)) AS place FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    keys = [P.text(c) for c in (F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey"), k % 100, k)]
    return _placed(table(spark, sf, "orders"), ["o_custkey"], keys).select("o_orderkey", "place")


@query("sort_09_best_candidate", f"WITH {_EVAL} SELECT id, row_number() OVER (PARTITION BY score % 7 ORDER BY failures = 0 DESC, score DESC, id) AS place FROM st")
def _(spark, sf):
    e = _evaluations(spark, sf).withColumn("g", F.col("score") % 7)
    return _placed(e, ["g"], [(F.col("failures") == 0).desc(), F.desc("score"), F.col("id")]).select("id", "place")


@query("sort_10_bottleneck_order", "WITH t AS (SELECT o_custkey, count(*) AS pairs, count(*) FILTER (o_orderstatus = 'F') AS kept FROM orders GROUP BY 1) SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY pairs DESC, kept DESC, o_custkey) AS place FROM t")
def _(spark, sf):
    t = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("pairs"), F.count_if(F.col("o_orderstatus") == "F").alias("kept")).withColumn("g", F.col("o_custkey") % 10)
    return _placed(t, ["g"], R.last(("pairs", "desc"), ("kept", "desc"), "o_custkey")).select("o_custkey", "place")


@query("lim_01_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    return table(spark, sf, "orders").orderBy(*R.last(("o_totalprice", "desc"), "o_orderkey")).limit(25).select("o_orderkey", "o_totalprice")


@query("lim_04_error_preview", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, o_custkey LIMIT 20")
def _(spark, sf):
    return C.duplicates(table(spark, sf, "orders"), "o_custkey", 20)


@query("set_02_concatenation", "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


@query("set_09_unique_texts", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text")
def _(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").withColumn("digest", F.md5(F.encode("text", "UTF-8")))
    return R.first_per_key(d.select("doc_id", "digest"), ["digest"], R.last("doc_id"))


# --- functions ---------------------------------------------------------------------------------------------------------


@query("fn_04_entry_point", r"SELECT item_id, nullif(regexp_extract(c, 'def\s+([a-zA-Z_]\w*)\s*\(', 1), '') AS entry FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'import x' || chr(10) || 'def  f' || item_id || ' (a):' WHEN 1 THEN text ELSE 'def g(x): def h(y):' END AS c FROM benchmark)")
def _(spark, sf):
    k = F.col("item_id") % 3
    code = F.when(k == 0, F.concat(F.lit("import x\ndef  f"), "item_id", F.lit(" (a):"))).when(k == 1, F.col("text")).otherwise("def g(x): def h(y):")
    return table(spark, sf, "benchmark").select("item_id", S.entry_point(code).alias("entry"))


_SIGNATURES = [
    (1, "def f(a, b=1):\n    pass", "def f(a, b=1):", 2),
    (2, "x = 1\ndef g(\n    a: dict[str, int] = {1: (2, 3)},\n    *rest,\n) -> int:\n    pass", "def g(a: dict[str, int] = {1: (2, 3)}, *rest,) -> int:", 2),
    (3, "class A:\n    def m(self, x):\n        pass", "def m(self, x):", 1),
    (4, "def none():\n    pass", "def none():", 0),
]


@query("fn_05_signatures", "SELECT * FROM (VALUES (1, 'def f(a, b=1):'), (3, 'def m(self, x):'), (4, 'def none():')) t(id, signature)")
def _(spark, sf):
    c = spark.createDataFrame([r[:2] for r in _SIGNATURES if r[0] != 2], "id int, code string")
    return c.select("id", K.udfs()["signature"]("code", F.lit(None).cast("string"))["signature"].alias("signature"))


@query("fn_06_argument_counts", "SELECT * FROM (VALUES (1, 2), (2, 2), (3, 1), (4, 0)) t(id, arg_count)")
def _(spark, sf):
    c = spark.createDataFrame([r[:2] for r in _SIGNATURES], "id int, code string")
    return c.select("id", K.udfs()["signature"]("code", F.lit(None).cast("string"))["arg_count"].cast("int").alias("arg_count"))


@query("fn_07_doctest_marker", "SELECT doc_id, contains(t, '>>>') AS doctest FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || ' >>> f(1)' WHEN 1 THEN text END AS t FROM documents)")
def _(spark, sf):
    k = F.col("doc_id") % 3
    return table(spark, sf, "documents").select("doc_id", S.has_doctest(F.when(k == 0, F.concat("text", F.lit(" >>> f(1)"))).when(k == 1, F.col("text"))).alias("doctest"))


@query("fn_08_import_list", "SELECT c_custkey, list_filter(['import a', trim(c_mktsegment), CASE WHEN c_custkey % 2 = 0 THEN 'x' END], lambda x: x IS NOT NULL AND trim(x) <> '') AS imports FROM customer")
def _(spark, sf):
    raw = F.array(F.lit(" import a"), "c_mktsegment", F.lit("  "), F.when(F.col("c_custkey") % 2 == 0, "x"))
    return table(spark, sf, "customer").select("c_custkey", S.clean_list(raw).alias("imports"))


@query("fn_10_top_imports", "SELECT 1 AS id, 'import a|from b import c' AS imports UNION ALL SELECT 2, '' UNION ALL SELECT 3, 'import x'")
def _(spark, sf):
    c = spark.createDataFrame([(1, "import a\n\nfrom b import c\ntext\nimport d"), (2, "text\nimport a"), (3, "import x")], "id int, code string")
    return c.select("id", F.array_join(K.udfs()["top_imports"]("code"), "|").alias("imports"))


@query("fn_14_exception_type", "SELECT event_id, CASE event_type WHEN 'error' THEN 'ValueError' WHEN 'click' THEN 'KeyError' WHEN 'view' THEN 'ImportError' END AS kind FROM events")
def _(spark, sf):
    log = F.when(F.col("event_type") == "error", "TypeError: first\nE   x\nValueError: last").when(F.col("event_type") == "click", "E   KeyError: 'k'").when(F.col("event_type") == "view", "it failed with ImportError in line 3").otherwise("2 passed")
    return table(spark, sf, "events").select("event_id", S.exception_type(log).alias("kind"))


@query("fn_17_consistent_counts", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 5 = 0 AS consistent FROM lineitem")
def _(spark, sf):
    k = F.col("l_partkey")
    li = table(spark, sf, "lineitem").withColumn("r", F.struct((k % 5 + 4).cast("int").alias("mutants_total"), F.lit(1).alias("mutants_killed"), F.lit(1).alias("mutants_survived"), F.lit(1).alias("mutants_timeout"), F.lit(1).alias("mutants_suspicious")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", PS.consistent(F.col("r")).alias("consistent"))


@query("fn_19_percent", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 100, 6) AS ratio FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.percent_to_ratio("l_quantity").alias("ratio"))


@query("fn_21_capped_ratios", "SELECT o_orderkey, round(least(o_custkey % 5 / 3.0, 1.0), 6)::DOUBLE AS three, least(o_custkey % 5, 1)::DOUBLE AS one FROM orders")
def _(spark, sf):
    n = F.col("o_custkey") % 5
    return table(spark, sf, "orders").select("o_orderkey", S.capped_ratio(n, 3).alias("three"), S.capped_ratio(n, 1).alias("one"))


@query("fn_22_branch_else_line", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN l_partkey % 3 > 0 THEN l_discount END, l_tax) AS v FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.first_metric(F.when(F.col("l_partkey") % 3 > 0, F.col("l_discount")), "l_tax").alias("v"))


@query("fn_23_fenced_block", "SELECT 1 AS id, 'def test_q(): pass' AS code UNION ALL SELECT 2, 'assert f(1)' UNION ALL SELECT 3, 'x' UNION ALL SELECT 4, 'no fence'")
def _(spark, sf):
    c = spark.createDataFrame([(1, "a\n```python\nassert x\n```\n```\ndef test_q(): pass\n```"), (2, "```\nx\n```\n```py\nassert f(1)\n```"), (3, "```\nx\n```\n```\ny\n```"), (4, "no fence")], "id int, text string")
    return c.select("id", F.trim(F.translate(K.udfs()["fenced"]("text"), "\n", "")).alias("code"))


@query("fn_25_word_counts", r"SELECT conv_id, turn, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE CAST(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS INT) END AS words FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.word_count("text").alias("words"))


@query("fn_26_hash_ids", "SELECT page_id, 'a1_' || substr(sha1(trim(url)), 1, 10) AS short, sha256(url) AS long FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.sample_id("url").alias("short"), F.sha2("url", 256).alias("long"))


@query("fn_27_applicability", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS applies FROM events")
def _(spark, sf):
    k = F.col("event_id") % 6
    said = F.when(k == 0, " Yes ").when(k == 1, "N/A").when(k == 2, "1.0").when(k == 3, "No").when(k == 4, "perhaps")
    return table(spark, sf, "events").select("event_id", S.applicability(said).alias("applies"))


@query("fn_31_status", f"WITH {_EVAL} SELECT id, status FROM st")
def _(spark, sf):
    return _evaluations(spark, sf).select("id", "status")


@query("fn_32_defect_advice", f"""WITH {_EVAL} SELECT id, CASE WHEN failures > 0 THEN 'fix or prune failing assertions' WHEN mutationvalid = 0 THEN 'repair the mutation run' WHEN mutation < 0.45 THEN 'assert on results, not on types' WHEN branch < 0.55 THEN 'add cases for untaken branches'
    WHEN score >= 75 AND mutation >= 0.6 THEN 'keep' ELSE 'add boundary assertions' END AS advice FROM st""")
def _(spark, sf):
    c = F.col
    return _evaluations(spark, sf).select("id", S.defect(c("failures"), c("mutationvalid"), c("mutation"), c("branch"), c("score"))["advice"].alias("advice"))


@query("fn_34_occurrences", "SELECT doc_id, CAST((length(text) - length(replace(text, 'a', ''))) AS INT) AS n_a, CAST((length(text) - length(replace(text, 'er', ''))) / 2 AS INT) AS n_er FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.occurrences("text", "a").alias("n_a"), S.occurrences("text", "er").alias("n_er"))


@query("fn_35_risk", f"WITH {_EVAL} SELECT id, CASE status WHEN 'adopt' THEN 'low' WHEN 'review' THEN 'medium' ELSE 'high' END AS risk FROM st")
def _(spark, sf):
    return _evaluations(spark, sf).select("id", S.risk(F.col("status")).alias("risk"))


@query("fn_39_groups", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unusable' WHEN o_custkey % 4 = 0 THEN 'flagged' WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS g FROM orders")
def _(spark, sf):
    c = F.col
    return table(spark, sf, "orders").select("o_orderkey", S.quantile_group(c("o_totalprice"), F.lit(100000), F.lit(300000), c("o_orderstatus") != "P", (c("o_custkey") % 4 == 0).cast("int")).alias("g"))


@query("fn_40_bucket", "SELECT p_partkey, CASE WHEN p_size <= 15 THEN 'easy' WHEN p_size <= 35 THEN 'medium' ELSE 'hard' END AS bucket FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.bucket(F.col("p_size"), F.lit(15), F.lit(35)).alias("bucket"))


@query("fn_41_deltas", "SELECT c_custkey, c_acctbal - s_acctbal AS delta, abs(c_acctbal - s_acctbal) AS gap, round(greatest(c_custkey % 7, s_suppkey % 7)::DOUBLE / nullif(least(c_custkey % 7, s_suppkey % 7), 0), 6) AS ratio FROM customer JOIN supplier ON c_custkey = s_suppkey + 3")
def _(spark, sf):
    c = F.col
    both = table(spark, sf, "customer").join(table(spark, sf, "supplier"), c("c_custkey") == c("s_suppkey") + 3)
    delta = c("c_acctbal") - c("s_acctbal")
    return both.select("c_custkey", delta.alias("delta"), F.abs(delta).alias("gap"), F.round(S.ratio((c("c_custkey") % 7).cast("double"), (c("s_suppkey") % 7).cast("double")), 6).alias("ratio"))


@query("fn_43_rounding", "SELECT event_id, round(value, 1) AS one, round(value, 2) AS two, round(value, 4) AS four FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", *[F.round("value", n).alias(k) for n, k in ((1, "one"), (2, "two"), (4, "four"))])


@query("fn_45_last_query_value", "SELECT page_id, 'b' || page_id AS q, NULL::VARCHAR AS missing FROM pages")
def _(spark, sf):
    url = F.concat("url", F.lit("?q=a&p=1&q=b"), "page_id", F.lit("#end"))
    return table(spark, sf, "pages").select("page_id", S.last_query_value(url, "q").alias("q"), S.last_query_value(url, "zz").alias("missing"))


# --- statistics --------------------------------------------------------------------------------------------------------

_FOUR = f"s AS (SELECT {_CELL} AS c, count(*) AS n, avg(o_custkey) AS m, var_pop(o_custkey) AS v FROM orders GROUP BY 1), g AS (SELECT max(n) FILTER (c = 'LL') AS nll, max(m) FILTER (c = 'LL') AS ll, max(n) FILTER (c = 'HL') AS nhl, max(m) FILTER (c = 'HL') AS hl, max(n) FILTER (c = 'LH') AS nlh, max(m) FILTER (c = 'LH') AS lh, max(n) FILTER (c = 'HH') AS nhh, max(m) FILTER (c = 'HH') AS hh, sum(n * v) AS rss, sum(n * v) / (sum(n) - 4) AS s2 FROM s)"


def _factorial(spark, sf):
    return ST.factorial_tests(_cells(spark, sf).withColumn("y", F.col("o_custkey").cast("double")), "cell", "y")


@query(
    "sta_11_coefficients",
    f"""WITH {_FOUR} SELECT 'intercept' AS term, round(ll, 5) AS coef, round(sqrt(s2 / nll), 5) AS se FROM g UNION ALL SELECT 'p', round(hl - ll, 5), round(sqrt(s2 * (1 / nll + 1 / nhl)), 5) FROM g UNION ALL SELECT 'n', round(lh - ll, 5), round(sqrt(s2 * (1 / nll + 1 / nlh)), 5) FROM g
    UNION ALL SELECT 'p:n', round(hh - hl - lh + ll, 5), round(sqrt(s2 * (1 / nll + 1 / nhl + 1 / nlh + 1 / nhh)), 5) FROM g""",
)
def _(spark, sf):
    return spark.createDataFrame([(c["term"], round(c["coef"], 5), round(c["se"], 5)) for c in _factorial(spark, sf)[0]], "term string, coef double, se double")


@query(
    "sta_12_anova",
    f"""WITH {_FOUR}, h AS (SELECT *, 1 / (1 / nll + 1 / nhl) AS wl, 1 / (1 / nlh + 1 / nhh) AS wh, 1 / (1 / nll + 1 / nlh) AS ul, 1 / (1 / nhl + 1 / nhh) AS uh FROM g),
    t AS (SELECT *, (wl * (hl - ll) + wh * (hh - lh)) ** 2 / (wl + wh) AS p, (ul * (lh - ll) + uh * (hh - hl)) ** 2 / (ul + uh) AS q, (hh - hl - lh + ll) ** 2 / (1 / nll + 1 / nhl + 1 / nlh + 1 / nhh) AS pq FROM h)
    SELECT 'p' AS term, round(p / 1e6, 4) AS sum_sq, round(p / s2, 4) AS f, round(p / (p + q + pq + rss), 8) AS eta_sq FROM t UNION ALL SELECT 'n', round(q / 1e6, 4), round(q / s2, 4), round(q / (p + q + pq + rss), 8) FROM t UNION ALL SELECT 'p:n', round(pq / 1e6, 4), round(pq / s2, 4), round(pq / (p + q + pq + rss), 8) FROM t
    UNION ALL SELECT 'residual', round(rss / 1e6, 4), NULL, round(rss / (p + q + pq + rss), 8) FROM t""",
)
def _(spark, sf):
    rows = [(a["term"], round(a["sum_sq"] / 1e6, 4), None if a["f"] is None else round(a["f"], 4), round(a["eta_sq"], 8)) for a in _factorial(spark, sf)[1]]
    return spark.createDataFrame(rows, "term string, sum_sq double, f double, eta_sq double")


@query("sta_14_interval", "SELECT o_orderstatus, count(*) AS n, round(1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS half FROM orders GROUP BY 1")
def _(spark, sf):
    return RP.group_ci(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice").select("o_orderstatus", "n", F.round((F.col("ci_high") - F.col("ci_low")) / 2, 4).alias("half"))


# --- code: expected rows are typed by hand ------------------------------------------------------------------------------


@query("udf_06_parse_check", "SELECT 1 AS id, true AS ok, NULL AS kind UNION ALL SELECT 2, false, 'SyntaxError' UNION ALL SELECT 3, false, 'IndentationError'")
def _(spark, sf):
    c = spark.createDataFrame([(1, "x = 1"), (2, "def f(:"), (3, "  x = 1")], "id int, code string")
    return c.select("id", K.udfs()["parse_check"]("code").alias("p")).select("id", "p.ok", "p.kind")


@query("udf_07_full_function", "SELECT 1 AS id, true AS whole UNION ALL SELECT 2, false UNION ALL SELECT 3, false")
def _(spark, sf):
    c = spark.createDataFrame([(1, "def f(x):\n    return x\n", "f"), (2, "    return x\n", "f"), (3, "def g(x):\n    return x\n", "f")], "id int, code string, entry string")
    return c.select("id", K.udfs()["is_full_function"]("code", "entry").alias("whole"))


@query("udf_08_runner_mode", "SELECT 1 AS id, CAST(0 AS BIGINT) AS top_level_asserts UNION ALL SELECT 2, 2")
def _(spark, sf):
    c = spark.createDataFrame([(1, "def test_a():\n    assert 1\n"), (2, "assert f(1)\nx = 2\nassert f(x)\n")], "id int, code string")
    return c.select("id", K.udfs()["runner_mode"]("code")["top_level_asserts"].alias("top_level_asserts"))


@query("udf_12_mutants", "SELECT 'a < b' AS code, 'a <= b' AS mutant UNION ALL SELECT 'a * b + c', 'a - b + c' UNION ALL SELECT 'a * b + c', 'a + b + c' UNION ALL SELECT 'not a', 'a' UNION ALL SELECT 'x % 2', 'x + 2' UNION ALL SELECT 'x % 2', 'x % 3'")
def _(spark, sf):
    c = spark.createDataFrame([("a < b",), ("a * b + c",), ("not a",), ("x % 2",), ("''",)], "code string")
    return c.select("code", F.explode(K.udfs()["mutants"]("code")).alias("m")).select("code", F.rtrim(F.translate("m.code", "\n", "")).alias("mutant"))


@query("udf_04_surface_counts", "SELECT * FROM (VALUES (1, 1, 3, 0), (2, 0, 2, 1), (3, 0, 0, 0)) t(id, async_tests, tests, nesting)")
def _(spark, sf):
    c = spark.createDataFrame([(1, "def test_a(): pass\ndef testing(): pass\nasync def test(): pass\ndef other(): pass\n"), (2, "def test_a():\n    if x:\n        pass\ndef testB():\n    for y in z: pass\n"), (3, "x = 1\n")], "id int, code string")
    s = K.udfs()["surface"]("code")
    return c.select("id", s.alias("s")).select("id", F.col("s.num_async_test_functions").cast("int").alias("async_tests"), F.col("s.num_test_functions").cast("int").alias("tests"), F.col("s.logical_nesting_depth").cast("int").alias("nesting"))


@query("udf_19_assembled", "SELECT 1 AS id, 'full_function' AS mode, 'import a||def f(x):|    return x||' AS code UNION ALL SELECT 2, 'prompt_plus_body', 'def f(x):|    return x||'")
def _(spark, sf):
    c = spark.createDataFrame([(1, "import a\ndef f(x):\n", "def f(x):\n    return x\n", "f"), (2, "def f(x):\n", "    return x\n", "f")], "id int, prompt string, solution string, entry string")
    return c.select("id", K.udfs()["assemble"]("prompt", "solution", "entry").alias("a")).select("id", "a.mode", F.translate("a.code", "\n", "|").alias("code"))


@query("fn_24_cleaned_text", "SELECT 1 AS id, 'import pytest|def test_a():|    assert f(1) == 2' AS code UNION ALL SELECT 2, 'x = 1' UNION ALL SELECT 3, 'def test_b():|    assert 1' UNION ALL SELECT 4, ''")
def _(spark, sf):
    made = [
        "Here it is:\n```python\nimport pytest\r\nfrom your_module import f\r\nprint('x')\r\ndef test_a():\r\n    assert f(1) == 2\r\n\r\nif __name__ == '__main__':\r\n    pytest.main()\r\n```\n",
        "xĠ=Ġ1Ċ",
        "def test_b():\n    assert 1\ndef broken(",
        None,
    ]
    c = spark.createDataFrame(list(enumerate(made, 1)), "id int, text string")
    return c.select("id", F.translate(K.udfs()["normalise_generated"]("text"), "\n", "|").alias("code"))


@query("udf_16_check_harness", "SELECT 1 AS id, true AS harness UNION ALL SELECT 2, false")
def _(spark, sf):
    c = spark.createDataFrame([(1, "def check(candidate):\n    assert candidate(1) == 1\n"), (2, "def test_a():\n    pass\n")], "id int, code string")
    return c.select("id", K.udfs()["is_check_harness"]("code").alias("harness"))


@query("udf_17_pruned_asserts", "SELECT 1 AS id, 'pass|assert 2' AS code UNION ALL SELECT 2, 'assert 1|assert 2'")
def _(spark, sf):
    c = spark.createDataFrame([(1, "assert 1\nassert 2", "t.py:1: AssertionError"), (2, "assert 1\nassert 2", "2 passed")], "id int, code string, log string")
    return c.select("id", F.regexp_replace(K.udfs()["prune"]("code", "log"), "\n", "|").alias("code"))


# --- generation and datasets -------------------------------------------------------------------------------------------


@query(
    "gen_04_candidate_records",
    """SELECT 'r1' AS run_id, CAST(o_orderkey AS VARCHAR) || '__greedy__7b__c' || lpad(CAST(o_custkey % 12 AS VARCHAR), 2, '0') AS candidate_id, o_orderstatus || '__' || o_orderpriority AS source_task_group, length(c) AS candidate_char_len, CASE WHEN c = '' THEN 0 ELSE 2 END AS candidate_nonempty_line_count
    FROM (SELECT *, CASE WHEN o_custkey % 5 > 0 THEN 'assert f(' || o_custkey || ')' || chr(10) || chr(10) || 'x' ELSE '' END AS c FROM orders)""",
)
def _(spark, sf):
    k = F.col("o_custkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"), F.lit("greedy").alias("preset"), F.lit("7b").alias("generator_tag"), (k % 12).alias("candidate_index"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("difficulty_bucket"), F.when(k % 5 > 0, F.concat(F.lit("assert f("), k, F.lit(")\n\nx"))).alias("candidate_test_code"))
    return D.candidate_records(o, "r1", "v1").select("run_id", "candidate_id", "source_task_group", "candidate_char_len", "candidate_nonempty_line_count")


@query("gen_05_merged_runs", "SELECT 'a__' || s_name AS candidate_id, s_name AS parent_candidate_id, s_acctbal FROM supplier UNION ALL SELECT 'b__' || s_name, s_name, NULL FROM supplier")
def _(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_name", "candidate_id")
    return D.merge_runs(s.select("candidate_id", "s_acctbal"), s.select("candidate_id")).select("candidate_id", "parent_candidate_id", "s_acctbal")


_DIAGNOSTIC = """c AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 6 > 0 THEN c_name ELSE ' ' END AS code, c_mktsegment AS source FROM customer WHERE c_custkey % 7 > 0),
    s AS (SELECT o_orderkey AS task_id, 'c' || o_custkey AS pos, 'c' || (o_custkey + 1) AS neg, row_number() OVER (ORDER BY o_orderkey, 'c' || o_custkey) AS rn FROM orders WHERE o_orderstatus = 'P'), o AS (SELECT o_orderkey AS task_id, 'c' || o_custkey AS pos, 'c' || (o_custkey + 1) AS neg, row_number() OVER (ORDER BY o_orderkey, 'c' || o_custkey) AS rn FROM orders WHERE o_orderstatus <> 'P'),
    n AS (SELECT least((SELECT count(*) FROM s), (SELECT count(*) FROM o)) AS n), u AS (SELECT 'strong' AS grp, s.* FROM s, n WHERE rn <= n UNION ALL SELECT 'ordinary', o.* FROM o, n WHERE rn <= n)"""


@query("ds_02_diagnostic_sets", f"WITH {_DIAGNOSTIC} SELECT grp, task_id, a.code AS chosen, b.code AS rejected, a.source FROM u JOIN c a ON pos = a.id JOIN c b ON neg = b.id WHERE trim(a.code) <> '' AND trim(b.code) <> ''")
def _(spark, sf):
    k = F.col("c_custkey")
    cands = table(spark, sf, "customer").filter(k % 7 > 0).select(F.concat(F.lit("c"), k).alias("candidate_id"), F.when(k % 6 > 0, F.col("c_name")).otherwise(" ").alias("candidate_test_code"), F.lit(0).alias("task_id"), F.col("c_mktsegment").alias("source"), F.lit("easy").alias("difficulty_bucket"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("c"), "o_custkey").alias("candidate_id_pos"), F.concat(F.lit("c"), F.col("o_custkey") + 1).alias("candidate_id_neg"), "o_orderstatus")
    out = D.diagnostic_sets(o.filter("o_orderstatus = 'P'"), o.filter("o_orderstatus <> 'P'"), cands, ("strong", "ordinary"), F.lit("p"))
    return out.select(F.col("group").alias("grp"), "task_id", "chosen", "rejected", "source")


@query(
    "ds_03_factorial_cells",
    f"""WITH o AS (SELECT *, {_CELL} AS cell FROM orders WHERE o_custkey % 6 <> 0), n AS (SELECT o_orderstatus, cell, count(*) AS n FROM o GROUP BY ALL), q AS (SELECT o_orderstatus, CASE WHEN count(*) = 4 THEN min(n) ELSE 0 END AS quota FROM n GROUP BY 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, cell ORDER BY CASE WHEN cell IN ('HL', 'HH') THEN -o_totalprice ELSE o_totalprice END, o_orderkey) AS rn FROM o)
    SELECT o_orderkey AS task_id, cell AS grp, CASE WHEN cell IN ('LH', 'HH') THEN 'strong' ELSE 'ordinary' END AS neg_kind FROM r JOIN q USING (o_orderstatus) WHERE rn <= quota""",
)
def _(spark, sf):
    k = F.col("o_custkey")
    o = _cells(spark, sf).select(F.col("o_orderkey").alias("task_id"), F.concat(F.lit("c"), k).alias("candidate_id_pos"), F.concat(F.lit("r"), k).alias("candidate_id_neg"), F.lit("good").alias("candidate_test_code_pos"), F.when(k % 6 != 0, "bad").alias("candidate_test_code_neg"), F.col("o_orderstatus").alias("source"), F.lit("easy").alias("difficulty_bucket"), "cell", "o_totalprice")
    rows = D.factorial_rows({c: o.filter(F.col("cell") == c) for c in ("LL", "HL", "LH", "HH")}, F.lit("p"))
    scored = rows.join(o.select("task_id", "o_totalprice"), "task_id")
    return D.balanced_cells(scored, ["source"], "o_totalprice", "task_id", "group").select("task_id", F.col("group").alias("grp"), "neg_kind")


# --- the application's data --------------------------------------------------------------------------------------------


@query("app_02_recent", f"WITH {_EVAL} SELECT id, target, score, status FROM st ORDER BY id DESC LIMIT 6")
def _(spark, sf):
    return RP.recent(_evaluations(spark, sf)).select("id", "target", "score", "status")


@query("app_05_report_of_ids", f"WITH {_EVAL} SELECT target, count(*) AS n, round(avg(score), 6) AS mean_score FROM st WHERE id IN (1, 2, 3, 5, 8, 13) GROUP BY 1")
def _(spark, sf):
    chosen = _evaluations(spark, sf).filter(PL.in_ids("1, 2,3,5,8,13,-4,x,1"))
    return RP.targets(chosen, top=None).select("target", "n", F.round("mean_score", 6).alias("mean_score"))


@query("app_06_assets", "SELECT 0 AS step, 'lines' AS pool, count(*) AS n FROM lineitem UNION ALL SELECT 1, 'orders', count(*) FROM orders UNION ALL SELECT 2, 'first customers', 12")
def _(spark, sf):
    first = table(spark, sf, "customer").orderBy("c_custkey").limit(12)
    return RP.funnel({"lines": table(spark, sf, "lineitem"), "orders": table(spark, sf, "orders"), "first customers": first})


@query(
    "app_08_job_status",
    """SELECT * FROM (VALUES (1, 'running', 'prepare', 4, 32), (2, 'running', 'generate', 20, 30), (3, 'running', 'evidence', 82, 5), (4, 'running', 'unknown', 1, 33), (5, 'completed', 'done', 100, 0), (6, 'failed', 'failed', 100, 0)) t(id, status, stage, progress, eta)
    WHERE stage <> 'unknown' UNION ALL SELECT 4, 'running', 'prepare', 1, 33""",
)
def _(spark, sf):
    jobs = [(1, "running", "prepare", 1.0), (2, "running", "generate", 1.0), (3, "running", "evidence", 40.0), (4, "running", "unknown", 0.0), (5, "completed", "report", 1.0), (6, "failed", "execute", 1.0)]
    return RP.job_status(spark.createDataFrame(jobs, "id int, status string, stage string, stage_elapsed double"))


@query("app_09_appended", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + n_nationkey + 1, n_name FROM nation")
def _(spark, sf):
    old = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("seq"), F.col("n_name").alias("status"))
    return RP.append_evaluations(old, new)


@query("app_10_deleted", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (1, 2, 3)")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return PL.delete(o, PL.in_ids("1,2,3")).select(F.col("id").alias("o_orderkey"))


@query("app_11_scan", "SELECT 'a.py' AS name, 'f' AS function, 'function' AS kind UNION ALL SELECT 'a.py', 'A.m', 'method:instance' UNION ALL SELECT 'b.py', '_g', 'internal'")
def _(spark, sf):
    files = spark.createDataFrame([("a.py", "def f(): pass\nclass A:\n    def m(self): pass\n    def __init__(self): pass\n"), ("b.py", "def _g(): pass\n"), ("broken.py", "def (")], "name string, text string")
    return files.select("name", F.explode(K.udfs()["discover"]("text")).alias("d")).select("name", F.col("d.name").alias("function"), "d.kind")


@query("app_04_record_lines", "SELECT 1 AS id, CAST(i AS INT) AS line_no, substr('target 1-URGENT score 83 status review ' || repeat('x', 40), CAST(i * 58 + 1 AS BIGINT), 58) AS line FROM range(2) t(i)")
def _(spark, sf):
    r = spark.createDataFrame([(1, "1-URGENT", 83, "review")], "id int, target string, score int, status string")
    text = F.concat(F.format_string("target %s score %d status %s ", "target", "score", "status"), F.repeat(F.lit("x"), F.lit(40)))
    return RP.paged(r.withColumn("text", text), "id", "text").select("id", "line_no", "line")


@query("app_15_client_gate", f"""WITH {_EVAL}, g AS (SELECT avg(score) AS score, avg(line) * 100 AS line, avg(branch) * 100 AS branch, coalesce(avg(mutation) FILTER (mutationvalid = 1), 0) * 100 AS mutation, bool_or(status = 'drop') AS d, bool_or(status = 'review') AS r FROM st WHERE score > 60)
    SELECT round(score, 4) AS score, round(line, 4) AS line, CASE WHEN d THEN 'reject' WHEN score >= 75 AND line >= 80 AND branch >= 70 AND mutation >= 60 AND NOT r THEN 'pass' ELSE 'review' END AS verdict FROM g""")
def _(spark, sf):
    return RP.gate(_evaluations(spark, sf).filter("score > 60")).select(F.round("score", 4).alias("score"), F.round("line", 4).alias("line"), "verdict")
