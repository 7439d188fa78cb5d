"""Hand-made frames for the traps: nulls, ties, single rows, thresholds and empty inputs."""

import math

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import scalars as S
from sparkassay.functions import statistics as ST
from sparkassay.operators import checks as C
from sparkassay.operators import datasets as D
from sparkassay.operators import pools as PL
from sparkassay.operators import ranking as R
from sparkassay.operators import reports as RP
from sparkassay.operators import shape as P
from sparkassay.operators import taxonomy as TX


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_zscore_of_constant_single_and_null(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, None), (3, 5.0, 2.0)], "id int, a double, b double")
    out = {r.id: r.s for r in ST.weighted_z(df, {"a": 1.0}, "s").collect()}
    assert out == {1: 0.0, 2: 0.0, 3: 0.0}
    one = ST.weighted_z(df.limit(1), {"b": 1.0}, "s").first().s
    assert one == 0.0
    assert ST.weighted_z(df, {"b": 1.0}, "s").filter("id = 2").first().s == pytest.approx(-1.0)


def test_fitted_score_uses_population_deviation_and_training_median(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 3.0, True), (3, None, False), (4, 9.0, False)], "id int, x double, train boolean")
    out = {r.id: (r.v, r.imputed_x) for r in ST.fitted_score(df, F.col("train"), {"x": 1.0}, "v").collect()}
    assert out == {1: (-1.0, False), 2: (1.0, False), 3: (0.0, True), 4: (7.0, False)}


def test_first_writer_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    a = spark.createDataFrame([(1, "late", 7)], "k int, x string, y int")
    b = spark.createDataFrame([(1, 8), (2, 9)], "k int, y int")
    assert rows(P.wide_left_join(base, [a, b], "k"), "k", "x", "y") == [(1, "a", 7), (2, "b", None)]


def test_flags_and_numbers(spark):
    df = spark.createDataFrame([("True",), ("False",), ("1.0",), ("0",), ("x",), (None,), ("nan",)], "v string")
    assert [r[0] for r in df.select(P.flag("v")).collect()] == [1, 0, 1, 0, 0, 0, 1] or [r[0] for r in df.select(P.flag("v")).collect()][:6] == [1, 0, 1, 0, 0, 0]
    assert [r[0] for r in df.select(P.number("v")).collect()] == [None, None, 1.0, 0.0, None, None, None]


def test_duplicate_flag_columns(spark):
    df = spark.createDataFrame([(0, 1), (None, 0), (1, None)], "f int, g int").withColumnRenamed("g", "f.1")
    assert [r[0] for r in P.coalesce_duplicates(df, "f").select("f").collect()] == [1, 0, 1]


def test_two_tier_fill(spark):
    data = [("s", 1, 0, 1.0), ("s", 2, 0, 2.0), ("s", 1, 1, 99.0), ("s", 3, 1, 5.0), ("t", 4, 1, 1.0)]
    df = spark.createDataFrame(data, "b string, id int, tier int, score double")
    out = R.two_tier_fill(df, ["b"], "tier", "id", R.last(("score", "desc"), "id"), 3)
    assert rows(out, "b", "id", "tier", "rn") == [("s", 1, 0, 2), ("s", 2, 0, 1), ("s", 3, 1, 3), ("t", 4, 1, 1)]


@pytest.mark.parametrize("spread", [True, False])
@pytest.mark.parametrize("n, strong", [(1, 0), (2, 1), (3, 2), (4, 2)])
def test_halves(spark, n, strong, spread):
    out = R.halves(spark.range(n).withColumn("k", F.lit(1)), ["k"], ["id"], spread=spread)
    assert out.filter("tier = 'strong'").count() == strong
    assert out.filter("tier = 'singleton'").count() == (n == 1)


@pytest.mark.parametrize("n", [0, 1, 3, 9, 90])
def test_split_covers_and_is_disjoint(spark, n):
    df = spark.range(n).withColumn("s", F.lit("x"))
    out = R.split(df, ["s"], "id", 42, {"a": 0.7, "b": 0.2, "c": 0.1})
    count = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert out.select("id").distinct().count() == n
    assert count.get("a", 0) == int(n * 0.7) and count.get("b", 0) == int(n * 0.2)
    assert all(r.n == 0 for r in C.split_faults(df, out, "id").collect())


def test_largest_remainder_sums_to_the_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    out = {r.k: r.quota for r in R.largest_remainder(df, "k", "n", 10).collect()}
    assert out == {"a": 3, "b": 3, "c": 4}
    assert R.largest_remainder(df.limit(0), "k", "n", 10).count() == 0


def test_top_k_is_pruned_before_the_shuffle(spark):
    plan = R.top_k(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], R.last("id"), 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_surface_flags_with_missing_rows_and_limits(spark):
    cols = "id int, execution_pass_pos int, execution_pass_neg int, syntax_pass_pos int, syntax_pass_neg int, token_length_pos double, token_length_neg double, num_asserts_pos double, num_asserts_neg double, num_test_functions_pos double, num_test_functions_neg double, comment_ratio_pos double, comment_ratio_neg double, assert_density_pos double, assert_density_neg double, surface_structural_complexity_pos double, surface_structural_complexity_neg double"
    ok = (1, 1, 1, 1, 100.0, 100.0, 1.0, 5.0, 1.0, 1.0, 0.0, 0.25, 0.0, 0.0, 0.0, 0.0)
    data = [(1, *ok), (2, 1, None, *ok[2:]), (3, *ok[:4], 0.0, 500.0, *ok[6:]), (4, *ok[:4], 100.0, 181.0, *ok[6:]), (5, *ok[:4], 90.0, 181.0, *ok[6:]), (6, *ok[:7], 6.0, *ok[8:])]
    out = {r.id: (r.hard_fail_count, r.surface_filter_keep) for r in PL.surface_flags(spark.createDataFrame(data, cols)).collect()}
    assert out == {1: (0, 1), 2: (1, 0), 3: (0, 1), 4: (0, 1), 5: (1, 0), 6: (1, 0)}


def test_primary_failure_ties_fall_to_the_rule(spark):
    log = "candidate_id int, stage string, failure_category string, failure_subtype string, severity string, rule_strength string, rule_id string"
    data = [(1, "coverage", "boundary_case_gap", "s", "major", "strong", "a"), (1, "coverage", "boundary_case_gap", "s", "major", "strong", "b"), (2, "mutation", "mutation_unavailable", "s", "minor", "weak", "m"), (2, "syntax", "syntax_error", "s", "critical", "strong", "x")]
    out = {r.candidate_id: r.primary_rule_id for r in TX.primary(spark.createDataFrame(data, log)).collect()}
    assert out == {1: "b", 2: "x"}


def test_stage_rules(spark):
    table = lambda rows, names: spark.createDataFrame(rows, names)
    execution = table([(1, "failed", "TypeError", "tb"), (2, "passed", None, None), (3, None, None, None), (4, "infra_error", " ", ""), (5, "failed", "OSError", "x" * 2000)], "candidate_id int, execution_status string, exception_type string, traceback_snippet string")
    static = table([(2, 0, 0, False, 0), (1, 1, 0, True, 1), (9, 0, 0, False, 0)], "candidate_id int, num_asserts int, num_try_except int, has_pytest_raises boolean, num_pytest_raises int")
    coverage = table([(2, "ok", 0.5, 0.8), (1, "tool_error", None, None)], "candidate_id int, coverage_status string, line_coverage double, branch_coverage double")
    mutation = table([(2, "ok", 3, None), (7, "tool_error", None, "no tool"), (1, "skipped", 5, None)], "candidate_id int, mutation_status string, mutants_survived int, mutation_error_msg string")
    candidates = table([(2, 1, "raises an error"), (1, 0, "adds")], "candidate_id int, redefines_target_flag int, prompt string")
    logs = TX.explode_rules(TX.join_stages(execution, static, coverage, mutation, candidates), TX.stage_rules(), ["candidate_id"])
    out = {(r.candidate_id, r.rule_id): r for r in logs.collect()}
    assert sorted(out) == [(1, "coverage.tool_error"), (1, "exec.failed"), (2, "coverage.low_line_coverage"), (2, "exec.invalid_candidate_redefines_target"), (2, "mutation.survival_major"), (2, "static.exception_path_gap"), (2, "static.no_assertions"), (4, "exec.infra_error"), (5, "exec.failed"), (7, "mutation.tool_error")]
    r = out[1, "exec.failed"]
    assert (r.failure_category, r.failure_subtype, r.severity, r.rule_strength, r.needs_manual_review, r.evidence) == ("execution_call_contract_error", "TypeError", "major", "moderate", True, "tb")
    assert (out[4, "exec.infra_error"].failure_subtype, out[4, "exec.infra_error"].evidence) == ("infra_error", None)
    assert (out[5, "exec.failed"].failure_category, len(out[5, "exec.failed"].evidence)) == ("test_runtime_failure", 1200)
    assert (out[7, "mutation.tool_error"].failure_subtype, out[7, "mutation.tool_error"].rule_strength, out[7, "mutation.tool_error"].severity) == ("no tool", "strong", "moderate")
    assert out[2, "coverage.low_line_coverage"].evidence == '{"line_coverage":0.5,"threshold":0.8}'


@pytest.mark.parametrize("policy, expected", [("null", (1, 2.0, None, None)), ("mean", (1, 2.0, None, 2.0)), ("zero", (1, 2.0, 0.0, 2.0))])
def test_interval_of_one_value(spark, policy, expected):
    df = spark.createDataFrame([("g", 2.0), ("g", None)], "g string, v double")
    r = RP.group_ci(df, ["g"], "v", policy).first()
    assert (r.n, r["mean"], r["std"], r.ci_low) == expected


def test_three_means(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 0, 1.0), (1, 1, None)], "run int, ok int, m double")
    r = RP.run_summary(df, ["run"], "ok", ["m"]).first()
    assert (r.m_mean, r.m_valid_mean, r.m_adjusted_mean) == (0.75, 0.5, pytest.approx(0.5 / 3))


def test_spearman(spark):
    df = spark.createDataFrame([("p", float(i), float(-i)) for i in range(5)] + [("c", 1.0, float(i)) for i in range(5)] + [("two", 1.0, 2.0), ("two", 2.0, 3.0)], "g string, x double, y double")
    out = {r.g: (r.n, r.rho, r.p) for r in ST.spearman(df, ["g"], "x", "y").collect()}
    assert out["p"][1] == pytest.approx(-1) and out["p"][2] == 0.0
    assert out["c"][1:] == (None, None) and out["two"][1:] == (None, None)


def test_tails():
    assert ST.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert ST.f_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert ST.beta_inc(2, 3, 0) == 0 and ST.beta_inc(2, 3, 1) == 1


def test_factorial_tests_match_the_closed_form(spark):
    data = [(c, m + d) for c, m in (("LL", 1.0), ("HL", 2.0), ("LH", 4.0), ("HH", 8.0)) for d in (-0.5, 0.5)]
    coefficients, anova = ST.factorial_tests(spark.createDataFrame(data, "cell string, y double"), "cell", "y")
    assert {c["term"]: round(c["coef"], 9) for c in coefficients} == {"intercept": 1.0, "p": 1.0, "n": 3.0, "p:n": 3.0}
    ss = {a["term"]: a["sum_sq"] for a in anova}
    assert ss["p:n"] == pytest.approx(8 * (3 / 4) ** 2) and ss["p"] == pytest.approx(8 * (2.5 / 2) ** 2) and ss["residual"] == pytest.approx(2.0)


@pytest.mark.parametrize("score, failures, mutation, line, status", [(44, 1, 0, 0, "drop"), (45, 3, 0, 0, "review"), (99, 4, 1, 1, "drop"), (75, 0, 0.6, 0.8, "adopt"), (74, 0, 0.9, 0.9, "review"), (55, 0, 0, 0, "review"), (54, 0, 1, 1, "drop")])
def test_status(spark, score, failures, mutation, line, status):
    got = spark.range(1).select(S.status(*[F.lit(x) for x in (score, failures, 1, float(mutation), float(line))])).first()[0]
    assert got == status


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.loc(F.lit("a\n\n# b\n  c"))) == 2 and one(S.loc(F.lit("  "))) is None
    assert one(S.word_count(F.lit(" a \n b\t c "))) == 3 and one(S.word_count(F.lit("  "))) == 0
    assert one(S.exception_type(F.lit("x\nTypeError: a\nValueError: b"))) == "ValueError"
    assert one(S.exception_type(F.lit("oh KeyError happened"))) == "KeyError" and one(S.exception_type(F.lit("fine"))) is None
    assert one(S.applicability(F.lit("N/A"))) == 0 and one(S.applicability(F.lit("1.0"))) == 1 and one(S.applicability(F.lit("?"))) is None
    assert one(S.clean_path(F.lit("C:\\a\\..\\b.py"))) == "a/b.py" and one(S.clean_path(F.lit("../"))) is None
    assert one(S.wrap(F.lit("abcdef\n"), 4)) == ["abcd", "ef", ""]
    assert one(S.quality_score(F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(0), F.lit(0))) == 41
    assert one(S.ratio(F.lit(0.0), F.lit(3.0))) is None


def test_validation_reports_and_raises(spark):
    df = spark.createDataFrame([(1, "a"), (1, " "), (2, None)], "id int, v string")
    broken = C.broken_rules(df, "id", {"v": ("error", C.present("v"))})
    with pytest.raises(C.ValidationError) as e:
        C.report_then_raise(broken)
    assert e.value.report == [{"rule": "v", "level": "error", "n": 2}]
    with pytest.raises(C.ValidationError):
        C.require_unique(df, "id")
    with pytest.raises(C.ValidationError):
        C.require_columns(df, ["id", "w"])
    with pytest.raises(C.ValidationError):
        C.check_weights({"a": 0.5}, ["a"])


def test_users_upsert_keeps_the_first_created(spark):
    old = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "name string, role string, created string")
    new = spark.createDataFrame([("b", "z", "9"), ("c", "w", "9")], "name string, role string, created string")
    assert rows(RP.users_upsert(old, new), "name", "role", "created") == [("a", "x", "1"), ("b", "z", "2"), ("c", "w", "9")]


def test_datasets(spark):
    pairs = spark.createDataFrame([(1, "p1", "n1", "x", "y"), (1, "p1", "n2", "x", " "), (2, "p2", "n3", "u", "v")], "task_id int, candidate_id_pos string, candidate_id_neg string, candidate_test_code_pos string, candidate_test_code_neg string").withColumns({"source": F.lit("s"), "difficulty_bucket": F.lit("easy")})
    pref = D.preference_rows(pairs, "HH", F.lit("p"))
    assert rows(pref, "chosen_candidate_id", "rejected_candidate_id") == [("p1", "n1"), ("p2", "n3")]
    assert rows(D.label_shuffled(pref), "task_id", "chosen", "label_shuffled") == [(1, "x", False), (2, "v", True)]
    assert math.isclose(D.sft_rows(pref).count(), 2)


@pytest.mark.parametrize("order", [["v", "id"], [("v", "desc"), "id"], [("s", "desc"), "id"]])
def test_ranks_in_pieces_equal_plain_ranks(spark, order):
    import random

    rnd = random.Random(1)
    data = [(i, rnd.choice(["a", "b", None]), rnd.choice([None, 1.5, 1e9, -3.0, rnd.random()]), rnd.choice("xyz")) for i in range(300)] + [(900, "alone", None, None)]
    df = spark.createDataFrame(data, "id int, g string, v double, s string")
    for by in (["g"], []):
        plain, pieces = (rows(R.ranked_strata(df, by, order, spread), "id", "rn", "n") for spread in (False, True))
        assert plain == pieces
    assert R.ranked_strata(df.limit(0), ["g"], order).count() == 0


def test_shuffled_and_split_equal_one_window(spark):
    from pyspark.sql import Window

    df = spark.range(500).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    one = df.withColumn("pos", F.row_number().over(Window.orderBy(R.shuffle_key(7, "id"), "id")))
    assert rows(R.shuffled(df, "id", 7), "id", "pos") == rows(one, "id", "pos")
    parts = R.split(df, ["g"], "id", 7, {"a": 0.5, "b": 0.5}).groupBy("g", "split").count()
    assert sorted(r["count"] for r in parts.collect()) == [83, 83, 83, 83, 84, 84]


def test_matched_random_is_the_nearest(spark):
    import random

    rnd = random.Random(3)
    data = [(i, rnd.choice(["x", "y", "z", None]), rnd.choice([None, *range(6)])) for i in range(80)] + [(200, "lonely", 3)]
    df = spark.createDataFrame(data, "id int, g string, v int")
    got = {r.anchor_id: (r.match_id, r.gap, r.level) for r in R.matched_random(df, df, [["g"], []], "id", "v", 1, near=1).collect()}
    expected = {}
    for i, g, v in data:
        for level, same in enumerate((lambda h, g=g: g is not None and g == h, lambda h: True)):
            near = sorted((abs(w - v), j) for j, h, w in data if v is not None and w is not None and j != i and same(h))
            if near:
                expected[i] = (near[0][1], near[0][0], level)
                break
    assert got == expected


def test_shared_folder_is_needed_off_a_local_master(spark):
    from sparkassay.sources import files as FS

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        FS.shared_dir(Cluster())
    assert FS.shared_dir(spark)


def test_bootstrap_draws(spark):
    data = [(s, c, float(s + 10 * (c[0] == "H"))) for s in range(8) for c in ("LL", "HL", "LH", "HH")]
    df = spark.createDataFrame(data, "seed int, cell string, y double")
    out = {r.effect: (r.lo, r.hi) for r in ST.bootstrap_effects(df, "cell", "y", "seed", draws=500).collect()}
    assert out["pos_main"] == (10.0, 10.0) and out["neg_main"] == (0.0, 0.0)
    low = df.filter("cell = 'LL'")
    spread = low.withColumn("y", F.lit(0.0)).unionByName(low.withColumn("cell", F.lit("HH")))
    lo, hi = next((r.lo, r.hi) for r in ST.bootstrap_effects(spread, "cell", "y", "seed", draws=2000).collect() if r.effect == "hh_minus_ll")
    assert 1.5 < lo < 2.5 and 4.5 < hi < 5.5
