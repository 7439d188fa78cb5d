"""Counts, summaries, roll-ups and verdicts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import scalars as S
from sparkassay.functions.statistics import mean_ci


def value_counts(df: DataFrame, c: str, na: str = "NA") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit(na)).alias(c)).agg(F.count("*").alias("n"))


def count_by(df: DataFrame, by: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def rates(df: DataFrame, by: list[str], flags: Iterable[str], metrics: Iterable[str]) -> DataFrame:
    """Rows of each group, the rate of each 0/1 flag, and each metric's mean over the rows that have it."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"{c}_rate") for c in flags], *[F.avg(c).alias(f"{c}_mean") for c in metrics])


def multi_level_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts at every combination of levels in one pass; ``level`` is the grouping id (bits of rolled-up columns)."""
    return df.cube(*dims).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def plain_mean(v: str) -> Column:
    return F.avg(v)


def valid_mean(v: str, passed: str) -> Column:
    """Over the rows that passed."""
    return F.avg(F.when(F.col(passed) == 1, F.col(v)))


def adjusted_mean(v: str, passed: str) -> Column:
    """Over all attempts: failed or missing ones count as 0."""
    return F.avg(F.coalesce(F.col(passed), F.lit(0)) * F.coalesce(F.col(v), F.lit(0.0)))


def run_summary(df: DataFrame, by: list[str], passed: str, metrics: Iterable[str], conditional: Iterable[str] = ()) -> DataFrame:
    """A row for each run: candidates, pass rate, and each metric's three means. ``conditional`` metrics keep only their plain mean."""
    aggs = [F.count("*").alias("n_candidates"), F.avg(F.coalesce(F.col(passed), F.lit(0))).alias("pass_rate")]
    for m in metrics:
        aggs += [plain_mean(m).alias(f"{m}_mean"), valid_mean(m, passed).alias(f"{m}_valid_mean"), adjusted_mean(m, passed).alias(f"{m}_adjusted_mean")]
    return df.groupBy(*by).agg(*aggs, *[plain_mean(m).alias(f"{m}_mean") for m in conditional])


def group_ci(runs: DataFrame, by: list[str], metric: str, policy: str = "mean") -> DataFrame:
    """Mean over runs (not weighted by their size) with deviation and interval."""
    return runs.groupBy(*by).agg(*[c.alias(k) for k, c in mean_ci(metric, policy).items()])


def metric_summary(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Long form: for each metric and group, and for ALL, count, missing rate, mean, median, deviation and extremes."""
    long = df.unpivot([group], metrics, "metric", "value")
    g = long.groupingSets([["metric", group], ["metric"]], "metric", group)
    return g.agg(
        F.grouping(group).alias("_all"),
        F.count("*").alias("n"),
        F.count("value").alias("n_present"),
        (1 - F.count("value") / F.count("*")).alias("missing_rate"),
        F.avg("value").alias("mean"),
        F.median("value").alias("median"),
        F.when(F.count("value") > 1, F.stddev_samp("value")).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ).select("metric", F.when(F.col("_all") == 1, "ALL").otherwise(F.col(group)).alias("group_name"), "n", "n_present", "missing_rate", "mean", "median", "std", "min", "max")


def flag_prevalence(df: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """Count and rate of each flag by group and for ALL, which also names the groups that have any (sorted) and their number."""
    long = df.unpivot([group], flags, "flag", "value")
    one = long.groupBy("flag", group).agg(F.count("value").alias("n_present"), F.coalesce(F.sum("value"), F.lit(0)).alias("n_flagged"))
    per = one.select("flag", F.col(group).alias("group_name"), "n_present", "n_flagged", F.lit(None).cast("long").alias("n_groups"), F.lit(None).cast("string").alias("groups"))
    named = F.filter(F.array_sort(F.collect_list(F.when(F.col("n_flagged") > 0, F.col(group)))), lambda x: x.isNotNull())
    whole = one.groupBy("flag").agg(F.sum("n_present").alias("n_present"), F.sum("n_flagged").alias("n_flagged"), F.size(named).cast("long").alias("n_groups"), F.array_join(named, "|").alias("groups"))
    rows = per.unionByName(whole.select("flag", F.lit("ALL").alias("group_name"), "n_present", "n_flagged", "n_groups", "groups"))
    return rows.withColumn("rate", F.col("n_flagged") / F.nullif("n_present", F.lit(0)))


def tier_summary(df: DataFrame, tier: str, metrics: Iterable[str]) -> DataFrame:
    return df.groupBy(tier).agg(F.count("*").alias("n"), *[a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.median(m).alias(f"{m}_median"))])


def pair_summary(pairs: DataFrame, by: list[str], flags: Iterable[str]) -> DataFrame:
    """Pairs before and after the filter, the kept share, and the rate of each flag."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n_before"), F.sum("surface_filter_keep").cast("long").alias("n_after"), F.avg("surface_filter_keep").alias("keep_rate"), *[F.avg(f).alias(f"{f}_rate") for f in flags])


def cell_pivot(df: DataFrame, by: list[str], cell: str = "cell", cells: tuple[str, ...] = ("LL", "HL", "LH", "HH")) -> DataFrame:
    """Counts of each cell as columns, and their least as ``quota``."""
    wide = df.groupBy(*by).pivot(cell, list(cells)).agg(F.count(F.lit(1))).na.fill(0, list(cells))
    return wide.withColumn("quota", F.least(*cells))


def sampling_summary(df: DataFrame, by: list[str], task: str, score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(task).alias("n_tasks"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"))


def dashboard(df: DataFrame) -> DataFrame:
    """Averages over all evaluations (missing counts as 0), passes, and the mutation mean over its valid rows only."""
    zero = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum("passed"), F.lit(0)).cast("long").alias("n_passed"), zero("score").alias("score"), zero("line").alias("line"), zero("branch").alias("branch"), F.coalesce(F.avg(F.when(F.col("mutationvalid") == 1, F.col("mutation"))), F.lit(0.0)).alias("mutation"))


def status_counts(df: DataFrame, order: tuple[str, ...] = ("adopt", "review", "drop")) -> DataFrame:
    """Statuses that occur, with their place in the fixed order."""
    return df.groupBy("status").agg(F.count("*").alias("n")).withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("status")).cast("int"))


def targets(df: DataFrame, by_score: bool = False, top: int | None = 8) -> DataFrame:
    """Evaluations of each target; the server ranks by (count, score), the client by (score, count)."""
    out = df.groupBy("target").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("line").alias("mean_line"), F.avg("branch").alias("mean_branch"), F.avg(F.when(F.col("mutationvalid") == 1, F.col("mutation"))).alias("mean_mutation"))
    key = [F.desc(F.round("mean_score", 6)), F.desc("n")] if by_score else [F.desc("n"), F.desc(F.round("mean_score", 6))]
    return out.orderBy(*key, "target").limit(top) if top else out


def gate(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Verdict by averages against 75 / 80 / 70 / 60 per cent and by statuses."""
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(
        F.avg("score").alias("score"),
        (F.avg("line") * 100).alias("line"),
        (F.avg("branch") * 100).alias("branch"),
        (F.coalesce(F.avg(F.when(F.col("mutationvalid") == 1, F.col("mutation"))), F.lit(0.0)) * 100).alias("mutation"),
        F.bool_or(F.col("status") == "drop").alias("any_drop"),
        F.bool_or(F.col("status") == "review").alias("any_review"),
    )
    meets = (F.col("score") >= 75) & (F.col("line") >= 80) & (F.col("branch") >= 70) & (F.col("mutation") >= 60)
    return out.withColumn("verdict", F.when(F.col("any_drop").isNull(), "empty").when(F.col("any_drop"), "reject").when(meets & ~F.col("any_review"), "pass").otherwise("review"))


def with_status(df: DataFrame) -> DataFrame:
    """Status derived from the numbers; what was stored is not trusted."""
    c = F.col
    return df.withColumn("status", S.status(c("score"), c("failures"), c("mutationvalid"), c("mutation"), c("line")))


def history(df: DataFrame, project: str, user: str, n: int = 200) -> DataFrame:
    """A user's latest evaluations in a project."""
    return with_status(df.filter((F.col("project") == project) & (F.col("user") == user))).orderBy(F.desc("id")).limit(n)


def record(df: DataFrame, id: int, index: int = 0) -> DataFrame:
    """One evaluation with one candidate of its JSON result; the index is clamped to what is there."""
    tests = F.from_json(F.get_json_object("result", "$.candidates"), "array<string>")
    place = F.least(F.greatest(F.lit(index), F.lit(0)), F.size(tests) - 1) + 1
    return df.filter(F.col("id") == id).withColumn("candidate", F.when(F.size(tests) > 0, F.element_at(tests, place)))


def funnel(counts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each pool, in order."""
    out = None
    for i, (name, df) in enumerate(counts.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("pool"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def users_upsert(users: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same name but keep the first ``created``."""
    u, n = users.alias("u"), new.alias("n")
    pick = [F.coalesce(F.col(f"n.{c}"), F.col(f"u.{c}")).alias(c) if c != "created" else F.coalesce("u.created", "n.created").alias(c) for c in users.columns if c != "name"]
    return u.join(n, F.col("u.name") == F.col("n.name"), "full_outer").select(F.coalesce("n.name", "u.name").alias("name"), *pick)


def backfill(df: DataFrame) -> DataFrame:
    """Adds ``mutationvalid`` to old tables from the metrics in their JSON result; 1 where they don't say."""
    if "mutationvalid" in df.columns:
        return df
    said = F.get_json_object("result", "$.metrics.mutationvalid")
    return df.withColumn("mutationvalid", F.when(said.isin("false", "0"), 0).otherwise(1))


def report_lines(df: DataFrame, width: int = 58) -> DataFrame:
    """A project report as wrapped text lines with their position, a target after the other."""
    text = F.concat_ws(" ", F.col("target"), F.format_string("n=%d score=%.2f", "n", "mean_score"))
    return targets(df, top=None).select("target", F.posexplode(S.wrap(text, width)).alias("line_no", "line"))


def distribution(df: DataFrame, kind: str, dims: tuple[str, ...], task: str, na: str = "NA") -> DataFrame:
    """``kind, field, value, n``: rows, distinct tasks, and counts by each dimension (missing as ``na``), from one pass of grouping sets."""
    filled = df.select(F.col(task).alias("_task"), *[F.coalesce(F.col(c).cast("string"), F.lit(na)).alias(c) for c in dims])
    counts = filled.groupingSets([[c] for c in dims], *dims).agg(*[F.grouping(c).alias(f"_{c}") for c in dims], F.count("*").alias("n"))
    pick = lambda f: F.coalesce(*[F.when(F.col(f"_{c}") == 0, f(c)) for c in dims])
    by = counts.select(pick(F.lit).alias("field"), pick(F.col).alias("value"), "n")
    whole = filled.agg(F.count("*").alias("rows"), F.count_distinct("_task").alias("unique_tasks")).unpivot([], ["rows", "unique_tasks"], "field", "n").select("field", F.lit(None).cast("string").alias("value"), "n")
    return whole.unionByName(by).select(F.lit(kind).alias("kind"), "field", "value", "n")


def status_counters(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``stage, status, n``: the counters of a manifest, for each stage its table and status column; a missing status is ``None``."""
    out = None
    for stage, (df, c) in tables.items():
        one = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("status")).agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "status", "n")
        out = one if out is None else out.unionByName(one)
    return out


#: Stages of an evaluation with where they begin and end on the progress bar and how long they take: fixed values.
STAGES = (("prepare", 1, 8, 2.0), ("generate", 8, 43, 3.0), ("execute", 43, 60, 5.0), ("evidence", 60, 84, 18.0), ("diagnose", 84, 94, 3.0), ("report", 94, 99, 2.0))


def job_status(jobs: DataFrame, stages: tuple[tuple[str, int, int, float], ...] = STAGES) -> DataFrame:
    """``id, status, stage, progress, eta`` of jobs (``id, status, stage, stage_elapsed``): progress within the stage up to 92 %, and the rest of it plus the later ones.

    An unknown stage counts as the first; a completed or failed job is at 100 with nothing left.
    """
    cases = {"start": lambda k: stages[k][1], "end": lambda k: stages[k][2], "seconds": lambda k: stages[k][3], "later": lambda k: sum(x[3] for x in stages[k + 1 :]), "name": lambda k: stages[k][0]}

    def of(what: str) -> Column:
        case = F
        for k, x in enumerate(stages):
            case = case.when(F.col("stage") == x[0], F.lit(cases[what](k)))
        return case.otherwise(F.lit(cases[what](0)))

    over = F.col("status").isin("completed", "failed")
    spent = F.greatest(F.col("stage_elapsed"), F.lit(0.0))
    share = F.least(F.lit(0.92), spent / F.greatest(of("seconds"), F.lit(1.0)))
    eta = F.greatest(of("seconds") - spent, F.lit(0.0)) + of("later")
    return jobs.select(
        "id",
        "status",
        F.when(F.col("status") == "completed", "done").when(F.col("status") == "failed", "failed").otherwise(of("name")).alias("stage"),
        F.when(over, 100).otherwise(F.bround(of("start") + (of("end") - of("start")) * share)).cast("int").alias("progress"),
        F.when(over, 0).otherwise(F.bround(eta)).cast("int").alias("eta"),
    )


def append_evaluations(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store with new evaluations (a batch's rows, numbered by ``seq`` from 1) under the ids that follow its largest."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    numbered = new.crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("seq")).drop("_top", "seq")
    return old.unionByName(numbered, allowMissingColumns=True)


def recent(df: DataFrame, n: int = 6) -> DataFrame:
    """The latest evaluations."""
    return df.orderBy(F.desc("id")).limit(n)


def paged(df: DataFrame, key: str, text: str, width: int = 58, lines: int = 52) -> DataFrame:
    """``key, page, line_no, line``: a text's wrapped lines on pages of ``lines``."""
    cut = df.select(key, F.posexplode(S.wrap(text, width)).alias("_n", "line"))
    return cut.select(key, F.floor(F.col("_n") / lines).cast("int").alias("page"), F.pmod("_n", F.lit(lines)).cast("int").alias("line_no"), "line")
