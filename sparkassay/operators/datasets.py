"""Preference, control and fixed-budget datasets, and the generation side's table work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import scalars as S
from sparkassay.operators import ranking as R
from sparkassay.operators import shape

PAIR_COLUMNS = ["group", "task_id", "prompt", "chosen", "rejected", "chosen_candidate_id", "rejected_candidate_id", "source", "difficulty_bucket"]


def preference_rows(pairs: DataFrame, group: str | Column, prompt: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """Chosen/rejected rows of pairs with ``candidate_test_code_pos/_neg``; rows with a blank side are left out."""
    out = pairs.select(
        (F.lit(group) if isinstance(group, str) else group).alias("group"),
        "task_id",
        prompt.alias("prompt"),
        shape.text("candidate_test_code_pos").alias("chosen"),
        shape.text("candidate_test_code_neg").alias("rejected"),
        F.col("candidate_id_pos").alias("chosen_candidate_id"),
        F.col("candidate_id_neg").alias("rejected_candidate_id"),
        "source",
        "difficulty_bucket",
        *extra,
    )
    return out.filter((F.trim("chosen") != "") & (F.trim("rejected") != ""))


def sft_rows(pairs: DataFrame) -> DataFrame:
    """The chosen side of preference rows, each candidate once."""
    one = R.first_per_key(pairs, ["chosen_candidate_id"], R.last("task_id", "rejected_candidate_id"))
    return one.select("prompt", F.col("chosen").alias("response"), F.concat("prompt", F.lit("\n"), "chosen").alias("text"), F.col("chosen_candidate_id").alias("candidate_id"), "task_id", "source", "difficulty_bucket")


def swap_labels(pairs: DataFrame, swapped: Column) -> DataFrame:
    """Chosen and rejected exchanged where the condition holds."""
    pick = lambda a, b: F.when(swapped, F.col(b)).otherwise(F.col(a))
    return pairs.select(*[c for c in pairs.columns if c not in ("chosen", "rejected", "chosen_candidate_id", "rejected_candidate_id")], pick("chosen", "rejected").alias("chosen"), pick("rejected", "chosen").alias("rejected"), pick("chosen_candidate_id", "rejected_candidate_id").alias("chosen_candidate_id"), pick("rejected_candidate_id", "chosen_candidate_id").alias("rejected_candidate_id"), swapped.alias("label_shuffled"))


def label_shuffled(pairs: DataFrame) -> DataFrame:
    """Every second row of each group swapped, in order of the ids."""
    marked = R.alternate(pairs, ["group"], R.last("task_id", "chosen_candidate_id", "rejected_candidate_id"), "_s")
    return swap_labels(marked, F.col("_s")).drop("_s")


def matched_random(pairs: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """The rejected side replaced by another candidate of about its length: of the same source and difficulty, else source, else any."""
    anchors = pairs.withColumn("candidate_id", F.col("rejected_candidate_id")).withColumn("n_words", S.word_count("rejected"))
    sized = pool.withColumn("n_words", S.word_count("candidate_test_code"))
    match = R.matched_random(anchors.dropDuplicates(["candidate_id"]), sized, [["source", "difficulty_bucket"], ["source"], []], "candidate_id", "n_words", seed)
    code = sized.select(F.col("candidate_id").alias("match_id"), F.col("candidate_test_code").alias("match_code"))
    joined = pairs.join(match.select(F.col("anchor_id").alias("rejected_candidate_id"), "match_id", "level"), "rejected_candidate_id").join(code, "match_id")
    return joined.select(*[c for c in pairs.columns if c not in ("rejected", "rejected_candidate_id")], F.col("match_code").alias("rejected"), F.col("match_id").alias("rejected_candidate_id"), F.col("level").alias("match_level"))


def cell(pos_high: Column, neg_high: Column) -> Column:
    return F.concat(F.when(pos_high, "H").otherwise("L"), F.when(neg_high, "H").otherwise("L"))


#: Whether a cell takes its highest scores first.
DESCENDING = {"LL": False, "HL": True, "LH": False, "HH": True}


def balanced_cells(rows: DataFrame, by: list[str], score: str, id: str, cell: str = "cell") -> DataFrame:
    """From each bucket as many rows of each cell as its scarcest cell has, in the cell's own order."""
    from sparkassay.operators.reports import cell_pivot

    quotas = cell_pivot(rows, by, cell).select(*by, "quota")
    keyed = rows.withColumn("_k", R.signed_order(cell, DESCENDING, score))
    ranked = R.rank(keyed, [*by, cell], R.last("_k", id))
    return ranked.join(quotas, by).filter(F.col("rn") <= F.col("quota")).drop("_k")


def fixed_budget(rows: DataFrame, budget: int, source: str, bucket: str, order: list[Column]) -> DataFrame:
    """``budget`` rows: sources in proportion (largest remainder), buckets in turn, then the rest in the same order."""
    counts = rows.groupBy(source).agg(F.count("*").alias("n"))
    quotas = R.largest_remainder(counts, source, "n", budget).select(source, "quota")
    turned = R.round_robin(rows, [source], bucket, order)
    return turned.join(quotas, source).filter(F.col("turn") <= F.col("quota"))


def expand_tasks(tasks: DataFrame, presets: DataFrame, variants: list[str], id: str = "task_id") -> DataFrame:
    """Every task with every preset (a small table), the prompt variant taken in turn."""
    both = tasks.crossJoin(F.broadcast(presets))
    ranked = R.rank(both, [id], R.last("preset"), "_n")
    return ranked.withColumn("variant", F.element_at(F.array(*map(F.lit, variants)), (F.pmod(F.col("_n") - 1, F.lit(len(variants))) + 1).cast("int"))).drop("_n")


def select_presets(presets: DataFrame, names: str) -> DataFrame:
    """Presets by a comma-separated list of names; raises if none is left."""
    wanted = [x.strip() for x in names.split(",") if x.strip()]
    out = presets.filter(F.col("preset").isin(*wanted)) if wanted else presets
    if not out.limit(1).count():
        raise ValueError(f"no preset among {wanted}")
    return out


def chat_prompt(system: str, prompt: Column, focus: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.concat(shape.text(prompt), F.lit("\nFocus: "), shape.text(focus)).alias("content")))


def merge_runs(a: DataFrame, b: DataFrame, prefixes: tuple[str, str] = ("a__", "b__")) -> DataFrame:
    """Candidates of two generator runs under prefixed ids, which are checked to be unique."""
    from sparkassay.operators.checks import require_unique

    return require_unique(shape.remap_ids(a, prefixes[0]).unionByName(shape.remap_ids(b, prefixes[1]), allowMissingColumns=True), "candidate_id")


def cascade(df: DataFrame, by: list[str], score: str, id: str, k: int) -> DataFrame:
    """Tiers high (best k), medium (the k nearest the median of those left), weak (the k lowest of the rest) of each partition."""
    high = R.top_k(df, by, R.last((score, "desc"), id), k).withColumn("tier", F.lit("high"))
    rest = R.rank(df, by, R.last((score, "desc"), id), "_h").filter(F.col("_h") > k).drop("_h")
    medium = R.nearest_median(rest, by, score, id, k).withColumn("tier", F.lit("medium")).drop("mid", "gap")
    weak_pool = rest.join(medium.select(id), id, "left_anti")
    weak = R.top_k(weak_pool, by, R.last(score, id), k).withColumn("tier", F.lit("weak"))
    return high.unionByName(medium).unionByName(weak)


def overlap_first(df: DataFrame, anchors: DataFrame, by: list[str], key: str, score: str, id: str, k: int) -> DataFrame:
    """The ``k`` lowest of each partition, those whose key the anchors also have first."""
    have = anchors.select(key).distinct().withColumn("_o", F.lit(1))
    joined = df.join(have, key, "left").withColumn("overlap", F.coalesce("_o", F.lit(0))).drop("_o")
    return R.top_k(joined, by, R.last(("overlap", "desc"), score, id), k)


def diagnostic_sets(left: DataFrame, right: DataFrame, candidates: DataFrame, groups: tuple[str, str], prompt: Column) -> DataFrame:
    """Preference rows of two sets of pairs, cut to the smaller number in order of their ids, so that only one thing differs.

    Candidates are looked up by id (of repeated ids the first by its code); pairs that miss one, or a side's text, go after the cut.
    """
    pairs = [df.select("task_id", "candidate_id_pos", "candidate_id_neg") for df in (left, right)]
    keys = R.last("task_id", "candidate_id_pos", "candidate_id_neg")
    n = min(df.count() for df in pairs)
    if not n:
        raise ValueError("one of the sets has no pairs")
    cut = pairs[0].orderBy(*keys).limit(n).withColumn("group", F.lit(groups[0])).unionByName(pairs[1].orderBy(*keys).limit(n).withColumn("group", F.lit(groups[1])))
    known = R.first_per_key(candidates, ["candidate_id"], R.last("candidate_test_code"))
    neg = known.select(F.col("candidate_id").alias("candidate_id_neg"), F.col("candidate_test_code").alias("candidate_test_code_neg"))
    pos = known.drop("task_id").withColumnsRenamed({"candidate_id": "candidate_id_pos", "candidate_test_code": "candidate_test_code_pos"})
    return preference_rows(cut.join(pos, "candidate_id_pos").join(neg, "candidate_id_neg"), F.col("group"), prompt)


def factorial_rows(cells: dict[str, DataFrame], prompt: Column) -> DataFrame:
    """Preference rows of the factorial's cells, each named by its group and the kind of its negatives."""
    out = None
    for group, pairs in cells.items():
        one = preference_rows(pairs, group, prompt).withColumn("neg_kind", F.lit("strong" if group[1] == "H" else "ordinary"))
        out = one if out is None else out.unionByName(one)
    return out


def ordinary_negatives(rows: DataFrame) -> DataFrame:
    """Rejected sides that may replace others: of ordinary kind and not blank, with their length in words."""
    return rows.filter((F.col("neg_kind") == "ordinary") & (F.trim("rejected") != "")).select("rejected", "rejected_candidate_id", "task_id", "source", "difficulty_bucket", F.col("group").alias("cell"), S.word_count("rejected").alias("length_words"))


def candidate_records(generated: DataFrame, run_id: str, version: str) -> DataFrame:
    """Records of generated candidates: ids, provenance, decoding, the code and its sizes. A missing text is an empty one."""
    code = shape.text("candidate_test_code")
    return generated.select(
        F.lit(run_id).alias("run_id"),
        F.lit(version).alias("script_version"),
        shape.candidate_id(F.col("task_id"), F.col("preset"), F.col("generator_tag"), index=F.col("candidate_index")).alias("candidate_id"),
        "task_id",
        "source",
        "difficulty_bucket",
        shape.group_key(F.col("source"), F.col("difficulty_bucket")).alias("source_task_group"),
        F.lit("model_generated").alias("test_source_type"),
        F.col("preset").alias("candidate_test_origin_detail"),
        F.col("preset").alias("decoding_config_name"),
        "candidate_index",
        code.alias("candidate_test_code"),
        F.length(code).alias("candidate_char_len"),
        S.nonblank_lines(code).alias("candidate_nonempty_line_count"),
    )
