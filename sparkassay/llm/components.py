"""Connected components of a large graph by alternating star contractions, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import Scratch


def _stars(edges: DataFrame, scratch: Scratch, name: str, small: bool) -> DataFrame:
    """One contraction: each node's larger neighbours (small: its smaller ones and itself) get joined to its least neighbour.

    The least neighbour is a partial aggregate. It is joined back to the edges on a key that it isn't aggregated by, so that
    both sides are shuffled for the join and Spark can split a node with many neighbours.
    """
    key = F.col("u").bitwiseXOR(F.lit(1)).alias("k")
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if small:  # from the larger node u to its smaller neighbours v
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(key, "m")
        joined = both.select("*", key).join(least.hint("merge"), "k")
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(key, "m")
        out = both.filter("v > u").select("*", key).join(least.hint("merge"), "k").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = out.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    return scratch.table(out, name)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` (its least reachable node) for each node of the edges ``u, v`` (any order, repeats and loops allowed).

    Each round is written to the shared folder, which cuts lineage; only two numbers a round come to the driver. Ends
    when a round changes nothing: then each edge leads from a node to the least of its component. Null ends are ignored.
    """
    edges = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = scratch.table(edges, "edges0"), None
    for k in range(1, 200):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        large = _stars(now, scratch, f"large{k}", small=False)
        now = _stars(large, scratch, f"edges{k}", small=True)
        scratch.drop(f"large{k}", f"edges{k - 1}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
