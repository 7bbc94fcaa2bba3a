"""Membership of candidates under a constraint, and their categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trace(samples: DataFrame, closed: DataFrame) -> DataFrame:
    """(key, pos, candidate, inside_a1, branch_hits, b_hits, verdict) for each candidate, pos from 1.

    ``samples``: key, family, a1, branches, bs, candidates. A candidate satisfies the constraint if it lies under
    a1, under a branch if there are any, and under no b.
    """
    cand = samples.select("key", "family", "a1", "branches", "bs", F.posexplode("candidates").alias("pos", "candidate")).withColumn("pos", F.col("pos") + 1)
    roles = F.concat(
        F.array(F.struct(F.lit("a1").alias("role"), F.col("a1").alias("id"))),
        F.transform("branches", lambda x: F.struct(F.lit("branch").alias("role"), x.alias("id"))),
        F.transform("bs", lambda x: F.struct(F.lit("b").alias("role"), x.alias("id"))),
    )
    asked = cand.select("key", "pos", "family", "candidate", F.explode(roles).alias("r")).select("key", "pos", "family", "candidate", "r.role", F.col("r.id").alias("anc"))
    hits = asked.join(closed.select("family", "anc", F.col("desc").alias("candidate")), ["family", "anc", "candidate"], "left_semi")
    got = hits.groupBy("key", "pos").agg(
        F.max((F.col("role") == "a1").cast("int")).alias("a"),
        F.array_sort(F.collect_set(F.when(F.col("role") == "branch", F.col("anc")))).alias("branch_hits"),
        F.array_sort(F.collect_set(F.when(F.col("role") == "b", F.col("anc")))).alias("b_hits"),
    )
    out = cand.join(got, ["key", "pos"], "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("inside_a1", F.coalesce(F.col("a") == 1, F.lit(False))).withColumn("branch_hits", F.coalesce("branch_hits", none)).withColumn("b_hits", F.coalesce("b_hits", none))
    verdict = F.col("inside_a1") & ((F.size("branches") == 0) | (F.size("branch_hits") > 0)) & (F.size("b_hits") == 0)
    return out.select("key", "family", "pos", "candidate", "inside_a1", "branch_hits", "b_hits", verdict.alias("verdict"), (F.size("branches") > 0).alias("has_branches"))


def gold(traced: DataFrame) -> DataFrame:
    """(key, gold_set, gold_any): positions that satisfy, ascending, and whether any does."""
    g = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("verdict"), F.col("pos")))).alias("gold_set"))
    return g.withColumn("gold_any", F.size("gold_set") > 0)


def category(in_gold: Column, inside_a1: Column, branch_ok: Column, hits_b: Column) -> Column:
    return F.when(in_gold, "positive").when(inside_a1 & branch_ok & hits_b, "B-excluded").otherwise("other-negative")


def negative_source(hits_b: Column, fails_branch: Column, sibling: Column) -> Column:
    return F.when(hits_b, "hits_B").when(fails_branch, "fails_positive_branch").when(sibling, "near_sibling").otherwise("outside_A1")
