"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))").alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` holds two long columns ``src, dst``; direction, repeats and self loops do not matter, and
    rows with a null end are dropped. An empty table gives an empty result. Each round joins every
    edge with its end's smallest neighbour; both sides are plain shuffles, so that a hub's edges can
    be split at run time, and minima are combined before the shuffle. The state is written to the
    shared folder after each round.
    """
    state = written(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(state)
    if not mark[0]:
        return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = state.select("u", "v").unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionAll(low.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )
        state = written(small, "edges")
        new = _mark(state)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    ends = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionAll(ends.select(F.col("root").alias("node"), "root").distinct())
