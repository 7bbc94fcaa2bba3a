"""Graph operators over ``node(family, object_id, surface, gloss, usable)`` and ``edge(family, parent, child)``."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions import exact, text
from lexgrove.operators.work import written

#: Upper ends of the closure-size buckets, by label.
BUCKETS = (("0", 0), ("1-19", 19), ("20-99", 99), ("100-499", 499), ("500-1999", 1999), ("2000+", None))


def nodes_from_english(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from ``object_id, lemmas, definition, hyponyms``.

    A node is usable with a clean lemma and a definition; edges need both ends among the records.
    """
    clean = F.filter("lemmas", text.is_clean_lemma)
    node = records.select(
        F.lit("wordnet").alias("family"), "object_id", F.coalesce(F.try_element_at(clean, F.lit(1)), F.lit("")).alias("surface"),
        F.coalesce("definition", F.lit("")).alias("gloss"), text.ordered_distinct(clean).alias("synonyms"),
    ).withColumn("usable", (F.col("surface") != "") & (F.col("gloss") != ""))
    pairs = records.select(F.col("object_id").alias("parent"), F.explode("hyponyms").alias("child"))
    known = records.select(F.col("object_id").alias("child"))
    return node, pairs.join(known, "child", "left_semi").distinct().select(F.lit("wordnet").alias("family"), "parent", "child")


def nodes_from_chinese(records: DataFrame, preferred: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from ``ordinal, object_id, pos, zh_synonyms, gloss, sememes, hyponyms``.

    The last record of an id counts. Nouns only; proper names go; usable with a Han surface and a gloss that is not blank.
    ``preferred`` lists, for an id, the surfaces that come before its first one.
    """
    last = records.groupBy("object_id").agg(F.max_by(F.struct("pos", "zh_synonyms", "gloss", "sememes", "hyponyms"), "ordinal").alias("r")).select("object_id", "r.*")
    noun = last.where("lower(pos) in ('n', 'noun')")
    clean = text.clean_han_synonyms(F.col("zh_synonyms"))
    node = noun.select(
        F.lit("babelnet").alias("family"), "object_id", text.preferred_surface(clean, F.col("object_id"), preferred).alias("surface"),
        F.coalesce("gloss", F.lit("")).alias("gloss"), clean.alias("synonyms"), text.is_proper_name(F.col("sememes")).alias("proper"),
    )
    node = node.withColumn("usable", (F.col("surface") != "") & (F.trim("gloss") != "") & ~F.col("proper")).drop("proper")
    pairs = noun.select(F.col("object_id").alias("parent"), F.explode("hyponyms").alias("child"))
    return node, pairs.join(noun.select(F.col("object_id").alias("child")), "child", "left_semi").distinct().select(F.lit("babelnet").alias("family"), "parent", "child")


def usable_edges(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges with usable ends: an unusable node cuts every path through it."""
    ok = node.where("usable").select("family", "object_id")
    out = edge.join(ok.withColumnRenamed("object_id", "parent"), ["family", "parent"], "left_semi")
    return out.join(ok.withColumnRenamed("object_id", "child"), ["family", "child"], "left_semi").select("family", "parent", "child").distinct()


def closure(edge: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(family, anc, desc, depth): all descendants, not the node itself unless it lies on a cycle; depth is the shortest.

    Paths are doubled: when all pairs up to a depth of n = 2**k are known, those of depth n are joined with all, which gives the
    pairs up to 2 * n, each over the nodes that lie n steps down its shortest paths. So rounds grow with the logarithm of the
    depth, and cycles end by themselves. Every round is written to the shared folder, so that plans stay short. With ``starts``
    (family, anc) only their descendants are walked, a level at a time.
    """
    pairs = edge.select("family", F.col("parent").alias("anc"), F.col("child").alias("desc")).distinct()
    if starts is not None:
        return _walk_down(edge, pairs.join(starts.distinct(), ["family", "anc"], "left_semi"))
    seen = last = written(pairs.withColumn("depth", F.lit(1)), "closure")
    n = 1
    while True:
        far = last.where(F.col("depth") == n)
        if far.isEmpty():
            return seen
        more = seen.select("family", F.col("anc").alias("desc"), F.col("desc").alias("next"), F.col("depth").alias("rest"))
        found = far.select("family", "anc", "desc").join(more, ["family", "desc"]).groupBy("family", "anc", F.col("next").alias("desc")).agg(F.min("rest").alias("rest"))
        last = found.join(seen, ["family", "anc", "desc"], "left_anti").select("family", "anc", "desc", (F.col("rest") + n).alias("depth"))
        last = written(last, "closure")
        seen = seen.unionByName(last)
        n *= 2


def _walk_down(edge: DataFrame, pairs: DataFrame) -> DataFrame:
    """The closure from ``pairs`` (family, anc, desc), semi-naive: a level joins only the pairs found last with the edges, and keeps what is new."""
    level = seen = written(pairs.withColumn("depth", F.lit(1)), "closure")
    step = edge.select("family", F.col("parent").alias("desc"), F.col("child").alias("next"))
    for depth in itertools.count(2):
        found = level.join(step, ["family", "desc"]).select("family", "anc", F.col("next").alias("desc")).distinct()
        level = written(found.join(seen, ["family", "anc", "desc"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


def alike(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(family, object_id, like): of each usable node the smallest id among those that are alike; ``edge`` has usable ends.

    Nodes without children are alike if they have the same parents: a closure holds all of them or none, so that they have the same
    ancestors, constraints and counts. A node with children is like itself only. A row holds the parents of one node.
    """
    keys = ["family", "object_id"]
    heads = edge.select("family", F.col("parent").alias("object_id")).distinct()
    up = edge.groupBy("family", F.col("child").alias("object_id")).agg(F.array_sort(F.collect_set("parent")).alias("up"))
    own = node.where("usable").select(*keys).distinct()
    leaves = own.join(heads, keys, "left_anti").join(up, keys, "left").withColumn("up", F.coalesce("up", F.array().cast("array<string>")))
    first = leaves.groupBy("family", "up").agg(F.min("object_id").alias("like"))
    return leaves.join(first, ["family", "up"]).select(*keys, "like").unionByName(own.join(heads, keys, "left_semi").withColumn("like", F.col("object_id")))


def closure_sizes(node: DataFrame, closed: DataFrame) -> DataFrame:
    """(family, object_id, size) of every usable node; 0 for leaves. If ``node`` has a ``weight``, a member counts that often."""
    many = F.count("*")
    if "weight" in node.columns:
        closed, many = closed.join(node.select("family", F.col("object_id").alias("desc"), "weight"), ["family", "desc"]), F.sum("weight")
    n = closed.groupBy("family", F.col("anc").alias("object_id")).agg(many.alias("size"))
    return node.where("usable").select("family", "object_id").join(n, ["family", "object_id"], "left").select("family", "object_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def bucket(size: Column) -> Column:
    out = F.lit(BUCKETS[-1][0])
    for label, top in reversed(BUCKETS[:-1]):
        out = F.when(size <= top, label).otherwise(out)
    return out


def closure_buckets(sizes: DataFrame) -> DataFrame:
    """(family, bucket, n) with all buckets present."""
    labels = F.explode(F.array(*(F.lit(b) for b, _ in BUCKETS))).alias("bucket")
    every = sizes.select("family").distinct().select("family", labels)
    n = sizes.groupBy("family", bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(n, ["family", "bucket"], "left").select("family", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def usable_children(edge: DataFrame, sizes: DataFrame) -> DataFrame:
    """(family, parent, child, size): children that have descendants themselves."""
    return edge.join(sizes.withColumnRenamed("object_id", "child"), ["family", "child"]).where("size >= 1").select("family", "parent", "child", "size")


def siblings(edge: DataFrame, children: DataFrame, closed: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(family, object_id, member): siblings with descendants and all those descendants, without the node and its own.

    With ``heads`` (family, object_id) only those nodes are looked at.
    """
    up = edge.select("family", "parent", F.col("child").alias("object_id"))
    if heads is not None:
        up = up.join(heads.select("family", "object_id").distinct(), ["family", "object_id"], "left_semi")
    pairs = up.join(children.select("family", "parent", F.col("child").alias("sibling")), ["family", "parent"]).where("sibling <> object_id")
    pairs = pairs.select("family", "object_id", "sibling").distinct()
    below = pairs.join(closed.select("family", F.col("anc").alias("sibling"), F.col("desc").alias("member")), ["family", "sibling"])
    every = pairs.select("family", "object_id", F.col("sibling").alias("member")).unionByName(below.select("family", "object_id", "member"))
    own = closed.select("family", F.col("anc").alias("object_id"), F.col("desc").alias("member"))
    return every.where("member <> object_id").distinct().join(own, ["family", "object_id", "member"], "left_anti")


def ancestor_walk(edge: DataFrame, sizes: DataFrame) -> DataFrame:
    """(family, seed, anc, distance, rank): ancestors in the order of a queue walk upwards.

    Parents join the queue by (closure size, id), and a node counts at its first arrival. Its place among equal
    distances is that of the least shortest path, written as (size, id) pairs, so each level keeps the
    least path of what it reaches anew.
    """
    up = edge.join(sizes.withColumnRenamed("object_id", "parent"), ["family", "parent"]).select("family", F.col("child").alias("at"), "parent", F.struct("size", F.col("parent").alias("id")).alias("step"))
    first = up.select("family", F.col("at").alias("seed"), F.col("parent").alias("anc"), F.array("step").alias("path")).groupBy("family", "seed", "anc").agg(F.min("path").alias("path"))
    level = written(first.where("seed <> anc").withColumn("distance", F.lit(1)), "walk")
    seen = level
    for distance in itertools.count(2):
        found = level.join(up.withColumnRenamed("at", "anc"), ["family", "anc"]).select("family", "seed", F.col("parent").alias("anc"), F.concat("path", F.array("step")).alias("path"))
        found = found.where("seed <> anc").groupBy("family", "seed", "anc").agg(F.min("path").alias("path"))
        level = written(found.join(seen, ["family", "seed", "anc"], "left_anti").withColumn("distance", F.lit(distance)).select("family", "seed", "anc", "path", "distance"), "walk")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    rank = F.row_number().over(Window.partitionBy("family", "seed").orderBy("distance", "path"))
    return seen.select("family", "seed", "anc", "distance", rank.alias("rank"))


def descendants_without_seed(children: DataFrame, closed: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """(family, src, seed, desc, depth): non-leaf descendants down to ``max_depth`` whose closures lack the seed.

    Those that cover the seed are walked through but not returned; depth is the shortest. The walk down from a start is the same
    for all its seeds, and is made once.
    """
    step = children.select("family", F.col("parent").alias("desc"), F.col("child").alias("next"))
    level = written(starts.select("family", "src").distinct().select("family", "src", F.col("src").alias("desc"), F.lit(0).alias("depth")), "descend")
    seen = level
    for depth in range(1, max_depth + 1) if max_depth else itertools.count(1):
        found = level.join(step, ["family", "desc"]).select("family", "src", F.col("next").alias("desc")).distinct()
        level = written(found.join(seen, ["family", "src", "desc"], "left_anti").withColumn("depth", F.lit(depth)), "descend")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    covers = closed.select("family", F.col("anc").alias("desc"), F.col("desc").alias("seed"))
    below = starts.select("family", "src", "seed").distinct().join(seen.where("depth > 0"), ["family", "src"]).select("family", "src", "seed", "desc", "depth")
    return below.join(covers, ["family", "desc", "seed"], "left_anti").select("family", "src", "seed", "desc", "depth")


def graph_audit(node: DataFrame, edge: DataFrame, sizes: DataFrame, children: DataFrame) -> DataFrame:
    """One row per family: nodes, roots, leaves (no child with descendants), nodes with several parents, largest closure, and quantiles of degrees and sizes as maps."""
    up = edge.groupBy("family", F.col("child").alias("object_id")).agg(F.count("*").alias("parents"))
    down = children.groupBy("family", F.col("parent").alias("object_id")).agg(F.count("*").alias("kids"))
    facts = sizes.join(up, ["family", "object_id"], "left").join(down, ["family", "object_id"], "left").fillna(0, ["parents", "kids"])
    grouped = facts.groupBy("family").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("parents") == 0).alias("roots"),
        F.count_if(F.col("kids") == 0).alias("leaves"), F.count_if(F.col("parents") > 1).alias("multi_parent"), F.max("size").alias("largest"),
    )
    for c in ("kids", "parents", "size"):
        q = value_quantiles(facts, ["family"], c).select("family", F.struct("n", "min", "p50", "p90", "p99", "max").alias(f"{c}_quantiles"))
        grouped = grouped.join(q, "family", "left")
    return grouped


def top_nodes(edge: DataFrame, sizes: DataFrame, children: DataFrame, count: int = 12) -> DataFrame:
    """(family, measure, object_id, value, rank): the nodes with most children with descendants, parents and descendants; ties by id."""
    up = edge.groupBy("family", F.col("child").alias("object_id")).agg(F.count("*").alias("value"))
    down = children.groupBy("family", F.col("parent").alias("object_id")).agg(F.count("*").alias("value"))
    rows = None
    for name, df in (("children", down), ("parents", up), ("closure", sizes.select("family", "object_id", F.col("size").alias("value")))):
        one = df.select("family", F.lit(name).alias("measure"), "object_id", F.col("value").cast("long").alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("family", "measure").orderBy(F.desc("value"), "object_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= count)


def direct_children(edge: DataFrame, sizes: DataFrame, least: int = 1) -> DataFrame:
    """(family, parent, child, size): children with at least ``least`` descendants."""
    return edge.join(sizes.withColumnRenamed("object_id", "child"), ["family", "child"]).where(F.col("size") >= least).select("family", "parent", "child", "size")


def sibling_pool(edge: DataFrame, closed: DataFrame) -> DataFrame:
    """(family, object_id, member): all siblings, leaves too, and their descendants, without the node and its own."""
    pairs = edge.select("family", "parent", F.col("child").alias("object_id")).join(edge.select("family", "parent", F.col("child").alias("sibling")), ["family", "parent"]).where("sibling <> object_id")
    pairs = pairs.select("family", "object_id", "sibling").distinct()
    below = pairs.join(closed.select("family", F.col("anc").alias("sibling"), F.col("desc").alias("member")), ["family", "sibling"]).select("family", "object_id", "member")
    all_ = pairs.select("family", "object_id", F.col("sibling").alias("member")).unionByName(below).where("member <> object_id").distinct()
    return all_.join(closed.select("family", F.col("anc").alias("object_id"), F.col("desc").alias("member")), ["family", "object_id", "member"], "left_anti")


def inventories(english: DataFrame | None, chinese: DataFrame | None, families: list[str], preferred: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the families that are switched on and have records; raises if none is left."""
    made = []
    if "wordnet" in families and english is not None:
        made.append(nodes_from_english(english))
    if "babelnet" in families and chinese is not None:
        made.append(nodes_from_chinese(chinese, preferred))
    if not made:
        raise ValueError("no family is switched on and has records")
    node, edge = made[0]
    for n, e in made[1:]:
        node, edge = node.unionByName(n, allowMissingColumns=True), edge.unionByName(e)
    return node, edge


def value_quantiles(values: DataFrame, keys: list[str], col: str, many: Column | None = None) -> DataFrame:
    """Nearest-rank quantiles of a whole-number column, from counts of its distinct values; with ``many`` a row counts that often.

    A group is never gathered: running counts over distinct values give the ranks.
    """
    counts = values.groupBy(*keys, F.col(col).alias("v")).agg((F.count("*") if many is None else F.sum(many)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("v")
    run = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    at = lambda q: F.min(F.when(F.col("upto") > F.rint((F.col("n") - 1) * F.lit(q)), F.col("v"))).cast("long")
    return run.groupBy(*keys).agg(F.max("n").cast("long").alias("n"), F.min("v").cast("long").alias("min"), *(at(q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)), F.max("v").cast("long").alias("max"))


def top_labels(rows: DataFrame, keys: list[str], label: str, ordinal: str, count: int = 12) -> DataFrame:
    """The commonest labels of each group with their share; ties in the order of first occurrence."""
    n = rows.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    return n.select(*keys, label, "n", exact.rate_or_zero(F.col("n"), total).alias("share"), rank.alias("rank")).where(F.col("rank") <= count)
