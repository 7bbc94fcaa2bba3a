"""Constraint cores: branches, exclusions, exact counts, and the first viable ancestor of a seed."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.operators import bitmaps, taxonomy
from lexgrove.operators.work import small_jobs, written

A_COUNTS, B_COUNTS, POOL = (1, 2, 3, 4, 5), (0, 1, 2, 3, 4, 5), 4
_IDS = "array<string>"
#: Seeds whose results one task tells; each has a row for every cell.
TOLD = 100_000


@dataclass(frozen=True)
class Graph:
    """Tables that constraint operators share; all of usable nodes.

    ``member`` (family, object_id, like) tells which nodes are alike, and ``lean`` is the graph of one node of each kind, its ``node``
    with the number of its kind as ``weight``: walks, cores and counts are made over it, so that they grow with kinds and not with nodes.
    """

    node: DataFrame
    edge: DataFrame
    closed: DataFrame
    sizes: DataFrame
    children: DataFrame
    walk: DataFrame
    member: DataFrame | None = None
    lean: Graph | None = None

    @functools.cached_property
    def ranked(self) -> DataFrame:
        """Numbered children, as ``ranked_children``; written once."""
        return written(ranked_children(self), "ranked")

    @functools.cached_property
    def covering(self) -> DataFrame:
        """(family, seed, parent, child, size, j): numbered children by the seeds that lie under them; written once."""
        under = self.closed.select("family", F.col("anc").alias("child"), F.col("desc").alias("seed"))
        return written(under.join(self.ranked, ["family", "child"]).select("family", "seed", "parent", "child", "size", "j"), "covers")

    @functools.cached_property
    def places(self) -> DataFrame:
        """Places of usable nodes, as ``bitmaps.node_places``; written once."""
        return written(bitmaps.node_places(self.node, self.edge), "places")

    @functools.cached_property
    def words(self) -> DataFrame:
        """Closures as words, as ``bitmaps.closure_words``; written once."""
        return written(bitmaps.closure_words(self.closed, self.places), "words")

    @functools.cached_property
    def planes(self) -> tuple[DataFrame, int]:
        """Weights of places, as ``bitmaps.weight_planes``; written once."""
        weights = self.node.where("usable").select("family", "object_id", "weight" if "weight" in self.node.columns else F.lit(1).cast("long").alias("weight"))
        planes, digits = bitmaps.weight_planes(self.places, weights)
        return written(planes, "planes"), digits

    @functools.cached_property
    def heads(self) -> DataFrame:
        """(family, a1, s, outside): how many nodes lie under a node, and how many outside it; written once."""
        planes, digits = self.planes
        total = planes.groupBy("family").agg(bitmaps.weight_of(F.lit(-1).cast("long"), digits).alias("total"))
        on_cycle = self.closed.where("anc = desc").select("family", F.col("anc").alias("object_id"), F.lit(1).alias("own"))
        rows = self.sizes.join(F.broadcast(total), "family").join(on_cycle, ["family", "object_id"], "left")
        outside = F.col("total") - F.col("size") - 1 + F.coalesce("own", F.lit(0))
        return written(rows.select("family", F.col("object_id").alias("a1"), F.col("size").alias("s"), outside.alias("outside")), "heads")


def graph(node: DataFrame, edge: DataFrame) -> Graph:
    """Tables of all usable nodes, told from those of one node of each kind."""
    edge = written(taxonomy.usable_edges(node, edge), "edge")
    member = written(taxonomy.alike(node, edge), "alike")
    with small_jobs(edge.sparkSession):
        lean = _lean(edge, member)
    all_ = lambda rows, c: rows.withColumnRenamed(c, "like").join(member.withColumnRenamed("object_id", c), ["family", "like"]).select(rows.columns)
    return Graph(node, edge, all_(lean.closed, "desc"), all_(lean.sizes, "object_id"), lean.children, all_(lean.walk, "seed"), member, lean)


def _lean(edge: DataFrame, member: DataFrame) -> Graph:
    """The graph of one node of each kind; sizes count all nodes."""
    node = member.groupBy("family", F.col("like").alias("object_id")).agg(F.count("*").alias("weight")).withColumn("usable", F.lit(True))
    node = written(node, "kinds")
    few = written(edge.join(node.select("family", F.col("object_id").alias("child")), ["family", "child"], "left_semi").select(edge.columns), "lean")
    closed = taxonomy.closure(few)
    sizes = written(taxonomy.closure_sizes(node, closed), "sizes")
    return Graph(node, few, closed, sizes, written(taxonomy.usable_children(few, sizes), "children"), taxonomy.ancestor_walk(few, sizes))


def ranked_children(g: Graph) -> DataFrame:
    """(family, parent, j, child, size): children with descendants, the largest first, numbered from 1."""
    j = F.row_number().over(Window.partitionBy("family", "parent").orderBy(F.desc("size"), "child"))
    return g.children.select("family", "parent", "child", "size", j.alias("j"))


def first_left(keys: DataFrame, removed: DataFrame, ranked: DataFrame, count: int) -> DataFrame:
    """Each key's ``count`` first children of ``parent`` that are not removed: the columns of ``keys`` and child, size, j.

    ``keys`` holds id, family, parent; ``removed`` id, parent, j. Only as many ranks are written out as can matter, so that a
    parent with many children costs no more than one with few.
    """
    gone = removed.distinct().withColumn("i", F.row_number().over(Window.partitionBy("id", "parent").orderBy("j")))
    early = gone.where(F.col("j") - F.col("i") < count).groupBy("id", "parent").agg(F.count("*").alias("n"))
    upto = keys.join(early, ["id", "parent"], "left").withColumn("j", F.explode(F.sequence(F.lit(1), (F.coalesce("n", F.lit(0)) + count).cast("int")))).drop("n")
    return upto.join(gone.select("id", "parent", "j"), ["id", "parent", "j"], "left_anti").join(ranked, ["family", "parent", "j"])


def branch_sets(pairs: DataFrame, g: Graph) -> DataFrame:
    """(family, seed, a1, k, branches): the branches of a (seed, a1) pair for k from 0 to 4, where it has enough.

    Taken in turn: the smallest covering child, those that do not cover by descending size, the rest of the covering;
    ids break ties, and the set is in id order. Of a parent's children only those that cover the seed and the first few others are looked at.
    """
    most = max(A_COUNTS) - 1
    ranked = g.ranked
    pairs = written(pairs.select("family", "seed", "a1").distinct().withColumn("id", F.monotonically_increasing_id()), "pairs")
    covering = written(g.covering.withColumnRenamed("parent", "a1").join(pairs, ["family", "seed", "a1"]), "covering")
    asked = pairs.join(covering.select("id").distinct(), "id", "left_semi").withColumn("parent", F.col("a1"))
    others = first_left(asked, covering.select("id", F.col("a1").alias("parent"), "j"), ranked, most)
    first = F.row_number().over(Window.partitionBy("id").orderBy("size", "child"))
    own = covering.withColumn("n", first).where(F.col("n") <= most)
    rows = own.select("id", F.when(F.col("n") == 1, 0).otherwise(2).alias("stage"), F.col("size").alias("o"), "child").unionByName(others.select("id", F.lit(1).alias("stage"), (-F.col("size")).alias("o"), "child"))
    ordered = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("stage", "o", "child"))).alias("x")).select("id", F.col("x.child").alias("x"))
    ks = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")
    some = pairs.join(ordered, "id").select("family", "seed", "a1", "x", ks).where(F.size("x") >= F.col("k"))
    some = some.select("family", "seed", "a1", "k", F.array_sort(F.slice("x", F.lit(1), F.col("k"))).alias("branches"))
    return pairs.select("family", "seed", "a1", F.lit(0).alias("k"), F.array().cast(_IDS).alias("branches")).unionByName(some)


def top_b(branched: DataFrame, g: Graph, count: int = max(B_COUNTS)) -> DataFrame:
    """As ``choose_b`` over ``b_options``, but of each branch and of a1 only the ``count`` first options of its own are looked at.

    A child belongs to the first branch in id order that has it, else to a1 if it is no branch itself. Within its
    source the order is by size and id, so that a source's ``count`` first hold all that can be chosen from it.
    """
    return _with_options(branched, g, count).where("chosen is not null").select("family", "seed", "a1", "k", "chosen")


def _with_options(branched: DataFrame, g: Graph, count: int = max(B_COUNTS)) -> DataFrame:
    """All rows of ``branched`` with ``chosen`` as in ``top_b``, null where there is no option."""
    ranked = g.ranked
    rows = written(branched.select("family", "seed", "a1", "k", "branches", F.monotonically_increasing_id().alias("id")), "branched")
    at = F.concat(F.transform("branches", lambda x, i: F.struct(i.alias("stage"), x.alias("parent"))), F.array(F.struct(F.lit(99).alias("stage"), F.col("a1").alias("parent"))))
    asked = rows.select("id", "family", "seed", F.explode(at).alias("p")).select("id", "family", "seed", "p.*")
    covers = asked.join(g.covering, ["family", "seed", "parent"]).select("id", "parent", "j")
    # Children of a branch belong to it, not to a later branch or to a1: what an earlier source has, is removed.
    named = rows.select("id", "family", F.col("a1").alias("parent"), F.explode("branches").alias("child")).join(ranked, ["family", "parent", "child"]).select("id", "parent", "j")
    # Children of two parents are found once for the two, whatever the number of seeds that ask.
    some = asked.select("family", "parent").distinct()
    other = ranked.join(some, ["family", "parent"], "left_semi").select("family", F.col("parent").alias("branch"), "child")
    shared = written(ranked.join(other, ["family", "child"]).where("branch <> parent").select("family", "branch", "parent", "j"), "shared")
    early = rows.select("id", "family", F.explode(at).alias("p"), at.alias("all")).where("p.stage < 99")
    meet = early.select("id", "family", F.col("p.parent").alias("branch"), F.explode(F.filter("all", lambda x: x["stage"] > F.col("p.stage"))).alias("later"))
    taken = meet.select("id", "family", "branch", F.col("later.parent").alias("parent")).join(shared, ["family", "branch", "parent"]).select("id", "parent", "j")
    found = first_left(asked.select("id", "family", "parent", "stage"), covers.unionByName(named).unionByName(taken), ranked, count)
    source = F.when(F.col("stage") == 99, "inside_A1").otherwise("inside_positive_branch").alias("source")
    key = F.struct((-F.col("size")).alias("neg"), F.col("parent").alias("paired"), F.col("child").alias("b"), source)
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(key)), 1, count).alias("chosen"))
    return rows.join(best, "id", "left").select("family", "seed", "a1", "k", "branches", "chosen")


def b_options(branched: DataFrame, g: Graph) -> DataFrame:
    """(family, seed, a1, k, b, size, paired, source): children that do not cover the seed, of each branch and then of a1.

    A child counts once: at the first branch in id order, or at a1 if it is no branch itself. The seed itself may be an option.
    """
    at = F.concat(
        F.transform("branches", lambda x, i: F.struct(i.alias("stage"), x.alias("paired"), F.lit("inside_positive_branch").alias("source"))),
        F.array(F.struct(F.lit(99).alias("stage"), F.col("a1").alias("paired"), F.lit("inside_A1").alias("source"))),
    )
    asked = branched.select("family", "seed", "a1", "k", "branches", F.explode(at).alias("p")).select("family", "seed", "a1", "k", "branches", "p.*")
    kids = asked.join(g.children.select("family", F.col("parent").alias("paired"), F.col("child").alias("b"), "size"), ["family", "paired"])
    kids = kids.where((F.col("stage") < 99) | ~F.array_contains("branches", F.col("b")))
    kids = kids.join(g.closed.select("family", F.col("anc").alias("b"), F.col("desc").alias("seed")), ["family", "b", "seed"], "left_anti")
    best = kids.groupBy("family", "seed", "a1", "k", "b", "size").agg(F.min(F.struct("stage", "paired", "source")).alias("f"))
    return best.select("family", "seed", "a1", "k", "b", "size", "f.paired", "f.source")


def choose_b(options: DataFrame, count: int = max(B_COUNTS)) -> DataFrame:
    """(family, seed, a1, k, chosen): at most ``count`` options, largest first; ties by paired id, then id."""
    key = F.struct((-F.col("size")).alias("neg"), "paired", "b", "source")
    return options.groupBy("family", "seed", "a1", "k").agg(F.slice(F.array_sort(F.collect_list(key)), 1, count).alias("chosen"))


def cores(g: Graph, seeds: DataFrame) -> DataFrame:
    """All candidate cores: (family, seed, a1, distance, rank, a_count, b_count, branches, bs, paired, sources)."""
    pairs = g.walk.join(seeds, ["family", "seed"], "left_semi").select("family", "seed", F.col("anc").alias("a1"), "distance", "rank")
    return cores_of(written(branch_sets(pairs.select("family", "seed", "a1"), g), "branches"), pairs, g)


def cores_of(branched: DataFrame, pairs: DataFrame, g: Graph) -> DataFrame:
    """The cores of branch sets, as ``cores``; ``pairs`` (family, seed, a1, distance, rank) places their ancestors."""
    out = _with_options(branched, g).join(pairs, ["family", "seed", "a1"])
    n = F.coalesce(F.size("chosen"), F.lit(0))
    out = out.withColumn("b_count", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)))))
    take = F.slice(F.coalesce("chosen", F.array().cast("array<struct<neg:bigint,paired:string,b:string,source:string>>")), F.lit(1), F.col("b_count"))
    out = out.withColumn("take", F.when(F.col("b_count") > 0, take))
    none = F.array().cast(_IDS)
    parts = (F.coalesce(F.col(f"take.{c}"), none).alias(n) for c, n in (("b", "bs"), ("paired", "paired"), ("source", "sources")))
    return out.select("family", "seed", "a1", "distance", "rank", (F.col("k") + 1).alias("a_count"), "b_count", "branches", *parts)


def core_counts(keys: DataFrame, g: Graph) -> DataFrame:
    """Exact counts of each distinct constraint (family, a1, branches, bs).

    With S all under a1 and P the part of it under a branch (all of S without branches): positive is P
    outside all bs, hits_b P inside one, fails S outside P, outside all usable nodes but S and a1. Near siblings are
    the fails if there are branches, else siblings' nodes outside P. Sets are put together and counted as bitmaps over kinds of
    nodes, each by the number of its nodes. The named nodes have children.
    """
    g = g.lean or g
    planes, digits = g.planes
    size_of = lambda bits: bitmaps.weight_of(bits, digits)
    keys = written(keys.select("family", "a1", "branches", "bs").distinct().withColumn("key", F.monotonically_increasing_id()), "keys")
    none = F.lit(0).cast("long")
    ids = F.concat(F.transform("branches", lambda x: F.struct(x.alias("id"), F.lit(True).alias("pre"))), F.transform("bs", lambda x: F.struct(x.alias("id"), F.lit(False).alias("pre"))))
    named = keys.select("key", "family", "a1", (F.size("branches") == 0).alias("lone"), F.explode(ids).alias("c")).select("key", "family", "a1", "lone", "c.*")
    bits = lambda is_: F.bit_or(F.when(is_, F.col("bits")).otherwise(none))
    each = named.join(g.words.withColumnRenamed("anc", "id"), ["family", "id"]).groupBy("key", "family", "a1", "lone", "word").agg(bits(F.col("pre")).alias("p"), bits(~F.col("pre")).alias("x"))
    # Without branches what the bs cover must lie under a1 to count as a hit.
    under = g.words.select("family", F.col("anc").alias("a1"), "word", F.col("bits").alias("s"))
    hit = F.when(~F.col("lone"), F.col("p")).otherwise(F.coalesce("s", none)).bitwiseAND(F.col("x"))
    each = each.join(under, ["family", "a1", "word"], "left").join(F.broadcast(planes), ["family", "word"])
    sums = each.groupBy("key").agg(size_of(F.col("p")).alias("p"), size_of(F.col("x")).alias("x"), size_of(hit).alias("hits"))
    heads = keys.where(F.size("branches") == 0).select("family", F.col("a1").alias("object_id"))
    near = bitmaps.sibling_words(heads, g.edge, g.children, g.words, g.places).join(F.broadcast(planes), ["family", "word"])
    sib = near.groupBy("family", F.col("object_id").alias("a1")).agg(size_of(F.col("bits")).alias("near"))
    row = keys.join(sums, "key", "left").join(g.heads, ["family", "a1"]).join(sib, ["family", "a1"], "left")
    row = row.fillna(0, ["p", "x", "hits", "near"])
    branches = F.size("branches") > 0
    scope = F.when(branches, F.col("p")).otherwise(F.col("s"))
    hits = F.col("hits")
    fails, outside = F.col("s") - scope, F.col("outside")
    near = F.when(branches, fails).otherwise(F.col("near"))
    as_long = lambda c, n: c.cast("long").alias(n)
    return row.select(
        "family", "a1", "branches", "bs", as_long(F.col("s"), "a1_scope"), as_long(scope, "positive_pre"), as_long(F.col("x"), "excluded_scope"), as_long(hits, "hits_b"),
        as_long(scope - hits, "positive"), as_long(fails, "fails"), as_long(near, "near_sibling"), as_long(outside, "outside"),
        as_long(hits + fails + outside, "negative"), as_long(hits + F.when(branches, fails).otherwise(near), "hard"),
    )


def capacity(positive: Column, negative: Column, hard: Column) -> dict[str, Column]:
    """Which tasks and answer sizes a core can serve with pools of POOL candidates."""
    def pool(p: int, pool_: Column) -> Column:
        return (positive >= p) & (pool_ >= POOL - p)

    t2 = [pool(p, negative) for p in (0, 1, 2)]
    return {
        "T1_true": positive >= 1, "T1_false": negative >= 1, "T1_balanced": (positive >= 1) & (negative >= 1),
        "T2_gold_0": t2[0], "T2_gold_1": t2[1], "T2_gold_2": t2[2], "T2_any": t2[0] | t2[1] | t2[2], "T2_all_gold_sizes": t2[0] & t2[1] & t2[2],
        **{f"T2_hard_gold_{p}": pool(p, hard) for p in (0, 1, 2)},
        "T3_true": t2[1], "T3_false": t2[0], "T3_balanced": (positive >= 1) & t2[0], "T3_hard_true": pool(1, hard), "T3_hard_false": pool(0, hard),
    }


def first_viable(all_: DataFrame, counted: DataFrame, min_positive: int = 1, need_negative: bool = True) -> DataFrame:
    """Of all cores with their counts the first in walk order of each seed and cell that is viable."""
    fine = F.col("positive") >= min_positive
    if need_negative:
        fine = fine & (F.col("negative") >= 1)
    viable = all_.join(counted.where(fine), ["family", "a1", "branches", "bs"])
    first = F.row_number().over(Window.partitionBy("family", "seed", "a_count", "b_count").orderBy("rank"))
    return viable.withColumn("n", first).where("n = 1").drop("n")


@dataclass(frozen=True)
class Search:
    """What the walk up from the seeds gave.

    ``found``: the first viable core of each seed and cell; ``open``: (family, seed, a_count, b_count) without one;
    ``branched`` (family, seed, anc, a_count) and ``tried`` (family, seed, anc, a_count, b_count, positive): what there was to try.
    ``built`` counts the cores that were built. ``kinds`` is the search over one seed of each kind, from which these are told, and
    ``asked`` (family, seed, like) says of which kind a seed is.
    """

    found: DataFrame
    open: DataFrame
    branched: DataFrame
    tried: DataFrame
    built: int
    kinds: Search | None = None
    asked: DataFrame | None = None

    def counted(self) -> DataFrame:
        """``found`` with one row for each kind of seed and cell, and ``seeds``: how many seeds it stands for."""
        if self.kinds is None:
            return self.found.withColumn("seeds", F.lit(1).cast("long"))
        many = self.asked.groupBy("family", F.col("like").alias("seed")).agg(F.count("*").alias("seeds"))
        return self.kinds.found.join(many, ["family", "seed"])

    def chosen(self, *cols: str | Column) -> DataFrame:
        """Family, seed and ``cols`` of ``found``; these are made once for each kind of seed and told for all of them."""
        if self.kinds is None:
            return self.found.select("family", "seed", *cols)
        return _all_seeds(self.kinds.found.select("family", "seed", *cols), _dealt(self.asked))

    def first(self, count: int) -> DataFrame:
        """``found`` of the first ``count`` seeds of each family and cell by id.

        They are among the first of the kinds that have the smallest first ids, so no more seeds of no other kinds are looked at.
        """
        at = lambda c, *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(c))
        cell = ("family", "a_count", "b_count")
        rows = self.found
        if self.kinds is not None:
            own = self.asked.groupBy("family", "like").agg(F.min("seed").alias("least"))
            kinds = self.kinds.found.withColumnRenamed("seed", "like").join(own, ["family", "like"])
            kinds = kinds.withColumn("n", at("least", *cell)).where(F.col("n") <= count).drop("n", "least")
            seeds = self.asked.withColumn("n", at("seed", "family", "like")).where(F.col("n") <= count).drop("n")
            rows = kinds.join(seeds, ["family", "like"]).select(rows.columns)
        return rows.withColumn("n", at("seed", *cell)).where(F.col("n") <= count).drop("n")


def _cells(seeds: DataFrame) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(a).alias("a_count"), F.lit(b).alias("b_count")) for a in A_COUNTS for b in B_COUNTS))
    return seeds.select("family", "seed", F.explode(cells).alias("c")).select("family", "seed", "c.*")


def search(g: Graph, seeds: DataFrame, min_positive: int = 1, need_negative: bool = True) -> Search:
    """What the walk up from the seeds gives. It is made for one seed of each kind: those that are alike have the same cores."""
    if g.lean is None:
        return _search(g, seeds, min_positive, need_negative)
    asked = seeds.select("family", "seed").join(g.member.withColumnRenamed("object_id", "seed"), ["family", "seed"], "left")
    asked = written(asked.select("family", "seed", F.coalesce("like", "seed").alias("like")), "asked")
    with small_jobs(seeds.sparkSession):
        got = _search(g.lean, asked.select("family", F.col("like").alias("seed")).distinct(), min_positive, need_negative)
    dealt = _dealt(asked)
    all_ = (_all_seeds(x, dealt) for x in (got.found, got.open, got.branched, got.tried))
    return Search(*all_, got.built, got, asked)


def _dealt(asked: DataFrame) -> DataFrame:
    """``asked`` in as many tasks as its seeds need: the table is small beside what is told of them, and its files make few."""
    tasks = asked.count() // TOLD + 1
    return asked.repartition(tasks, "family", "seed") if tasks > 1 else asked


def _all_seeds(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` of one seed of each kind, for all seeds."""
    return rows.withColumnRenamed("seed", "like").join(asked, ["family", "like"]).select(rows.columns)


def _search(g: Graph, seeds: DataFrame, min_positive: int, need_negative: bool) -> Search:
    """Walks up from the seeds in rounds of ancestors: ranks 1, then 2 and 3, then 4 to 7, and so on.

    A round builds and counts the cores of open cells only, and takes the first viable one of each; what is solved takes no
    part in the next. Every round is written. Rounds grow as the logarithm of the longest walk.
    """
    cell = ["family", "seed", "a_count", "b_count"]
    walk = g.walk.join(seeds.select("family", "seed"), ["family", "seed"], "left_semi").select("family", "seed", F.col("anc").alias("a1"), "distance", "rank")
    last = walk.agg(F.max("rank")).first()[0] or 0
    open_ = written(_cells(seeds), "open")
    found, branched, tried, built = [], [], [], 0
    low, high = 1, 1
    while True:
        pairs = walk.where(F.col("rank").between(low, high)).join(open_.select("family", "seed").distinct(), ["family", "seed"], "left_semi")
        sets = branch_sets(pairs.select("family", "seed", "a1"), g).withColumn("a_count", F.col("k") + 1)
        sets = written(sets.join(open_.select("family", "seed", "a_count").distinct(), ["family", "seed", "a_count"], "left_semi"), "branches")
        made = written(cores_of(sets.drop("a_count"), pairs, g).join(open_, cell, "left_semi"), "cores")
        counted = written(core_counts(made, g), "counts")
        first = written(first_viable(made, counted, min_positive, need_negative), "found")
        built += made.count()
        found.append(first)
        branched.append(sets.select("family", "seed", F.col("a1").alias("anc"), "a_count"))
        tried.append(made.join(counted, ["family", "a1", "branches", "bs"]).select("family", "seed", F.col("a1").alias("anc"), "a_count", "b_count", "positive"))
        open_ = written(open_.join(first, cell, "left_anti"), "open")
        low, high = high + 1, 2 * high + 1
        if low > last or open_.isEmpty():
            break
    whole = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return Search(whole(found), open_, whole(branched), whole(tried), built)


def seed_cores(g: Graph, seeds: DataFrame, min_positive: int = 1, need_negative: bool = True) -> DataFrame:
    """For each seed and cell the first ancestor in walk order whose core is viable, with its counts.

    ``need_negative`` tells the generator's gate (a negative must exist) from the audit's.
    """
    return search(g, seeds, min_positive, need_negative).found


def missing_reasons(g: Graph, seeds: DataFrame, min_positive: int = 1, searched: Search | None = None) -> DataFrame:
    """(family, seed, a_count, b_count, reason) where no ancestor is viable: the commonest reason over ancestors, ties to the earliest; without ancestors no_usable_ancestor.

    ``searched`` is the audit's search (``need_negative`` off) over the same seeds, if it has been made.
    """
    got = searched or search(g, seeds, min_positive, need_negative=False)
    return _reasons(g, got) if got.kinds is None else _all_seeds(_reasons(g.lean, got.kinds), _dealt(got.asked))


def counted_reasons(g: Graph, searched: Search) -> DataFrame:
    """As ``missing_reasons`` of a search, with one row for each kind of seed and cell, and ``seeds``: how many seeds it stands for."""
    if searched.kinds is None:
        return _reasons(g, searched).withColumn("seeds", F.lit(1).cast("long"))
    many = searched.asked.groupBy("family", F.col("like").alias("seed")).agg(F.count("*").alias("seeds"))
    return _reasons(g.lean, searched.kinds).join(many, ["family", "seed"])


def _reasons(g: Graph, got: Search) -> DataFrame:
    cell, at = ["family", "seed", "a_count", "b_count"], ["family", "seed", "anc", "a_count"]
    each = got.open.join(g.walk, ["family", "seed"]).join(got.branched.withColumn("branched", F.lit(True)), at, "left").join(got.tried, [*at, "b_count"], "left")
    why = F.when(F.col("branched").isNull(), "insufficient_positive_branches").when(F.col("positive").isNull(), "insufficient_B_options").otherwise("empty_final_positive_scope")
    n = each.groupBy(*cell, why.alias("reason")).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    top = n.groupBy(*cell).agg(F.min_by("reason", F.struct((-F.col("n")).alias("n"), "first")).alias("reason"))
    none = got.open.join(g.walk.select("family", "seed").distinct(), ["family", "seed"], "left_anti").withColumn("reason", F.lit("no_usable_ancestor"))
    return top.unionByName(none)


def feasibility(g: Graph, seeds: DataFrame, min_positive: int = 1, tasks: tuple[str, ...] = ("T1", "T2", "T3")) -> DataFrame:
    """One row per family, task and cell: feasible seeds, capacities, negative sources, status and its reason.

    Cells without a core give the reasons that their seeds lack one, in order, joined by commas.
    """
    searched = search(g, seeds, min_positive, need_negative=False)
    found = searched.counted()
    reasons = counted_reasons(g, searched).groupBy("family", "a_count", "b_count").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    kids = g.children.groupBy("family", "parent").agg(F.count("*").alias("n")).groupBy("family").agg(F.max("n").alias("direct_children"))
    n_seeds = seeds.groupBy("family").agg(F.count("*").alias("usable_seed_count"))
    easy = F.col("outside") >= POOL
    t2 = sum(((F.col("positive") >= p) & (F.col("negative") >= POOL - p)).cast("int") for p in (0, 1, 2))
    t3 = ((F.col("positive") >= 1) & (F.col("negative") >= POOL - 1)).cast("int") + (F.col("negative") >= POOL).cast("int")
    g1 = found.groupBy("family", "a_count", "b_count").agg(
        F.sum("seeds").alias("feasible"), F.sum(F.col("seeds") * (F.col("positive") + F.col("negative"))).alias("candidates"),
        F.array_sort(F.flatten(F.collect_set("sources"))).alias("sources"), F.bool_or(F.col("hits_b") > 0).alias("hits"), F.bool_or(F.col("fails") > 0).alias("fails"),
        F.bool_or(F.col("hard") >= POOL).alias("hard_available"), F.bool_or(easy).alias("easy_available"),
        F.sum(F.col("seeds") * (F.col("positive") + F.col("negative"))).alias("t1"), F.sum(F.col("seeds") * t2).alias("t2"), F.sum(F.col("seeds") * t3).alias("t3"),
        F.min("positive").alias("positive_min"), F.max("positive").alias("positive_max"), F.min("negative").alias("negative_min"), F.max("negative").alias("negative_max"),
    )
    cells = n_seeds.select("family", "usable_seed_count", F.explode(F.array(*(F.struct(F.lit(t).alias("task"), F.lit(a).alias("a_count"), F.lit(b).alias("b_count")) for t in tasks for a in A_COUNTS for b in B_COUNTS))).alias("c")).select("family", "usable_seed_count", "c.*")
    out = cells.join(g1, ["family", "a_count", "b_count"], "left").join(reasons, ["family", "a_count", "b_count"], "left").join(kids, "family", "left")
    numbers = ["feasible", "candidates", "t1", "t2", "t3", "positive_min", "positive_max", "negative_min", "negative_max"]
    out = out.fillna(0, [*numbers, "direct_children"]).fillna(False, ["hits", "fails", "hard_available", "easy_available"])
    status = F.when(F.col("feasible") == 0, "infeasible").when(F.col("feasible") < F.greatest(F.lit(1), F.floor(F.col("usable_seed_count") / 100)), "shortage").otherwise("available")
    sources = F.array_sort(F.filter(F.array(F.lit("outside_A1"), F.when(F.col("hits"), "hits_B"), F.when(F.col("fails"), "fails_positive_branch")), lambda x: x.isNotNull()))
    return out.select(
        "family", "task", "a_count", "b_count", "usable_seed_count", F.col("feasible").cast("long").alias("feasible_seed_cell_count"), F.col("candidates").cast("long").alias("usable_candidate_count"),
        F.array_join(F.array_distinct(F.coalesce("sources", F.array().cast(_IDS))), ",").alias("b_sources"), F.array_join(sources, ",").alias("negative_sources"), "hard_available", "easy_available",
        F.when(F.col("task") == "T1", F.col("t1")).otherwise(0).cast("long").alias("t1_capacity"), F.col("t2").cast("long").alias("t2_pool_space"), F.col("t3").cast("long").alias("t3_pool_space"),
        status.alias("status"), F.when(status == "infeasible", F.coalesce("reasons", F.lit("no_feasible_seed_cell"))).when(status == "shortage", "low_feasible_seed_cell_count").otherwise("ok").alias("reason"),
        F.col("direct_children").cast("long").alias("direct_usable_child_count"), *(F.col(c).cast("long").alias(c) for c in numbers[5:]),
    )
