"""Ranks, hash bounds, bitmaps and the search in rounds against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lexgrove.functions.hashing import stable_hash
from lexgrove.operators import bitmaps, constraint, ranks, sampling, taxonomy
from tests.test_engine import EDGE, WORKSHOP, closed_sets, make, random_dag
from tests.test_products import BRANCHY, Plain


def test_numbered_within_groups(spark):
    r = random.Random(6)
    # One group holds most rows, one is null, and equal rows get different numbers.
    rows = [(r.choice(["big", "big", "big", "b", None]), r.randrange(300), i % 7) for i in range(2000)] + [("big", 5, 0)] * 50
    frame = spark.createDataFrame(rows, "g string, v int, w int").repartition(5)
    got = ranks.numbered(frame, ["v", F.desc("w")], ["g"], "n", parts=9).collect()
    assert sorted(map(str, [(x["g"], x["v"], x["w"]) for x in got])) == sorted(map(str, rows))
    for g in ("big", "b", None):
        mine = sorted((x["n"], x["v"], -x["w"]) for x in got if x["g"] == g)
        assert [m[0] for m in mine] == list(range(len(mine)))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    alone = ranks.numbered(frame, ["v", "w"], name="n", parts=4).collect()
    assert sorted(x["n"] for x in alone) == list(range(len(rows)))
    assert ranks.numbered(frame.limit(0), ["v"], ["g"], "n").count() == 0


def test_numbered_with_many_groups(spark, monkeypatch):
    """The first numbers of groups are joined by shuffling where they are too many to broadcast."""
    monkeypatch.setattr(ranks, "FEW_GROUPS", 3)
    frame = spark.range(500).select((F.col("id") % 50).alias("g"), (F.col("id") * 37 % 500).alias("v"))
    got = {}
    for x in ranks.numbered(frame, ["v"], ["g"], "n", parts=6).collect():
        got.setdefault(x["g"], []).append((x["v"], x["n"]))
    assert all([n for _, n in sorted(x)] == list(range(10)) for x in got.values()) and len(got) == 50


def test_a_family_of_a_million(spark):
    """Places of a million ids in one family; the plan of what follows the deal has no window."""
    n = 1_000_000
    seeds = spark.range(n).select(F.lit("f").alias("family"), F.lpad((F.col("id") * 7919 % n).cast("string"), 7, "0").alias("seed"))
    out = sampling.seed_indexes(seeds)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.agg(F.count("*").alias("n"), F.count_if(F.col("seed").cast("long") != F.col("seed_index")).alias("wrong")).first()
    assert (row["n"], row["wrong"]) == (n, 0)


@pytest.mark.parametrize("slack", [0, 5, 1000])
def test_first_by_hash(spark, slack):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 < 2, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 30)).alias("k"), "id", stable_hash(32, i=F.col("id")).alias("h"))
    want = {"big": 700, "g2": 40, "g5": 1000, "g8": 0, "none": 4}
    wanted = spark.createDataFrame(list(want.items()), "k string, need long")
    by = {}
    for x in rows.collect():
        by.setdefault(x["k"], []).append((x["h"], x["id"]))
    expected = sorted((k, i, n) for k, need in want.items() for n, (_, i) in enumerate(sorted(by.get(k, []))[:need], 1))
    got = ranks.first_by_hash(rows, ["k"], wanted, slack=slack).collect()
    assert sorted((x["k"], x["id"], x["n"]) for x in got) == expected


def test_hash_bounds_let_few_rows_through(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("k"), stable_hash(32, i=F.col("id")).alias("h"))
    bound = ranks.hash_bounds(rows, ["k"], spark.createDataFrame([("k", 100)], "k string, need long")).first()["bound"]
    passed = rows.where(F.left("h", F.lit(len(bound))) <= bound).count()
    assert 100 <= passed <= 100 + ranks.SLACK


def members(words, places):
    at = {(r["word"], r["place"] % 64): r["object_id"] for r in places.collect()}
    out = {}
    for r in words.collect():
        out.setdefault(r[1], set()).update(at[r["word"], k] for k in range(64) if r["bits"] >> k & 1)
    return out


@pytest.mark.parametrize("edges", [WORKSHOP, BRANCHY, random_dag(5), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")]])
def test_closures_as_bitmaps(spark, edges):
    node, edge = make(spark, edges)
    places = bitmaps.written(bitmaps.node_places(node, edge), "places")
    want = {k: v for k, v in closed_sets(edges).items() if v}
    assert members(bitmaps.closure_by_words(edge, places), places) == want
    assert members(bitmaps.closure_words(taxonomy.closure(edge), places), places) == want


def test_closure_of_a_wide_and_a_deep_hierarchy(spark):
    """Seventy levels, and one parent with more children than a word has bits."""
    edges = [(f"d{i:02}", f"d{i + 1:02}") for i in range(70)] + [("top", f"w{i:03}") for i in range(200)] + [("top", "d00")]
    edge = spark.createDataFrame([("wordnet", a, b) for a, b in edges], EDGE)
    node = make(spark, edges)[0]
    words = bitmaps.closure_by_words(edge, bitmaps.node_places(node, edge))
    sizes = {r["anc"]: r["n"] for r in words.groupBy("anc").agg(bitmaps.size_of(F.col("bits")).alias("n")).collect()}
    assert sizes == {k: len(v) for k, v in closed_sets(edges).items() if v}


@pytest.mark.parametrize("edges", [WORKSHOP, BRANCHY])
def test_sibling_bitmaps(spark, edges):
    node, edge = make(spark, edges)
    g = constraint.graph(node, edge)
    pairs = {}
    for r in taxonomy.siblings(g.edge, g.children, g.closed).collect():
        pairs.setdefault(r["object_id"], set()).add(r["member"])
    assert members(bitmaps.sibling_words(node, g.edge, g.children, g.words, g.places), g.places) == pairs
    some = node.where("object_id in ('joint', 'f')")
    few = members(bitmaps.sibling_words(some, g.edge, g.children, g.words, g.places), g.places)
    assert few == {k: v for k, v in pairs.items() if k in ("joint", "f")}
    heads = taxonomy.siblings(g.edge, g.children, g.closed, some)
    assert {(r["object_id"], r["member"]) for r in heads.collect()} == {(k, m) for k, ms in few.items() for m in ms}


def test_search_leaves_solved_cells_alone(spark):
    """The same cores as over all ancestors at once, with fewer built."""
    node, edge = make(spark, BRANCHY)
    g, plain = constraint.graph(node, edge), Plain(BRANCHY)
    seeds = node.select("family", F.col("object_id").alias("seed"))
    for need in (True, False):
        got = constraint.search(g, seeds, 1, need)
        every = constraint.written(constraint.cores(g, seeds), "every")
        counted = constraint.core_counts(every, g)
        cols = ("seed", "a_count", "b_count", "a1", "bs", "rank", "positive", "negative")
        rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
        assert rows(got.found) == rows(constraint.first_viable(every, counted, 1, need))
        assert got.built < 0.7 * every.count()
        assert got.found.count() + got.open.count() == 30 * len(plain.ids)


def test_closure_doubles_paths(spark, monkeypatch):
    """A chain of 300 nodes, a cycle of nine with a way out, and shortcuts: depths are shortest, rounds logarithmic."""
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(299)] + [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("c4", "n250"), ("n010", "n020"), ("n100", "n257")]
    edge = spark.createDataFrame([("wordnet", a, b) for a, b in edges], EDGE)
    rounds = []
    write = taxonomy.written
    monkeypatch.setattr(taxonomy, "written", lambda df, label: (rounds.append(label), write(df, label))[1])
    got = {(r["anc"], r["desc"]): r["depth"] for r in taxonomy.closure(edge).collect()}
    kids = {}
    for a, b in edges:
        kids.setdefault(a, []).append(b)
    want = {}
    for start in {x for e in edges for x in e}:
        level, depth = {start}, 0
        while level:
            depth += 1
            level = {k for x in level for k in kids.get(x, ()) if (start, k) not in want}
            want.update({(start, k): depth for k in level})
    assert got == want and len(rounds) <= 11
    few = taxonomy.closure(edge, starts=spark.createDataFrame([("wordnet", "n290")], "family string, anc string"))
    assert {(r["anc"], r["desc"]): r["depth"] for r in few.collect()} == {k: v for k, v in want.items() if k[0] == "n290"}
