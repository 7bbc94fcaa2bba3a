"""Operators over kinds of nodes: as many rows are made for many equal leaves as for few, and results are those of all nodes."""

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import audits, bitmaps, constraint, ranks, sampling, taxonomy
from lexgrove.plans import catalog
from tests.test_engine import WORKSHOP, closed_sets, make


def grown(times):
    """The workshop with ``times`` copies of each node without children."""
    heads = {a for a, _ in WORKSHOP}
    return [(a, b if b in heads or not i else f"{b}{i}") for a, b in WORKSHOP for i in range(1 if b in heads else times)]


@pytest.fixture(scope="module")
def made(spark):
    node, edge = make(spark, grown(5))
    return node, edge, constraint.graph(node, edge)


def test_leaves_of_the_same_parents_are_alike(spark, made):
    node, _, g = made
    like = {r["object_id"]: r["like"] for r in g.member.collect()}
    assert like["felt3"] == like["cord"] == "cord" and like["rivet2"] == "rivet" and like["hinge4"] == "hinge" and like["blade"] == "blade"
    few = constraint.graph(*make(spark, grown(1)))
    assert g.lean.walk.count() == few.lean.walk.count() and g.lean.words.count() == few.lean.words.count()
    closed = closed_sets(grown(5))
    assert {r["object_id"]: r["size"] for r in g.sizes.collect()} == {k: len(v) for k, v in closed.items()}
    assert {(r["anc"], r["desc"]) for r in g.closed.select("anc", "desc").collect()} == {(a, d) for a, x in closed.items() for d in x}


def test_search_of_kinds_is_that_of_all_seeds(made):
    node, _, g = made
    seeds = node.select("family", F.col("object_id").alias("seed"))
    got = constraint.search(g, seeds, need_negative=False)
    cols = ("seed", "a_count", "b_count", "a1", "branches", "bs", "positive", "negative", "hard")
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    plain = constraint.Graph(g.node, g.edge, g.closed, g.sizes, g.children, g.walk)
    every = constraint.search(plain, seeds, need_negative=False)
    assert rows(got.found) == rows(every.found) and got.built < every.built
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(audits.threshold_populations(got.counted())) == flat(audits.threshold_populations(every.found))
    for n in (1, 4):
        assert rows(got.first(n)) == rows(every.first(n))


def test_windows_hold_the_lowest_nodes_of_all_kinds(made):
    node, _, g = made
    cores = constraint.search(g, node.select("family", F.col("object_id").alias("seed"))).found
    plain = constraint.Graph(g.node, g.edge, g.closed, g.sizes, g.children, g.walk)
    flat = lambda df: sorted(str(r) for r in df.select("a1", "branches", "bs", *sampling.STREAMS).collect())
    for size in (2, 7, 512):
        assert flat(sampling.windows(cores, g, size)) == flat(sampling.windows(cores, plain, size))


def test_scopes_of_siblings_by_weight(spark):
    # A leaf that lies under its own sibling: the others of its kind do too, and count.
    edges = [("r", "s"), ("r", "a"), ("r", "b"), ("s", "a"), ("s", "b"), ("s", "c"), ("r", "t"), ("t", "u")]
    node, edge = make(spark, edges)
    g = constraint.graph(node, edge)
    for kids, pairs in ((g.children, taxonomy.siblings(g.edge, g.children, g.closed)), (g.edge, taxonomy.sibling_pool(g.edge, g.closed))):
        lean = kids if kids is g.children else g.lean.edge
        got = bitmaps.sibling_sizes(g.lean.node, g.lean.edge, lean, g.lean.words, g.lean.places, *g.lean.planes)
        got = {r["object_id"]: r["near"] for r in got.withColumnRenamed("object_id", "like").join(g.member, ["family", "like"]).collect()}
        assert got == {r["object_id"]: r["n"] for r in pairs.groupBy("object_id").agg(F.count("*").alias("n")).collect()}


def test_sibling_pools_of_all_nodes(spark, tmp_path, monkeypatch):
    # Many leaves of one parent, of two parents, and one without a sibling: all have their pools, and pairs are not made.
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    many = 200
    tables = {
        "region": ("r_regionkey int", [(0,), (1,)]),
        "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, 0), (2, 1)]),
        "customer": ("c_custkey int, c_nationkey int", [(i, 0) for i in range(many)] + [(many, 1), (many + 1, 2)]),
        "supplier": ("s_suppkey int, s_nationkey int", [(0, 0), (1, 2)]),
        "part": ("p_partkey int, p_type string, p_brand string", [(i, "SMALL", "x") for i in range(many)] + [(many, "SMALL", "y"), (many + 1, "LARGE", "y"), (many + 2, "SOLE", "z")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = {("ROOT", f"R{r}") for r, in tables["region"][1]} | {(f"R{r}", f"N{n}") for n, r in tables["nation"][1]}
    edges |= {(f"N{n}", f"{c}{k}") for c, t in (("C", "customer"), ("S", "supplier")) for k, n in tables[t][1]}
    edges |= {e for k, t, b in tables["part"][1] for e in (("ROOT", f"T:{t}"), ("ROOT", f"B:{b}"), (f"T:{t}", f"P{k}"), (f"B:{b}", f"P{k}"))}
    closed, kids = closed_sets(sorted(edges)), {}
    for p, c in edges:
        kids.setdefault(p, set()).add(c)
    pool = {c: set() for _, c in edges}
    for p, c in edges:
        pool[c] |= {m for s in kids[p] - {c} for m in {s} | closed[s]}
    want = {c: len(m - closed[c] - {c}) for c, m in pool.items() if m - closed[c] - {c}}
    assert want["C0"] == want["P0"] == many and f"C{many}" not in want and f"P{many + 2}" not in want

    sizes, real = [], bitmaps.written

    def seen(df, name, *more):
        out = real(df, name, *more)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(bitmaps, "written", seen)
    got = entry.queries()["sibling_pool"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r["object_id"]: r["near"] for r in got} == want
    assert max(sizes) < many
    db = duckdb.connect()
    for name in tables:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(db.execute(entry.oracle_sql()["sibling_pool"]).fetchall()) == sorted(want.items())


def test_sizes_of_kinds_are_told_without_dealing_nodes_by_kind(made, monkeypatch):
    _, _, g = made
    pairs = taxonomy.sibling_pool(g.edge, g.closed).groupBy("object_id").agg(F.count("*").alias("near"))
    want = sorted(map(tuple, pairs.collect()))
    few = catalog._near(g, g.lean.edge)
    assert sorted(map(tuple, few.collect())) == want and "hashpartitioning" not in few._jdf.queryExecution().toString()
    monkeypatch.setattr(ranks, "FEW_GROUPS", 3)
    assert sorted(map(tuple, catalog._near(g, g.lean.edge).collect())) == want


def test_walks_down_are_made_once_for_all_seeds(spark, made, monkeypatch):
    node, _, g = made
    sizes, real = [], taxonomy.written

    def seen(df, name, *more):
        out = real(df, name, *more)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(taxonomy, "written", seen)
    starts = node.select("family", F.lit("goods").alias("src"), F.col("object_id").alias("seed"))
    got = taxonomy.descendants_without_seed(g.children, g.closed, starts, None)
    closed = closed_sets(grown(5))
    kids = {x for x in closed["goods"] if closed[x]}
    assert {(r["seed"], r["desc"]) for r in got.collect()} == {(s, d) for s in closed for d in kids if s not in closed[d]}
    assert max(sizes) <= len(kids)


def test_line_places_writes_parts_in_many_tasks(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from lexgrove.plans import scale

    read, files = scale.parts.read_records, []

    def seen(s, path, schema):
        files.append(s.read.text(path).select(F.input_file_name().alias("f")).distinct().count())
        return read(s, path, schema)

    monkeypatch.setattr(scale.parts, "read_records", seen)
    spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 100).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = {r["doc_id"]: r["ordinal"] for r in entry.queries()["line_places"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert min(files) > 1
    assert [i for i, _ in sorted(rows.items(), key=lambda x: x[1])] == [i for i in range(3000) if i % 3 == 0] + [i for i in range(3000) if i % 3]


def test_samples_of_kinds_are_those_of_all_seeds(made):
    node, _, g = made
    seeds = node.select("family", F.col("object_id").alias("seed"))
    got = constraint.search(g, seeds)
    flat = lambda df: sorted(str(r.asDict()) for r in df.collect())
    for quota in (1, 6):
        base, strata = sampling.stratified(got.counted(), g, seeds, {"wordnet": quota}, "test", margin=0, asked=got.asked)
        every, all_ = sampling.stratified(got.found, g, seeds, {"wordnet": quota}, "test")
        assert flat(base.drop("scanned")) == flat(every.drop("scanned")) and flat(strata) == flat(all_)


def test_visits_are_not_written(spark, made, monkeypatch):
    """Hashes of all seeds, cells and tasks are read in one pass, and those about the wanted ones are all that is written."""
    rows = spark.range(30_000).select((F.col("id") % 2).alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    sizes, written = [], ranks.written

    def told(df, label, by=()):
        out = written(df, label, by)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ranks, "written", told)
    wanted = spark.createDataFrame([(0, 50, 15_000), (1, 3, 15_000), (2, 9, 0)], "k long, need long, found long")
    got = ranks.first_of_known(rows, ["k"], wanted).collect()
    every = {k: sorted((r["h"], r["id"]) for r in rows.where(f"k = {k}").collect()) for k in (0, 1)}
    assert sorted((r["k"], r["n"], r["id"]) for r in got) == [(k, n, i) for k, need in ((0, 50), (1, 3)) for n, (_, i) in enumerate(every[k][:need], 1)]
    assert max(sizes) < 250
    # Groups that turn out shorter than their hashes promise are read again.
    few = rows.where("h >= '4'")
    found = few.where("k = 0").count()
    got = ranks.first_of_known(few, ["k"], spark.createDataFrame([(0, 500, found)], "k long, need long, found long")).collect()
    assert sorted(r["id"] for r in got) == sorted(i for h, i in [x for x in every[0] if x[0] >= "4"][:500])


def test_visits_have_the_hash_of_seed_order(spark):
    names = ['a', 'b"{}', "c\\u001f}", "d\u001f", "{e", "語"]
    rows = spark.createDataFrame([("wordnet", s, a, b, s, [], [], 1) for s in names for a, b in ((1, 0), (5, 5), (2, 3))], "family string, seed string, a_count int, b_count int, a1 string, branches array<string>, bs array<string>, distance int")
    kinds = spark.createDataFrame([("wordnet", s, s) for s in names] + [("wordnet", "a2", "a"), ("wordnet", "z", "z")], "family string, seed string, like string")
    got = sampling.visits(rows, kinds, "p}", "t{", "s", 13)
    want = sampling.seed_order(got.drop("h"), "p}", "t{", "s", 13)
    flat = lambda df: sorted(str(r.asDict()) for r in df.select("task", "a_count", "b_count", "seed", "seed_index", "h").collect())
    assert flat(got) == flat(want) and got.count() == 7 * 3 * 3


def test_rounds_share_what_does_not_change(spark, monkeypatch):
    """Children by the seeds under them and the sizes of heads are made once for all rounds of a search."""
    node, edge = make(spark, WORKSHOP)
    g, labels, written = constraint.graph(node, edge), [], constraint.written
    monkeypatch.setattr(constraint, "written", lambda df, label, by=(): labels.append(label) or written(df, label, by))
    constraint.search(g, node.select("family", F.col("object_id").alias("seed")))
    assert labels.count("counts") > 1 and labels.count("covers") == labels.count("heads") == 1


def test_search_writes_no_more_for_more_leaves(spark, monkeypatch):
    """Twice as many leaves of the same kinds: only the table of all seeds grows, no table of the search does."""
    rows, written = {}, constraint.written
    for times in (4, 8):
        node, edge = make(spark, grown(times))
        g, sizes = constraint.graph(node, edge), {}

        def told(df, label, by=()):
            out = written(df, label, by)
            sizes[label] = sizes.get(label, 0) + out.count()
            return out

        monkeypatch.setattr(constraint, "written", told)
        constraint.missing_reasons(g, node.select("family", F.col("object_id").alias("seed"))).collect()
        monkeypatch.setattr(constraint, "written", written)
        rows[times] = sizes
    asked = {times: sizes.pop("asked") for times, sizes in rows.items()}
    assert asked[8] > 1.5 * asked[4] and rows[8] == rows[4] and sum(rows[8].values()) > 0


def test_results_of_all_seeds_are_told_by_many_tasks(spark, monkeypatch):
    """The table of seeds is small and is read by few tasks; what is told of the seeds has more rows, and tasks by the number of seeds."""
    monkeypatch.setattr(constraint, "TOLD", 2_000, raising=False)
    kinds = constraint.written(spark.createDataFrame([("w", f"k{i}", n, [f"x{i}", "y"]) for i in range(3) for n in range(4)], "family string, seed string, b_count int, branches array<string>"), "found")
    monkeypatch.setattr(constraint, "_search", lambda *_: constraint.Search(kinds, kinds, kinds, kinds, 12))
    member = spark.range(20_000).select(F.lit("w").alias("family"), F.concat(F.lit("s"), "id").alias("object_id"), F.concat(F.lit("k"), F.col("id") % 3).alias("like"))
    g = constraint.Graph(*[member] * 6, member=member, lean=member)
    got = constraint.search(g, member.select("family", F.col("object_id").alias("seed")))
    for make in (lambda: got.found, lambda: got.chosen("b_count", F.array_join("branches", ",").alias("branches"))):
        rows = make()
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 10 and sum(sizes) == 80_000 and max(sizes) < 12_000
    told = {(r["seed"], r["b_count"], r["branches"]) for r in rows.collect()}
    assert told == {(f"s{i}", n, f"x{i % 3},y") for i in range(20_000) for n in range(4)}
