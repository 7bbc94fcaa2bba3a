"""The engine's operators against small fixtures and an independent set-based oracle."""

import itertools
import json
import random
from collections import deque
from math import comb

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import exact, text
from lexgrove.functions.hashing import canonical_json, stable_hash
from lexgrove.operators import audits, constraint, rendering, runlog, sampling, scoring, taxonomy, truth
from lexgrove.sources import files
from lexgrove.streaming import log_state

NODE = "family string, object_id string, surface string, gloss string, usable boolean"
EDGE = "family string, parent string, child string"


def make(spark, edges, unusable=()):
    ids = sorted({x for e in edges for x in e})
    node = spark.createDataFrame([("wordnet", i, i, f"about {i}", i not in unusable) for i in ids], NODE)
    return node, spark.createDataFrame([("wordnet", a, b) for a, b in edges], EDGE)


def closed_sets(edges):
    kids = {}
    for a, b in edges:
        kids.setdefault(a, set()).add(b)
    out = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), list(kids.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(kids.get(x, ()))
        out[n] = seen
    return out


#: Goods of a workshop; a rivet and a chair have two parents each.
WORKSHOP = [
    *(("goods", x) for x in ("timber", "metalware", "textile")),
    *(("timber", x) for x in ("chair", "plank", "joint")),
    *(("joint", x) for x in ("dovetail", "tenon", "lap", "bridle", "rivet")),
    *(("metalware", x) for x in ("rivet", "hinge", "blade")),
    *(("blade", x) for x in ("chisel", "saw")),
    *(("textile", x) for x in ("felt", "cord", "chair")),
]


def test_closure_shapes(spark):
    node, edge = make(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("q", "u"), ("u", "v")], unusable=("u",))
    got = {}
    for r in taxonomy.closure(taxonomy.usable_edges(node, edge)).collect():
        got.setdefault(r["anc"], set()).add(r["desc"])
    assert got["r"] == {"a", "b", "c", "d"} and got["x"] == {"x", "y"} and "q" not in got and "u" not in got


def random_dag(seed):
    r = random.Random(seed)
    n = r.randint(4, 11)
    return [(f"n{i:02}", f"n{j:02}") for i in range(n) for j in range(i + 1, n) if r.random() < 0.3] or [("n00", "n01")]


def queue_walk(edges, seed, sizes):
    up = {}
    for a, b in edges:
        up.setdefault(b, []).append(a)
    seen, out, todo = {seed}, [], deque([(seed, 0)])
    while todo:
        x, d = todo.popleft()
        if x != seed:
            if x in seen:
                continue
            seen.add(x)
            out.append((x, d))
        for p in sorted(up.get(x, []), key=lambda p: (sizes[p], p)):
            if p not in seen:
                todo.append((p, d + 1))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walk_and_counts_against_sets(spark, seed):
    edges = random_dag(seed)
    node, edge = make(spark, edges)
    g = constraint.graph(node, edge)
    below = closed_sets(edges)
    sizes = {k: len(v) for k, v in below.items()}
    assert {r["object_id"]: r["size"] for r in g.sizes.collect()} == sizes
    walk = {}
    for r in g.walk.orderBy("seed", "rank").collect():
        walk.setdefault(r["seed"], []).append((r["anc"], r["distance"]))
    assert walk == {s: w for s in below if (w := queue_walk(edges, s, sizes))}
    seeds = node.select("family", F.col("object_id").alias("seed"))
    kids = {n: [c for a, c in edges if a == n and below[c]] for n in below}
    for r in constraint.core_counts(constraint.cores(g, seeds), g).collect():
        s, a1 = below[r["a1"]], r["a1"]
        pre = s & set().union(*(below[b] for b in r["branches"])) if r["branches"] else s
        cut = set().union(*(below[b] for b in r["bs"])) if r["bs"] else set()
        outside = set(below) - s - {a1}
        near = set()
        for p, c in edges:
            if c == a1:
                for k in kids[p]:
                    if k != a1:
                        near |= {k} | below[k]
        near -= s | {a1}
        assert (r["positive"], r["hits_b"], r["fails"], r["outside"], r["excluded_scope"]) == (len(pre - cut), len(pre & cut), len(s - pre), len(outside), len(cut))
        assert r["near_sibling"] == (len(s - pre) if r["branches"] else len(near)) and r["hard"] == len(pre & cut) + (len(s - pre) if r["branches"] else len(near))
    for r in constraint.branch_sets(g.walk.select("family", "seed", F.col("anc").alias("a1")), g).collect():
        cover = sorted((k for k in kids[r["a1"]] if r["seed"] in below[k]), key=lambda k: (sizes[k], k))
        rest = sorted((k for k in kids[r["a1"]] if r["seed"] not in below[k]), key=lambda k: (-sizes[k], k))
        assert r["branches"] == sorted((cover[:1] + rest + cover[1:])[: r["k"]])


def test_samples_and_prompts_of_a_small_hierarchy(spark):
    node, edge = make(spark, WORKSHOP)
    g = constraint.graph(node, edge)
    seeds = node.where("object_id = 'plank'").select("family", F.col("object_id").alias("seed"))
    cores = constraint.seed_cores(g, seeds).where("a_count = 1 and b_count = 1")
    core = cores.first()
    assert (core["a1"], core["bs"], core["positive"], core["hits_b"]) == ("timber", ["joint"], 3, 5)
    visits = cores.select("family", "seed", "a1", "branches", "bs", "a_count", "b_count", "paired", "sources", "distance").join(sampling.windows(cores, g), ["family", "a1", "branches", "bs"])
    visits = visits.withColumns({"population": F.lit(20), "quota": F.lit(1), "h": F.lit("0")}).withColumn("task", F.explode(F.array(*map(F.lit, sampling.TASKS))))
    base = sampling.realise(visits, "p")
    rows = {r["task"]: r for r in base.collect()}
    assert set(rows) == {"T1", "T2", "T3"} and all(abs(r["inclusion"] - 0.05) < 1e-12 and r["weight"] == 20.0 for r in rows.values())
    assert rows["T1"]["gold_bool"] is True and rows["T2"]["gold_set"] is not None and len(rows["T3"]["candidates"]) == 4
    full = sampling.with_information(base)
    assert full.count() == 9 and sampling.violations(full).count() == 0
    judged = truth.gold(truth.trace(base.select(F.col("base_sample_id").alias("key"), "family", "a1", "branches", "bs", "candidates"), g.closed))
    for r in judged.withColumnRenamed("gold_set", "told").join(base, F.col("key") == F.col("base_sample_id")).collect():
        assert r["told"] == r["gold_set"] if r["task"] == "T2" else r["gold_any"] == r["gold_bool"]
    asked = rendering.prompt(rendering.with_nodes(full, node))
    assert rendering.request_faults(asked).count() == 0
    by = {(r["task"], r["information"]): r["prompt"] for r in asked.collect()}
    assert "notes" not in by["T1", "I0"] and "Concept notes:" in by["T1", "I1"] and "Candidate notes:" not in by["T1", "I1"] and "Candidate notes:" in by["T1", "I2"]
    assert by["T1", "I0"].startswith("You are given a concept-boundary question.\n\nTarget condition:\n- A1 timber is the outer required concept.\n- Exclude objects that are a kind of any concept below:\n- B1 joint\n")


def test_fold_respects_caps():
    f = sampling.Fold("p", 64, {"seed": 1})
    r = {"family": "f", "seed": "s", "a1": "a", "branches": [], "bs": [], "a_count": 1, "b_count": 0, "positive": ["x", "y"], "negative": ["n1", "n2", "n3", "n4"], "hard_negative": [], "easy_negative": []}
    got = f.build(r, "T1", 0)
    assert got[1] is True and f.admit(r, "T1", got[0]) and not f.admit(r, "T1", got[0])
    assert f.build({**r, "negative": ["n1"]}, "T2", 0) is None
    assert [len(f.build(r, "T2", v)[1]) for v in range(3)] == [0, 1, 2]


def test_target_sizes():
    assert sampling.target_size({"wordnet": 3, "babelnet": 1}) == {"base_samples": 360, "requests": 1080}
    assert sampling.target_size({"wordnet": 650, "babelnet": 100}) == {"base_samples": 67500, "requests": 202500}
    assert audits.gold_size_targets(650) == [217, 217, 216]


def test_hash_matches_python(spark):
    probe = ["plain", "日本", 'q"uote\\back/slash', "line\nfeed", "\x1f\x01", "😀", "\\u001F"]
    got = spark.createDataFrame([(p,) for p in probe], "t string").select("t", canonical_json(b=F.col("t"), a=F.lit(1), c=F.lit(None).cast("string")).alias("j"), stable_hash(24, b=F.col("t"), a=F.lit(1), c=F.lit(None).cast("string")).alias("h")).collect()
    for r in got:
        want = {"a": 1, "b": r["t"], "c": None}
        assert r["j"] == json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":")) and r["h"] == sampling.hash_text(want, 24)


ANSWERS = ["True, because x", "False.", "The answer is true.", "[1, 3]", "[]", "[1, 1]", "[5]", "", None, "I cannot answer", "Trueish", "**True**", "[True]", "[1, 3,]", "[01]", "[-1]", "[1.0]", "　true　", "[0x2]", "x" * 3000, "see [2] and [3]", "[", "[1_0]"]


def brute_parse(task, t, options=4, limit=2000):
    import ast
    import re

    s = (t or "")[:limit].strip()
    if task != "T2":
        m = re.match(r"[A-Za-z]+", s)
        return {"true": True, "false": False}.get(m.group().lower()) if m else None
    m = re.search(r"\[[^\]]*\]", s)
    try:
        v = ast.literal_eval(m.group()) if m else None
    except (SyntaxError, ValueError):
        v = None
    if not isinstance(v, list) or any(not isinstance(x, int) for x in v) or len(set(v)) != len(v) or any(not 1 <= x <= options for x in v):
        return None
    return [int(x) for x in v]


def test_answer_parsing(spark):
    d = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "i int, t string")
    for r in d.select("t", text.parse_bool(F.col("t")).alias("b"), text.parse_list(F.col("t"), F.lit(4)).alias("l"), text.is_refusal(F.col("t")).alias("no")).collect():
        assert r["b"] == brute_parse("T1", r["t"]) and r["l"] == brute_parse("T2", r["t"]), r
        assert r["no"] == (r["t"] == "I cannot answer")


def test_text_filters(spark):
    d = spark.createDataFrame([(["弥", "中文", "abc", "中文", ""], "中文\n", "ab_c"), (None, "x", "abc")], "s array<string>, h string, l string")
    a, b = d.select(text.clean_han_synonyms(F.col("s")).alias("s"), text.is_han(F.col("h")).alias("h"), text.is_clean_lemma(F.col("l")).alias("l")).collect()
    assert a["s"] == ["中文"] and a["h"] and not a["l"] and b["l"] and not b["h"]


LOG = "request_id long, ordinal long, status string, error_state string, final_answer_text string"


def test_log_state_and_stream(spark, tmp_path):
    rows = [(1, 0, "success", None, "True"), (2, 1, "error", "429", None), (3, 2, "error", "BadRequest", None), (1, 3, "error", "429", None)]
    d = spark.createDataFrame(rows, LOG)
    state = {r["request_id"]: (r["completed"], r["latest"]) for r in runlog.log_state(d).collect()}
    assert state == {1: (True, "retryable"), 2: (False, "retryable"), 3: (True, "permanent")}
    c = runlog.terminal_counts(runlog.log_state(d)).first()
    assert (c["success"], c["retryable"], c["permanent"], c["terminal"]) == (0, 2, 1, 1)
    asked = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "request_id long, ordinal long")
    assert [r["request_id"] for r in runlog.pending(asked, d, 1).collect()] == [2]
    assert {r["request_id"]: r["status"] for r in runlog.select_response(d).collect()}[1] == "success"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["request_id"]: (r["completed"], r["latest_status"]) for r in log_state.drain(s, str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    assert got == {1: (True, "error"), 2: (False, "error"), 3: (True, "error")}


def test_stream_state_over_late_and_repeated_rows(spark, tmp_path):
    """Many micro-batches in any order give the state of the whole log."""
    r = random.Random(12)
    rows = [(r.randrange(12), i, *r.choice([("success", None), ("error", "429"), ("error", "BadRequest"), ("error", None)]), None) for i in range(80)]
    rows += r.sample(rows, 10)
    r.shuffle(rows)
    for k in range(0, len(rows), 15):
        spark.createDataFrame(rows[k : k + 15], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = log_state.drain(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    cols = ["request_id", "completed", "attempts", "latest_status", "latest_error"]
    whole = runlog.log_state(spark.createDataFrame(rows, LOG))
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, whole.select(cols).collect()))
    assert len(list((tmp_path / "out").glob("batch=*"))) > 3


REQ = "request_id long, ordinal long, task string, family string, information string, a_count int, b_count int, sampling_weight double, base_sample_id long, option_count int, gold_bool boolean, gold_set array<int>"


def test_scores_and_rows_differ_by_design(spark):
    req = spark.createDataFrame([(1, 1, "T2", "f", "I0", 2, 1, 2.0, 1, 4, None, [1, 3]), (2, 2, "T1", "f", "I1", 1, 0, 1.0, 1, 4, True, None), (3, 3, "T1", "f", "I2", 1, 0, 1.0, 1, 4, False, None)], REQ)
    log = spark.createDataFrame([(1, 0, "error", "Timeout", None), (1, 1, "success", None, "[3, 1]"), (2, 2, "success", None, "I cannot answer")], LOG)
    s = {r["request_id"]: r for r in scoring.scores(req, log).collect()}
    assert s[1]["correct"] and s[2]["parse_error"] == "Refusal" and 3 not in s
    rows = scoring.evaluation_rows(req, log)
    e = {r["request_id"]: r for r in rows.collect()}
    assert e[2]["parse_error"] == "Format Error" and e[3]["parse_error"] == "Missing Response" and not e[3]["correct"]
    m = scoring.binary_metrics(rows, ["family"]).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (0, 0, 1, 1)
    t = {(r["slice"], r["label"]): r for r in scoring.slice_table(rows).collect()}
    assert t["", ""]["total"] == 3 and abs(t["", ""]["weighted_accuracy"] - 0.5) < 1e-9 and t["cell", "2,1"]["hits"] == 1
    assert scoring.information_effect(rows).first()["paired"] == 1
    sizes = {(r["gold_set_size"], r["predicted_size_label"]): r["share"] for r in scoring.set_size_table(rows).collect()}
    assert len(sizes) == 18 and sizes[2, "2"] == 1.0 and sizes[0, "0"] == 0.0


def test_exact_counts(spark):
    d = spark.createDataFrame([([3, 1, 2], 400), ([], 3)], "v array<int>, n int")
    r = d.select(exact.nearest_rank(F.col("v"), 0.5).alias("p"), exact.evenly_spread(F.col("v"), 2).alias("s"), exact.log10_combinations(F.col("n"), 5).alias("l")).collect()
    assert [x["p"] for x in r] == [2, 0] and r[1]["l"] == float("-inf") and r[0]["s"] == [3, 2]


def test_thresholds_and_scenarios(spark):
    cores = spark.createDataFrame([("wordnet", 1, 0, p, 9, 9) for p in (1, 3, 7)], "family string, a_count int, b_count int, positive int, negative int, hard int")
    p = {r["threshold"]: r for r in audits.threshold_populations(cores).collect()}
    assert p[1]["T1"] == 3 and p[2]["T1"] == 2 and p[5]["T2_all_gold_sizes"] == 1 and 10 not in p
    s = {r["scenario"]: r for r in audits.scheduler_scenarios(audits.threshold_populations(cores), {"wordnet": 2}, 2).collect()}
    assert s["A_balanced_simple"]["status"] == "audited_no_shortage" and s["C_balanced_with_fixed_hard_negative_ratio"]["status"] == "requires_candidate_level_audit"


def test_depth_options(spark):
    node, edge = make(spark, [("a1", "branch"), ("a1", "direct_b"), ("branch", "seed"), ("branch", "branch_b"), ("branch_b", "deep_b"), ("deep_b", "deep_leaf"), ("direct_b", "direct_leaf")])
    g = constraint.graph(node, edge)
    pairs = spark.createDataFrame([("wordnet", "seed", "a1", 1, ["branch"])], "family string, seed string, a1 string, k int, branches array<string>")
    names = lambda d: {r["b"] for r in audits.b_options_by_depth(pairs, g, d).collect()}
    assert names(1) == {"branch_b", "direct_b"} and names(None) == {"branch_b", "direct_b", "deep_b"}
    with pytest.raises(ValueError):
        audits.choose_by_policy(audits.b_options_by_depth(pairs, g, 1), 1, "other")


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(2, "é", None), (1, "b", 0.5)], "b int, a string, c double")
    files.write_jsonl(d, str(tmp_path / "j"))
    lines = sorted(x for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines())
    assert lines == ['{"a":"b","b":1,"c":0.5}', '{"a":"é","b":2,"c":null}']
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a string, b int").count() == 2
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a string").count() == 0
    files.write_json(str(tmp_path / "m.json"), {"b": 1, "a": "é"})
    assert files.read_json(str(tmp_path / "m.json")) == {"a": "é", "b": 1}
    (tmp_path / "c.toml").write_text('[run]\nlimit = 3\ndata_path = "x/y"\n')
    got = files.load_config(str(tmp_path / "c.toml"), {"run": {"limit": 1, "retries": 1}})
    assert got["run"]["limit"] == 3 and got["run"]["retries"] == 1 and got["run"]["data_path"].endswith("/x/y")


def test_loaders(spark):
    english = spark.createDataFrame([("a", ["x_y", "dog"], "an animal", ["b", "zz"]), ("b", ["x1"], "d", [])], "object_id string, lemmas array<string>, definition string, hyponyms array<string>")
    node, edge = taxonomy.nodes_from_english(english)
    assert {r["object_id"]: (r["surface"], r["usable"]) for r in node.collect()} == {"a": ("dog", True), "b": ("", False)}
    assert [(r["parent"], r["child"]) for r in edge.collect()] == [("a", "b")]
    chinese = spark.createDataFrame([(0, "a", "noun", ["旧"], "g", [], ["b"]), (1, "a", "noun", ["弥", "狗"], "g", [], ["b"]), (2, "b", "noun", ["人名"], "g", ["ProperName"], []), (3, "c", "verb", ["跑"], "g", [], [])], "ordinal int, object_id string, pos string, zh_synonyms array<string>, gloss string, sememes array<string>, hyponyms array<string>")
    node, _ = taxonomy.nodes_from_chinese(chinese)
    assert {r["object_id"]: (r["surface"], r["usable"]) for r in node.collect()} == {"a": ("狗", True), "b": ("人名", False)}


def test_catalogue_names():
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "truth_boundary" in q


def test_core_audits_run_over_the_whole_hierarchy(spark):
    import __spark_entry__ as entry
    from lexgrove.plans import driver_data

    d = "/root/testdata/sf0.001"
    n = driver_data.nodes(driver_data.edges(spark, d)).count()
    cell = entry.queries()["probe_summary"](spark, d).where("a_count = 1 and b_count = 0").first()
    assert cell["positive_max"] == n - 1
    assert {r["usable_seed_count"] for r in entry.queries()["feasibility"](spark, d).collect()} == {n}


def test_empty_cells_are_shortages(spark):
    kind = "family string, a_count int, b_count int, positive int, negative int, hard int"
    families = spark.createDataFrame([("wordnet",), ("wordnet",), ("babelnet",)], "family string")
    for cores, filled in (([("wordnet", 1, 0, p, 9, 9) for p in (1, 3, 7)], 1), ([], 0)):
        p = audits.threshold_populations(spark.createDataFrame(cores, kind), families)
        assert p.count() == 2 * 30 * len(audits.THRESHOLDS) and p.where("T1 > 0").where("threshold = 2").count() == filled
        s = {r["scenario"]: r for r in audits.scheduler_scenarios(p, {"wordnet": 2, "babelnet": 1}, 2).collect()}
        a, b = s["A_balanced_simple"], s["B_opportunistic_simple"]
        assert a["shortages"] == (60 - filled) * 4 and b["shortages"] == (60 - filled) * 3 and a["status"] == b["status"] == "quota_shortage"
    with pytest.raises(ValueError):
        audits.scheduler_scenarios(p, {"wordnet": 2}, 3)


def test_bench_times_all_operators():
    import bench
    import __spark_entry__ as entry

    assert all(n in bench.HEADLINE or any(h.endswith("_") and n.startswith(h) for h in bench.HEADLINE) for n in entry.queries() if n == "pipeline" or n.startswith("op"))
