"""Products, audits and the scheduler's probe against plain Python over sets."""

import json
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import audits, constraint, probe, providers, rendering, sampling, scoring, taxonomy
from lexgrove.sources import config, files, snapshots
from tests.test_engine import LOG, WORKSHOP, closed_sets, make, queue_walk

BRANCHY = [
    ("r", "a"), ("r", "b"), ("r", "c"), ("r", "d"), ("a", "e"), ("a", "f"), ("b", "f"), ("b", "g"), ("c", "g"), ("c", "h"), ("d", "h"), ("d", "i"), ("e", "j"), ("f", "j"), ("f", "k"), ("g", "k"), ("g", "l"), ("h", "l"), ("h", "m"),
    ("i", "m"), ("i", "n"), *[(p, f"{p}{i}") for p in "efghijklmn" for i in range(3)],
]


class Plain:
    """The same questions answered over sets, one seed at a time."""

    def __init__(self, edges):
        self.edges, self.below = edges, closed_sets(edges)
        self.size = {k: len(v) for k, v in self.below.items()}
        self.kids = {n: sorted(c for a, c in set(edges) if a == n and self.below[c]) for n in self.below}
        self.ids = sorted(self.below)

    def options(self, a1, branches, seed):
        out = {}
        for p in [*branches, a1]:
            for c in self.kids[p]:
                if seed not in self.below[c] and c not in out and not (p == a1 and c in branches):
                    out[c] = (p, "inside_A1" if p == a1 and p not in branches else "inside_positive_branch")
        return out

    def masks(self, a1, branches, bs):
        s = self.below[a1]
        pre = s & set().union(*(self.below[x] for x in branches)) if branches else s
        cut = set().union(*(self.below[x] for x in bs)) if bs else set()
        near = set()
        if not branches:
            for p, c in self.edges:
                if c == a1:
                    for k in self.kids[p]:
                        if k != a1:
                            near |= {k} | self.below[k]
            near -= s | {a1}
        outside = set(self.ids) - s - {a1}
        hard = (pre & cut) | (s - pre) | near
        return {"positive": pre - cut, "negative": (pre & cut) | (s - pre) | outside, "hard_negative": hard, "easy_negative": outside}

    def core(self, seed, a, b):
        for a1, distance in queue_walk(self.edges, seed, self.size):
            cover = sorted((k for k in self.kids[a1] if seed in self.below[k]), key=lambda k: (self.size[k], k))
            rest = sorted((k for k in self.kids[a1] if seed not in self.below[k]), key=lambda k: (-self.size[k], k))
            if a > 1 and not cover:
                continue
            branches = sorted((cover[:1] + rest + cover[1:])[: a - 1])
            if len(branches) != a - 1:
                continue
            got = self.options(a1, branches, seed)
            bs = sorted(got, key=lambda x: (-self.size[x], got[x][0], x))[:b]
            if len(bs) != b:
                continue
            m = self.masks(a1, branches, bs)
            if m["positive"] and m["negative"]:
                return {"seed": seed, "a1": a1, "branches": branches, "bs": bs, "masks": m, "distance": distance, "paired": [got[x][0] for x in bs]}
        return None

    def stratified(self, quota, product="test", limit=64, caps=None):
        """Every stratum in order, every seed in the order of its hash."""
        caps, used, out, tallies = caps or {}, Counter(), [], {}
        reuse = {k: Counter() for k in ("seed", "A1", "constraint", "candidate", "pool")}
        pick = lambda ids, n, salt: sorted(ids, key=lambda i: (used[i], sampling.hash_text({"salt": salt, "object_id": i})))[:n] if len(ids) >= n else []
        for task in ("T1", "T2", "T3"):
            for a in range(1, 6):
                for b in range(6):
                    cores = {s: c for s in self.ids if (c := self.core(s, a, b))}
                    target, done = min(quota, len(cores)), 0
                    key = lambda s: sampling.hash_text({"product_id": product, "tier": "test", "scheduler": sampling.SCHEDULER, "seed": 13, "dataset_family": "wordnet", "task": task, "a_count": a, "b_count": b, "seed_index": self.ids.index(s), "seed_id": s}, 32)  # noqa: B023, E731
                    for s in sorted(self.ids, key=key):
                        if done >= target:
                            break
                        if s not in cores:
                            continue
                        c, pools = cores[s], {}
                        salt = {"dataset_family": "wordnet", "task": task, "a_count": a, "b_count": b, "seed_id": s, "A1_id": c["a1"], "A_branch_ids": c["branches"], "B_ids": c["bs"], "variant_index": done, "product_id": product}
                        for name, ids in c["masks"].items():
                            pools[name] = sorted(sorted(ids)[: 8 * limit], key=lambda i: sampling.hash_text({"salt": {**salt, "stream": name}, "object_id": i}))[:limit]  # noqa: B023
                        hard, neg, base = pools["hard_negative"], pools["negative"], {"task": task, "variant": done}
                        if task == "T1":
                            got = pick(pools["positive"] if done % 2 == 0 else hard or neg, 1, {**base, "truth": done % 2 == 0})
                            if not got:
                                continue
                        else:
                            want = done % 3 if task == "T2" else int(done % 2 == 0)
                            yes = pick(pools["positive"], want, {**base, "kind": "positive"})
                            no = pick([i for i in (hard if len(hard) >= 4 - want else neg) if i not in yes], 4 - want, {**base, "kind": "negative"})
                            if len(yes) != want or len(no) != 4 - want:
                                continue
                            got = yes + no
                            if task == "T2" or want:
                                got = sorted(got, key=lambda i: sampling.hash_text({"pool": task, "variant": done, "object_id": i}))  # noqa: B023
                        keys = {"seed": [s], "A1": [c["a1"]], "constraint": [sampling.hash_text({"A1": c["a1"], "branches": c["branches"], "B": c["bs"]})], "candidate": got, "pool": [sampling.hash_text(got)] if task != "T1" else []}
                        if any(caps.get(k, 0) > 0 and reuse[k][x] >= caps[k] for k, xs in keys.items() for x in xs):
                            continue
                        for k, xs in keys.items():
                            reuse[k].update(xs)
                        used.update(got)
                        good = [k for k, i in enumerate(got, 1) if i in c["masks"]["positive"]]
                        gold = good if task == "T2" else bool(good)
                        payload = {"dataset_family": "wordnet", "task": task, "constraint_cell": [a, b], "seed_id": s, "A1_id": c["a1"], "A_branch_ids": c["branches"], "B_ids": c["bs"], "candidate_ids": got, "gold_answer": gold, "oracle_version": "a1_or_branches_minus_b", "frame_version": "seed_object_first"}
                        out.append((task, a, b, s, tuple(got), json.dumps(gold), "base_" + sampling.hash_text(payload, 24), payload))
                        done += 1
                    tallies[task, a, b] = (len(cores), done)
        return out, tallies


@pytest.fixture(scope="module")
def branchy(spark):
    g = constraint.graph(*make(spark, BRANCHY))
    seeds = g.node.select("family", F.col("object_id").alias("seed"))
    return g, seeds, constraint.written(constraint.seed_cores(g, seeds), "cores"), Plain(BRANCHY)


def test_cores_of_a_graph_with_several_parents(branchy):
    _, _, cores, plain = branchy
    got = {(r["seed"], r["a_count"], r["b_count"]): (r["a1"], r["branches"], r["bs"], r["paired"], r["positive"], r["hard"]) for r in cores.collect()}
    want = {(s, a, b): (c["a1"], c["branches"], c["bs"], c["paired"], len(c["masks"]["positive"]), len(c["masks"]["hard_negative"])) for s in plain.ids for a in range(1, 6) for b in range(6) if (c := plain.core(s, a, b))}
    assert got == want and any(b > 1 and a > 2 for _, a, b in got)


def test_options_and_their_first_ones(spark, branchy):
    g, seeds, _, plain = branchy
    pairs = g.walk.select("family", "seed", F.col("anc").alias("a1"))
    sets = constraint.written(constraint.branch_sets(pairs, g), "sets")
    rows = {(r["seed"], r["a1"], r["k"]): [x["b"] for x in r["chosen"]] for r in constraint.top_b(sets, g).collect()}
    full = {(r["seed"], r["a1"], r["k"]): [x["b"] for x in r["chosen"]] for r in constraint.choose_b(constraint.b_options(sets, g)).collect()}
    assert rows == full and len(rows) > 50


@pytest.mark.parametrize(("quota", "caps"), [(3, None), (4, {"seed": 2, "candidate": 6, "pool": 1, "constraint": 3})])
def test_samples_are_those_of_plain_python(branchy, quota, caps):
    g, seeds, cores, plain = branchy
    want, tallies = plain.stratified(quota, caps=caps)
    base, strata = sampling.stratified(cores, g, seeds, {"wordnet": quota}, "test", caps=caps, margin=0)
    got = {(r["task"], r["a_count"], r["b_count"], r["seed"], tuple(r["candidates"]), json.dumps(r["gold_set"] if r["task"] == "T2" else r["gold_bool"]), r["base_sample_id"]) for r in base.collect()}
    assert got == {w[:-1] for w in want} and len(want) > 60
    rows = {(r["task"], r["a_count"], r["b_count"]): r for r in strata.collect()}
    assert len(rows) == 90 and {k: (r["population"], r["accepted"]) for k, r in rows.items()} == tallies
    assert all((r["skipped_reason"] is None) == (r["accepted"] == min(quota, r["population"])) for r in rows.values())
    full = {(r["base_sample_id"], r["information"]): (r["sample_hash"], r["request_hash"]) for r in sampling.with_information(base).collect()}
    for *_, key, payload in want:
        for i in ("I0", "I1", "I2"):
            more = {**payload, "information": i, "renderer_version": "separated_gloss_v2"}
            assert full[key, i] == (sampling.hash_text(more, 32), sampling.hash_text({**more, "request_layer": "rendered_request"}, 32))


def test_windows_hold_the_lowest_ids(spark, branchy):
    g, _, cores, plain = branchy
    for size in (3, 512):
        for r in sampling.windows(cores, g, size).collect():
            for name, ids in plain.masks(r["a1"], r["branches"], r["bs"]).items():
                assert (r[name] or []) == sorted(ids)[:size], (r, name)


def test_population_comes_from_the_feasibility_table_where_it_has_the_cell(spark, branchy):
    g, seeds, cores, _ = branchy
    known = spark.createDataFrame([("wordnet", 1, 0, 20)], "family string, a_count int, b_count int, population long")
    s = {(r["a_count"], r["b_count"]): r for r in sampling.strata_of(cores, seeds, {"wordnet": 1}, known).where("task = 'T1'").collect()}
    assert s[1, 0]["population"] == 20 and s[1, 1]["population"] == s[1, 1]["found"] and len(s) == 30


def test_violations_are_found(spark, branchy):
    g, seeds, cores, _ = branchy
    base, _ = sampling.stratified(cores, g, seeds, {"wordnet": 2}, "test")
    full = constraint.written(sampling.with_information(base), "full")
    assert sampling.violations(full, g.closed).count() == 0 and sampling.stream_validation(full, g.closed)["passed"]
    one = full.orderBy("sample_id").first()["sample_id"]
    hit = F.col("sample_id") == one
    swap = lambda c, v: full.withColumn(c, F.when(hit, v).otherwise(F.col(c)))
    cases = {
        "a_count_out_of_range": swap("a_count", F.lit(6)), "condition_count": swap("condition_count", F.lit(99)), "b_provenance": swap("paired", F.array(*[F.lit("x")] * 6)),
        "candidate_count": swap("candidates", F.array()), "paired_payload": swap("seed", F.lit("zz")), "information_levels": full.where(~hit), "duplicate_sample_id": full.unionByName(full.where(hit)),
        "duplicate_request_hash": full.unionByName(full.where(hit)), "oracle_mismatch": full.withColumn("gold_bool", ~F.col("gold_bool")),
    }
    for rule, rows in cases.items():
        assert rule in {r["rule"] for r in sampling.violations(rows, g.closed).select("rule").distinct().collect()}, rule
    bad = sampling.stream_validation(cases["information_levels"], g.closed)
    assert bad["unpaired_base_sample_count"] == 1 and not bad["passed"]


def test_full_tier_and_its_resume(branchy):
    g, _, cores, plain = branchy
    few = cores.where("a_count <= 2 and b_count <= 1")
    base = constraint.written(sampling.full_frame(few, g, "test", chunk=7, tasks=("T1", "T2")), "full")
    rows = base.orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(len(rows))) and all(r["weight"] == 1.0 for r in rows)
    whole = sampling.full_frame(few, g, "test", chunk=1000, tasks=("T1", "T2")).orderBy("ordinal").collect()
    assert [(r["base_sample_id"], r["variant"]) for r in whole] == [(r["base_sample_id"], r["variant"]) for r in rows]
    order = [(r["task"], r["a_count"], r["b_count"], r["seed"]) for r in rows]
    assert order == sorted(order)
    made = sampling.with_information(base)
    keys = ["family", "ordinal", "information"]
    assert sampling.missing_after(made.where("ordinal < 5"), made, keys).count() == made.where("ordinal >= 5").count()
    with pytest.raises(ValueError, match="differ"):
        sampling.missing_after(made.withColumn("sample_hash", F.lit("x")), made, keys)
    with pytest.raises(ValueError, match="beyond"):
        sampling.missing_after(made.withColumn("ordinal", F.col("ordinal") + 10_000), made, keys)
    assert sampling.rolling_hash(made, keys, "sample_hash") == sampling.rolling_hash(made.repartition(5), keys, "sample_hash")


def test_manifest_and_reuse(branchy):
    g, seeds, cores, _ = branchy
    base, strata = sampling.stratified(cores, g, seeds, {"wordnet": 2}, "test")
    m = sampling.manifest(base, strata, "test", "test", {"wordnet": 2}, 1)
    rows = base.collect()
    assert m["base_sample_count"] == len(rows) and len(m["strata"]) == 90 and m["renderer_version"] == "separated_gloss_v2"
    assert m["reuse_counts"]["candidate"]["most"] == max(Counter(c for r in rows for c in r["candidates"]).values())
    pools = {(r["kind"], r["value"]): r["n"] for r in sampling.reuse_counts(base).where("kind in ('pool', 'constraint')").collect()}
    r = next(r for r in rows if r["task"] == "T2")
    assert pools["pool", sampling.hash_text(r["candidates"])] >= 1 and pools["constraint", sampling.hash_text({"A1": r["a1"], "branches": r["branches"], "B": r["bs"]})] >= 1


def test_negative_sources(branchy):
    g, seeds, cores, plain = branchy
    base, _ = sampling.stratified(cores, g, seeds, {"wordnet": 2}, "test")
    got = {(r["base_sample_id"], r["source"]): r["n"] for r in sampling.negative_sources(base, g).collect()}
    want = Counter()
    for r in base.collect():
        s = plain.below[r["a1"]]
        pre = s & set().union(*(plain.below[x] for x in r["branches"])) if r["branches"] else s
        m = plain.masks(r["a1"], r["branches"], r["bs"])
        for c in r["candidates"]:
            if c not in m["positive"]:
                want[r["base_sample_id"], "hits_B" if c in pre else "fails_positive_branch" if c in s else "near_sibling" if not r["branches"] and c in m["hard_negative"] else "outside_A1"] += 1
    assert got == want


# --- the scheduler's probe -----------------------------------------------------------------------


def plain_simulation(frame, strategy, plain, threshold, limit):
    """One strategy, a core at a time: samples with their candidates, and what was passed over."""
    used, made, skipped = Counter(), [], 0

    def select(ids, n, avoid):
        free = [i for i in ids if i not in avoid]
        if n <= 0 or len(free) < n:
            return []
        return free[:n] if strategy == "hash_balanced" else sorted(free, key=lambda i: (used[i], sampling.hash_text({"reuse": i})))[:n]

    def negatives(pools, n, index, avoid):
        mode = ("hard_first", "mixed", "easy_first")[index % 3] if strategy == "reuse_aware_mixed_negatives" else "hard_first"
        out = []
        for source, want in {"hard_first": (("hard", n), ("easy", n)), "easy_first": (("easy", n), ("hard", n)), "mixed": (("hard", n // 2), ("easy", n - n // 2), ("hard", n), ("easy", n))}[mode]:
            out += select(pools[f"{source}_negative"], min(want, n - len(out)), set(avoid) | set(out))
        if len(out) < n:
            out += select(pools["negative"], n - len(out), set(avoid) | set(out))
        return out

    cells = {}
    for r in frame:
        if r["positive"] >= threshold:
            cells.setdefault((r["a_count"], r["b_count"]), []).append(r)
    for cell in sorted(cells):
        for index, r in enumerate(sorted(cells[cell], key=lambda r: sampling.hash_text({"family": "wordnet", "core": r["core_id"]}))):
            pools = {n: sorted(sorted(ids)[: 8 * limit], key=lambda i: sampling.hash_text({"stream": n, "salt": r["core_id"], "object_id": i}))[:limit] for n, ids in plain.masks(r["a1"], r["branches"], r["bs"]).items()}
            for task, want, size in (("T1", int(index % 2 == 0), 1), ("T2", index % 3, 4), ("T3", int(index % 2 == 0), 4)):
                yes = select(pools["positive"], want, ())
                no = negatives(pools, size - want, index, yes)
                if len(yes) == want and len(no) == size - want:
                    used.update(yes + no)
                    made.append((cell, task, index, tuple(yes + no)))
                elif not (task == "T1" and want):
                    skipped += 1
    return made, skipped


def test_simulation_is_that_of_plain_python(spark, branchy):
    g, seeds, _, plain = branchy
    frame = constraint.written(probe.probe_frame(constraint.seed_cores(g, seeds, need_negative=False), 4), "frame")
    rows = frame.collect()
    assert max(Counter((r["a_count"], r["b_count"]) for r in rows).values()) == 4
    sim = constraint.written(probe.simulate(probe.probe_windows(frame, g, 8), threshold=2, limit=8), "sim")
    metrics = {r["strategy"]: r for r in probe.strategy_metrics(sim).collect()}
    assert set(metrics) == set(probe.STRATEGIES)
    for strategy in probe.STRATEGIES:
        made, skipped = plain_simulation(rows, strategy, plain, 2, 8)
        got = {((r["a_count"], r["b_count"]), r["task"], r["row_index"], tuple(r["candidates"])) for r in sim.where(F.col("strategy") == strategy).where("built").collect()}
        m = metrics[strategy]
        assert got == set(made) and m["base_samples"] == len(made) > 50 and m["skipped_count"] == skipped and m["validation"] == "pass"
        reuse = Counter(c for *_, ids in made for c in ids)
        assert (m["candidate_reuse"]["n"], m["candidate_reuse"]["max"]) == (len(reuse), max(reuse.values()))
    assert metrics["hash_balanced"]["candidate_reuse"]["max"] >= metrics["reuse_aware"]["candidate_reuse"]["max"]


def test_simulation_faults_are_seen(spark):
    kind = "strategy string, family string, a_count int, b_count int, task string, answer string, candidates array<string>, built boolean, pool string"
    rows = [("s", "f", 1, 0, "T1", "true", ["a"], True, None), ("s", "f", 1, 0, "T1", "true", ["b"], True, None), ("s", "f", 1, 0, "T2", "0", ["a", "a", "b", "c"], True, "p"), ("s", "f", 1, 0, "T3", "true", ["a", "b", "c"], True, None)]
    sim = spark.createDataFrame(rows, kind)
    assert {r["fault"] for r in probe.simulation_faults(sim).collect()} == {"T1 missing answer false", "repeated_candidate", "pool_size", "pool_count"}
    assert {r["task"]: r["imbalance"] for r in probe.cell_imbalances(sim).collect()} == {"T1": 2, "T2": 1, "T3": 1}


def test_probe_summary_and_structural_counts(spark, branchy):
    g, _, _, plain = branchy
    got = {(r["a_count"], r["b_count"]): r for r in probe.probe_summary(probe.probe_cores(g), audits.structural_counts(g)).collect()}
    from itertools import combinations
    from math import comb

    for a in (1, 2, 3):
        for b in (0, 1, 2):
            n = sum(comb(len(k), b) if a == 1 else sum(comb(sum(len(plain.kids[x]) for x in s), b) for s in combinations(k, a - 1)) for k in plain.kids.values() if k)
            assert got[a, b]["constraints"] == str(n) and got[a, b]["heads"] == sum(1 for k in plain.kids.values() if k)
    assert got[5, 5]["status"] in ("infeasible", "available") and got[1, 0]["positive_max"] == plain.size["r"]
    frame = audits.sampling_frame(audits.scaled_task_populations(probe.probe_cores(g), audits.structural_counts(g)))
    assert frame.count() == 90


# --- audits --------------------------------------------------------------------------------------


def test_seed_cells_and_frames(spark, branchy):
    g, seeds, _, plain = branchy
    found = constraint.written(constraint.seed_cores(g, seeds, need_negative=False), "found")
    cells = constraint.written(audits.seed_cells(found, constraint.missing_reasons(g, seeds), seeds), "cells")
    rows = found.collect()
    for c in cells.collect():
        own = [r for r in rows if (r["a_count"], r["b_count"]) == (c["a_count"], c["b_count"])]
        assert c["seed_total"] == len(plain.ids) and c["feasible"] == len(own) and c["hard_ge_2"] == sum(r["hard"] >= 2 for r in own)
        assert sum((c["missing_reasons"] or {}).values()) == len(plain.ids) - len(own)
        if own:
            values = sorted(r["positive"] for r in own)
            assert c["quantiles"]["positive"]["p50"] == values[round((len(values) - 1) * 0.5)] and c["quantiles"]["positive"]["max"] == values[-1]
            assert [x["seed"] for x in c["examples"]] == sorted(r["seed"] for r in own)[:5]
            assert sum((c["b_sources"] or {}).values()) == sum(r["b_count"] for r in own)
        assert c["status"] == ("infeasible" if not own else "shortage" if len(own) < 10 else "available")
    frame = audits.sampling_frame(audits.task_populations(cells))
    total = audits.sampling_summary(frame).first()
    assert total["strata"] == 90 and total["full_requests"] == 3 * total["full_base_samples"] and total["main_shortages"] == 90
    assert audits.top_heads(found).where("rank = 1").count() == len({(r["a_count"], r["b_count"]) for r in rows})


def test_threshold_summary_and_plan(spark):
    cores = spark.createDataFrame([("wordnet", 1, 0, p, 9, 9) for p in (1, 3, 7)], "family string, a_count int, b_count int, positive int, negative int, hard int")
    p = audits.threshold_populations(cores, cores.select("family"))
    s = {r["threshold"]: r for r in audits.threshold_summary(p, {"wordnet": 2}).collect()}
    assert s[1]["min_T1"] == 0 and s[1]["base_samples"] == 9 and s[1]["requests"] == 27 and s[1]["shortages"] == 29 * 4
    plan = {(r["a_count"], r["b_count"]): r for r in audits.gold_size_plan(p, {"wordnet": 8}, 1).collect()}
    assert (plan[1, 0]["size_0"], plan[1, 0]["size_1"], plan[1, 0]["size_2"], plan[1, 0]["possible"]) == (3, 3, 2, False)
    lines = {r["scenario"]: r["examples"] for r in audits.scheduler_scenarios(p, {"wordnet": 2}, 1).collect()}
    assert all(len(x) == audits.SHORTAGES for x in lines.values())


def test_depth_policies(spark):
    edges = [
        *(("land", x) for x in ("estate", "lake", "hill", "moor", "dune")), *(("estate", x) for x in ("farm", "mill")), *(("mill", x) for x in ("wheel", "stone")),
        *(("farm", x) for x in ("plot", "stable")), ("stable", "stall"), ("stall", "rack"), ("rack", "hook"),
    ]
    g = constraint.graph(*make(spark, edges))
    seeds = spark.createDataFrame([("wordnet", "plot")], "family string, seed string")
    frame = constraint.written(probe.probe_frame(constraint.seed_cores(g, seeds, need_negative=False)).where("a_count = 2 and b_count = 1"), "frame")
    assert frame.first()["a1"] == "estate" and frame.first()["bs"] == ["stable"]
    r = audits.depth_comparison(frame, g).first()
    assert (r["direct"], r["depth2"], r["all"], r["same_largest"], r["deepest_depth"]) == (2, 3, 4, True, 3)
    options = audits.b_options_by_depth(frame.selectExpr("family", "seed", "a1", "1 as k", "branches"), g, None)
    chosen = {p: audits.policy_cores(frame, options, g, p).first()["bs"] for p in audits.POLICIES}
    assert chosen == {"largest_closure": ["stable"], "smallest_closure": ["rack"], "deepest_then_smallest": ["rack"]}
    compared = audits.depth_comparison(frame, g)
    assert audits.depth_cells(compared).first()["rows"] == 1 and audits.depth_summary(compared).where("name = 'all'").first()["max"] == 4


def test_resource_audit_and_inventory(spark):
    node, edge = make(spark, WORKSHOP, unusable=("felt",))
    g = constraint.graph(node, edge)
    r = audits.resource_audit(node, g.sizes).first()
    n = node.count()
    assert (r["raw"], r["usable"]) == (n, n - 1) and abs(r["usable_coverage"] - (n - 1) / n) < 1e-12 and r["surface_coverage"] == 1.0
    assert set(r["closure_sizes"]) == {b for b, _ in taxonomy.BUCKETS} and sum(r["closure_sizes"].values()) == n - 1
    inv = {x["object_id"]: x for x in audits.object_inventory(node, g).collect()}
    assert inv["goods"]["direct_usable_child_count"] == 3 and inv["joint"]["closure_size"] == 5 and inv["rivet"]["usable_parent_count"] == 2 and "felt" not in inv
    top = {(x["measure"], x["rank"]): x["object_id"] for x in taxonomy.top_nodes(g.edge, g.sizes, g.children).collect()}
    assert top["closure", 1] == "goods" and top["children", 1] == "goods"


# --- configuration, providers, snapshots ---------------------------------------------------------


def test_experiment_files(tmp_path):
    (tmp_path / "providers.toml").write_text('[one]\nbase_url = "http://x"\ndefault_model = "m1"\nrequest_adapter = "plain_openai"\nrecommended_max_concurrency = 2\nsupports_reasoning_channel = false\n')
    (tmp_path / "e.toml").write_text('name = "e"\ntasks = ["T1"]\n[matrix]\na_count = [1, 2]\n[resources]\nbabelnet_enabled = false\nbabelnet_path = "data/x"\n[budgets]\nmax_seed_reuse = 5\n[product]\nwordnet_quota_per_stratum = 7\n[provider]\nname = "one"\nthinking = "on"\nmax_concurrency = 3\nreasoning_effort = "huge"\n')
    c = config.load_experiment(tmp_path / "e.toml")
    assert c.tasks == ("T1",) and c.matrix.a_count == (1, 2) and c.budgets.caps()["seed"] == 5 and c.product.quotas() == {"wordnet": 7, "babelnet": 1}
    assert c.resources.families() == ["wordnet"] and c.resources.babelnet_path == str(tmp_path / "data/x") and (c.provider.model, c.provider.base_url) == ("m1", "http://x")
    errors, warnings = config.setting_faults(c, "one")
    assert len(errors) == 2 and len(warnings) == 1
    assert config.settings_for_run(c, "mock").protocol == "local_mock" and config.setting_faults(c, "other")[0] and "provider" not in config.dataset_snapshot(c)
    assert config.load_experiment(tmp_path / "e.toml", tmp_path / "none.toml").provider.model == ""


def test_request_shaping():
    s = config.ProviderSettings(name="p", model="m", thinking="on", reasoning_effort="low", request_adapter="deepseek_reasoning_effort")
    body = providers.request_body(s, [{"role": "user", "content": "q"}])
    assert body["extra_body"] == {"thinking": {"type": "enabled"}} and body["reasoning_effort"] == "low" and body["max_tokens"] == 128
    assert providers.extra_body(replace(s, request_adapter="aliyun_enable_thinking")) == {"enable_thinking": True}
    assert providers.extra_body(replace(s, request_adapter="nvidia_gemma_chat_template", save_reasoning=False))["include_reasoning"] is False
    assert "reasoning_effort" not in providers.request_body(replace(s, thinking="off"), [])
    with pytest.raises(providers.ProviderFault):
        providers.extra_body(replace(s, request_adapter="none"))
    sent = []

    def send(b):
        sent.append(b)
        if len(sent) > 1:
            raise TimeoutError("slow")
        return {"choices": [{"message": {"content": "True", "reasoning": "x" * 10}}]}

    p = providers.ChatProvider(replace(s, reasoning_char_limit=4), send)
    ask = {"request_id": "r", "system_prompt": "s", "prompt": "q"}
    first, second = p.call(ask, 1), p.call(ask, 2)
    assert first["final_answer_text"] == "True" and first["reasoning_text"] == "xxxx" and first["reasoning_truncated"] and sent[0]["messages"][0]["role"] == "system"
    assert second["status"] == "error" and second["error_state"] == "TimeoutError: slow" and first["attempt_id"] != second["attempt_id"]
    assert providers.MockProvider("empty").call({"request_id": "r", "task": "T1"}, 1)["final_answer_text"] == ""


def test_snapshots_and_parts(spark, tmp_path):
    node = spark.createDataFrame([("wordnet", "a", "A", "g", ["s"], ["b"], [], {"surface": True}, {"k": "v"}), ("wordnet", "b", "B", None, [], [], ["a"], {}, {})], snapshots.NODE)
    snapshots.export_snapshot(node, str(tmp_path / "resource_snapshot.json"))
    back = snapshots.load_snapshot(spark, str(tmp_path / "resource_snapshot.json"))
    assert sorted(map(str, back.select(*node.columns).collect())) == sorted(map(str, node.collect()))
    assert [tuple(r) for r in snapshots.edges_of(back).collect()] == [("wordnet", "a", "b")] and snapshots.load_snapshot(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "feasibility.jsonl").write_text(json.dumps({"dataset_family": "wordnet", "task": "T1", "a_count": 1, "b_count": 0, "feasible_seed_cell_count": 9, "constraint_cell": [1, 0]}) + "\n")
    f = snapshots.load_feasibility(spark, str(tmp_path / "feasibility.jsonl"))
    assert f.first()["recommended_pool_size"] == 4 and f.first()["surface_coverage"] == 1.0 and snapshots.populations(f).first()["population"] == 9
    audit = {"cell_rows": [{"dataset_family": "wordnet", "a_count": 1, "b_count": 0, "counts_by_min_final_positive": {"5": {"T1": 3, "T2_any": 2, "T2_all_gold_sizes": 1, "T3": 4}}}]}
    files.write_json(str(tmp_path / "t.json"), audit)
    assert tuple(snapshots.load_threshold_audit(spark, str(tmp_path / "t.json")).first()) == ("wordnet", 1, 0, 5, 3, 2, 1, 4)
    rows = spark.createDataFrame([(i // 3, f"I{i % 3}", f"x{i:02}") for i in range(30)], "base int, information string, name string")
    assert snapshots.write_parts(rows.repartition(4), str(tmp_path / "parts"), "base", 3, 12) == 3
    assert sorted(p.name for p in (tmp_path / "parts").iterdir()) == ["part-00000.jsonl", "part-00001.jsonl", "part-00002.jsonl"] and snapshots.part_faults(str(tmp_path / "parts")) == []
    read = snapshots.load_requests(spark, str(tmp_path / "parts"), "information string, name string").orderBy("ordinal").collect()
    assert [r["name"] for r in read] == [f"x{i:02}" for i in range(30)] and [r["ordinal"] for r in read] == list(range(30))
    (tmp_path / "parts/part-00001.jsonl").write_text("{}\n")
    (tmp_path / "parts/part-00002.jsonl").rename(tmp_path / "parts/part-00003.jsonl")
    assert len(snapshots.part_faults(str(tmp_path / "parts"))) == 2


def test_run_context(tmp_path):
    (tmp_path / "d").mkdir()
    files.write_json(str(tmp_path / "d/config_snapshot.json"), {"name": "e", "provider": {"name": "x"}})
    files.write_json(str(tmp_path / "d/sample_manifest.json"), {"source_feasibility": "/far/away"})
    (tmp_path / "d/feasibility.jsonl").write_text("{}\n")
    out = snapshots.copy_context(str(tmp_path / "d/requests.jsonl"), str(tmp_path / "r"))
    assert set(out) == {"dataset_config_snapshot.json", "sample_manifest.json", "feasibility.jsonl"}
    assert files.read_json(out["dataset_config_snapshot.json"]) == {"name": "e"} and files.read_json(out["sample_manifest.json"])["source_feasibility"] == "feasibility.jsonl"


# --- reports -------------------------------------------------------------------------------------


def test_reports(spark):
    kind = "request_id long, ordinal long, task string, family string, information string, a_count int, b_count int, sampling_weight double, base_sample_id long, option_count int, gold_bool boolean, gold_set array<int>, a1 string, branches array<string>, bs array<string>, candidates array<string>"
    req = spark.createDataFrame([
        (1, 1, "T2", "wordnet", "I0", 1, 1, 2.0, 1, 4, None, [1], "timber", [], ["joint"], ["chair", "tenon", "cord", "plank"]), (2, 2, "T1", "wordnet", "I1", 1, 0, 1.0, 1, 4, True, None, "timber", [], [], ["chair"]),
    ], kind)
    log = spark.createDataFrame([(1, 0, "success", None, "[1, 2]"), (2, 1, "success", None, "x" * 3000)], LOG)
    told = {r["request_id"]: r for r in scoring.predictions(scoring.scores(req, log)).collect()}
    assert told[1]["parsed_set"] == [1, 2] and told[2]["answer_truncated"] and not told[1]["answer_truncated"] and told[2]["parse_error_type"] == "Format Error"
    rows = scoring.evaluation_rows(req, log)
    _, edge = make(spark, WORKSHOP)
    frame = {r["pos"]: (r["category"], r["selected"]) for r in scoring.candidate_frame(rows, taxonomy.closure(edge)).collect()}
    assert frame == {1: ("positive", True), 2: ("B-excluded", True), 3: ("other-negative", False), 4: ("other-negative", False)}
    m = scoring.evaluation_metrics(rows, log, scoring.candidate_frame(rows, taxonomy.closure(edge)))
    assert m["overall"]["total"] == 2 and m["overall"]["response_rows_seen"] == 2 and m["overall_accuracy_matrix"] == {"index": [1], "columns": [0, 1], "values": [[0.0, 0.0]]}
    assert {x["category"]: x["chosen"] for x in m["t2_candidate_summary"]} == {"positive": 1, "B-excluded": 1, "other-negative": 0}
    with pytest.raises(ValueError):
        scoring.evaluation_metrics(rows.where("false"), log)
    shown = spark.createDataFrame([(0.12345, 1234567.0), (None, 0.5), (float("nan"), float("nan"))], "p double, n double").select(scoring.as_percent(F.col("p")).alias("p"), scoring.as_number(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in shown] == [("12.35%", "1,234,567"), ("", "0.5000"), ("", "")]
    assert scoring.markdown(["a", "b"], [[1, None], [0.5, "x"]]) == "| a | b |\n| --- | --- |\n| 1 |  |\n| 0.5000 | x |"
    raw = spark.createDataFrame([('{"usage":{"completion_tokens":7},"choices":[{"finish_reason":"stop"}]}',), ('{"choices":[{"stop_reason":"len"}]}',), (None,)], "raw_response string")
    assert [(r["completion_tokens"], r["finish_reason"]) for r in scoring.usage(raw).collect()] == [(7, "stop"), (0, "len"), (0, "unknown")]
    gold = scoring.normal_gold(spark.createDataFrame([("T2", None, None), ("T1", None, [1])], "task string, gold_bool boolean, gold_set array<int>")).collect()
    assert (gold[0]["gold_set"], gold[0]["gold_bool"], gold[1]["gold_bool"], gold[1]["gold_set"]) == ([], None, False, None)


def test_chinese_prompt(spark):
    node = spark.createDataFrame([("babelnet", i, f"词{i}", f"释{i}", True) for i in ("a", "b", "x", "c")], "family string, object_id string, surface string, gloss string, usable boolean")
    s = spark.createDataFrame([("s1", "babelnet", "T1", "I2", "a", ["b"], ["x"], ["c"])], "sample_id string, family string, task string, information string, a1 string, branches array<string>, bs array<string>, candidates array<string>")
    r = rendering.prompt(rendering.with_nodes(s, node)).first()
    assert r["prompt"].startswith("请判断下面的概念边界题。\n\n目标条件：\n- A1 词a 是外层必须满足的概念。\n") and "- A2 词b" in r["prompt"] and "- B1 词x" in r["prompt"] and "候选解释：" in r["prompt"]
    assert [m["role"] for m in r["messages"]] == ["system", "user"] and r["sample_request_hash"] == r["request_hash"]


def test_unused_pools_and_families(spark):
    node, edge = make(spark, WORKSHOP)
    closed = taxonomy.closure(edge)
    pool = {}
    for r in taxonomy.sibling_pool(edge, closed).collect():
        pool.setdefault(r["object_id"], set()).add(r["member"])
    assert pool["plank"] == {"chair", "joint", "dovetail", "tenon", "lap", "bridle", "rivet"}
    sizes = taxonomy.closure_sizes(node, closed)
    assert taxonomy.direct_children(edge, sizes, 5).where("parent = 'goods'").count() == 2
    english = spark.createDataFrame([("a", ["dog"], "an animal", [])], "object_id string, lemmas array<string>, definition string, hyponyms array<string>")
    assert taxonomy.inventories(english, None, ["wordnet", "babelnet"])[0].count() == 1
    with pytest.raises(ValueError):
        taxonomy.inventories(english, None, ["babelnet"])
    few = taxonomy.closure(edge, starts=spark.createDataFrame([("wordnet", "timber")], "family string, anc string"))
    assert {r["desc"] for r in few.collect()} == closed_sets(WORKSHOP)["timber"] and few.where("anc <> 'timber'").count() == 0


def test_first_left_matches_plain_selection(spark):
    r = random.Random(4)
    universe = [("f", "p", j, f"c{j:03}", 1000 - j) for j in range(1, 60)]
    ranked = spark.createDataFrame(universe, "family string, parent string, j int, child string, size int")
    gone = {k: set(r.sample(range(1, 60), n)) for k, n in ((1, 0), (2, 5), (3, 40), (4, 59))}
    keys = spark.createDataFrame([(k, "f", "p") for k in gone], "id long, family string, parent string")
    removed = spark.createDataFrame([(k, "p", j) for k, js in gone.items() for j in js], "id long, parent string, j int")
    got = {}
    for x in constraint.first_left(keys, removed, ranked, 4).collect():
        got.setdefault(x["id"], []).append(x["j"])
    assert {k: sorted(v) for k, v in got.items()} == {k: [j for j in range(1, 60) if j not in js][:4] for k, js in gone.items() if len(js) < 59}
