"""A1-first audit and the candidate scheduler's simulation."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions import exact, residues
from lexgrove.functions.hashing import stable_hash
from lexgrove.operators import taxonomy
from lexgrove.operators.constraint import A_COUNTS, B_COUNTS, POOL, Graph, choose_b, core_counts
from lexgrove.operators.sampling import STREAMS, hash_text, windows

#: The strategies; the first knows nothing of usage, the last turns through three ways to choose negatives.
STRATEGIES, TURNS = ("hash_balanced", "reuse_aware", "reuse_aware_mixed_negatives"), ("hard_first", "mixed", "easy_first")
ANSWERS = {"T1": ("false", "true"), "T2": ("0", "1", "2"), "T3": ("false", "true")}
PROBE_ROWS = 80
SETS = ("largest", "smallest", "lexical", "spread", "hashed")


def probe_branch_sets(g: Graph) -> DataFrame:
    """(family, a1, k, set, branches): up to five distinct sets of k children of each node, by how they were picked.

    Largest and smallest closures, first by id, evenly spread by (size, id), and first by hash; a set that was picked before is left out.
    """
    key = F.struct
    kids = g.children.withColumn("h", stable_hash(16, a1=F.col("parent"), child=F.col("child"))).groupBy("family", F.col("parent").alias("a1")).agg(
        F.array_sort(F.collect_list(key((-F.col("size")).alias("o"), "child"))).alias("largest"), F.array_sort(F.collect_list(key(F.col("size").alias("o"), "child"))).alias("smallest"),
        F.array_sort(F.collect_list("child")).alias("lexical"), F.array_sort(F.collect_list(key(F.col("h").alias("o"), "child"))).alias("hashed"),
    )
    out = None
    for k in range(1, max(A_COUNTS)):
        picks = {
            "largest": F.slice(F.col("largest.child"), 1, k), "smallest": F.slice(F.col("smallest.child"), 1, k), "lexical": F.slice("lexical", 1, k),
            "spread": exact.evenly_spread(F.col("smallest.child"), k), "hashed": F.slice(F.col("hashed.child"), 1, k),
        }
        sets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("set"), F.array_sort(picks[n]).alias("branches")) for i, n in enumerate(SETS)))
        rows = kids.where(F.size("lexical") >= k).select("family", "a1", F.lit(k).alias("k"), F.explode(sets).alias("s")).select("family", "a1", "k", "s.*").where(F.size("branches") == k)
        out = rows if out is None else out.unionByName(rows)
    first = F.row_number().over(Window.partitionBy("family", "a1", "k", "branches").orderBy("i"))
    return out.withColumn("n", first).where("n = 1").select("family", "a1", "k", "set", "branches")


def probe_cores(g: Graph) -> DataFrame:
    """(family, a1, a_count, b_count, branches, bs): cores without a seed, each with its largest options, and their counts.

    With branches only their children are options, else a1's.
    """
    heads = g.children.select("family", F.col("parent").alias("a1")).distinct()
    lone = heads.select("family", "a1", F.lit(0).alias("k"), F.array().cast("array<string>").alias("branches"))
    sets = lone.unionByName(probe_branch_sets(g).select("family", "a1", "k", "branches")).withColumn("seed", F.array_join("branches", "\x00"))
    at = F.when(F.size("branches") > 0, F.transform("branches", lambda x, i: F.struct(i.alias("stage"), x.alias("paired")))).otherwise(F.array(F.struct(F.lit(0).alias("stage"), F.col("a1").alias("paired"))))
    asked = sets.select("family", "a1", "k", "seed", "branches", F.explode(at).alias("p")).select("family", "a1", "k", "seed", "branches", "p.*")
    found = asked.join(g.children.select("family", F.col("parent").alias("paired"), F.col("child").alias("b"), "size"), ["family", "paired"])
    best = found.groupBy("family", "a1", "k", "seed", "b", "size").agg(F.min(F.struct("stage", "paired")).alias("f"))
    chosen = choose_b(best.select("family", "seed", "a1", "k", "b", "size", "f.paired", F.lit("probe").alias("source")))
    rows = sets.join(chosen, ["family", "seed", "a1", "k"], "left").withColumn("b_count", F.explode(F.sequence(F.lit(0), F.coalesce(F.size("chosen"), F.lit(0)))))
    bs = F.when(F.col("b_count") > 0, F.transform(F.slice("chosen", F.lit(1), F.col("b_count")), lambda x: x["b"])).otherwise(F.array().cast("array<string>"))
    rows = rows.select("family", "a1", (F.col("k") + 1).alias("a_count"), "b_count", "branches", bs.alias("bs"))
    return rows.join(core_counts(rows, g), ["family", "a1", "branches", "bs"])


def quantiles(df: DataFrame, keys: list[str], columns: list[str], many: str | None = None) -> DataFrame:
    """(keys, name, n, min, p50, p90, p99, max): nearest-rank quantiles of several whole-number columns in one pass; a row counts ``many`` times, if given."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("v")) for c in columns))).alias("x")
    own = [many] if many else []
    return taxonomy.value_quantiles(df.select(*keys, *own, each).select(*keys, *own, "x.*").where("v is not null"), [*keys, "name"], "v", F.col(many) if many else None)


def probe_summary(cores: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """Per family and cell of cores without a seed: how many were probed and are feasible, quantiles of positives, status, share.

    With ``structural`` (family, a1, a_count, b_count, n as text) also how many nodes can head a constraint and how many
    constraints there are, exactly, as text. A cell without any constraint is infeasible; one with
    constraints of which none was probed is a shortage. Every family has all 30 cells.
    """
    keys = ["family", "a_count", "b_count"]
    ok = (F.col("positive") >= 1) & (F.col("negative") >= 1)
    g = cores.groupBy(*keys).agg(F.count("*").alias("probed"), F.count_if(ok).alias("feasible"))
    spread = quantiles(cores, keys, ["positive"]).select(*keys, *(F.col(c).alias(f"positive_{c}") for c in ("min", "p50", "p90", "p99", "max")))
    out = _cells(cores.select("family")).join(g, keys, "left").join(spread, keys, "left")
    if structural is None:
        some = F.col("probed") > 0
    else:
        heads = structural.groupBy(*keys).agg(F.count("*").alias("heads"))
        total = residues.sum_texts(structural, keys, "n", "constraints")
        out = out.join(heads, keys, "left").join(total, keys, "left").fillna(0, ["heads"]).fillna("0", ["constraints"])
        some = F.col("constraints") != "0"
    out = out.fillna(0, ["probed", "feasible", *(f"positive_{c}" for c in ("min", "p50", "p90", "p99", "max"))])
    status = F.when(~some, "infeasible").when(F.col("probed") > 0, "available").otherwise("shortage")
    return out.withColumn("status", status).withColumn("share", exact.rate_or_zero(F.col("feasible"), F.col("probed")))


def _cells(families: DataFrame) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("a_count"), F.lit(b).alias("b_count")) for a in A_COUNTS for b in B_COUNTS))).alias("c")
    return families.distinct().select("family", cells).select("family", "c.*")


def probe_frame(found: DataFrame, rows: int = PROBE_ROWS) -> DataFrame:
    """``found`` (cores of seeds with their counts) with ``core_id``: the first ``rows`` of each family and cell, by seed id."""
    n = F.row_number().over(Window.partitionBy("family", "a_count", "b_count").orderBy("seed"))
    core = stable_hash(16, dataset_family=F.col("family"), seed_id=F.col("seed"), a_count=F.col("a_count"), b_count=F.col("b_count"), A1=F.col("a1"), A_branches=F.col("branches"), B=F.col("bs"))
    return found.withColumn("n", n).where(F.col("n") <= rows).drop("n").withColumn("core_id", F.concat(F.lit("seed_"), core))


_SIM = (
    "strategy string, family string, a_count int, b_count int, task string, row_index int, core_id string, candidates array<string>, answer string, "
    "hard int, easy int, fallback_any int, fallback boolean, built boolean, pool string"
)


class Selection:
    """State of one strategy: how often each candidate was used."""

    def __init__(self, strategy: str) -> None:
        self.strategy, self.used = strategy, Counter()

    def pick(self, ids: list[str], count: int, avoid: set[str]) -> list[str]:
        """``count`` ids that are not to be avoided, or none: the window's first, or the least used, by hash."""
        free = [i for i in ids if i not in avoid]
        if count <= 0 or len(free) < count:
            return []
        if self.strategy == STRATEGIES[0]:
            return free[:count]
        return sorted(free, key=lambda i: (self.used[i], hash_text({"reuse": i})))[:count]

    def negatives(self, pools: dict[str, list[str]], count: int, index: int, avoid: set[str]) -> tuple[list[str], dict[str, int], bool]:
        """Negatives, how many came from each source, and whether the last resort, any negative, had to serve or failed too.

        A source gives all that is asked of it or nothing; half and half asks again for what is then missing.
        """
        turn = TURNS[index % 3] if self.strategy == STRATEGIES[2] else TURNS[0]
        half = count // 2
        plan = {"hard_first": [("hard", count), ("easy", count)], "easy_first": [("easy", count), ("hard", count)], "mixed": [("hard", half), ("easy", count - half), ("hard", count), ("easy", count)]}[turn]
        out: list[str] = []
        took = {"hard": 0, "easy": 0, "any": 0}
        for source, upto in plan:
            want = min(upto, count - len(out)) if upto == count else upto
            got = self.pick(pools[f"{source}_negative"], want, avoid | set(out))
            out += got
            took[source] += len(got)
        short = len(out) < count
        if short:
            got = self.pick(pools["negative"], count - len(out), avoid | set(out))
            out += got
            took["any"] += len(got)
        return out, took, short


def simulate(rows: DataFrame, strategies: tuple[str, ...] = STRATEGIES, threshold: int = 5, limit: int = 64) -> DataFrame:
    """Samples that each strategy would build from ``rows``: (family, a_count, b_count, core_id, positive count, and the four windows).

    Rows below ``threshold`` final positives take no part. Within a cell rows go by hash, numbered from 0; the number decides truth and
    gold size. Candidates are a window's ``limit`` first by a hash salted with core and stream. Usage passes from cell to cell
    of a strategy and family, whose ids are its own: one fold each. Rows come with ``built`` false where candidates lacked.
    """
    kept = rows.where(F.col("positive_count") >= threshold)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        strategy, family, out = pdf["strategy"].iloc[0], pdf["family"].iloc[0], []
        state = Selection(strategy)
        order = pdf.assign(h=[hash_text({"family": family, "core": c}) for c in pdf["core_id"]]).sort_values(["a_count", "b_count", "h"], kind="stable")
        for (a, b), cell in order.groupby(["a_count", "b_count"], sort=False):
            for index, r in enumerate(cell.to_dict("records")):
                pools = {}
                for s in STREAMS:
                    ids = list(r[s])[: 8 * limit] if r[s] is not None else []
                    pools[s] = sorted(ids, key=lambda i, s=s: hash_text({"stream": s, "salt": r["core_id"], "object_id": i}))[:limit]
                for task, wanted in (("T1", int(index % 2 == 0)), ("T2", index % 3), ("T3", int(index % 2 == 0))):
                    size = 1 if task == "T1" else POOL
                    yes = state.pick(pools["positive"], wanted, set())
                    no, took, fell = state.negatives(pools, size - wanted, index, set(yes)) if size > wanted else ([], {"hard": 0, "easy": 0, "any": 0}, False)
                    fine = len(yes) == wanted and len(no) == size - wanted
                    if fine:
                        state.used.update(yes + no)
                    answer = str(wanted) if task == "T2" else ("true" if wanted else "false")
                    pool = hash_text({"pool": sorted(yes + no)}) if fine and size > 1 else None
                    out.append((strategy, family, a, b, task, index, r["core_id"], yes + no if fine else [], answer, took["hard"], took["easy"], took["any"], fell, fine, pool))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SIM.split(", ")])

    each = kept.withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    return each.groupBy("strategy", "family").applyInPandas(fold, _SIM)


def probe_windows(frame: DataFrame, g: Graph, limit: int = 64) -> DataFrame:
    """A probe frame with the windows of its constraints, as ``simulate`` takes it."""
    keyed = frame.select("family", "a_count", "b_count", "core_id", "a1", "branches", "bs", F.col("positive").alias("positive_count"))
    return keyed.join(windows(keyed, g, 8 * limit), ["family", "a1", "branches", "bs"])


def strategy_metrics(simulated: DataFrame) -> DataFrame:
    """One row per strategy: samples by task and answer, negatives by source, reuse of candidates and pools, imbalance of cells, faults.

    Counters are maps with sorted keys. A T1 row without a positive is neither built nor skipped.
    """
    fine = simulated.where("built")
    skipped = ~F.col("built") & ~((F.col("task") == "T1") & (F.col("answer") == "true"))
    base = simulated.groupBy("strategy").agg(
        F.count_if("built").alias("base_samples"), F.count_if(skipped).alias("skipped_count"), F.count_if(F.col("built") & F.col("fallback")).alias("fallback_count"),
        *(F.coalesce(F.sum(F.when(F.col("built"), F.col(c))), F.lit(0)).alias(n) for c, n in (("hard", "hard"), ("easy", "easy"), ("fallback_any", "fallback_any_negative"))),
    )
    tasks = counter_map(fine, ["strategy"], F.col("task"), "task_counts")
    answers = counter_map(fine, ["strategy"], F.concat_ws(":", "task", "answer"), "answer_counts")
    uses = fine.select("strategy", F.explode("candidates").alias("id")).groupBy("strategy", "id").agg(F.count("*").alias("v"))
    pools = fine.where("pool is not null").groupBy("strategy", "pool").agg(F.count("*").alias("v"))
    spread = lambda df, name: taxonomy.value_quantiles(df, ["strategy"], "v").select("strategy", F.struct("n", "min", "p50", "p90", "p99", "max").alias(name))
    out = base.join(tasks, "strategy", "left").join(answers, "strategy", "left").join(spread(uses, "candidate_reuse"), "strategy", "left").join(spread(pools, "pool_reuse"), "strategy", "left")
    out = out.join(spread(cell_imbalances(simulated).withColumnRenamed("imbalance", "v"), "cell_answer_imbalance"), "strategy", "left")
    bad = simulation_faults(simulated).groupBy("strategy").agg(F.array_sort(F.collect_list("fault")).alias("issues"))
    none = F.array().cast("array<string>")
    return out.join(bad, "strategy", "left").withColumn("issues", F.coalesce("issues", none)).withColumn("validation", F.when(F.size("issues") == 0, "pass").otherwise("fail"))


def counter_map(rows: DataFrame, keys: list[str], label: Column, name: str, many: Column | None = None) -> DataFrame:
    """(keys, name): counts of labels as a map whose keys are strings in order; a row counts ``many`` times, if given."""
    n = rows.groupBy(*keys, label.cast("string").alias("k")).agg((F.count("*") if many is None else F.sum(many)).alias("v"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))


def simulation_faults(simulated: DataFrame) -> DataFrame:
    """(strategy, fault, n): answers of a task that never came though it has samples enough, pools that repeat a candidate or lack one, pool counts that differ from samples."""
    fine = simulated.where("built")
    size = F.when(F.col("task") == "T1", 1).otherwise(POOL)
    wrong = fine.select("strategy", F.explode(F.filter(F.array(
        F.when(F.size(F.array_distinct("candidates")) != F.size("candidates"), "repeated_candidate"), F.when(F.size("candidates") != size, "pool_size"),
        F.when((F.col("task") != "T1") & F.col("pool").isNull(), "pool_count"),
    ), lambda x: x.isNotNull())).alias("fault")).groupBy("strategy", "fault").agg(F.count("*").alias("n"))
    per = fine.groupBy("strategy", "task").agg(F.count("*").alias("n"), F.collect_set("answer").alias("seen"))
    labels = F.create_map(*[x for t, a in ANSWERS.items() for x in (F.lit(t), F.array(*map(F.lit, a)))])[F.col("task")]
    missing = per.where(F.col("n") >= F.size(labels)).select("strategy", F.col("task"), F.explode(F.array_except(labels, "seen")).alias("answer"))
    return wrong.unionByName(missing.groupBy("strategy", F.concat(F.col("task"), F.lit(" missing answer "), F.col("answer")).alias("fault")).agg(F.count("*").alias("n")))


def cell_imbalances(simulated: DataFrame) -> DataFrame:
    """(strategy, family, a_count, b_count, task, imbalance): most minus least samples over a task's answers; an answer that never came counts 0."""
    keys = ["strategy", "family", "a_count", "b_count", "task"]
    labels = F.create_map(*[x for t, a in ANSWERS.items() for x in (F.lit(t), F.array(*map(F.lit, a)))])[F.col("task")]
    fine = simulated.where("built")
    every = fine.select(*keys).distinct().select(*keys, F.explode(labels).alias("answer"))
    n = fine.groupBy(*keys, "answer").agg(F.count("*").alias("n"))
    return every.join(n, [*keys, "answer"], "left").fillna(0, ["n"]).groupBy(*keys).agg((F.max("n") - F.min("n")).alias("imbalance"))
