"""Audits over cores: structural counts, thresholds, scheduler scenarios, exclusion depth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions import exact, residues
from lexgrove.operators import taxonomy
from lexgrove.operators.constraint import A_COUNTS, B_COUNTS, Graph, capacity, core_counts
from lexgrove.operators.probe import counter_map, quantiles
from lexgrove.operators.work import written

# Thresholds of positives, quotas of the test and main products, scenarios, lengths of lists.
THRESHOLDS = (1, 2, 5, 10, 20, 50, 100)
TEST_QUOTAS = {"wordnet": 3, "babelnet": 1}
QUOTAS = {"wordnet": 650, "babelnet": 100}
SCENARIOS = (
    ("A_balanced_simple", "balanced_gold_sizes", "prefer"), ("B_opportunistic_simple", "opportunistic_gold_sizes", "prefer"),
    ("C_balanced_with_fixed_hard_negative_ratio", "balanced_gold_sizes", "fixed_ratio"),
)
SHORTAGES, PLANS, TOP, EXAMPLES = 20, 12, 12, 5
#: Counts of a core whose quantiles the audits give.
MEASURES = ("a1_scope", "positive_pre", "excluded_scope", "positive", "hits_b", "fails", "outside", "negative", "hard")
_CELL = ["family", "a_count", "b_count"]


def _many(found: DataFrame) -> Column:
    """How many seeds a row of found cores stands for: its ``seeds``, if it is counted by kinds, else one."""
    return F.col("seeds") if "seeds" in found.columns else F.lit(1).cast("long")


def _count(when: Column, many: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, many)), F.lit(0).cast("long"))


def structural_counts(g: Graph) -> DataFrame:
    """(family, a1, a_count, b_count, branch_sets and n as text): sets of branches and constraints each node can head, exactly, at every size.

    Without branches b of its children are excluded; else for each set of k children b of the set's children together.
    With n children below each child, the latter are the coefficient of x^b in the k-th elementary symmetric polynomial of
    the (1 + x)^n. Power sums give it, so children are summed and no node's list of children is ever gathered.
    """
    kids = g.children.groupBy("family", F.col("parent").alias("child")).agg(F.count("*").alias("n"))
    per = g.children.join(kids, ["family", "child"], "left").select("family", F.col("parent").alias("a1"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    # Children that have equally many children of their own are one row.
    alike = written(per.groupBy("family", "a1", "n").agg(F.count("*").alias("times")), "alike")
    widest = alike.groupBy("family", "a1").agg(F.sum("times").alias("kids"), F.max("n").alias("n")).agg(F.max("kids").alias("kids"), F.max("n").alias("n")).first()
    most, widths = max(A_COUNTS) - 1, max(B_COUNTS)
    # A bound of every count: choices of children, times choices among all that the widest ones have below.
    bits = max(most, widths) * math.log2(1 + (widest["kids"] or 0)) + widths * math.log2(1 + most * (widest["n"] or 0))
    moduli = residues.primes(bits)
    p = F.col("p")
    rows = alike.withColumn("m", F.explode(residues.modulus(moduli))).select("family", "a1", "n", "times", "m.*")
    powers = {j: [f"s{j}_{b}" for b in range(widths + 1)] for j in range(1, most + 1)}
    terms = [F.sum(residues.times(residues.choose(F.col("n") % p * j % p, b, p, moduli), F.col("times") % p, p)).alias(c) for j, names in powers.items() for b, c in enumerate(names)]
    sums = rows.groupBy("family", "a1", "i", "p").agg(F.sum("times").alias("kids"), *terms)
    sums = sums.select("family", "a1", "i", "p", (F.col("kids") % p).alias("kids"), *((F.col(c) % p).alias(c) for names in powers.values() for c in names))
    made = residues.elementary(powers, p, moduli, sums)
    value = lambda a, b: residues.choose(F.col("kids"), b, p, moduli) if a == 1 else F.col(f"e{a - 1}_{b}")
    cells = [(a, b) for a in A_COUNTS for b in B_COUNTS]
    values = F.array(*(value(a, b) for a, b in cells)).alias("values")
    sets = F.array(*(residues.choose(F.col("kids"), a - 1, p, moduli) for a, _ in cells)).alias("sets")
    each = made.groupBy("family", "a1").agg(F.array_sort(F.collect_list(F.struct("i", values, sets))).alias("of"))
    cell = F.explode(F.array(*(F.struct(F.lit(a).alias("a_count"), F.lit(b).alias("b_count"), F.lit(i).alias("at")) for i, (a, b) in enumerate(cells)))).alias("c")
    at = lambda name: F.transform("of", lambda x: x[name][F.col("c.at")]).alias(name)
    rows = each.select("family", "a1", "of", cell).select("family", "a1", "c.a_count", "c.b_count", at("sets"), at("values"))
    rows = residues.text_of(F.col("sets"), moduli, rows, "branch_sets")
    return residues.text_of(F.col("values"), moduli, rows, "n").drop("sets", "values")


def universe_counts(structural: DataFrame) -> DataFrame:
    """(family, a_count, b_count, heads, branch_sets, constraints): nodes that can head a constraint, sets of branches and constraints of each cell; sums as text, exact."""
    heads = structural.groupBy(*_CELL).agg(F.count_if(F.col("branch_sets") != "0").alias("heads"))
    out = heads
    for column, name in (("branch_sets", "branch_sets"), ("n", "constraints")):
        out = out.join(residues.sum_texts(structural, _CELL, column, name), _CELL)
    return out


def threshold_populations(cores: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """(family, a_count, b_count, threshold, T1, T2_any, T2_all_gold_sizes, T3): seeds whose core has at least that many positives and the capacity.

    ``cores`` has a row for each seed, or for each kind with its ``seeds``.
    With ``families`` (a column family) each of them has a row for every cell and threshold, zeros where no seed
    qualifies, as scheduler_scenarios needs; without, only cells and thresholds that some seed reaches have rows.
    """
    can = capacity(F.col("positive"), F.col("negative"), F.col("hard"))
    rows = cores.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS)))).where("positive >= threshold")
    names = {"T1": "T1_balanced", "T2_any": "T2_any", "T2_all_gold_sizes": "T2_all_gold_sizes", "T3": "T3_balanced"}
    keys = ["family", "a_count", "b_count", "threshold"]
    found = rows.groupBy(*keys).agg(*(_count(can[c], _many(cores)).alias(n) for n, c in names.items()))
    if families is None:
        return found
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("a_count"), F.lit(b).alias("b_count"), F.lit(t).alias("threshold")) for a in A_COUNTS for b in B_COUNTS for t in THRESHOLDS))).alias("c")
    every = families.select("family").distinct().select("family", cells).select("family", "c.*")
    return every.join(found, keys, "left").fillna(0, list(names))


def _quota(quotas: dict[str, int]) -> Column:
    out = F.lit(0)
    for f, q in quotas.items():
        out = F.when(F.col("family") == f, q).otherwise(out)
    return out


def threshold_shortages(populations: DataFrame, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """(threshold, family, a_count, b_count, task, population, quota): every count of a cell below its family's quota."""
    tasks = ("T1", "T2_any", "T3", "T2_all_gold_sizes")
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), F.col(t).cast("long").alias("population")) for t in tasks))).alias("x")
    rows = populations.select("threshold", *_CELL, _quota(quotas).alias("quota"), each).select("threshold", *_CELL, "x.task", "x.population", "quota")
    return rows.where("quota > 0 and population < quota")


def threshold_summary(populations: DataFrame, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """(threshold, family, least population by task, samples that are left, requests, shortages): one row for each threshold and family."""
    base = populations.groupBy("threshold", "family").agg(
        *(F.min(c).alias(f"min_{c}") for c in ("T1", "T2_any", "T3", "T2_all_gold_sizes")), F.sum(F.col("T1") + F.col("T2_any") + F.col("T3")).alias("base_samples"),
    )
    short = threshold_shortages(populations, quotas).groupBy("threshold", "family").agg(F.count("*").alias("shortages"))
    return base.withColumn("requests", 3 * F.col("base_samples")).join(short, ["threshold", "family"], "left").fillna(0, ["shortages"])


def scenario_shortages(populations: DataFrame, quotas: dict[str, int], threshold: int) -> DataFrame:
    """(scenario, family, task, a_count, b_count, population, quota): what lacks under each scenario; balanced ones ask for all gold sizes too."""
    if threshold not in THRESHOLDS:
        raise ValueError(threshold)
    short = threshold_shortages(populations.where(F.col("threshold") == threshold), quotas)
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(t).alias("t2")) for n, t, _ in SCENARIOS))).alias("s")
    rows = short.select(names, "family", "task", "a_count", "b_count", "population", "quota").select("s.*", "family", "task", "a_count", "b_count", "population", "quota")
    return rows.where("task <> 'T2_all_gold_sizes' or t2 = 'balanced_gold_sizes'").drop("t2")


def scheduler_scenarios(populations: DataFrame, quotas: dict[str, int], threshold: int) -> DataFrame:
    """(scenario, t2_policy, hard_negative_policy, shortages, status, examples): cells below quota under each scenario.

    A fixed ratio always asks for an audit of candidates, whatever lacks. ``populations`` holds all cells of its
    families, empty ones too. Examples are the first SHORTAGES by family, cell and task, as text.
    """
    short = scenario_shortages(populations, quotas, threshold)
    n = F.row_number().over(Window.partitionBy("scenario").orderBy("family", "a_count", "b_count", "task"))
    line = F.concat_ws(":", "family", "task", "a_count", "b_count", "population", "quota")
    first = short.withColumn("n", n).where(F.col("n") <= SHORTAGES).groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("x"))
    names = populations.sparkSession.createDataFrame([*SCENARIOS], "scenario string, t2_policy string, hard_negative_policy string")
    out = names.join(short.groupBy("scenario").agg(F.count("*").alias("shortages")), "scenario", "left").fillna(0, ["shortages"]).join(first, "scenario", "left")
    status = F.when(F.col("hard_negative_policy") == "fixed_ratio", "requires_candidate_level_audit").when(F.col("shortages") > 0, "quota_shortage").otherwise("audited_no_shortage")
    return out.select("scenario", "t2_policy", "hard_negative_policy", "shortages", status.alias("status"), F.coalesce(F.col("x.line"), F.array().cast("array<string>")).alias("examples"))


def gold_size_plan(populations: DataFrame, quotas: dict[str, int], threshold: int) -> DataFrame:
    """(family, a_count, b_count, quota, size_0, size_1, size_2, population, possible): a quota of T2 samples over gold sizes, as evenly as whole numbers allow."""
    q = F.col("quota")
    rows = populations.where(F.col("threshold") == threshold).withColumn("quota", _quota(quotas)).where("quota > 0")
    part = lambda i: (F.floor(q / 3) + (q % 3 > i).cast("int")).cast("int").alias(f"size_{i}")
    return rows.select(*_CELL, "quota", *map(part, range(3)), F.col("T2_all_gold_sizes").alias("population"), (F.col("T2_all_gold_sizes") >= q).alias("possible"))


def task_counts(cores: DataFrame) -> DataFrame:
    """Cores with ``tasks``: the names of what each can serve."""
    can = capacity(F.col("positive"), F.col("negative"), F.col("hard"))
    return cores.withColumn("tasks", F.filter(F.array(*(F.when(c, n) for n, c in can.items())), lambda x: x.isNotNull()))


def seed_cells(found: DataFrame, missing: DataFrame, seeds: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """One row per family and cell: seeds, feasible ones, status, why others lack a core, tasks, sources, quantiles, hard negatives, examples.

    ``found`` holds the cores of seeds with their counts (the audit's gate), ``missing`` the reasons of the
    others. A cell with fewer feasible seeds than a hundredth of all, or than ten, is a shortage. Examples are the first EXAMPLES
    seeds by id. Nothing is gathered per seed: quantiles come from counts of values. ``found`` and ``missing`` may have a row for each
    kind of seed with its ``seeds``; then ``first`` holds the cores of the first EXAMPLES seeds of each cell.
    """
    many = _many(found)
    total = seeds.groupBy("family").agg(F.count("*").alias("seed_total"))
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("a_count"), F.lit(b).alias("b_count")) for a in A_COUNTS for b in B_COUNTS))).alias("c")
    every = total.select("family", "seed_total", cells).select("family", "seed_total", "c.*")
    counts = found.groupBy(*_CELL).agg(F.sum(many).alias("feasible"), *(_count(F.col("hard") >= k, many).alias(f"hard_ge_{k}") for k in (1, 2, 3, 4)))
    spread = quantiles(found.withColumn("distance", F.col("distance").cast("long")), _CELL, ["distance", *MEASURES], "seeds" if "seeds" in found.columns else None)
    spread = spread.groupBy(*_CELL).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("n", "min", "p50", "p90", "p99", "max").alias("q"))))).alias("quantiles"))
    n = F.row_number().over(Window.partitionBy(*_CELL).orderBy("seed"))
    line = F.struct("seed", "a1", "branches", "bs", "distance", "positive", "hard")
    shown = (found if first is None else first).withColumn("n", n).where(F.col("n") <= EXAMPLES).groupBy(*_CELL).agg(F.array_sort(F.collect_list(line)).alias("examples"))
    out = every.join(counts, _CELL, "left").fillna(0, ["feasible", *(f"hard_ge_{k}" for k in (1, 2, 3, 4))])
    for table in (
        counter_map(missing, _CELL, F.col("reason"), "missing_reasons", _many(missing)), counter_map(task_counts(found).withColumn("t", F.explode("tasks")), _CELL, F.col("t"), "task_counts", many),
        counter_map(found.withColumn("s", F.explode("sources")), _CELL, F.col("s"), "b_sources", many), spread, shown,
    ):
        out = out.join(table, _CELL, "left")
    few = F.col("feasible") < F.greatest(F.lit(10), F.floor(F.col("seed_total") / 100))
    status = F.when(F.col("feasible") == 0, "infeasible").when(few, "shortage").otherwise("available")
    return out.withColumn("status", status).withColumn("feasible_rate", exact.rate_or_zero(F.col("feasible"), F.col("seed_total")))


def top_heads(found: DataFrame, count: int = TOP) -> DataFrame:
    """(family, a_count, b_count, a1, n, share, rank): the commonest A1 of each cell; ties in seed order."""
    return taxonomy.top_labels(found, _CELL, "a1", "seed", count)


_TASK_COUNT = {"T1": "T1_balanced", "T2": "T2_any", "T3": "T3_balanced"}


def task_populations(cells: DataFrame) -> DataFrame:
    """(family, task, a_count, b_count, population) from rows of ``seed_cells``: seeds that can serve the task."""
    n = lambda t: F.coalesce(F.try_element_at("task_counts", F.lit(_TASK_COUNT[t])), F.lit(0)).cast("long")
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), n(t).alias("population")) for t in _TASK_COUNT))).alias("x")
    return cells.select(*_CELL, each).select("family", "x.task", "a_count", "b_count", "x.population")


def scaled_task_populations(probed: DataFrame, structural: DataFrame) -> DataFrame:
    """(family, task, a_count, b_count, population as text): all constraints of a cell times the probed share that serves the task, cut to a whole number.

    ``probed`` are cores without a seed with their counts; ``structural`` counts of constraints, as text.
    """
    can = capacity(F.col("positive"), F.col("negative"), F.col("hard"))
    share = probed.groupBy(*_CELL).agg(F.count("*").alias("n"), *(F.count_if(can[c]).alias(t) for t, c in _TASK_COUNT.items()))
    total = residues.sum_texts(structural, _CELL, "n", "constraints")
    rows = total.join(share, _CELL, "left").fillna(0, ["n", *_TASK_COUNT])
    # The product is a double cut to a whole number, as the estimate it is; a double has some 16 right digits.
    whole = lambda x: F.when(x < 1e15, x.cast("long").cast("string")).otherwise(F.format_string("%.0f", x))
    value = lambda t: whole(F.col("constraints").cast("double") * F.col(t) / F.greatest(F.lit(1), F.col("n")))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), value(t).alias("population")) for t in _TASK_COUNT))).alias("x")
    return rows.select(*_CELL, each).select("family", "x.task", "a_count", "b_count", "x.population")


def sampling_frame(populations: DataFrame, test: dict[str, int] = TEST_QUOTAS, main: dict[str, int] = QUOTAS) -> DataFrame:
    """Populations (family, task, a_count, b_count, population) with what the test and main products would draw, inclusion, weight and shortage."""
    out = populations.withColumn("population", F.col("population").cast("double").cast("long"))
    p = F.col("population")
    for name, quotas in (("test", test), ("main", main)):
        out = out.withColumn(f"{name}_quota", _quota(quotas)).withColumn(f"{name}_selected", F.least(F.col(f"{name}_quota").cast("long"), p))
        chosen = F.col(f"{name}_selected")
        out = out.withColumn(f"{name}_shortage", p < F.col(f"{name}_quota")).withColumn(f"{name}_inclusion", exact.rate_or_zero(chosen, p)).withColumn(f"{name}_weight", exact.rate_or_zero(p, chosen))
    return out


def sampling_summary(frame: DataFrame) -> DataFrame:
    """One row: strata, least population that isn't zero, and for each product base samples, requests and shortages; the full tier takes all."""
    made = [x for n in ("test", "main") for x in (F.sum(f"{n}_selected").alias(f"{n}_base_samples"), (3 * F.sum(f"{n}_selected")).alias(f"{n}_requests"), F.count_if(f"{n}_shortage").alias(f"{n}_shortages"))]
    least = F.coalesce(F.min(F.when(F.col("population") > 0, F.col("population"))), F.lit(0)).alias("least_population")
    return frame.agg(F.count("*").alias("strata"), least, *made, F.sum("population").alias("full_base_samples"), (3 * F.sum("population")).alias("full_requests"))


def gold_size_targets(quota: int) -> list[int]:
    """A quota over gold sizes 0, 1, 2, as evenly as whole numbers allow."""
    return [quota // 3 + (i < quota % 3) for i in range(3)]


def b_options_by_depth(branched: DataFrame, g: Graph, max_depth: int | None) -> DataFrame:
    """(family, seed, a1, k, b, size, paired, source, depth): exclusions down to a depth below branches and a1.

    As the direct options, but descendants count too; the first source by stage wins, at its depth.
    """
    at = F.concat(F.transform("branches", lambda x, i: F.struct(i.alias("stage"), x.alias("src"), F.lit("inside_positive_branch").alias("source"))), F.array(F.struct(F.lit(99).alias("stage"), F.col("a1").alias("src"), F.lit("inside_A1").alias("source"))))
    asked = branched.select("family", "seed", "a1", "k", "branches", F.explode(at).alias("p")).select("family", "seed", "a1", "k", "branches", "p.*")
    below = taxonomy.descendants_without_seed(g.children, g.closed, asked.select("family", "src", "seed").distinct(), max_depth)
    found = asked.join(below.withColumnRenamed("desc", "b"), ["family", "src", "seed"]).where((F.col("stage") < 99) | ~F.array_contains("branches", F.col("b")))
    best = found.groupBy("family", "seed", "a1", "k", "b").agg(F.min(F.struct("stage", "depth", "src", "source")).alias("f"))
    return best.join(g.sizes.withColumnRenamed("object_id", "b"), ["family", "b"]).select("family", "seed", "a1", "k", "b", "size", F.col("f.src").alias("paired"), "f.source", "f.depth")


POLICIES = ("largest_closure", "smallest_closure", "deepest_then_smallest")


def choose_by_policy(options: DataFrame, count: int, policy: str) -> DataFrame:
    """The ``count`` options of each core under a policy, in its order; cores with fewer have none."""
    keys = ["family", "seed", "a1", "k"]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*_orders(policy)))
    first = options.withColumn("n", n).where(F.col("n") <= count)
    enough = first.groupBy(*keys).agg(F.count("*").alias("all")).where(F.col("all") >= count).drop("all")
    return first.join(enough, keys, "left_semi")


def policy_cores(frame: DataFrame, options: DataFrame, g: Graph, policy: str) -> DataFrame:
    """(core_id, bs, sources, depth_min, depth_max, depth_mean, excluded_scope, hits_b, positive, hard, feasible): each probed core with the exclusions a policy chooses.

    ``options`` are those at all depths. Cores with fewer options than their b_count have no row. Feasible: it serves T1, T2 and T3.
    """
    keys = ["family", "seed", "a1", "k"]
    asked = frame.select("core_id", "family", "seed", "a1", (F.col("a_count") - 1).alias("k"), "b_count", "branches")
    ranked = options.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*_orders(policy))))
    few = ranked.where(F.col("n") <= max(B_COUNTS))
    picked = asked.join(few, keys, "left").where(F.col("n").isNull() | (F.col("n") <= F.col("b_count")))
    item = F.when((F.col("n").isNotNull()) & (F.col("b_count") > 0), F.struct("n", "b", "source", "depth"))
    rows = asked.join(picked.groupBy("core_id").agg(F.array_sort(F.collect_list(item)).alias("x")), "core_id", "left")
    rows = rows.withColumn("x", F.coalesce("x", F.array().cast("array<struct<n:int,b:string,source:string,depth:int>>"))).where(F.size("x") == F.col("b_count"))
    none = F.array().cast("array<string>")
    rows = rows.select("core_id", "family", "a1", "branches", F.coalesce(F.col("x.b"), none).alias("bs"), F.coalesce(F.col("x.source"), none).alias("sources"), F.col("x.depth").alias("d"))
    got = rows.join(core_counts(rows, g), ["family", "a1", "branches", "bs"])
    can = capacity(F.col("positive"), F.col("negative"), F.col("hard"))
    mean = F.when(F.size("d") > 0, F.aggregate("d", F.lit(0), lambda a, x: a + x) / F.size("d")).otherwise(0.0)
    return got.select(
        "core_id", "family", "bs", "sources", F.coalesce(F.array_min("d"), F.lit(0)).alias("depth_min"), F.coalesce(F.array_max("d"), F.lit(0)).alias("depth_max"), mean.alias("depth_mean"),
        "excluded_scope", "hits_b", "positive", "hard", (can["T1_balanced"] & can["T2_any"] & can["T3_balanced"]).alias("feasible"),
    )


def _orders(policy: str) -> list[Column]:
    orders = {
        "largest_closure": [F.desc("size"), F.col("paired"), F.col("b")], "smallest_closure": [F.col("size"), F.col("paired"), F.col("b")],
        "deepest_then_smallest": [F.desc("depth"), F.col("size"), F.col("paired"), F.col("b")],
    }
    if policy not in orders:
        raise ValueError(policy)
    return orders[policy]


def depth_comparison(frame: DataFrame, g: Graph) -> DataFrame:
    """Each probed core: options at depth 1, at most 2 and any, log10 of the sets they allow, and cores of other policies beside its own.

    ``frame`` is a probe frame. ``ways_delta`` is what depth adds; ``same_largest``: the largest at any depth are the core's own exclusions;
    ``deepest_ok``: with the deepest it still serves all tasks.
    """
    branched = frame.select("family", "seed", "a1", (F.col("a_count") - 1).alias("k"), "branches").distinct()
    keys = ["family", "seed", "a1", "k"]
    options = b_options_by_depth(branched, g, None)
    n = options.groupBy(*keys).agg(F.count_if(F.col("depth") <= 1).alias("direct"), F.count_if(F.col("depth") <= 2).alias("depth2"), F.count("*").alias("all"))
    rows = frame.withColumn("k", F.col("a_count") - 1).join(n, keys, "left").fillna(0, ["direct", "depth2", "all"])
    def ways(c: str) -> Column:
        out = F.lit(0.0)
        for b in B_COUNTS[1:]:
            out = F.when(F.col("b_count") == b, F.when(F.col(c) >= b, exact.log10_combinations(F.col(c), b))).otherwise(out)
        return out

    rows = rows.select("core_id", *_CELL, "seed", "a1", "bs", "hits_b", "direct", "depth2", "all", *(ways(c).alias(f"ways_{c}") for c in ("direct", "depth2", "all")))
    rows = rows.withColumn("ways_delta", F.col("ways_all") - F.col("ways_direct"))
    largest = policy_cores(frame, options, g, "largest_closure").select("core_id", F.array_sort("bs").alias("largest"))
    deepest = policy_cores(frame, options, g, "deepest_then_smallest").select("core_id", F.col("hits_b").alias("deepest_hits_b"), F.col("feasible").alias("deepest_ok"), F.col("depth_max").alias("deepest_depth"))
    out = rows.join(largest, "core_id", "left").join(deepest, "core_id", "left")
    same = F.coalesce(F.array_sort("bs") == F.col("largest"), F.lit(False))
    return out.withColumn("same_largest", same).withColumn("deepest_ok", F.coalesce("deepest_ok", F.lit(False))).drop("largest", "bs")


def depth_summary(compared: DataFrame) -> DataFrame:
    """(family, name, n, min, p50, p90, p99, max): quantiles of ``depth_comparison``'s numbers, logarithms rounded half to even."""
    whole = compared.select("family", "direct", "depth2", "all", "hits_b", "deepest_hits_b", *(F.rint(c).cast("long").alias(c) for c in ("ways_direct", "ways_depth2", "ways_all", "ways_delta")))
    return quantiles(whole, ["family"], whole.columns[1:])


def depth_cells(compared: DataFrame) -> DataFrame:
    """(family, a_count, b_count, rows, delta_ge_3, delta_ge_3_rate, deepest_ok, deepest_ok_rate) of each probed cell."""
    out = compared.groupBy(*_CELL).agg(F.count("*").alias("rows"), F.count_if(F.col("ways_delta") >= 3).alias("delta_ge_3"), F.count_if("deepest_ok").alias("deepest_ok"))
    return out.withColumn("delta_ge_3_rate", exact.rate_or_zero(F.col("delta_ge_3"), F.col("rows"))).withColumn("deepest_ok_rate", exact.rate_or_zero(F.col("deepest_ok"), F.col("rows")))


def resource_audit(node: DataFrame, sizes: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """One row per family: raw and usable nodes, shares with a surface, a gloss and both, and closure sizes by bucket.

    ``node`` holds all nodes, unusable ones too; ``raw`` (family) rows as read, if they are more. Shares of nothing are 0.
    """
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    facts = node.groupBy("family").agg(F.count("*").alias("known"), F.count_if("usable").alias("usable"), F.count_if(has("surface")).alias("with_surface"), F.count_if(has("gloss")).alias("with_gloss"))
    total = (raw if raw is not None else node).groupBy("family").agg(F.count("*").alias("raw"))
    rows = total.join(facts, "family", "left").fillna(0, ["known", "usable", "with_surface", "with_gloss"])
    rates = [exact.rate_or_zero(F.col(c), F.col("raw")).alias(n) for c, n in (("with_surface", "surface_coverage"), ("with_gloss", "gloss_coverage"), ("usable", "usable_coverage"))]
    buckets = counter_map(sizes.withColumn("b", taxonomy.bucket(F.col("size"))), ["family"], F.col("b"), "m")
    full = F.map_from_entries(F.array(*(F.struct(F.lit(b).alias("k"), F.coalesce(F.try_element_at("m", F.lit(b)), F.lit(0)).alias("v")) for b, _ in taxonomy.BUCKETS)))
    return rows.join(buckets, "family", "left").select("family", "raw", "usable", *rates, full.alias("closure_sizes"))


def object_inventory(node: DataFrame, g: Graph) -> DataFrame:
    """One row per usable node: surface, whether it has a gloss, numbers of synonyms, children with descendants, parents and descendants."""
    kids = g.children.groupBy("family", F.col("parent").alias("object_id")).agg(F.count("*").alias("direct_usable_child_count"))
    up = g.edge.groupBy("family", F.col("child").alias("object_id")).agg(F.count("*").alias("usable_parent_count"))
    own = node.where("usable").select(
        "family", "object_id", "surface", (F.coalesce("gloss", F.lit("")) != "").alias("gloss_available"),
        (F.coalesce(F.size("synonyms"), F.lit(0)) if "synonyms" in node.columns else F.lit(0)).alias("synonym_count"),
    )
    out = own.join(kids, ["family", "object_id"], "left").join(up, ["family", "object_id"], "left").join(g.sizes.withColumnRenamed("size", "closure_size"), ["family", "object_id"], "left")
    return out.fillna(0, ["direct_usable_child_count", "usable_parent_count", "closure_size"])
