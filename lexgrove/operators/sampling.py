"""Hash-ordered seeds, inclusion weights, and the ordered fold that realises samples."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.functions.hashing import canonical_json, stable_hash
from lexgrove.operators import truth
from lexgrove.operators.constraint import A_COUNTS, B_COUNTS, Graph
from lexgrove.operators.ranks import first_of_known, numbered
from lexgrove.operators.taxonomy import siblings
from lexgrove.operators.work import written

TASKS, INFORMATION, POOL = ("T1", "T2", "T3"), ("I0", "I1", "I2"), 4
STREAMS = ("positive", "negative", "hard_negative", "easy_negative")
#: Versions that go into the hashes, and the scheduler's name, which salts the order of seeds.
ORACLE_VERSION, FRAME_VERSION, RENDERER_VERSION = "a1_or_branches_minus_b", "seed_object_first", "separated_gloss_v2"
SCHEDULER = "reuse_aware_mixed_negatives"
CORE = ["family", "seed", "a1", "branches", "bs", "a_count", "b_count"]


@dataclass(frozen=True)
class Scope:
    """The strata of a product, in the order in which they are filled and numbered: families, tasks and counts as they are configured."""

    families: tuple[str, ...] = ("wordnet", "babelnet")
    tasks: tuple[str, ...] = TASKS
    a_counts: tuple[int, ...] = A_COUNTS
    b_counts: tuple[int, ...] = B_COUNTS

    def strata(self) -> list[tuple[str, int, int]]:
        return [(t, a, b) for t in self.tasks for a in self.a_counts for b in self.b_counts]

    def cells(self) -> Column:
        """An array of (task, a_count, b_count)."""
        return F.array(*(F.struct(F.lit(t).alias("task"), F.lit(a).alias("a_count"), F.lit(b).alias("b_count")) for t, a, b in self.strata()))

    def holds(self) -> Column:
        return F.col("a_count").isin(*self.a_counts) & F.col("b_count").isin(*self.b_counts)

    def place(self) -> Column:
        """A stratum's number in the product's order."""
        out = F.lit(0)
        for c, values in (("family", self.families), ("task", self.tasks), ("a_count", self.a_counts), ("b_count", self.b_counts)):
            out = out * len(values) + F.array_position(F.array(*map(F.lit, values)), F.col(c))
        return out


def in_order(samples: DataFrame, scope: Scope, within: list[str]) -> DataFrame:
    """``samples`` with ``ordinal``: the place of each in the dataset, strata in the scope's order and then by ``within``."""
    return numbered(samples.drop("ordinal").withColumn("place", scope.place()), ["place", *within], name="ordinal").drop("place")


def hash_text(value, length: int = 16) -> str:
    """First hex digits of the SHA-256 of canonical JSON; the Python twin of ``stable_hash``."""
    body = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()[:length]


def seed_order(seeds: DataFrame, product: str, tier: str, scheduler: str, seed: int) -> DataFrame:
    """``seeds`` (family, task, a_count, b_count, seed, seed_index) with ``h``, by which a stratum's seeds are visited."""
    h = stable_hash(
        32, product_id=F.lit(product), tier=F.lit(tier), scheduler=F.lit(scheduler), seed=F.lit(seed), dataset_family=F.col("family"), task=F.col("task"),
        a_count=F.col("a_count"), b_count=F.col("b_count"), seed_index=F.col("seed_index"), seed_id=F.col("seed"),
    )
    return seeds.withColumn("h", h)


def hash_window(rows: DataFrame, keys: list[str], id_col: str, salt: Column, limit: int = 64) -> DataFrame:
    """For each key: of its first ``8 * limit`` ids the ``limit`` first by hash, numbered."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(id_col))
    near = rows.withColumn("i", first).where(F.col("i") <= 8 * limit).withColumn("h", stable_hash(16, object_id=F.col(id_col), salt=salt))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    return near.withColumn("n", n).where(F.col("n") <= limit).drop("i")


def inclusion(population: Column, quota: Column) -> tuple[Column, Column]:
    """Inclusion probability and weight when min(quota, population) of a population are drawn."""
    target = F.least(quota, population)
    p = F.when((population <= target) | (target == 0), 1.0).otherwise(target / population)
    return p, F.when(target == 0, 1.0).otherwise(population / target)


def target_size(quotas: dict[str, int], tasks: int = 3, cells: int = 30, information: int = 3) -> dict[str, int]:
    """Base samples and requests of a product with one quota per family, task and cell."""
    base = tasks * cells * sum(quotas.values())
    return {"base_samples": base, "requests": base * information}


def seed_indexes(seeds: DataFrame, limit: int = 0) -> DataFrame:
    """``seeds`` (family, seed) with ``seed_index``, the place of its id in the family from 0; only the first ``limit``, if given."""
    out = numbered(seeds, ["seed"], ["family"], "seed_index")
    return out.where(F.col("seed_index") < limit) if limit else out


def _lowest_left(keys: DataFrame, removed: DataFrame, universe: DataFrame, owner: list[str], size: int) -> DataFrame:
    """(key, m): the ``size`` lowest members of a key's universe that are not removed.

    ``keys``: key, owner columns; ``universe``: owner columns, m and its rank j from 1; ``removed``: key, j. The
    removed ranks before which fewer than ``size`` others lie are a prefix of all; with n of them the wanted ones are
    among the first size + n, so only that many ranks are written out, whatever the universe's size.
    """
    gone = removed.select("key", "j").distinct().withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("j")))
    early = gone.where(F.col("j") - F.col("i") < size).groupBy("key").agg(F.count("*").alias("n"))
    total = universe.groupBy(*owner).agg(F.max("j").alias("total"))
    upto = keys.join(early, "key", "left").join(total, owner)
    ranks = upto.select("key", *owner, F.explode(F.sequence(F.lit(1), F.least(F.col("total"), F.coalesce("n", F.lit(0)) + size).cast("int"))).alias("j"))
    return ranks.join(gone.select("key", "j"), ["key", "j"], "left_anti").join(universe, [*owner, "j"]).select("key", "m")


def windows(cores: DataFrame, g: Graph, size: int = 512) -> DataFrame:
    """(family, a1, branches, bs, positive, negative, hard_negative, easy_negative): the ``size`` lowest ids of each candidate stream of a constraint.

    Only members of branches and of bs are expanded; what lies under a1 beside them, and outside a1, is found by rank.
    All nodes of a kind are in the same streams: the streams are made of kinds, and their nodes written out at the end.
    """
    member_of, g = g.member, g.lean or g
    keys = cores.select("family", "a1", "branches", "bs").distinct().withColumn("key", F.monotonically_increasing_id())
    keys = written(keys, "keys")
    member = g.closed.select("family", F.col("anc").alias("id"), F.col("desc").alias("m"))
    heads = written(keys.select("family", "a1").distinct().withColumn("head", F.monotonically_increasing_id()), "heads")
    under = heads.join(member.withColumnRenamed("id", "a1"), ["family", "a1"])
    under = written(numbered(under, ["m"], ["head"], "j").withColumn("j", F.col("j") + 1), "under")
    nodes = numbered(g.sizes.select("family", F.col("object_id").alias("m")), ["m"], ["family"], "j")
    nodes = written(nodes.withColumn("j", F.col("j") + 1), "ranks")
    inside = lambda c, r: keys.select("key", "family", "a1", F.explode(c).alias("id")).join(member, ["family", "id"]).select("key", "family", "a1", "m", F.lit(r).alias("role"))
    roles = inside("branches", "p").unionByName(inside("bs", "x")).groupBy("key", "family", "a1", "m").agg(*(F.max((F.col("role") == r).cast("int")).alias(r) for r in "px"))
    roles = written(roles.join(under.drop("head"), ["family", "a1", "m"]), "roles")
    has = keys.where(F.size("branches") > 0).select("key", "family", "a1")
    lone = keys.where(F.size("branches") == 0).select("key", "family", "a1")
    with_p, without = roles.join(has.select("key"), "key", "left_semi"), roles.join(lone.select("key"), "key", "left_semi")
    hits = with_p.where("p = 1 and x = 1").select("key", "m").unionByName(without.where("x = 1").select("key", "m"))
    positive = with_p.where("p = 1 and x = 0").select("key", "m").unionByName(_lowest_left(lone, without.where("x = 1"), under.drop("head"), ["family", "a1"], size))
    fails = _lowest_left(has, with_p.where("p = 1"), under.drop("head"), ["family", "a1"], size)
    near = lone.join(siblings(g.edge, g.children, g.closed, lone.withColumnRenamed("a1", "object_id")).select("family", F.col("object_id").alias("a1"), "member"), ["family", "a1"]).select("key", F.col("member").alias("m"))
    # What lies outside is the same for all constraints of an a1.
    own = heads.select("family", F.col("a1").alias("m"), F.col("head").alias("key")).join(nodes, ["family", "m"]).select("key", "j")
    below = under.select("family", F.col("head").alias("key"), "m").join(nodes, ["family", "m"]).select("key", "j")
    beyond = written(_lowest_left(heads.select(F.col("head").alias("key"), "family"), own.unionByName(below), nodes, ["family"], size), "outside")
    outside = keys.join(heads, ["family", "a1"]).select("key", "head").join(beyond.withColumnRenamed("key", "head"), "head").select("key", "m")
    label = lambda df, *names: df.select("key", "m", F.explode(F.array(*map(F.lit, names))).alias("stream"))
    every = label(positive, "positive").unionByName(label(hits, "negative", "hard_negative")).unionByName(label(fails, "negative", "hard_negative"))
    every = every.unionByName(label(near, "hard_negative")).unionByName(label(outside, "negative", "easy_negative")).distinct()
    n = F.row_number().over(Window.partitionBy("key", "stream").orderBy("m"))
    kept = every.withColumn("n", n).where(F.col("n") <= size)
    if member_of is not None:
        kept = _nodes_of(kept.join(keys.select("key", "family"), "key"), member_of, size)
    ids = kept.groupBy("key").pivot("stream", list(STREAMS)).agg(F.array_sort(F.collect_list("m")))
    return keys.join(ids, "key", "left").drop("key")


def _nodes_of(kinds: DataFrame, member: DataFrame, size: int) -> DataFrame:
    """(key, stream, m): the ``size`` lowest ids of each stream, from its ``size`` kinds (key, family, stream, m) with the lowest first ids ``m``.

    With ``size`` kinds there are that many nodes up to the last one's first id, so those beyond it are not needed; nor is more
    of a kind than its ``size`` lowest nodes.
    """
    kinds = written(kinds, "streams")
    last = kinds.groupBy("key", "stream").agg(F.when(F.count("*") >= size, F.max("m")).alias("last"))
    at = F.row_number().over(Window.partitionBy("family", "like").orderBy("object_id"))
    few = member.withColumn("i", at).where(F.col("i") <= size).select("family", F.col("like").alias("m"), "object_id")
    rows = kinds.join(last, ["key", "stream"]).join(few, ["family", "m"]).where(F.col("last").isNull() | (F.col("object_id") <= F.col("last")))
    n = F.row_number().over(Window.partitionBy("key", "stream").orderBy("object_id"))
    return rows.withColumn("n", n).where(F.col("n") <= size).select("key", "stream", F.col("object_id").alias("m"))


class Fold:
    """State of one family's sequential selection: usage counts and reuse caps over all strata."""

    def __init__(self, product: str, limit: int, caps: dict[str, int]) -> None:
        self.product, self.limit, self.caps = product, limit, caps
        self.used = {k: Counter() for k in ("seed", "A1", "constraint", "candidate", "pool")}

    def _window(self, ids: list[str], salt: dict) -> list[str]:
        return sorted(ids[: self.limit * 8], key=lambda i: hash_text({"salt": salt, "object_id": i}))[: self.limit]

    def _pick(self, ids: list[str], n: int, salt: dict, avoid: tuple[str, ...] = ()) -> list[str]:
        free = [i for i in ids if i not in avoid]
        if len(free) < n:
            return []
        return sorted(free, key=lambda i: (self.used["candidate"][i], hash_text({"salt": salt, "object_id": i})))[:n]

    def build(self, r, task: str, variant: int) -> tuple[list[str], object] | None:
        """Candidates and gold answer, or None if the pools are too small."""
        salt = {
            "dataset_family": r["family"], "task": task, "a_count": r["a_count"], "b_count": r["b_count"], "seed_id": r["seed"], "A1_id": r["a1"],
            "A_branch_ids": r["branches"], "B_ids": r["bs"], "variant_index": variant, "product_id": self.product,
        }
        pos, neg, hard, _ = (self._window(r[s], {**salt, "stream": s}) for s in STREAMS)
        if task == "T1":
            truth = variant % 2 == 0
            got = self._pick(pos if truth else (hard or neg), 1, {"task": task, "variant": variant, "truth": truth})
            return (got, truth) if got else None
        want = variant % 3 if task == "T2" else int(variant % 2 == 0)
        kind = {"task": task, "variant": variant}
        yes = self._pick(pos, want, {**kind, "kind": "positive"}) if want else []
        no = self._pick(hard if len(hard) >= POOL - want else neg, POOL - want, {**kind, "kind": "negative"}, tuple(yes))
        if len(yes) != want or len(no) != POOL - want:
            return None
        pool = yes + no
        if task == "T2" or want:
            pool.sort(key=lambda i: hash_text({"pool": task, "variant": variant, "object_id": i}))
        return pool, [k for k, i in enumerate(pool, 1) if i in yes] if task == "T2" else bool(want)

    def admit(self, r, task: str, candidates: list[str], capped: bool = True) -> bool:
        """Counts a sample's reuse unless a cap is reached; caps of 0 or less do not bind."""
        keys = {"seed": [r["seed"]], "A1": [r["a1"]], "constraint": [hash_text({"A1": r["a1"], "branches": r["branches"], "B": r["bs"]})], "candidate": candidates, "pool": [hash_text(candidates)] if task != "T1" else []}
        if capped and any(self.caps.get(k, 0) > 0 and self.used[k][x] >= self.caps[k] for k, xs in keys.items() for x in xs):
            return False
        for k, xs in keys.items():
            self.used[k].update(xs)
        return True


_SAMPLE = (
    "family string, task string, a_count int, b_count int, seed string, a1 string, branches array<string>, bs array<string>, paired array<string>, sources array<string>, "
    "candidates array<string>, gold_bool boolean, gold_set array<int>, variant int, base_sample_id string, inclusion double, weight double, distance int, scanned int"
)
_NAMES = [c.split()[0] for c in _SAMPLE.split(", ")]


def _payload(r: dict, task: str, candidates: list[str], gold) -> dict:
    return {
        "dataset_family": r["family"], "task": task, "constraint_cell": [r["a_count"], r["b_count"]], "seed_id": r["seed"], "A1_id": r["a1"], "A_branch_ids": r["branches"],
        "B_ids": r["bs"], "candidate_ids": candidates, "gold_answer": gold, "oracle_version": ORACLE_VERSION, "frame_version": FRAME_VERSION,
    }


def _stratum(state: Fold, rows: list[dict], task: str, target: int | None, population: int, start: int, capped: bool) -> list[tuple]:
    """Samples of one stratum's seeds in their order; up to ``target``, or of all."""
    out, done = [], start
    for n, r in enumerate(rows, 1):
        if target is not None and done >= target:
            break
        r = {k: (v.tolist() if hasattr(v, "tolist") else v) for k, v in r.items()}
        r = {**r, **{s: r[s] if r[s] is not None else [] for s in STREAMS}}
        built = state.build(r, task, done)
        if not built or not state.admit(r, task, built[0], capped):
            continue
        gold = built[1]
        p, w = (1.0 if population <= target or not target else target / population, population / target if target else 1.0) if target is not None else (1.0, 1.0)
        base = f"base_{hash_text(_payload(r, task, built[0], gold), 24)}"
        out.append((r["family"], task, r["a_count"], r["b_count"], r["seed"], r["a1"], r["branches"], r["bs"], r["paired"], r["sources"], built[0], gold if task != "T2" else None, gold if task == "T2" else None, done, base, p, w, r["distance"], n))
        done += 1
    return out


def strata_of(cores: DataFrame, seeds: DataFrame, quotas: dict[str, int], populations: DataFrame | None = None, scope: Scope = Scope()) -> DataFrame:
    """(family, task, a_count, b_count, population, quota, target, found): every stratum of the families with a quota.

    The population is that of ``populations`` (family, a_count, b_count, population), where it has the cell, else the number of cores; ``found`` is that number.
    A core with ``seeds`` counts for that many.
    """
    quota = F.lit(0)
    for f, q in quotas.items():
        quota = F.when(F.col("family") == f, q).otherwise(quota)
    cells = F.explode(scope.cells()).alias("c")
    every = seeds.where(F.col("family").isin(*scope.families)).select("family").distinct().withColumn("quota", quota).where("quota > 0").select("family", "quota", cells).select("family", "quota", "c.*")
    keys = ["family", "a_count", "b_count"]
    many = F.sum("seeds") if "seeds" in cores.columns else F.count("*")
    out = every.join(cores.groupBy(*keys).agg(many.alias("found")), keys, "left").fillna(0, ["found"])
    known = F.col("found")
    if populations is not None:
        out, known = out.join(populations.select(*keys, F.col("population").alias("_p")), keys, "left"), F.coalesce("_p", "found")
    out = out.withColumn("population", known.cast("long"))
    return out.select("family", "task", "a_count", "b_count", "population", "quota", F.least(F.col("quota").cast("long"), "population").alias("target"), "found")


def visits(cores: DataFrame, asked: DataFrame, product: str, tier: str, scheduler: str, seed: int, scope: Scope = Scope()) -> DataFrame:
    """(family, task, a_count, b_count, seed, like, seed_index, h): one row for each core and task with its hash, by which a stratum's seeds are visited.

    ``asked`` (family, seed, like) are all seeds of a family, as a seed's place among them goes into its hash; ``cores`` are those of ``like``.
    Cells go as bits until the rows are dealt out evenly, whatever the number of seeds that are alike.
    """
    parts = int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c)) - 1
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
    of = number("a_count", scope.a_counts) * len(scope.b_counts) + number("b_count", scope.b_counts)
    has = cores.where(scope.holds()).groupBy("family", F.col("seed").alias("like")).agg(F.bit_or(bit(of)).alias("cells"))
    cells = F.array(*(F.struct(F.lit(1 << (i * len(scope.b_counts) + j)).cast("long").alias("bit"), F.lit(a).alias("a_count"), F.lit(b).alias("b_count")) for i, a in enumerate(scope.a_counts) for j, b in enumerate(scope.b_counts)))
    rows = seed_indexes(asked.select("family", "seed", "like")).join(has, ["family", "like"]).repartition(parts, "family", "seed")
    # The hash of ``seed_order``: what its JSON has of the seed is written once for all its cells and tasks.
    inner = lambda **fields: F.regexp_replace(canonical_json(**fields), r"^\{|\}$", "")
    own = inner(dataset_family=F.col("family"), product_id=F.lit(product), scheduler=F.lit(scheduler), seed=F.lit(seed), seed_id=F.col("seed"), seed_index=F.col("seed_index"))
    tasks = F.array(*(F.struct(F.lit(t).alias("task"), inner(task=F.lit(t), tier=F.lit(tier)).alias("last")) for t in scope.tasks))
    rows = rows.withColumn("own", own).withColumn("c", F.explode(F.filter(cells, lambda c: c["bit"].bitwiseAND(F.col("cells")) != 0))).withColumn("t", F.explode(tasks))
    body = F.concat(F.lit('{"a_count":'), F.col("c.a_count"), F.lit(',"b_count":'), F.col("c.b_count"), F.lit(","), F.col("own"), F.lit(","), F.col("t.last"), F.lit("}"))
    return rows.select("family", "t.task", "c.a_count", "c.b_count", "seed", "like", "seed_index", F.substring(F.sha2(body, 256), 1, 32).alias("h"))


def realise(rows: DataFrame, product: str, caps: dict[str, int] | None = None, limit: int = 64, scope: Scope = Scope()) -> DataFrame:
    """Base samples from ``rows``: visits with a ``quota`` and their windows.

    Usage is shared by all strata of a family, so a family is one ordered fold: strata in the scope's
    order, seeds by hash, each stratum up to the least of quota and population. Seeds whose pools are too small, or whose reuse
    would exceed a cap, are passed over.
    """
    caps, places = dict(caps or {}), {x: i for i, x in enumerate(scope.strata())}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Fold(product, limit, caps), []
        pdf["place"] = [places[x] for x in zip(pdf["task"], pdf["a_count"], pdf["b_count"])]
        pdf = pdf.sort_values(["place", "h"], kind="stable").drop(columns="place")
        for (task, _, _), rows in pdf.groupby(["task", "a_count", "b_count"], sort=False):
            population, quota = int(rows["population"].iloc[0]), int(rows["quota"].iloc[0])
            out += _stratum(state, rows.to_dict("records"), task, min(population, quota), population, 0, True)
        return pd.DataFrame(out, columns=_NAMES)

    return rows.groupBy("family").applyInPandas(fold, _SAMPLE)


def stratified(cores: DataFrame, g: Graph, seeds: DataFrame, quotas: dict[str, int], product: str, tier: str = "test", scheduler: str = SCHEDULER, seed: int = 13, caps: dict[str, int] | None = None, limit: int = 64, populations: DataFrame | None = None, margin: int = 8, scope: Scope = Scope(), asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(base samples, strata) of a product with one quota a family, exactly as if every seed were visited in order.

    The fold gets only the first 2 * target + ``margin`` seeds of a stratum by hash, with the windows of their constraints. A
    stratum that these don't fill, though it has more, is given four times as many, and the fold runs again; it is
    deterministic, so the outcome is that of all seeds. Strata: population, quota, target, accepted, inclusion and
    weight by what was accepted, and the reason where the target is not met.

    ``cores`` may have a row for each kind of seed with its ``seeds`` (``Search.counted``); then ``asked`` (family, seed, like) tells
    the kinds of all seeds. Hashes are made as they are read, and only those below a stratum's bound are written.
    """
    keys = ["family", "task", "a_count", "b_count"]
    need = written(strata_of(cores, seeds, quotas, populations, scope).withColumn("need", 2 * F.col("target") + margin), "need")
    kinds = seeds.select("family", "seed", F.col("seed").alias("like")) if asked is None else asked
    all_ = visits(cores, kinds, product, tier, scheduler, seed, scope)
    of = cores.select(*CORE, "paired", "sources", F.col("distance").cast("int").alias("distance")).withColumnRenamed("seed", "like")
    first, fresh = None, need
    while True:
        # Constraints are only looked up for the seeds that the fold gets.
        new = written(first_of_known(all_, keys, fresh.select(*keys, "need", "found")).drop("n", "need"), "first")
        first = new if first is None else first.join(F.broadcast(fresh.select(*keys)), keys, "left_anti").unionByName(new)
        asked = first.join(of, ["family", "like", "a_count", "b_count"]).drop("like")
        asked = written(asked.join(F.broadcast(need.select(*keys, "population", "quota")), keys), "asked")
        win = written(windows(asked, g, 8 * limit), "windows")
        base = written(realise(asked.join(win, ["family", "a1", "branches", "bs"]), product, caps, limit, scope), "base")
        accepted = base.groupBy(*keys).agg(F.count("*").alias("accepted"))
        got = need.join(accepted, keys, "left").fillna(0, ["accepted"])
        starved = (F.col("accepted") < F.col("target")) & (F.col("need") < F.col("found"))
        if not got.where(starved).limit(1).count():
            break
        got = written(got.withColumn("starved", starved).withColumn("need", F.when(starved, 4 * F.col("need")).otherwise(F.col("need"))).drop("accepted"), "need")
        need, fresh = got.drop("starved"), got.where("starved")
    share = F.when(F.col("population") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("accepted").cast("double"), "population")))
    strata = got.select(
        F.concat_ws(":", *keys).alias("stratum_id"), *keys, "population", "quota", "target", "accepted", share.alias("inclusion_probability"),
        F.try_divide(F.col("population").cast("double"), "accepted").alias("sampling_weight"),
        F.when(F.col("accepted") < F.col("target"), "quota_not_filled_after_candidate_realization").alias("skipped_reason"),
    )
    return base, strata


def _chunk_fold(product: str, limit: int, task: str, start: dict[str, int]):
    def fold(pdf: pd.DataFrame, usage: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=_NAMES)
        state = Fold(product, limit, {})
        state.used["candidate"].update(dict(zip(usage["id"], usage["n"])))
        rows = pdf.sort_values("seed").to_dict("records")
        return pd.DataFrame(_stratum(state, rows, task, None, 0, start.get(pdf["family"].iloc[0], 0), False), columns=_NAMES)

    return fold


def full_frame(cores: DataFrame, g: Graph, product: str, limit: int = 64, chunk: int = 5000, tasks: tuple[str, ...] = TASKS, scope: Scope | None = None) -> DataFrame:
    """The full tier: a base sample of every core and task, seeds in id order, weight 1; caps are not enforced.

    The order of candidates depends on all samples before, so strata of a family go one after another, ``chunk`` seeds at a
    time; what passes between chunks is the usage count of each candidate, as a table. Families run side by side, and a task
    holds one chunk. ``ordinal`` is a sample's place in its family.
    """
    scope = scope or Scope(tasks=tasks)
    rows = cores.where(scope.holds()).select(*CORE, "paired", "sources", F.col("distance").cast("int").alias("distance"))
    rows = numbered(rows, ["seed"], ["family", "a_count", "b_count"], "n")
    rows = written(rows.withColumn("chunk", F.floor(F.col("n") / chunk).cast("int")), "frame")
    # Windows depend on constraints only: they are made once for all tasks, and a step reads those of its chunk.
    frame = rows.join(windows(rows, g, 8 * limit), ["family", "a1", "branches", "bs"])
    frame = written(frame.repartition("a_count", "b_count", "chunk"), "windows", ("a_count", "b_count", "chunk"))
    cells = [tuple(r) for r in rows.select("a_count", "b_count", "chunk").distinct().collect()]
    cells.sort(key=lambda x: (scope.a_counts.index(x[0]), scope.b_counts.index(x[1]), x[2]))
    spark = cores.sparkSession
    used = spark.createDataFrame([], "family string, id string, n long")
    out = None
    count = lambda df: {r["family"]: r["c"] for r in df.groupBy("family").agg(F.count("*").alias("c")).collect()}
    placed: dict[str, int] = {}
    for task in scope.tasks:
        done: dict[tuple[str, int, int], int] = {}
        for a, b, c in cells:
            part = frame.where((F.col("a_count") == a) & (F.col("b_count") == b) & (F.col("chunk") == c))
            start = {f: n for (f, x, y), n in done.items() if (x, y) == (a, b)}
            made = written(part.groupBy("family").cogroup(used.groupBy("family")).applyInPandas(_chunk_fold(product, limit, task, start), _SAMPLE), "full")
            for f, n in count(made).items():
                done[f, a, b] = start.get(f, 0) + n
                placed[f] = placed.get(f, 0) + n
            before = F.lit(0)
            for f, n in placed.items():
                before = F.when(F.col("family") == f, n).otherwise(before)
            own = made.withColumn("ordinal", before - F.count("*").over(Window.partitionBy("family")) + F.row_number().over(Window.partitionBy("family").orderBy("variant")) - 1)
            out = own if out is None else out.unionByName(own)
            used = written(used.unionByName(made.select("family", F.explode("candidates").alias("id"), F.lit(1).cast("long").alias("n"))).groupBy("family", "id").agg(F.sum("n").alias("n")), "usage")
    return out if out is not None else spark.createDataFrame([], _SAMPLE + ", ordinal long")


def with_information(base: DataFrame, product: str = "test") -> DataFrame:
    """Three samples of each base sample, one for each information level, with their ids and hashes.

    The hash covers the base payload, the information level and the renderer's version; the request hash is a
    placeholder until a prompt is rendered.
    """
    out = base.withColumn("information", F.explode(F.array(*map(F.lit, INFORMATION))))
    fields = {
        "A1_id": F.col("a1"), "A_branch_ids": F.col("branches"), "B_ids": F.col("bs"), "candidate_ids": F.col("candidates"), "constraint_cell": F.array("a_count", "b_count"),
        "dataset_family": F.col("family"), "frame_version": F.lit(FRAME_VERSION), "information": F.col("information"), "oracle_version": F.lit(ORACLE_VERSION),
        "renderer_version": F.lit(RENDERER_VERSION), "seed_id": F.col("seed"), "task": F.col("task"),
    }
    def hashed(**more) -> Column:
        sets, flags = (stable_hash(32, **fields, **more, gold_answer=F.col(c)) for c in ("gold_set", "gold_bool"))
        return F.when(F.col("task") == "T2", sets).otherwise(flags)

    out = out.withColumn("sample_hash", hashed()).withColumn("request_hash", hashed(request_layer=F.lit("rendered_request")))
    return out.withColumn("sample_id", F.concat(F.lit("sample_"), F.substring("sample_hash", 1, 24))).withColumn("product_id", F.lit(product)).withColumn("condition_count", F.col("a_count") + F.col("b_count"))


def negative_sources(base: DataFrame, g: Graph) -> DataFrame:
    """(base_sample_id, source, n): what kind of negatives a sample's candidates are; positives do not count."""
    key = F.col("base_sample_id").alias("key")
    traced = truth.trace(base.select(key, "family", "a1", "branches", "bs", "candidates"), g.closed).where("not verdict")
    heads = base.select("family", F.col("a1").alias("object_id"))
    near = siblings(g.edge, g.children, g.closed, heads).select("family", F.col("object_id").alias("a1"), F.col("member").alias("candidate"), F.lit(True).alias("near"))
    rows = traced.join(base.select(key, "a1"), "key").join(near, ["family", "a1", "candidate"], "left")
    scope = F.col("inside_a1") & (~F.col("has_branches") | (F.size("branch_hits") > 0))
    source = truth.negative_source(scope & (F.size("b_hits") > 0), F.col("inside_a1") & ~scope, F.coalesce("near", F.lit(False)) & ~F.col("has_branches"))
    return rows.groupBy(F.col("key").alias("base_sample_id"), source.alias("source")).agg(F.count("*").alias("n"))


def reuse_counts(base: DataFrame) -> DataFrame:
    """(kind, value, n): how often each seed, A1, constraint, candidate and pool occurs among base samples; pools of T2 and T3 only."""
    constraint = stable_hash(16, A1=F.col("a1"), B=F.col("bs"), branches=F.col("branches"))
    pool = F.substring(F.sha2(F.to_json("candidates"), 256), 1, 16)
    kinds = {"seed": F.array("seed"), "A1": F.array("a1"), "constraint": F.array(constraint), "candidate": F.col("candidates"), "pool": F.when(F.col("task") != "T1", F.array(pool))}
    def told(kind: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    each = F.flatten(F.array(*(told(k, v) for k, v in kinds.items())))
    return base.select(F.explode(each).alias("r")).select("r.*").groupBy("kind", "value").agg(F.count("*").alias("n"))


def manifest(base: DataFrame, strata: DataFrame, product: str, tier: str, quotas: dict[str, int], min_positive: int, scheduler: str = SCHEDULER, limit: int = 64) -> dict:
    """What a frozen product is: versions, policy, size target, strata, reuse and strata that were not filled.

    Strata are at most 90 a family; of reuse counts the number of values and the most reuses of one come to the driver.
    """
    rows = [r.asDict() for r in strata.orderBy("family", "task", "a_count", "b_count").collect()]
    reuse = {r["kind"]: {"values": r["values"], "most": r["most"]} for r in reuse_counts(base).groupBy("kind").agg(F.count("*").alias("values"), F.max("n").alias("most")).collect()}
    n = sum(r["accepted"] for r in rows)
    return {
        "product_id": product, "product_tier": tier, "frame_version": FRAME_VERSION, "oracle_version": ORACLE_VERSION, "renderer_version": RENDERER_VERSION,
        "paired_information_levels": list(INFORMATION), "candidate_scheduler": {"name": scheduler, "candidate_window_limit": limit},
        "sampling_policy": {"type": "post_gate_stratified_without_replacement", "gate": f"final_positive_count >= {min_positive}", "quotas": dict(quotas)},
        "size_target": target_size(quotas), "base_sample_count": n, "sample_count": n * len(INFORMATION), "reuse_cap_unit": "base_sample", "reuse_counts": reuse,
        "strata": [{k: v for k, v in r.items() if k not in ("target", "skipped_reason")} for r in rows],
        "skipped": [{k: r[k] for k in ("family", "task", "a_count", "b_count", "population", "quota", "target", "accepted")} | {"reason": r["skipped_reason"]} for r in rows if r["skipped_reason"]],
    }


#: What must be the same in the three samples of a base sample.
_PAIRED = ("family", "task", "a_count", "b_count", "seed", "a1", "branches", "bs", "candidates", "gold_bool", "gold_set")


def violations(samples: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """(rule, id): samples that break a rule. Empty for a sound dataset. With ``closed`` answers are held against the oracle too."""
    def rule(name: str, bad: DataFrame, key: str) -> DataFrame:
        return bad.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("id"))

    # One pass for all rules on single rows.
    size = F.when(F.col("task") == "T1", 1).otherwise(POOL)
    broken = {
        "a_count_out_of_range": ~F.col("a_count").between(1, 5), "b_count_out_of_range": ~F.col("b_count").between(0, 5),
        "condition_count": F.col("condition_count") != F.col("a_count") + F.col("b_count"), "branch_count": F.size("branches") != F.greatest(F.lit(0), F.col("a_count") - 1),
        "b_count": F.size("bs") != F.col("b_count"), "b_provenance": (F.size("paired") != F.col("b_count")) | (F.size("sources") != F.col("b_count")), "candidate_count": F.size("candidates") != size,
    }
    single = F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), n) for n, c in broken.items())), lambda x: x.isNotNull()))
    out = samples.select(single.alias("rule"), F.col("sample_id").alias("id"))
    for key in ("sample_hash", "request_hash", "sample_id"):
        out = out.unionByName(rule(f"duplicate_{key}", samples.groupBy(key).count().where("count > 1"), key))
    same = F.to_json(F.struct(*_PAIRED), {"ignoreNullFields": "false"})
    groups = samples.groupBy("base_sample_id").agg(F.array_sort(F.collect_list("information")).alias("i"), F.min(same).alias("low"), F.max(same).alias("high"))
    out = out.unionByName(rule("information_levels", groups.where(F.col("i") != F.array(*map(F.lit, INFORMATION))), "base_sample_id")).unionByName(rule("paired_payload", groups.where("low <> high"), "base_sample_id"))
    return out if closed is None else out.unionByName(rule("oracle_mismatch", oracle_mismatches(samples, closed), "sample_id"))


def oracle_mismatches(samples: DataFrame, closed: DataFrame) -> DataFrame:
    """Samples whose answer is not what the oracle says."""
    asked = samples.select(F.col("sample_id").alias("key"), "family", "a1", "branches", "bs", "candidates")
    told = truth.gold(truth.trace(asked, closed)).select(F.col("key").alias("sample_id"), F.col("gold_set").alias("_set"), F.col("gold_any").alias("_any"))
    right = F.when(F.col("task") == "T2", F.col("gold_set") == F.col("_set")).otherwise(F.col("gold_bool") == F.col("_any"))
    return samples.join(told, "sample_id").where(~F.coalesce(right, F.lit(False))).drop("_set", "_any")


def stream_validation(samples: DataFrame, closed: DataFrame, duplicates: bool = True) -> dict:
    """Counts over a full dataset: unpaired base samples, payloads that differ, wrong answers and, if asked for, duplicates; passed if all are zero."""
    same = F.to_json(F.struct(*_PAIRED), {"ignoreNullFields": "false"})
    groups = samples.groupBy("base_sample_id").agg(F.array_sort(F.collect_list("information")).alias("i"), F.min(same).alias("low"), F.max(same).alias("high"))
    row = groups.agg(F.count("*").alias("n"), F.count_if(F.col("i") != F.array(*map(F.lit, INFORMATION))).alias("unpaired"), F.count_if(F.col("low") != F.col("high")).alias("differ")).first()
    out = {"base_sample_count": row["n"], "unpaired_base_sample_count": row["unpaired"], "paired_payload_mismatch_count": row["differ"], "oracle_mismatch_count": oracle_mismatches(samples, closed).count()}
    if duplicates:
        for key, name in (("sample_hash", "duplicate_sample_hashes"), ("request_hash", "duplicate_request_hashes"), ("sample_id", "duplicate_sample_ids")):
            out[name] = samples.groupBy(key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).first()["n"]
    bad = [v for k, v in out.items() if k != "base_sample_count"]
    if not duplicates:
        out["duplicate_check_policy"] = "not_materialized_during_full_stream_freeze"
    return {**out, "passed": not any(bad)}


def rolling_hash(rows: DataFrame, order: list[str], col: str) -> str:
    """SHA-256 over the values of ``col``, each with a line feed, in the order of ``order``: one partition at a time passes the driver."""
    h = hashlib.sha256()
    for r in rows.select(*order, col).orderBy(*order).toLocalIterator():
        h.update(f"{r[col]}\n".encode())
    return h.hexdigest()


def list_hash(rows: DataFrame, order: list[str], col: str, length: int = 32) -> str:
    """First hex digits of the SHA-256 of the canonical JSON list of ``col`` in the order of ``order``, as ``hash_text`` of that list."""
    h, before = hashlib.sha256(), "["
    for r in rows.select(*order, col).orderBy(*order).toLocalIterator():
        h.update((before + json.dumps(r[col], ensure_ascii=False)).encode())
        before = ","
    h.update(b"[]" if before == "[" else b"]")
    return h.hexdigest()[:length]


def missing_after(existing: DataFrame, made: DataFrame, order: list[str], col: str = "sample_hash") -> DataFrame:
    """The rows of ``made`` that a broken-off freeze has not written yet; raises if ``existing`` differs from it or has more."""
    both = existing.select(*order, F.col(col).alias("_was")).join(made.select(*order, F.col(col).alias("_is")), order, "left")
    faults = both.agg(F.count_if(F.col("_is").isNull()).alias("surplus"), F.count_if(F.col("_was") != F.col("_is")).alias("mismatch")).first()
    if faults["surplus"] or faults["mismatch"]:
        raise ValueError(f"existing samples do not match: {faults['mismatch']} differ, {faults['surplus']} beyond the end")
    return made.join(existing.select(*order), order, "left_anti")
