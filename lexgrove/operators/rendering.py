"""Prompts of samples, in English or Chinese, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import unions
from lexgrove.functions.hashing import stable_hash
from lexgrove.operators.sampling import RENDERER_VERSION

# The wording of prompts, English and Chinese.
WORDING = {
    "wordnet": {
        "head": "You are given a concept-boundary question.", "condition": "Target condition:", "outer": ("- A1 ", " is the outer required concept."),
        "branches": "- The target object must also be a kind of at least one concept below:", "excluded": "- Exclude objects that are a kind of any concept below:", "no_excluded": "- There are no excluded concepts.",
        "candidate": "Candidate:", "candidates": "Candidates:", "concept_notes": "Concept notes:", "candidate_notes": "Candidate notes:", "system": "Answer exactly in the required format.",
        "T1": ("Question: Does the candidate satisfy the target condition?", "Required answer: begin with True or False."),
        "T2": ("Required answer: return only the list of candidate numbers that satisfy the target condition, for example [1, 3] or [].",),
        "T3": ("Question: Does at least one candidate satisfy the target condition?", "Required answer: begin with True or False. True means at least one candidate satisfies the target condition."),
    },
    "babelnet": {
        "head": "请判断下面的概念边界题。", "condition": "目标条件：", "outer": ("- A1 ", " 是外层必须满足的概念。"),
        "branches": "- 目标对象还必须至少属于下面一个概念：", "excluded": "- 排除属于下面任一概念的对象：", "no_excluded": "- 没有排除概念。",
        "candidate": "候选项：", "candidates": "候选项：", "concept_notes": "概念解释：", "candidate_notes": "候选解释：", "system": "请严格按照题目要求的格式作答。",
        "T1": ("问题：该候选项是否满足目标条件？", "作答要求：第一个词必须是 True 或 False。"),
        "T2": ("作答要求：只输出满足目标条件的候选编号列表，例如 [1, 3] 或 []。",),
        "T3": ("问题：候选项中是否至少有一个满足目标条件？", "作答要求：第一个词必须是 True 或 False；True 表示至少存在一个满足条件的候选项。"),
    },
}


def _numbered(ids: str, role: str) -> Column:
    return F.transform(ids, lambda x, i: F.struct(F.lit(role).alias("role"), i.alias("i"), x.alias("object_id")))


def with_nodes(samples: DataFrame, node: DataFrame, key: str = "sample_id") -> DataFrame:
    """``samples`` with the (surface, gloss) of A1, branches, bs and candidates, in their order; unknown ids raise."""
    roles = F.concat(
        F.array(F.struct(F.lit("a").alias("role"), F.lit(0).alias("i"), F.col("a1").alias("object_id"))),
        *(_numbered(c, r) for c, r in (("branches", "p"), ("bs", "x"), ("candidates", "c"))),
    )
    asked = samples.select(key, "family", F.explode(roles).alias("r")).select(key, "family", "r.*")
    known = asked.join(node.select("family", "object_id", "surface", "gloss", F.lit(True).alias("known")), ["family", "object_id"], "left")
    item = F.struct("i", F.when(F.col("known"), F.coalesce("surface", F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("no node "), "object_id"))).alias("surface"), F.coalesce("gloss", F.lit("")).alias("gloss"))
    got = known.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("role") == r, item))).alias(f"_{r}") for r in "apxc"))
    return samples.join(got, key)


def _family(family: Column, pick) -> Column:
    return F.when(family == "babelnet", pick(WORDING["babelnet"])).otherwise(pick(WORDING["wordnet"]))


def prompt(rows: DataFrame) -> DataFrame:
    """Adds prompt, system_prompt, messages, expected_protocol, request_hash and request_id to rows of ``with_nodes``.

    The request hash replaces the sample's placeholder; ``sample_request_hash`` is the sample's own copy of it.
    """
    fam, task, info = F.col("family"), F.col("task"), F.col("information")
    word = lambda k: _family(fam, lambda w: F.lit(w[k]))
    strings = lambda *c: F.array(*c)
    none = F.array().cast("array<string>")
    a, p, x, c = (F.col(f"_{k}") for k in "apxc")
    listed = lambda items, prefix, start: F.transform(items, lambda o, i: F.concat(F.lit(f"- {prefix}"), (i + start).cast("string"), F.lit(" "), o["surface"]))
    outer = F.concat(_family(fam, lambda w: F.lit(w["outer"][0])), a[0]["surface"], _family(fam, lambda w: F.lit(w["outer"][1])))
    condition = F.concat(
        strings(word("head"), F.lit(""), word("condition"), outer), F.when(F.size(p) > 0, F.concat(strings(word("branches")), listed(p, "A", 2))).otherwise(none),
        F.when(F.size(x) > 0, F.concat(strings(word("excluded")), listed(x, "B", 1))).otherwise(strings(word("no_excluded"))), strings(F.lit("")),
    )
    numbered = F.transform(c, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o["surface"]))
    shown = F.when(task == "T1", F.concat(strings(word("candidate")), F.transform(c, lambda o: F.concat(F.lit("- "), o["surface"])))).otherwise(F.concat(strings(word("candidates")), numbered))
    label = lambda items, prefix, start: F.transform(items, lambda o, i: F.struct(F.concat(F.lit(f"- {prefix}"), (i + start).cast("string"), F.lit(" "), o["surface"], F.lit(": "), o["gloss"]).alias("line"), o["gloss"].alias("gloss")))
    notes = lambda items: F.transform(F.filter(items, lambda n: n["gloss"] != ""), lambda n: n["line"])
    concepts = notes(F.concat(label(a, "A", 1), label(p, "A", 2), label(x, "B", 1)))
    own = F.transform(c, lambda o, i: F.struct(F.concat(F.when(task == "T1", F.lit("- Candidate ")).otherwise(F.concat(F.lit("- "), (i + 1).cast("string"), F.lit(". "))), o["surface"], F.lit(": "), o["gloss"]).alias("line"), o["gloss"].alias("gloss")))
    block = lambda on, title, lines: F.when(on & (F.size(lines) > 0), F.concat(strings(F.lit(""), word(title)), lines)).otherwise(none)
    ask = none
    for t in ("T1", "T2", "T3"):
        ask = F.when(task == t, _family(fam, lambda w, t=t: F.array(*map(F.lit, w[t])))).otherwise(ask)
    lines = F.concat(condition, shown, block(info.isin("I1", "I2"), "concept_notes", concepts), block(info == "I2", "candidate_notes", notes(own)), strings(F.lit("")), ask)
    out = rows.withColumn("prompt", F.array_join(lines, "\n")).withColumn("system_prompt", word("system"))
    out = out.withColumn("expected_protocol", F.when(task == "T2", "candidate_number_list").otherwise("boolean_first_word")).withColumn("renderer_version", F.lit(RENDERER_VERSION))
    out = out.withColumn("request_hash", stable_hash(32, **{k: F.col(k) for k in ("sample_id", "renderer_version", "prompt", "system_prompt", "expected_protocol")}))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    out = out.withColumn("messages", F.array(message("system", "system_prompt"), message("user", "prompt"))).withColumn("sample_request_hash", F.col("request_hash"))
    return out.withColumn("request_id", F.concat(F.lit("request_"), F.substring("request_hash", 1, 16))).drop("_a", "_p", "_x", "_c")


def nested(requests: DataFrame, sample: list[str]) -> DataFrame:
    """Requests as they are handed on: their own fields, ``provider_payload`` and ``sample`` as VARIANT.

    The payload holds the messages; the sample its columns named in ``sample``, the request's hash and the renderer's version.
    """
    own = [c for c in ("request_id", "sample_id", "base_sample_id", "task", "family", "information", "renderer_version", "prompt", "system_prompt", "expected_protocol", "request_hash") if c in requests.columns]
    kept = [F.col(f"`{c}`") for c in sample if c not in ("request_hash", "renderer_version")]
    inner = F.struct(*kept, F.col("sample_request_hash").alias("request_hash"), "renderer_version")
    return requests.select(*own, F.to_variant_object(F.struct("messages")).alias("provider_payload"), F.to_variant_object(inner).alias("sample"))


def flat(rows: DataFrame) -> DataFrame:
    """Nested requests (VARIANT, or JSON text as read from a file) with the messages and the sample's own hash as columns, as ``request_faults`` takes them.

    ``payload_malformed`` marks payloads or samples that are no JSON objects, or hold no list of messages.
    """
    for c in ("provider_payload", "sample"):
        rows = unions.with_variant(rows, c, f"__{c}", f"__{c}_malformed")
    messages = F.try_variant_get("__provider_payload", "$.messages", "array<struct<role:string,content:string>>")
    rows = rows.withColumns({"messages": messages, "sample_request_hash": F.try_variant_get("__sample", "$.request_hash", "string")})
    whole = F.col("messages").isNotNull() & (F.coalesce(unions.kind(F.col("__sample")), F.lit("null")) == "object")
    return rows.withColumn("payload_malformed", ~whole).drop("__provider_payload", "__sample", "__provider_payload_malformed", "__sample_malformed")


#: Fields that every request must have.
REQUIRED = ("request_id", "sample_id", "base_sample_id", "task", "family", "information", "request_hash", "messages", "sample_request_hash")


def request_faults(requests: DataFrame, renderer_version: str = RENDERER_VERSION) -> DataFrame:
    """(fault, request_id): missing fields, duplicate ids or hashes, ids that do not end with their hash, samples with another hash, no messages, other renderer versions.

    A field is missing if its column is, or if it is null. Single rows are checked in one pass.
    """
    rows = requests
    for c in REQUIRED:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("array<struct<role:string,content:string>>" if c == "messages" else "string"))
    rows = rows if "renderer_version" in rows.columns else rows.withColumn("renderer_version", F.lit(None).cast("string"))
    lacking = F.lit(False)
    for c in REQUIRED:
        lacking = lacking | F.col(c).isNull()
    empty = (F.size("messages") == 0) | F.exists("messages", lambda m: F.coalesce(m["content"], F.lit("")) == "")
    checks = {
        "missing_fields": lacking, "id_without_hash": ~F.col("request_id").endswith(F.substring("request_hash", 1, 16)), "nested_hash": F.col("sample_request_hash") != F.col("request_hash"),
        "empty_messages": F.col("messages").isNotNull() & empty, "renderer_version": F.coalesce(F.col("renderer_version") != renderer_version, F.lit(True)),
    }
    each = F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items())), lambda x: x.isNotNull()))
    twice = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("request_id").alias("id"), F.count("*").alias("n")).where("n > 1").select(F.lit(f"duplicate_{c}").alias("fault"), F.col("id").alias("request_id"))
    return rows.select(each.alias("fault"), "request_id").unionByName(twice("request_id")).unionByName(twice("request_hash"))
