"""Union columns: answers, raw responses and payloads as VARIANT."""

import json

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import unions
from lexgrove.operators import rendering, scoring
from lexgrove.sources import files

VALUES = [None, True, False, 0, 1, -2.5, 0.0, "", "x", [], [1, 3], [3, 1, 1], [1.0, 2], [1, "a"], [1.5], [None], [[1]], {}, {"a": []}, 2**40, [2**40]]


def test_truth_and_kinds_as_in_python(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, t string")
    v = F.try_parse_json("t")
    got = {r["i"]: r for r in rows.select("i", unions.truth(v).alias("truth"), unions.kind(v).alias("kind"), unions.whole_numbers(v).alias("numbers")).collect()}
    name = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object", type(None): "null"}
    for i, x in enumerate(VALUES):
        whole = isinstance(x, list) and all(isinstance(y, (int, float)) and y == int(y) and abs(y) < 2**31 for y in x)
        assert (got[i]["truth"], got[i]["kind"], got[i]["numbers"]) == (bool(x), name[type(x)], [int(y) for y in x] if whole else None), x


@pytest.mark.parametrize("as_variant", [False, True])
def test_normal_gold_of_one_column(spark, as_variant):
    texts = [("T2", "[3, 1]"), ("T2", None), ("T2", "false"), ("T2", "[]"), ("T2", '"x"'), ("T2", '[1, "a"]'), ("T1", "true"), ("T1", "null"), ("T1", None), ("T3", "[0]"), ("T3", '""')]
    want = [([3, 1], None, False), ([], None, False), ([], None, False), ([], None, False), (None, None, True), (None, None, True), (None, True, False), (None, False, False), (None, False, False), (None, True, False), (None, False, False)]
    if not as_variant:
        texts, want = [*texts, ("T1", "{oops"), ("T2", "[1")], [*want, (None, None, True), (None, None, True)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, task string, gold string")
    if as_variant:
        rows = rows.withColumn("gold", F.try_parse_json("gold"))
    got = sorted(scoring.normal_gold(rows, "gold").collect(), key=lambda r: r["i"])
    assert [(r["gold_set"], r["gold_bool"], r["gold_malformed"]) for r in got] == want and "gold" in got[0]
    assert scoring.normal_gold(rows.limit(0), "gold").count() == 0


def test_usage_of_text_and_variant(spark):
    raw = [
        {"usage": {"completion_tokens": 7}, "choices": [{"finish_reason": "stop"}]}, {"choices": [{"finish_reason": "", "stop_reason": "len"}]}, None, {"usage": None, "choices": []},
        {"usage": {"completion_tokens": "12"}, "choices": [{"finish_reason": None}]}, [1], {"usage": {"completion_tokens": "many"}},
    ]
    rows = spark.createDataFrame([(i, None if v is None else json.dumps(v)) for i, v in enumerate(raw)] + [(7, '{"usage"')], "i int, raw_response string")
    want = [(7, "stop", False), (0, "len", False), (0, "unknown", False), (0, "unknown", False), (12, "unknown", False), (0, "unknown", True), (0, "unknown", False), (0, "unknown", True)]
    see = lambda d: [(r["completion_tokens"], r["finish_reason"], r["raw_malformed"]) for r in sorted(scoring.usage(d).collect(), key=lambda r: r["i"])]
    assert see(rows) == want
    assert see(rows.where("i < 7").withColumn("raw_response", F.try_parse_json("raw_response"))) == want[:7]
    assert {r["finish_reason"]: (r["n"], r["malformed"]) for r in scoring.usage_table(rows).collect()} == {"stop": (1, 0), "len": (1, 0), "unknown": (6, 2)}


def test_nested_requests_through_a_file(spark, tmp_path):
    texts = ["plain", 'quote " and \\ and \n', "ünï 漢字", "", "x" * 300_000]
    rows = [(f"r{i}", f"s{i}", t, f"h{i}", [("system", "be"), ("user", t)], ["b", "a"], 1.5) for i, t in enumerate(texts)]
    asked = spark.createDataFrame(rows, "request_id string, sample_id string, prompt string, request_hash string, messages array<struct<role:string,content:string>>, branches array<string>, weight double")
    asked = asked.withColumn("sample_request_hash", F.col("request_hash")).withColumn("renderer_version", F.lit("v1"))
    sent = rendering.nested(asked, ["sample_id", "branches", "weight", "request_hash"])
    files.write_jsonl(sent, str(tmp_path / "requests"))
    lines = [json.loads(line) for f in (tmp_path / "requests").glob("part-*") for line in f.read_text().splitlines()]
    assert {x["request_id"]: x["provider_payload"]["messages"][1]["content"] for x in lines} == {f"r{i}": t for i, t in enumerate(texts)}
    assert all(x["sample"] == {"sample_id": "s" + x["request_id"][1:], "branches": ["b", "a"], "weight": 1.5, "request_hash": x["request_hash"], "renderer_version": "v1"} for x in lines)
    back = files.read_jsonl(spark, str(tmp_path / "requests"), "request_id string, request_hash string, provider_payload variant, sample variant")
    got = rendering.flat(back).collect()
    assert {r["request_id"]: [tuple(m) for m in r["messages"]] for r in got} == {f"r{i}": [("system", "be"), ("user", t)] for i, t in enumerate(texts)}
    assert all(r["sample_request_hash"] == r["request_hash"] and not r["payload_malformed"] for r in got)
    odd = spark.createDataFrame([("a", "{", "{}"), ("b", '{"messages": 1}', "{}"), ("c", '{"messages": []}', "[]"), ("d", None, None), ("e", '{"messages": []}', '{"request_hash": "h"}')], "request_id string, provider_payload string, sample string")
    assert {r["request_id"] for r in rendering.flat(odd).where("payload_malformed").collect()} == {"a", "b", "c", "d"}
