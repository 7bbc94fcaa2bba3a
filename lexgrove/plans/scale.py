"""Registered queries of ranks, bounds and bitmaps over the driver's tables, each beside its SQL twin for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexgrove.functions.hashing import stable_hash
from lexgrove.operators import bitmaps, ranks, rendering, scoring, taxonomy
from lexgrove.operators.work import work_dir
from lexgrove.plans import driver_data as data
from lexgrove.plans.catalog import FULL, query
from lexgrove.sources import parts

_PLACES = """, home AS (SELECT node.id, coalesce(min(e.p), '') AS home FROM node LEFT JOIN e ON e.c = node.id GROUP BY node.id),
place AS (SELECT id, row_number() OVER (ORDER BY home, id) - 1 AS place FROM home)"""
_WORDS = """, bits AS (SELECT cl.p AS anc, place // 64 AS word, bit_or(CAST(1 AS HUGEINT) << CAST(place % 64 AS INTEGER)) AS b
  FROM cl JOIN place ON place.id = cl.c GROUP BY 1, 2)"""


def _nodes(spark, sf_dir):
    edge = data.edges(spark, sf_dir)
    return data.nodes(edge), edge


@query("node_places", FULL + _PLACES + " SELECT id AS object_id, place FROM place")
def node_places(spark, sf_dir):
    """Every node's place, children of a parent together: a family numbered over many partitions."""
    node, edge = _nodes(spark, sf_dir)
    return bitmaps.node_places(node, edge).select("object_id", "place")


@query("lineitem_ranks", """SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS rank
FROM lineitem""")
def lineitem_ranks(spark, sf_dir):
    """Every line's place by shipping date among those of its flag; one flag has about half of all rows."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return ranks.numbered(rows, ["l_shipdate", "l_orderkey", "l_linenumber"], ["l_returnflag"]).drop("l_shipdate")


_HASHED = """WITH x AS (SELECT o_orderpriority AS k, o_orderkey AS id, substr(sha256('{"order":' || o_orderkey || '}'), 1, 32) AS h FROM orders)"""


@query("hash_sample", _HASHED + """, q AS (SELECT k, count(*) // 10 AS need FROM x GROUP BY k),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY h) AS n FROM x)
SELECT n.k, n.id, n.h, CAST(n.n AS INTEGER) AS n FROM n JOIN q ON q.k = n.k WHERE n.n <= q.need""")
def hash_sample(spark, sf_dir):
    """The first tenth of the orders of each priority by hash: a sampling operator."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("id"), stable_hash(32, order=F.col("o_orderkey")).alias("h"))
    wanted = rows.groupBy("k").agg(F.floor(F.count("*") / 10).alias("need"))
    return ranks.first_by_hash(rows, ["k"], wanted).select("k", "id", "h", "n")


@query("closure_bitmaps", FULL + _PLACES + _WORDS + """ SELECT anc AS object_id, word, CAST(CASE WHEN b >= CAST(9223372036854775808 AS HUGEINT) THEN b - CAST(18446744073709551616 AS HUGEINT) ELSE b END AS BIGINT) AS bits FROM bits""")
def closure_bitmaps(spark, sf_dir):
    """Every closure as bitmaps, built without pairs."""
    node, edge = _nodes(spark, sf_dir)
    words = bitmaps.closure_by_words(edge, bitmaps.node_places(node, edge))
    return words.select(F.col("anc").alias("object_id"), "word", "bits")


@query("bitmap_sizes", FULL + " SELECT id AS object_id, size FROM sz WHERE size > 0")
def bitmap_sizes(spark, sf_dir):
    """Sizes of all closures, by bitmaps."""
    node, edge = _nodes(spark, sf_dir)
    words = bitmaps.closure_by_words(edge, bitmaps.node_places(node, edge))
    return words.groupBy(F.col("anc").alias("object_id")).agg(bitmaps.size_of(F.col("bits")).alias("size"))


@query("scope_overlap", FULL + """, t AS (SELECT p AS type, c FROM cl WHERE p LIKE 'T:%'), b AS (SELECT p AS brand, c FROM cl WHERE p LIKE 'B:%'), n AS (SELECT type, count(*) AS n FROM t GROUP BY type)
SELECT t.type, b.brand, count(*) AS shared, any_value(n.n) - count(*) AS rest FROM t JOIN b ON b.c = t.c JOIN n ON n.type = t.type GROUP BY t.type, b.brand""")
def scope_overlap(spark, sf_dir):
    """Types and brands that share objects: how many, and how many of the type's are left without the brand; word by word."""
    node, edge = _nodes(spark, sf_dir)
    words = bitmaps.closure_by_words(edge, bitmaps.node_places(node, edge))
    type_ = words.where("anc like 'T:%'").select(F.col("anc").alias("type"), "word", F.col("bits").alias("t"))
    brand = words.where("anc like 'B:%'").select(F.col("anc").alias("brand"), "word", F.col("bits").alias("b"))
    size = type_.groupBy("type").agg(bitmaps.size_of(F.col("t")).alias("n"))
    both = type_.join(brand, "word").groupBy("type", "brand").agg(bitmaps.size_of(F.col("t").bitwiseAND(F.col("b"))).alias("shared")).where("shared > 0")
    return both.join(size, "type").select("type", "brand", "shared", (F.col("n") - F.col("shared")).alias("rest"))


@query("sibling_bitmaps", FULL + """, s AS (SELECT DISTINCT e.c AS id, kid.c AS sib FROM e JOIN kid ON kid.p = e.p WHERE kid.c <> e.c),
m AS (SELECT id, sib AS member FROM s UNION SELECT s.id, cl.c FROM s JOIN cl ON cl.p = s.sib)
SELECT m.id AS object_id, count(*) AS near FROM m WHERE m.member <> m.id AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.p = m.id AND cl.c = m.member) GROUP BY m.id""")
def sibling_bitmaps(spark, sf_dir):
    """Sizes of the sibling scopes of all nodes that have one, by bitmaps."""
    node, edge = _nodes(spark, sf_dir)
    places = bitmaps.written(bitmaps.node_places(node, edge), "places")
    words = bitmaps.closure_by_words(edge, places)
    sizes = words.groupBy("family", F.col("anc").alias("object_id")).agg(bitmaps.size_of(F.col("bits")).alias("size"))
    kids = taxonomy.usable_children(edge, sizes)
    got = bitmaps.sibling_words(node, edge, kids, words, places)
    return got.groupBy("object_id").agg(bitmaps.size_of(F.col("bits")).alias("near"))


@query("line_places", """SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END, doc_id) - 1 AS ordinal, sha256(coalesce(text, '')) AS text_sha256 FROM documents""")
def line_places(spark, sf_dir):
    """Documents as two unequal parts of JSON lines, each in as many files as it fills, read back by byte ranges: each record's place over both."""
    folder = f"{work_dir(spark)}/lines-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for name, some in (("a", "doc_id % 3 = 0"), ("b", "doc_id % 3 <> 0")):
        docs.where(some).orderBy("doc_id").select(F.to_json(F.struct("doc_id", "text"))).write.text(f"{folder}/{name}")
    # Spark numbers a folder's files in the rows' order; the folders' order is the parts'.
    first = parts.read_records(spark, f"{folder}/a", "doc_id long, text string")
    second = parts.read_records(spark, f"{folder}/b", "doc_id long, text string")
    n = first.count()
    every = first.unionByName(second.withColumn("ordinal", F.col("ordinal") + n))
    return every.select("r.doc_id", "ordinal", F.sha2("r.text", 256).alias("text_sha256"))


# Texts of answers by the document's number: lists, truth values, what counts as neither, and broken JSON.
_GOLD = """SELECT d.doc_id, concat('T', 1 + CAST(floor(d.doc_id / 10) AS BIGINT) % 3) AS task, CASE d.doc_id % 10 WHEN 0 THEN concat('[', d.doc_id % 7, ', ', d.n_chars % 4, ']') WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'null'
  WHEN 4 THEN '[]' WHEN 5 THEN CAST(d.n_chars % 2 AS STRING) WHEN 6 THEN concat('[1, "', d.lang, '"]') WHEN 7 THEN concat('{{"a": ', d.n_chars) WHEN 8 THEN concat('"', d.lang, '"') ELSE NULL END AS gold FROM documents d"""


@query("union_answers", "WITH g AS (" + _GOLD.replace("AS STRING", "AS VARCHAR").replace("{{", "{") + """), k AS (SELECT *, CASE WHEN json_valid(gold) THEN json_type(gold) END AS kind FROM g),
t AS (SELECT *, CASE WHEN kind IN ('UBIGINT', 'BIGINT') THEN gold <> '0' WHEN kind = 'BOOLEAN' THEN gold = 'true' WHEN kind = 'ARRAY' THEN gold <> '[]' WHEN kind = 'VARCHAR' THEN gold <> '""' ELSE false END AS truth,
  CASE WHEN kind = 'ARRAY' AND NOT contains(gold, '"') THEN replace(trim(gold, '[]'), ' ', '') END AS numbers FROM k),
m AS (SELECT *, coalesce(gold IS NOT NULL AND NOT json_valid(gold), false) OR (task = 'T2' AND numbers IS NULL AND truth) AS malformed FROM t)
SELECT doc_id, task, malformed, CASE WHEN task <> 'T2' AND NOT malformed THEN truth END AS gold_bool, CASE WHEN task = 'T2' AND NOT malformed THEN coalesce(numbers, '') END AS gold_set FROM m""")
def union_answers(spark, sf_dir):
    """Answers that are a truth value or a list, out of one column of VARIANT."""
    got = scoring.normal_gold(data.run_sql(spark, sf_dir, _GOLD, ("documents",)), "gold")
    return got.select("doc_id", "task", F.col("gold_malformed").alias("malformed"), "gold_bool", F.array_join("gold_set", ",").alias("gold_set"))


_RAW = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('{{"usage": {{"completion_tokens": ', user_id, '}}, "choices": [{{"finish_reason": "', event_type, '"}}], "props": ', props, '}}')
  WHEN 1 THEN concat('{{"usage": null, "choices": [{{"finish_reason": "", "stop_reason": "', event_type, '"}}]}}') WHEN 2 THEN concat('{{"usage": {{"completion_tokens": ', user_id) WHEN 3 THEN concat('[', user_id, ']') WHEN 4 THEN props ELSE NULL END AS raw FROM events"""


@query("response_usage", "WITH r AS (" + _RAW.replace("{{", "{").replace("}}", "}") + """), k AS (SELECT raw, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind FROM r), x AS (SELECT CASE WHEN kind = 'OBJECT' THEN raw END AS j, raw IS NOT NULL AND coalesce(kind <> 'OBJECT', true) AS bad FROM k)
SELECT coalesce(nullif(json_extract_string(j, '$.choices[0].finish_reason'), ''), nullif(json_extract_string(j, '$.choices[0].stop_reason'), ''), 'unknown') AS finish_reason, count(*) AS n,
  CAST(sum(coalesce(CAST(json_extract_string(j, '$.usage.completion_tokens') AS BIGINT), 0)) AS BIGINT) AS completion_tokens, count(*) FILTER (WHERE bad) AS malformed FROM x GROUP BY 1""")
def response_usage(spark, sf_dir):
    """Tokens and reasons of raw answers, malformed ones told apart."""
    return scoring.usage_table(data.run_sql(spark, sf_dir, _RAW, ("events",)), "raw")


@query("request_payloads", """SELECT conv_id, turn, coalesce(role, '') AS role, sha256(coalesce(text, '')) AS content_sha256, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS request_hash, false AS payload_malformed FROM conversations""")
def request_payloads(spark, sf_dir):
    """Every turn as a nested request of JSON text, read back: its message and its sample's hash."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    asked = c.withColumns({"request_id": key, "sample_id": key, "sample_request_hash": key, "renderer_version": F.lit("v"), "messages": F.array(F.struct("role", F.col("text").alias("content")))})
    sent = rendering.nested(asked, ["conv_id", "turn", "sample_id"])
    text = sent.withColumns({c: F.to_json(c) for c in ("provider_payload", "sample")})
    got = rendering.flat(text)
    inside = lambda c: F.try_variant_get(F.try_parse_json("sample"), f"$.{c}", "long").alias(c)
    first = F.col("messages")[0]
    return got.select(inside("conv_id"), inside("turn"), first["role"].alias("role"), F.sha2(first["content"], 256).alias("content_sha256"), F.col("sample_request_hash").alias("request_hash"), "payload_malformed")
