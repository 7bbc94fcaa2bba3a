"""Concept hierarchies, requests and responses mapped onto the driver's tables, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = """
SELECT 'ROOT' AS p, concat('R', r_regionkey) AS c FROM region
UNION ALL SELECT concat('R', n_regionkey), concat('N', n_nationkey) FROM nation
UNION ALL SELECT concat('N', c_nationkey), concat('C', c_custkey) FROM customer
UNION ALL SELECT concat('N', s_nationkey), concat('S', s_suppkey) FROM supplier
UNION ALL SELECT DISTINCT 'ROOT', concat('T:', p_type) FROM part
UNION ALL SELECT DISTINCT 'ROOT', concat('B:', p_brand) FROM part
UNION ALL SELECT concat('T:', p_type), concat('P', p_partkey) FROM part
UNION ALL SELECT concat('B:', p_brand), concat('P', p_partkey) FROM part
"""
REQUESTS = """
SELECT d.doc_id AS request_id, d.doc_id AS ordinal, concat('T', 1 + d.doc_id % 3) AS task, d.lang AS family, concat('I', floor(d.doc_id / 3) % 3) AS information,
       CAST(1 + d.doc_id % 5 AS INT) AS a_count, CAST(d.doc_id % 6 AS INT) AS b_count, CAST(d.n_chars AS DOUBLE) AS sampling_weight,
       CAST(floor(d.doc_id / 9) AS BIGINT) AS base_sample_id, 4 AS option_count, l.quality = 1 AS gold_bool, CAST(d.doc_id % 3 AS INT) AS gold_kind
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""
REQUESTS = REQUESTS.replace("concat('I', floor(d.doc_id / 3) % 3)", "concat('I', CAST(floor(d.doc_id / 3) AS BIGINT) % 3)").replace("d.doc_id % 3 AS INT) AS gold_kind", "(d.doc_id + l.quality) % 3 AS INT) AS gold_kind")
RESPONSES = """
SELECT CAST(floor(event_id / 3) AS BIGINT) AS request_id, event_id AS ordinal,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
       CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN '429 rate limit' WHEN event_id % 3 = 1 THEN 'BadRequestError' ELSE 'Timeout' END AS error_state,
       CASE event_id % 11 WHEN 0 THEN 'True, because x' WHEN 1 THEN 'False.' WHEN 2 THEN '[1, 3]' WHEN 3 THEN '[]' WHEN 4 THEN 'I cannot answer'
            WHEN 5 THEN 'The answer is true.' WHEN 6 THEN '[1, 1]' WHEN 7 THEN 'answer: [1]' WHEN 8 THEN '' WHEN 9 THEN '[5]' ELSE 'true' END AS final_answer_text
FROM events
"""


def run_sql(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    """``sql`` over the named tables of ``sf_dir``, without views that outlive the call."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        for word in ("FROM ", "JOIN "):
            sql = sql.replace(f"{word}{t}", f"{word}{{{t}}}")
    return spark.sql(sql, **frames)


def edges(spark: SparkSession, sf_dir: str, family: str = "wordnet") -> DataFrame:
    return run_sql(spark, sf_dir, EDGES, ("region", "nation", "customer", "supplier", "part")).select(F.lit(family).alias("family"), F.col("p").alias("parent"), F.col("c").alias("child"))


def nodes(edge: DataFrame) -> DataFrame:
    ids = edge.select("family", F.explode(F.array("parent", "child")).alias("object_id")).distinct()
    return ids.select("family", "object_id", F.col("object_id").alias("surface"), F.concat(F.lit("about "), "object_id").alias("gloss"), F.lit(True).alias("usable"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run_sql(spark, sf_dir, REQUESTS, ("documents", "labels"))
    sets = F.when(F.col("gold_kind") == 0, F.array().cast("array<int>")).when(F.col("gold_kind") == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(3), F.lit(1)))
    return r.withColumn("gold_set", F.when(F.col("task") == "T2", sets)).withColumn("gold_bool", F.when(F.col("task") != "T2", F.col("gold_bool"))).drop("gold_kind")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, RESPONSES, ("events",))
