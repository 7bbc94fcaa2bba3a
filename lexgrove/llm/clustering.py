"""Centroid clustering: Lloyd's rounds over integer vectors, exact at every size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import read, written

CLUSTERS, COMPONENTS, ROUNDS, SEED = 8, 64, 10, 3
SCALE = 1024
#: Bits of a limb: sums travel as limbs, so that no sum leaves 64 bits.
LIMB = 32
_MOST = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, dim: int = COMPONENTS) -> DataFrame:
    """(vec_id, x array<double>): vectors of ``dim`` components, none null or not finite; others go."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", e).where((F.size(e) == dim) & fine).select("vec_id", e.cast("array<double>").alias("x"))


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers where every squared distance fits in them, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not scaled.size or np.abs(scaled).max() <= math.isqrt(_MOST // x.shape[1]) // 2:
        return scaled.astype(np.int64)
    exact = [int(s) if np.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.ravel(), x.ravel())]
    return np.array(exact, dtype=object).reshape(x.shape)


def nearest(v: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the lowest of equals) and the squared distance to it, for each row."""
    fits = math.isqrt(_MOST // v.shape[1]) // 2
    if v.dtype != object and any(abs(c) > fits for row in centroids for c in row):
        v = v.astype(object)
    far = np.empty((len(v), len(centroids)), v.dtype)
    for k, c in enumerate(centroids):
        gap = v - np.array(c, dtype=v.dtype)
        far[:, k] = (gap * gap).sum(axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(v)), best]


def _limbs(total: int) -> list[int]:
    out = []
    while not -(1 << LIMB - 1) <= total < 1 << LIMB - 1:
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


def _partial_sums(centroids):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centroids.value
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            if not len(f):
                continue
            v = whole(np.stack(f["x"].to_numpy()))
            near, _ = nearest(v, c)
            for k in np.unique(near).tolist():
                mine = v[near == k]
                own = np.array([len(mine), *mine.sum(axis=0).tolist()], dtype=object)
                sums[k] = sums[k] + own if k in sums else own
        rows = [(k, at, i, part) for k, own in sums.items() for at, total in enumerate(own) for i, part in enumerate(_limbs(int(total)))]
        if rows:
            yield pd.DataFrame(rows, columns=["cluster", "at", "limb", "part"])

    return run


def _assigned(centroids):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                near, far = nearest(whole(np.stack(f["x"].to_numpy())), centroids.value)
                yield pd.DataFrame({"vec_id": f["vec_id"], "cluster": near.astype(np.int32), "distance": [min(int(d), _MOST) for d in far]})

    return run


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``, as integers; all, if fewer.

    Equal ids go by their components; vectors without an id come last.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(h.alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    return [[int(q) for q in whole(np.array([r["x"]]))[0]] for r in rows]


def moved(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the floor of each centroid's mean over the vectors nearest to it; without vectors it stays.

    Each partition sends a sum for each centroid and component, and the sums of sums come to the driver: their
    number depends on the number of centroids and components only.
    """
    sent = kept.sparkSession.sparkContext.broadcast(centroids)
    parts = kept.mapInPandas(_partial_sums(sent), "cluster int, at int, limb int, part long")
    sums: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "at", "limb").agg(F.sum("part").alias("part")).collect():
        key = r["cluster"], r["at"]
        sums[key] = sums.get(key, 0) + (r["part"] << LIMB * r["limb"])
    return [[sums[k, 1 + i] // sums[k, 0] for i in range(len(c))] if sums.get((k, 0)) else c for k, c in enumerate(centroids)]


def lloyd(kept: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after ``rounds`` rounds; where a round moves none, the later ones would not either."""
    for _ in range(rounds if centroids else 0):
        was, centroids = centroids, moved(kept, centroids)
        if was == centroids:
            break
    return centroids


def assign(kept: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of each vector, and the squared distance, 2**63 - 1 at most."""
    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInPandas(_assigned(kept.sparkSession.sparkContext.broadcast(centroids)), f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CLUSTERS, dim: int = COMPONENTS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (decimal integers joined by commas).

    Vectors that are null, of another number of components, or with components that are null or not finite have no
    row. Rows with equal or null ids each have their own. Distances and their sums that pass 64 bits count as the
    largest long. An empty table gives an empty result; further columns of ``vectors`` are not read.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dim)
    centroids = lloyd(kept, first_centroids(kept, k, seed), rounds)
    # Written once: the sums and the rows that carry them come from the same assignment.
    rows = written(assign(kept, centroids), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), _MOST)
    facts = [(c, min(sums.get(c, 0), _MOST), total, ",".join(map(str, x))) for c, x in enumerate(centroids)]
    # One short row for each centroid.
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster`` of all ``embeddings``, with the digest of each vector's centroid; nulls, ties and empty tables as there."""
    made = cluster(read(spark, sf_dir, "embeddings"))
    return made.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _oracle() -> str:
    fine = f"len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}"
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE {fine}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS cluster, q
  FROM (SELECT * FROM v ORDER BY sha256('{SEED}:' || vec_id), q LIMIT {CLUSTERS})
)"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT v.id, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM v CROSS JOIN c{r} AS c
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY d, c.cluster) = 1
)""")
        if r == ROUNDS:
            break
        parts.append(f"""m{r} AS MATERIALIZED (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
    SELECT a.cluster, i, sum(v.q[i]) AS s, count(*) AS n
    FROM a{r} AS a JOIN v USING (id) CROSS JOIN range(1, {COMPONENTS + 1}) AS t(i) GROUP BY a.cluster, i
  ) GROUP BY cluster
), c{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} AS c LEFT JOIN m{r} AS m USING (cluster)
)""")
    return f"""
WITH {', '.join(parts)}
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN v USING (id) JOIN c{ROUNDS} AS c USING (cluster)
"""


ORACLE = _oracle()
