"""Exact top-k by inner product: distributed histogram selection over blocks of queries and candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import read, written

K = 10
SCALE = 1024
EVERY = 100
#: Vectors of a block, and bins of each histogram.
QUERY_BLOCK, CANDIDATE_BLOCK, BINS = 1024, 2048, 256
#: Scores and components beyond this size count as this size.
_MOST = (1 << 62) - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): floor(SCALE * x) of each component, 2**62 - 1 in size at most; rows with null ids, null vectors or components that are null or not finite go."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", e).where(F.col("vec_id").isNotNull() & e.isNotNull() & fine).select("vec_id", F.transform(e, lambda x: F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), F.floor(x.cast("double") * SCALE)))).alias("v"))


def _blocks(size: int):
    """Rows of equal dimension into blocks: ids and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.asarray(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False), np.int64)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                for at in range(0, len(rows), size):
                    part = b.take(pa.array(rows[at : at + size]))
                    ids = part.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
                    v = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rows[at : at + size])], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["dim", "n", "ids", "v"])

    return run


def _unpacked(ids: bytes, v: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(v, "<i8").reshape(len(i), dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by float64 where every partial sum stays below 2**53, by long integers where 64 bits do not suffice.

    Those beyond 2**62 - 1 in size are cut to it, so that differences of scores stay within 64 bits.
    """
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.astype(object).T, -_MOST, _MOST).astype(np.int64)


def _tiles(columns: list[str]):
    def each(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.select(columns).to_pylist():
                qi, qv = _unpacked(r["q_ids"], r["q_v"], r["dim"])
                ci, cv = _unpacked(r["ids"], r["v"], r["dim"])
                s = _scores(qv, cv)
                own = qi[:, None] == ci[None, :]
                yield r, qi, ci, s, own

    return each


_LEAST = np.iinfo(np.int64).min


def _bounds(k: int):
    """For each query of a tile the kth score from above (null with fewer), the least, the greatest, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, qi, _, s, own in _tiles(["dim", "ids", "v", "q_ids", "q_v"])(batches):
            n = (~own).sum(axis=1)
            lo, high = np.where(own, np.iinfo(np.int64).max, s).min(axis=1), np.where(own, _LEAST, s)
            kth = np.partition(high, -k, axis=1)[:, -k] if high.shape[1] >= k else np.full(len(qi), _LEAST)
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(qi[some]), pa.array(kth[some], mask=(n < k)[some]), *(pa.array(x[some]) for x in (lo, high.max(axis=1), n))], ["query_id", "kth", "lo", "hi", "n"])

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histogram of each query's scores in its range [lo, hi]; scores outside count in no bin."""
    for r, qi, _, s, own in _tiles(["dim", "ids", "v", "q_ids", "q_v", "q_lo", "q_hi"])(batches):
        lo, hi = (np.asarray(r[k], np.int64)[:, None] for k in ("q_lo", "q_hi"))
        width = (hi - lo) // BINS + 1
        inside = (s >= lo) & (s <= hi) & ~own
        q, _ = np.nonzero(inside)
        bins = ((s - lo) // width)[inside]
        keys, counts = np.unique(q * BINS + bins, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(qi[keys // BINS]), pa.array((keys % BINS).astype(np.int32)), pa.array(counts.astype(np.int64))], ["query_id", "bin", "n"])


def _winners(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores that reach the query's threshold; of equal ones a tile needs to give its k smallest ids only."""
        for r, qi, ci, s, own in _tiles(["dim", "ids", "v", "q_ids", "q_v", "q_lo"])(batches):
            least = np.asarray(r["q_lo"], np.int64)[:, None]
            q, c = np.nonzero((s >= least) & ~own)
            if not len(q):
                continue
            got, ids = s[q, c], ci[c]
            order = np.lexsort((ids, -got, q))
            q, got, ids = q[order], got[order], ids[order]
            first = np.searchsorted(q, q, side="left")
            own_k = np.arange(len(q)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(x[own_k]) for x in (qi[q], ids, got)], ["query_id", "vec_id", "score"])

    return run


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Blocks of queries with their state; the block number decides which rows lie together."""
    packed = queries.groupBy("block", "dim").agg(F.sort_array(F.collect_list(F.struct("query_id", "v", "lo", "hi"))).alias("x"))
    return packed.select("block", "dim", F.col("x.query_id").alias("i"), F.flatten("x.v").alias("f"), F.col("x.lo").alias("q_lo"), F.col("x.hi").alias("q_hi"))


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [np.asarray(x, "<i8").tobytes() for x in b.column(2).to_pylist()]
        v = [np.asarray(x, "<i8").tobytes() for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(v, pa.binary()), b.column(4), b.column(5)], ["block", "dim", "q_ids", "q_v", "q_lo", "q_hi"])


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id ``every`` divides its k best other rows.

    Scores are inner products of integer vectors, ties go to the smaller vec_id. Every candidate is
    scored for every query, tile by tile: blocks of queries and blocks of candidates are dealt so that each
    pair of blocks meets once. The first pass gives each query's range: from the best of its tiles' kth
    scores up, so that few scores are counted from then on. Passes of global score histograms narrow it down to
    the kth score; a last pass gives the scores that reach it. Vectors of another dimension than a
    query's are no candidates of it. Rows that share a vec_id are one another's own row; the least of their
    vectors is the query, and each stays a candidate of other queries. Fewer than k candidates: all of them.
    Scores beyond 2**62 - 1 in size count as that. An empty table gives an empty result.
    """
    rows = integers(vectors)
    n = written(rows, "vectors")
    parts = max(1, n.count() // CANDIDATE_BLOCK + 1)
    dealt = n.repartition(parts, F.xxhash64("vec_id", "v"))
    blocks = written(dealt.mapInArrow(_blocks(CANDIDATE_BLOCK), "dim int, n int, ids binary, v binary").withColumn("cb", F.monotonically_increasing_id()), "blocks")
    queries = n.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").cast("long").alias("query_id")).agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    count = queries.count()
    nb = max(1, -(-count // QUERY_BLOCK))
    # Ids alone decide the block, so that a block's bytes are bounded and every pass deals them alike.
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(nb)).cast("int")), "queries")
    cbs = blocks.select("cb", F.col("dim").alias("c_dim")).distinct()

    def tiles(state: DataFrame) -> DataFrame:
        q = _query_blocks(queries.join(state, "query_id")).mapInArrow(_as_bytes, "block int, dim int, q_ids binary, q_v binary, q_lo array<long>, q_hi array<long>")
        # Every pair of a query block and a candidate block, by number: small tables of numbers, no rows.
        left = q.join(cbs, q["dim"] == cbs["c_dim"]).drop("c_dim")
        return left.join(blocks.drop("dim", "n"), "cb").repartition(F.col("block"), F.col("cb"))

    full = queries.select("query_id", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))
    found = tiles(full).mapInArrow(_bounds(k), "query_id long, kth long, lo long, hi long, n long").groupBy("query_id").agg(F.coalesce(F.max("kth"), F.min("lo")).alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    # want: how many scores of the range are needed; with fewer candidates than k all of them.
    state = written(found.select("query_id", "lo", "hi", F.least(F.col("n"), F.lit(k)).alias("want")), "state")
    while state.where("hi > lo").limit(1).count():
        width = F.expr(f"(hi - lo) div {BINS} + 1")
        narrowing = state.where("hi > lo")
        counts = tiles(narrowing.select("query_id", "lo", "hi")).mapInArrow(_counts, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # From the top bin down, the first in which the wanted number is reached.
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))
        hit = counts.withColumn("upto", above).join(narrowing, "query_id").where("upto >= want").groupBy("query_id").agg(F.max(F.struct("bin", "upto", "n")).alias("h"))
        new = narrowing.join(hit, "query_id").select(
            "query_id",
            (F.col("lo") + F.col("h.bin") * width).alias("lo"),
            F.least("hi", F.col("lo") + (F.col("h.bin") + 1) * width - 1).alias("hi"),
            (F.col("want") - (F.col("h.upto") - F.col("h.n"))).alias("want"),
        )
        state = written(state.where("hi <= lo").unionByName(new), "state")
    best = tiles(state.select("query_id", "lo", "hi")).mapInArrow(_winners(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
