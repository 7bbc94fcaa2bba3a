"""Line dedup over batches of documents, against levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import free_name, give_back, read, shuffle_parts, slices, written

LEAST = 10
BATCHES = 5
#: Runs of one level that are compacted into one of the next.
FANOUT = 3
_STRIPPED = b" \t\n\r\x0b\x0c"
_LOWEST = -(1 << 63)


def line_keys(text: str | None, least: int = LEAST) -> list[bytes | None]:
    """For each line the 128-bit hash of its key; None where the key is shorter than ``least`` code points.

    The key is the line without ASCII white space at both ends, A-Z lower-cased. Null is one empty line.
    """
    h, out = xxhash.xxh3_128_digest, []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(_STRIPPED).lower()
        n = len(key)
        out.append(h(key) if n >= least and (n >= 4 * least or len(key.decode()) >= least) else None)
    return out


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b, 1):
            at, keys = [], []
            for i, t in enumerate(part.column(1)):
                own = {k for k in line_keys(t.as_py()) if k is not None}
                at.extend([i] * len(own))
                keys.extend(own)
            ids = part.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary())], ["id", "key"])
    give_back()


def _keep_batches(columns: list[str], names: tuple[str, str]):
    """Batches of the own ``columns`` and the keys to drop; a text at a time is split into lines."""
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                out, lines, dropped = [], [], []
                for t, d in zip(b.column(at), b.column(len(columns))):
                    text = t.as_py()
                    all_ = (text or "").split("\n")
                    n = len(all_)
                    if d.is_valid and len(d):
                        own = set(d.as_py())
                        all_ = [x for x, k in zip(all_, line_keys(text)) if k not in own]
                        text = "\n".join(all_)
                    out.append(text)
                    lines.append(n)
                    dropped.append(n - len(all_))
                cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*columns, *names])
        give_back()

    return run


class Runs:
    """Sorted runs of keys already seen, in levels; FANOUT runs of a level become one of the next."""

    def __init__(self, parts: int) -> None:
        self.parts, self.levels = parts, []

    def _sorted(self, keys: DataFrame) -> DataFrame:
        return written(keys.select("key").repartition(self.parts, "key").sortWithinPartitions("key"), "run")

    def unseen(self, keys: DataFrame) -> DataFrame:
        for _, run in self.levels:
            keys = keys.join(run.hint("merge"), "key", "left_anti")
        return keys

    def add(self, run: DataFrame) -> None:
        self.levels.append((0, run))
        while len(self.levels) >= FANOUT and len({k for k, _ in self.levels[-FANOUT:]}) == 1:
            level = self.levels[-1][0]
            last = [self.levels.pop()[1] for _ in range(FANOUT)]
            whole = last[0]
            for x in last[1:]:
                whole = whole.unionByName(x)
            self.levels.append((level + 1, self._sorted(whole)))


def dropped_keys(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(id, key): keys that a document loses, as a document with a smaller id holds them.

    Batches are ranges of ascending ids. A batch's keys that no run has (merge anti-join) belong to its
    smallest id that has them; they become a new run. Whatever else the batch's documents hold is lost.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce("doc_id", F.lit(_LOWEST)).cast("long").alias("id"), "text")
    cuts = ids.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    batch = sum((F.when(F.col("id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    keys = ids.mapInArrow(_key_batches, "id long, key binary").withColumn("batch", batch)
    keys = written(keys, "lines")
    runs, lost = Runs(shuffle_parts(spark)), None
    for b in range(len(cuts) + 1):
        own = keys.where(F.col("batch") == b).select("id", "key")
        first = runs.unseen(own.groupBy("key").agg(F.min("id").alias("id")))
        run = written(first.repartition(runs.parts, "key").sortWithinPartitions("key"), "run")
        gone = own.join(run, ["id", "key"], "left_anti")
        lost = gone if lost is None else lost.unionByName(gone)
        if b < len(cuts):
            runs.add(run.select("key"))
    return lost


def dedup_lines(docs: DataFrame, batches: int = BATCHES, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and the counts ``names``.

    A line whose key has at least LEAST code points stays only in the document with the smallest doc_id
    that holds the key, with all its repeats there. Rows with the same doc_id are one document; null
    ids are one document, below all others, which so never loses a line. A null text stays null and counts one
    line. Columns of ``docs`` with the counts' names are replaced. An empty table gives an empty result.
    """
    base = docs.drop(*names)
    columns = base.columns
    own, drop = free_name(columns, "id"), free_name(columns, "keys")
    lost = dropped_keys(base, batches).groupBy("id").agg(F.collect_list("key").alias(drop)).withColumnRenamed("id", own)
    joined = base.withColumn(own, F.coalesce("doc_id", F.lit(_LOWEST)).cast("long")).join(lost, own, "left")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    asked = joined.select(*[F.col(f"`{c}`") for c in columns], drop)
    return asked.mapInArrow(_keep_batches(columns, names), f"{kinds}, `{names[0]}` long, `{names[1]}` long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``; the same columns, all others with their values."""
    names = free_name(docs.columns, "n_lines_"), free_name(docs.columns, "n_dropped_")
    return dedup_lines(docs, names=names).drop(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT x.doc_id, x.pos, x.line, f.first_id IS NOT NULL AND f.first_id < x.doc_id AS gone
  FROM keyed x LEFT JOIN firsts f ON x.k = f.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
