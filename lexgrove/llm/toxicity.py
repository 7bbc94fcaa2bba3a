"""Toxicity: a linear classifier regularised by counterfactual swaps of identity terms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import first_by_hash, free_name, read, written

#: Labelled rows that the classifier is fitted on: this many of each label at most, first by a hash of the text.
SAMPLE = 2000
#: Size of the model: terms whose share differs between the labels by a z value of at least LEAST_Z and that LEAST_DOCS of the
#: sampled documents hold, FEATURES of them at most, the clearest first.
FEATURES, LEAST_Z, LEAST_DOCS = 4000, 3.5, 3
THRESHOLD = 0.7
#: Lengths in bytes of the stems that a word gives.
STEMS = (4, 5, 6, 7, 8, 9, 10)
#: Weight of the squared change of a sentence's score when an identity term is swapped, and of the weights' size.
COUNTERFACTUAL, RIDGE = 1.0, 1.0
#: Neutral mentions of groups, of which one is swapped for another.
IDENTITY = tuple(
    "woman women man men girl girls boy boys mother father muslim muslims christian christians jew jews jewish "
    "hindu hindus buddhist atheist catholic protestant gay lesbian bisexual transgender queer straight black white "
    "asian african european american latino hispanic arab indian chinese mexican immigrant immigrants refugee refugees "
    "foreigner foreigners disabled deaf blind elderly old young poor rich "
    "frau frauen mann männer moslem christen juden schwarz weiß ausländer flüchtling flüchtlinge behindert "
    "femme femmes homme hommes musulman musulmans chrétien chrétiens juif juifs noir blanc étranger étrangers réfugié réfugiés "
    "mujer mujeres hombre hombres musulmán musulmanes cristiano cristianos judío judíos negro blanco extranjero extranjeros refugiado refugiados".split()
)
_MARKS = bytes(c if c in b"'" or c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: str | None) -> set[bytes]:
    """Distinct words (runs of letters, digits, apostrophes and characters beyond ASCII; A-Z lower-cased), and stems.

    The stems of a word are its first bytes, of each of STEMS lengths, with a star, where it has more; inflected forms share them.
    """
    words = set((text or "").encode().translate(_MARKS).split())
    stems = [{w[:n] + b"*" for w in words if len(w) > n} for n in STEMS]
    return words.union(*stems)


class Model:
    """Weights of terms and an offset; a text's score is the logistic of the sum over its distinct terms."""

    def __init__(self, weights: dict[bytes, float], offset: float) -> None:
        self.weights, self.offset = weights, offset
        self.keys = frozenset(weights)

    def score(self, text: str | None) -> float:
        z = self.offset + sum(sorted(self.weights[t] for t in self.keys & terms(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def clearest(counts: list[tuple[bytes, int, int]], ones: int, zeros: int, count: int = FEATURES) -> list[bytes]:
    """Terms whose share among the two labels differs most, by z value; ``counts`` holds (term, documents of label 1, of label 0)."""
    n1, n0 = max(1, ones), max(1, zeros)
    found = []
    for t, a, b in counts:
        if a + b >= LEAST_DOCS:
            p = (a + b + 1) / (n1 + n0 + 2)
            z = abs(a / n1 - b / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
            if z >= LEAST_Z:
                found.append((-z, t))
    return [t for _, t in sorted(found)[:count]]


def fit(rows: list[tuple[str, int]], identity: tuple[str, ...] = IDENTITY, steps: int = 400) -> Model:
    """A model of labelled texts that are at hand; ``learn`` does the same over tables."""
    docs, counts, ones = [terms(t) for t, _ in rows], {}, sum(int(y) for _, y in rows)
    for d, (_, y) in zip(docs, rows):
        for t in d:
            n = counts.setdefault(t, [0, 0])
            n[1 - int(y)] += 1
    names = clearest([(t, a, b) for t, (a, b) in counts.items()], ones, len(rows) - ones)
    return fit_terms(docs, [int(y) for _, y in rows], names, identity, steps)


def fit_terms(docs: list[set[bytes]], ys: list[int], features: list[bytes], identity: tuple[str, ...] = IDENTITY, steps: int = 400) -> Model:
    """Logistic regression on term presence, with a counterfactual penalty.

    For each labelled text with identity terms, each such term is swapped for each other one; the mean
    squared change of the logit over these pairs is added to the loss. Identity terms always are
    features, so that their weights are learnt, and pulled together. Without both labels the model
    has no weights and scores the share of label 1 (0.5 without rows).
    """
    labels = np.asarray(ys, float)
    if not len(labels) or labels.min() == labels.max():
        p = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
        return Model({}, math.log(p / (1 - p)))
    groups = [t.encode() for t in identity]
    names = list(dict.fromkeys([*groups, *features]))
    at = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(docs), len(names)), np.float32)
    for i, d in enumerate(docs):
        x[i, [at[t] for t in at.keys() & d]] = 1
    g = len(groups)
    # Swaps of term a for term b change the logit by w[b] - w[a]: a quadratic form in the identity weights.
    form = np.zeros((g, g))
    for a in range(g):
        n = float(x[:, a].sum())
        for b in range(g) if n else ():
            if a != b:
                form[a, a] += n
                form[b, b] += n
                form[a, b] -= n
                form[b, a] -= n
    form /= max(1.0, float(x[:, :g].sum()) * (g - 1))
    w, offset = np.zeros(len(names)), 0.0
    m, v, m0, v0 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + offset, -30, 30)))
        e = weight * (p - labels) / len(labels)
        grad = x.T @ e.astype(np.float32) + RIDGE * w / len(labels)
        grad[:g] += 2 * COUNTERFACTUAL * (form @ w[:g])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        m0, v0 = 0.9 * m0 + 0.1 * e.sum(), 0.999 * v0 + 0.001 * e.sum() ** 2
        rate = 0.05 / (1 + k / 200)
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        offset -= rate * (m0 / (1 - 0.9**k)) / (math.sqrt(v0 / (1 - 0.999**k)) + 1e-8)
    return Model({t: float(c) for t, c in zip(names, w) if abs(c) > 1e-3}, float(offset))


def is_held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, t in enumerate(b.column(0).to_pylist()):
            own = sorted(terms(t))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array([i] * len(own), pa.int64())) for c in b.columns[1:]), pa.array(own, pa.binary())], ["h", "y", "term"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` texts of each label that are not held out, first by a hash of the text.

    Rows with a null label, text or doc_id, and labels other than 0 and 1, take no part; of two labels of
    one text both do, and equal texts count once. Terms are taken and counted on the executors; what comes to
    the driver is the counts of terms that LEAST_DOCS texts hold, and each text's numbers of chosen features.
    """
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("y in (0, 1)").where(~is_held_out())
    # The texts' hashes choose the rows first; only those rows' texts are then read. Equal texts share a hash, so copies count as one.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").isNull().alias("none")).where("not none").drop("none").join(own, "doc_id")
    keyed = written(keyed.groupBy("h", "y").agg(F.min("doc_id").alias("doc_id")), "labelled")
    chosen = written(first_by_hash(keyed, "y", sample), "chosen")
    ids = chosen.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("h"))
    texts = texts.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("h", "y").agg(F.min("text").alias("text")).select("text", "h", "y")
    pairs = written(texts.mapInArrow(_term_batches, "h long, y int, term binary"), "terms")
    rows = [(r["h"], r["y"]) for r in chosen.select("h", "y").distinct().orderBy("h", "y").collect()]
    ones = sum(y for _, y in rows)
    counted = pairs.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCS)
    names = clearest([(bytes(r["term"]), r["a"], r["b"]) for r in counted.collect()], ones, len(rows) - ones)
    kept = docs.sparkSession.createDataFrame([(bytearray(t),) for t in dict.fromkeys([*(t.encode() for t in IDENTITY), *names])], "term binary")
    found: dict[tuple[int, int], set[bytes]] = {r: set() for r in rows}
    for r in pairs.join(F.broadcast(kept), "term").select("h", "y", "term").collect():
        found[r["h"], r["y"]].add(bytes(r["term"]))
    return fit_terms([found[r] for r in rows], [y for _, y in rows], names)


def _batches(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], columns)

    return run


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with ``name``, from 0 to 1, of each whole text; null texts count as empty. An own column of that name is replaced."""
    base = docs.drop(name)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(_batches(model, [*base.columns, name]), f"{kinds}, {name} double")


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that score below THRESHOLD; the same columns with their values, whatever their names. Null texts score as empty ones."""
    name = free_name(docs.columns, "toxicity")
    return score(docs, learn(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), learn(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
