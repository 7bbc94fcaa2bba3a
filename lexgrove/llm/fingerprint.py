"""Document fingerprints by consistent weighted sampling, in DataFrame functions only."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import read, shuffle_parts

#: Samples of a fingerprint, in groups that are drawn together.
GROUPS, PER_GROUP = 16, 4
SAMPLES = GROUPS * PER_GROUP
#: Steps of the table of Gamma(2, 1) quantiles, as bits.
STEP_BITS = 10
#: Bits of a candidate that tell it, and those of them that a fingerprint keeps and likeness compares.
_CODE_BITS, CODE_BITS, _LOWEST = 23, 16, -(1 << 63)
#: Bytes of text that a task of neighbours or draws is to hold, about, and ranges of doc_ids a task.
TASK_BYTES, RANGES = 32 << 20, 4


@functools.cache
def gamma_quantiles(bits: int = STEP_BITS) -> list[float]:
    """Quantiles of the Gamma(2, 1) distribution at the middles of 2**bits equal steps, by bisection."""
    out, n = [], 1 << bits
    for k in range(n):
        want, lo, hi = (k + 0.5) / n, 0.0, 60.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if 1 - (1 + mid) * math.exp(-mid) < want else (lo, mid)
        out.append((lo + hi) / 2)
    return out


def _table(values: list[float]) -> Column:
    """A constant array, given as one string, so that it is one node of the plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def words(text: Column) -> Column:
    """Lower-cased runs without ASCII white space; may hold empty strings at its ends."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D]+")


def _draw(term: Column, at: Column, log_weights: list[Column]) -> list[Column]:
    """One sample's candidate of a term under each weight, as a long whose minimum over terms wins.

    With r and c from Gamma(2, 1) and b uniform, all fixed by term and sample, a weight w gives t =
    floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the term with the least a is the sample,
    told by term and t. The long holds ln a in its upper 40 bits and, below, the first bits of the hash of
    term and sample, with t in their lowest.
    """
    table = gamma_quantiles()
    steps = F.lit((1 << STEP_BITS) - 1).cast("long")
    x = F.xxhash64(term, at)
    r = F.get(_table(table), x.bitwiseAND(steps).cast("int"))
    c = F.get(_table([math.log(v) for v in table]), F.shiftright(x, STEP_BITS).bitwiseAND(steps).cast("int"))
    b = F.shiftrightunsigned(x, 2 * STEP_BITS) / F.lit(float(1 << (64 - 2 * STEP_BITS)))
    out = []
    for w in log_weights:
        t = F.floor(w / r + b)
        a = c - r * (t - b + 1)
        rank = ((a + 64.0) * float(1 << (63 - 7 - _CODE_BITS))).cast("long")
        own = F.shiftrightunsigned(x, 64 - _CODE_BITS).bitwiseXOR(F.shiftleft(t.cast("long"), _CODE_BITS - CODE_BITS))
        out.append(F.shiftleft(rank, _CODE_BITS).bitwiseOR(own.bitwiseAND(F.lit((1 << _CODE_BITS) - 1).cast("long"))))
    return out


def signatures(terms: DataFrame, keys: list[str], weights: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """For each key: one array of SAMPLES codes for each weight column; terms (``term`` long) are distinct within a key.

    The greatest values of ``carried`` long columns come along.

    Two signatures' share of equal codes estimates the generalised Jaccard similarity of their weighted
    terms, sum of least weights over sum of greatest. Codes are CODE_BITS bits; without a positive weight all are 0.
    """
    logs = terms.select(*keys, *carried, "term", *(F.ln(F.col(w).cast("double")).alias(f"l_{w}") for w in weights))
    spread = logs.withColumn("g", F.explode(F.array(*map(F.lit, range(GROUPS)))))
    least = []
    for i in range(PER_GROUP):
        drawn = _draw(F.col("term"), F.col("g") * PER_GROUP + i, [F.col(f"l_{w}") for w in weights])
        least += [F.min(d).alias(f"{w}_{i}") for w, d in zip(weights, drawn)]
    top = [F.max(c).alias(c) for c in carried]
    found = spread.groupBy(*keys, "g").agg(*least, *top)
    mask = F.lit((1 << CODE_BITS) - 1).cast("long")
    codes = [F.array(*(F.coalesce(F.shiftright(f"{w}_{i}", _CODE_BITS - CODE_BITS).bitwiseAND(mask), F.lit(0).cast("long")) for i in range(PER_GROUP))).alias(w) for w in weights]
    rows = found.select(*keys, *carried, F.struct("g", *codes).alias("group")).groupBy(*keys).agg(F.array_sort(F.collect_list("group")).alias("groups"), *top)
    return rows.select(*keys, *carried, *(F.flatten(F.col("groups")[w]).alias(w) for w in weights))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal codes of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SAMPLES))


def as_hex(signature: Column) -> Column:
    """Four hex digits of each code."""
    return F.array_join(F.transform(signature, lambda c: F.lower(F.lpad(F.hex(c), 4, "0"))), "")


def with_next(docs: DataFrame) -> DataFrame:
    """(b, pos, s, doc_id, text, next): each row and the text of the row after it, by descending doc_id; after the last comes the first.

    Rows are dealt by ranges of doc_id with fixed bounds, as many as the bytes of all texts ask for, and ordered within
    a range; of equal ids the text's hash decides, and a null id comes last. The first row of a range is copied, with s = 1, to the end of the
    range before it, so that no order over all rows is needed. Null texts are empty.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)))
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    tasks = max(shuffle_parts(spark), total // TASK_BYTES + 1)
    parts = RANGES * tasks
    cuts = sorted({int(c) for c in rows.approxQuantile("id", [k / parts for k in range(1, parts)], 1 / (4 * parts))})
    if cuts:
        bounds = F.array(*(F.lit(c).cast("long") for c in cuts))
        bucket = F.size(F.filter(bounds, lambda c: c <= F.col("id")))
    else:
        bucket = F.lit(0)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("home", bucket)
    heads = sorted(((r["home"], r["id"], r["tie"]) for r in rows.groupBy("home").agg(F.max_by(F.struct("id", "tie"), F.struct("id", -F.col("tie").cast("decimal(20,0)"))).alias("h")).select("home", "h.id", "h.tie").collect()), reverse=True)
    target = F.lit(None).cast("int")
    if heads:
        # The head of a range is the row after the last of the next higher range; that of the highest is after the very last.
        to = {h[0]: heads[k - 1][0] for k, h in enumerate(heads)}
        firsts = F.create_map(*[x for h in heads for x in (F.lit(h[0]), F.struct(F.lit(h[1]).cast("long").alias("id"), F.lit(h[2]).cast("long").alias("tie"), F.lit(to[h[0]]).alias("to")))])
        own = F.try_element_at(firsts, F.col("home"))
        target = F.when((own["id"] == F.col("id")) & (own["tie"] == F.col("tie")), own["to"])
    places = F.filter(F.array(F.struct(F.col("home").alias("b"), F.lit(0).alias("s")), F.struct(target.alias("b"), F.lit(1).alias("s"))), lambda x: x["b"].isNotNull())
    dealt = rows.select("doc_id", "text", "id", "tie", F.explode(places).alias("p")).select("p.b", "p.s", "doc_id", "text", "id", "tie").repartition(tasks, "b")
    order = Window.partitionBy("b").orderBy("s", F.desc("id"), "tie")
    return dealt.select("b", "s", "doc_id", "text", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("next"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next one's are.

    The edited text has its last third (of code points, rounded down) replaced by as many of the next
    document's first (or all it has). Terms are words, weighted by their counts. Texts without words are all alike.
    """
    rows = with_next(docs)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.select("b", "s", "pos", "doc_id", "text", edited.alias("edited"))
    digest = F.sha2("edited", 256)
    facts = [n.cast("string"), *(F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10) for k in range(4))]
    two = rows.select("b", "s", "pos", "doc_id", words(F.col("text")).alias("own"), words(F.col("edited")).alias("new"), F.array(*facts).alias("facts"))
    # Facts of a row ride along as elements behind its words, so that its text is dealt once; they have no weight.
    each = two.select("b", "s", "pos", "doc_id", F.size("own").alias("n"), (F.size("own") + F.size("new")).alias("m"), F.posexplode(F.concat("own", "new", "facts")).alias("i", "word"))
    kind = F.greatest(F.col("i") - F.col("m") + 1, F.lit(0))
    there = F.col("word") != ""
    each = each.select(
        "b", "s", "pos", "doc_id", kind.alias("kind"), F.when(kind > 0, F.col("word").try_cast("long")).otherwise(F.xxhash64("word")).alias("term"),
        (there & (F.col("i") < F.col("n"))).cast("int").alias("x"), (there & (F.col("i") >= F.col("n")) & (kind == 0)).cast("int").alias("y"),
    )
    keys = ["b", "s", "pos", "doc_id"]
    terms = each.groupBy(*keys, "kind", "term").agg(F.sum("x").alias("own"), F.sum("y").alias("new"))
    carried = ("n_chars", "h0", "h1", "h2", "h3")
    terms = terms.select(*keys, "term", "own", "new", *(F.when(F.col("kind") == k, F.col("term")).alias(c) for k, c in enumerate(carried, 1)))
    found = signatures(terms, keys, ["own", "new"], carried)
    after = F.lead("own").over(Window.partitionBy("b").orderBy("pos"))
    found = found.select(*found.columns, after.alias("after")).where("s = 0")
    return found.select(
        "doc_id", "n_chars", F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in carried[1:]))).alias("edited_sha256"),
        as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(read(spark, sf_dir, "documents"))
