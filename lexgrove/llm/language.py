"""Language ID by compression with per-language raw-content dictionaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import first_by_hash, read, written

#: The bounded sample that a language's dictionary is cut from: distinct texts at most, and bytes.
SAMPLE_DOCS, DICTIONARY_BYTES = 320, 120_000
LEVEL = 5
BLOCK = 8192
#: A text is rejected if the second best language needs less than this share more bytes than the best. On the held-out
#: rows of sf0.1 0.3 % of the rightly named texts lie below, and most of the wrongly named ones.
MARGIN = 0.01
_LETTER = regex.compile(r"\p{L}")


def is_held_out(mod: int = 5, rest: int = 0):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == rest


def _folded(text: str) -> str:
    return text.lower()


def learn(docs: DataFrame, texts: int = SAMPLE_DOCS, total: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each value of ``lang`` among the rows that are not held out.

    It holds whole texts: of the ``texts`` distinct ones of a language that come first by their hash, as many as
    fit ``total`` bytes; those over a quarter of that are left out, unless a language has no others, when its
    shortest is taken alone. Copies count once. Empty without such rows.
    """
    rows = docs.where(~F.coalesce(is_held_out(), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    each = written(rows.groupBy("lang", "h").agg(F.max(F.octet_length("text").cast("long")).alias("size")), "texts")
    fits = each.where(F.col("size") <= total // 4)
    chosen = first_by_hash(fits, "lang", texts).collect()
    own: dict[str, list[tuple[int, int]]] = {}
    for r in chosen:
        own.setdefault(r["lang"], []).append((r["h"], r["size"]))
    shortest = each.groupBy("lang").agg(F.min_by(F.struct("h", "size"), F.struct("size", "h")).alias("f")).select("lang", "f.h", "f.size")
    for r in shortest.collect():
        own.setdefault(r["lang"], [(r["h"], r["size"])])
    wanted = []
    for lang, found in own.items():
        filled = 0
        for h, n in sorted(found):
            if not filled or filled + n <= total:
                filled += n + 1
                wanted.append((lang, h))
    if not wanted:
        return {}
    keys = docs.sparkSession.createDataFrame(wanted, "lang string, h long").withColumn("lang", F.col("lang").cast(docs.schema["lang"].dataType))
    out: dict[str, list[str]] = {}
    for r in rows.join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect():
        out.setdefault(r["lang"], []).append(_folded(r["text"]))
    return {lang: "\n".join(parts).encode() for lang, parts in out.items()}


class Classifier:
    """Sizes of a text under each language's dictionary; the smallest wins."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = list(dictionaries)
        self.tools = [self._tool(raw) for raw in dictionaries.values()]

    @staticmethod
    def _tool(raw: bytes):
        import zstandard as z

        d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        params = z.ZstdCompressionParameters.from_level(LEVEL, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        return z.ZstdCompressor(dict_data=d, compression_params=params).compress

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected. The score is the best one's share when each saved half byte doubles the odds."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True
        raw = _folded(text).encode()
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(f(b)) for b in blocks) for f in self.tools]
        best, *rest = sorted(sizes)
        score = 1 / (1 + sum(math.exp2(-2 * min(200, s - best)) for s in rest))
        return self.langs[sizes.index(best)], score, bool(rest) and rest[0] - best <= MARGIN * best


def _batches(dictionaries: dict[str, bytes], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(dictionaries)
        for b in batches:
            got = [c.predict(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], columns)

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes] | None = None, prefix: str = "lang_") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected; learns from ``docs`` itself if no dictionaries are given.

    Each whole text is compressed under each language's dictionary; the smallest wins, ties go to the
    first language in order. Leads of at most MARGIN of the best size are rejected. Null texts, texts without a
    letter, and all texts if nothing was learnt, get ``und``, score 0, rejected. Columns of ``docs`` with the new
    names are replaced; ``prefix`` changes the names.
    """
    names = [f"{prefix}{n}" for n in ("pred", "score", "rejected")]
    base = docs.drop(*names)
    learnt = learn(base) if dictionaries is None else dictionaries
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(_batches(learnt, [*base.columns, *names]), f"{kinds}, {names[0]} string, {names[1]} double, {names[2]} boolean")


def known_language(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose language is rejected; the same columns with their values, whatever their names.

    Null texts, texts without a letter and narrow margins go.
    """
    prefix = "language_"
    while any(f"{prefix}{n}" in map(str.lower, docs.columns) for n in ("pred", "score", "rejected")):
        prefix += "_"
    found = identify(docs, prefix=prefix)
    return found.where(~F.col(f"{prefix}rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
