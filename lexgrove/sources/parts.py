"""Numbered parts of JSON lines: read by byte ranges, and written by tasks with a commit that a broken-off write can go on from."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lexgrove.operators.work import written

#: Byte ranges up to which their counts are broadcast.
FEW_RANGES = 100_000


def part_name(number: int) -> str:
    return f"part-{number:05d}.jsonl"


def manifest(folder: str) -> Path:
    """The file beside a folder of parts that says what they hold."""
    return Path(f"{folder}.json")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(part, ordinal, value): the lines of a file or of all files of a folder that are not blank, numbered from 0 by file name and then by line.

    Files are read in the byte ranges that Spark splits them into, so that a large one is read by many tasks. A line knows
    its range and its place in it; the counts of the ranges give the places of all lines.
    """
    at = F.monotonically_increasing_id()
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    raw = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    lines = written(raw.select(name.alias("part"), F.col("_metadata.file_block_start").alias("start"), "value", at.alias("at")), "lines")
    ranges = lines.groupBy("part", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    own = Window.partitionBy("part").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))
    # One row for each part.
    parts = ranges.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    ranges = written(ranges.join(parts, "part").select("part", "start", (F.col("earlier") + F.col("before") - F.col("first")).alias("move")), "ranges")
    few = ranges.limit(FEW_RANGES + 1).count() <= FEW_RANGES
    placed = lines.join(F.broadcast(ranges) if few else ranges, ["part", "start"])
    return placed.select("part", (F.col("at") + F.col("move")).alias("ordinal"), "value")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of numbered parts: part, ordinal, ``r`` (a struct of ``schema``), and ``malformed``: the line, where it is no such record."""
    lines = read_lines(spark, path)
    whole = F.from_json("value", f"{schema}, _malformed string", {"columnNameOfCorruptRecord": "_malformed"})
    names = [f.name for f in StructType.fromDDL(schema)]
    parsed = lines.select("part", "ordinal", whole.alias("w"))
    return parsed.select("part", "ordinal", F.struct(*[F.col("w")[n].alias(n) for n in names]).alias("r"), F.col("w._malformed").alias("malformed"))


@dataclass
class _Done(WriterCommitMessage):
    parts: list[tuple[int, int, str, str]]


class _PartsWriter(DataSourceWriter):
    """Tasks write whole parts beside their final names; the commit checks and renames them."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> _Done:
        from pyspark import TaskContext

        mark, parts = f"{TaskContext.get().taskAttemptId()}.tmp", []
        number, n, h, file = None, 0, None, None

        def close() -> None:
            file.close()
            parts.append((number, n, h.hexdigest(), file.name))

        for r in iterator:
            if r["part"] != number:
                if file:
                    close()
                number, n, h = r["part"], 0, hashlib.sha256()
                file = open(f"{self.folder}/{part_name(number)}.{mark}", "wb")  # noqa: SIM115
            line = (r["line"] + "\n").encode()
            h.update(line)
            file.write(line)
            n += 1
        if file:
            close()
        return _Done(parts)

    def commit(self, messages: list[_Done | None]) -> None:
        """A part that is there already must be the same; then all get their names, and the manifest says what they hold."""
        made = sorted(p for m in messages if m for p in m.parts)
        numbers = [p[0] for p in made]
        try:
            if numbers != list(range(len(numbers))):
                raise ValueError(f"parts are not numbered from 0 without gaps: {numbers[:20]}")
            for number, n, digest, _ in made:
                was = known_part(self.folder, number)
                if was and was != (n, digest):
                    raise ValueError(f"{part_name(number)} holds other rows than this write would")
            beyond = Path(self.folder, part_name(len(numbers)))
            if beyond.exists():
                raise ValueError(f"{beyond.name} is beyond the last part of this write")
        except ValueError:
            self.abort(messages)
            raise
        for number, _, _, name in made:
            os.replace(name, f"{self.folder}/{part_name(number)}")
        body = {"parts": [{"part": part_name(p), "rows": n, "sha256": digest} for p, n, digest, _ in made], "rows": sum(p[1] for p in made)}
        Path(f"{self.folder}.tmp").write_text(json.dumps(body, indent=1), encoding="utf-8")
        os.replace(f"{self.folder}.tmp", manifest(self.folder))

    def abort(self, messages: list[_Done | None]) -> None:
        for m in messages:
            for p in m.parts if m else ():
                Path(p[3]).unlink(missing_ok=True)


def known_part(folder: str, number: int) -> tuple[int, str] | None:
    """Rows and digest of a part that is there, read a block at a time."""
    path = Path(folder, part_name(number))
    if not path.exists():
        return None
    n, h = 0, hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            n += block.count(b"\n")
            h.update(block)
    return n, h.hexdigest()


class PartsSource(DataSource):
    """Format ``numbered_parts``: rows of (part, line), sorted by part, into the files of a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "numbered_parts"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PartsWriter(self.options["path"])


def write_parts(rows: DataFrame, folder: str, ordinal: str, part_rows: int, columns: list[str] | None = None) -> dict:
    """Files part-00000.jsonl and on with ``part_rows`` rows each, in the order of ``ordinal``, the rows' places from 0; returns the manifest.

    A row is a JSON object of ``columns``, all if not given, by name. Rows are dealt by part, and a task writes whole parts. Nothing gets its final name before all parts are written and agree
    with those that an earlier, broken-off write has left; a difference raises, and leaves what was there.
    """
    spark = rows.sparkSession
    spark.dataSource.register(PartsSource)
    Path(folder).mkdir(parents=True, exist_ok=True)
    folder = folder.rstrip("/")
    cols = sorted(columns or rows.columns)
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols)), {"ignoreNullFields": "false"}).alias("line")
    dealt = rows.select(F.floor(F.col(ordinal) / part_rows).cast("int").alias("part"), F.col(ordinal).alias("at"), line)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartitionByRange(n, "part").sortWithinPartitions("part", "at").select("part", "line")
    dealt.write.format("numbered_parts").option("path", folder).mode("append").save()
    return json.loads(manifest(folder).read_text(encoding="utf-8"))
