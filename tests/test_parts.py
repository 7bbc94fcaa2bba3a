"""Numbered parts: read by byte ranges, written with a commit, gone on with after a break."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexgrove.sources import parts


def test_lines_are_numbered_over_byte_ranges(spark, tmp_path):
    r = random.Random(2)
    want, k = [], 0
    for p in range(3):
        lines = []
        for _ in range(r.randint(1, 900)):
            if r.random() < 0.1:
                lines.append(r.choice(["", "   "]))
            lines.append(json.dumps({"i": k, "s": "x" * r.randint(0, 80)}))
            want.append((f"part-{p:05d}.jsonl", k))
            k += 1
        (tmp_path / f"part-{p:05d}.jsonl").write_text("\n".join(lines) + ("\n" if p else ""))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = parts.read_records(spark, str(tmp_path), "i long, s string").collect()
        blocks = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert blocks > 5
    assert sorted((x["part"], x["ordinal"]) for x in got) == want
    assert all(x["r"]["i"] == x["ordinal"] and x["malformed"] is None for x in got)


def test_malformed_records_are_told(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1}\n{"i": \n{"i": 3}\n')
    got = parts.read_records(spark, str(tmp_path), "i long").orderBy("ordinal").collect()
    assert [(x["r"]["i"], x["malformed"]) for x in got] == [(1, None), (None, '{"i": '), (3, None)]


def test_parts_are_written_checked_and_gone_on_with(spark, tmp_path):
    rows = spark.range(1003).select(F.col("id").alias("ordinal"), F.concat(F.lit("row "), "id").alias("s"))
    folder = tmp_path / "out"
    made = parts.write_parts(rows.repartition(5), str(folder), "ordinal", 100)
    files = sorted(p.name for p in folder.glob("part-*"))
    assert files == [parts.part_name(k) for k in range(11)] and made["rows"] == 1003 and [p["rows"] for p in made["parts"]] == [100] * 10 + [3]
    read = [json.loads(x) for f in files for x in (folder / f).read_text().splitlines()]
    assert [x["ordinal"] for x in read] == list(range(1003)) and read[7]["s"] == "row 7"
    # Broken off half-way: the rest is written, what is there stays the same.
    whole = {f: (folder / f).read_text() for f in files}
    for f in files[4:]:
        (folder / f).unlink()
    parts.manifest(str(folder)).unlink()
    assert parts.write_parts(rows, str(folder), "ordinal", 100) == made
    assert {f: (folder / f).read_text() for f in files} == whole
    # Other rows than those that are there, or fewer, are refused, and nothing is touched.
    for other in (rows.withColumn("s", F.when(F.col("ordinal") == 250, "x").otherwise(F.col("s"))), rows.where("ordinal < 500")):
        with pytest.raises(Exception, match="part-0000"):
            parts.write_parts(other, str(folder), "ordinal", 100)
        assert {p.name: p.read_text() for p in Path(folder).glob("part-*")} == whole
