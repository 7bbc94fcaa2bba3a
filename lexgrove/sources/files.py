"""JSON-lines, sharded datasets, manifests, configuration."""

from __future__ import annotations

import json
import os
import tempfile
import time
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file or folder of JSON lines, by Spark's reader; a missing path gives no rows, blank lines are skipped."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, keys sorted, nulls kept."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).write.mode(mode).text(path)


def shard_number(group: Column, order: Column, rows_per_group: int = 3, shard_rows: int = 100_000) -> Column:
    """Shard of a base group by its 0-based index; a group of rows is never split."""
    groups = -(-shard_rows // rows_per_group)
    return F.floor(order / groups).cast("int")


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(path: str, value: dict, tries: int = 20) -> None:
    """Pretty JSON by a temporary file and an atomic replace, tried again while the target is locked."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=target.parent, suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
    for k in range(tries):
        try:
            os.replace(tmp, target)
            return
        except PermissionError:
            if k == tries - 1:
                raise
            time.sleep(0.05)


def load_config(path: str, defaults: dict | None = None) -> dict:
    """A TOML configuration over nested defaults; keys that end in _path are relative to the file."""
    with open(path, "rb") as f:
        got = tomllib.load(f)

    def merged(base: dict, over: dict) -> dict:
        out = dict(base)
        for k, v in over.items():
            if isinstance(v, dict):
                out[k] = merged(out.get(k) or {}, v)
            else:
                out[k] = str((Path(path).parent / v).resolve()) if k.endswith("_path") and isinstance(v, str) else v
        return out

    return merged(defaults or {}, got)
