"""What the operators of this subpackage share: a shared work folder, written tables, row keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has no such setting and all runs on one machine (tests) a folder of our own is
    set; on a cluster a missing setting raises, as executors would write where nobody reads.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexgrove-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared work folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def first_by_hash(rows: DataFrame, group: str, want: int) -> DataFrame:
    """Rows of each group that are its ``want`` first by the 64-bit hash ``h``, rows of equal hash all.

    A group's count sets the share of hashes that is looked at, so that ranking never gathers a whole group:
    about twice as many hashes as wanted come to the driver, eight bytes each, and give the bound. Few groups are expected.
    """
    own = F.col(group)
    share = F.lit(None).cast("long")
    for r in rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > 4 * want).collect():
        at = -(1 << 63) + int((1 << 64) * (2 * want + 100) / r["n"])
        share = F.when(own == F.lit(r[group]), F.lit(min(at, (1 << 63) - 1)).cast("long")).otherwise(share)
    found: dict[object, list[int]] = {}
    for r in rows.where(share.isNull() | (F.col("h") <= share)).select(group, "h").collect():
        found.setdefault(r[group], []).append(r["h"])
    bound = F.lit(None).cast("long")
    for value, hashes in found.items():
        bound = F.when(own == F.lit(value), F.lit(sorted(hashes)[:want][-1]).cast("long")).otherwise(bound)
    return rows.where(F.col("h") <= bound)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or with as many underscores behind it as no column has; columns are the same in any case of letters."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about ``most`` bytes of a text or binary column at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + most)))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Hands a worker's free memory to the system: workers live on between tasks, and count against the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass
