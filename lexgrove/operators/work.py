"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs on one machine, as in tests."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexgrove-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


@contextlib.contextmanager
def small_jobs(spark: SparkSession) -> Iterator[None]:
    """For dozens of jobs over small tables in a row: their plans are not compiled, as the classes of all of them fill the driver's memory."""
    key = "spark.sql.codegen.wholeStage"
    was = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def written(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df``, written as Parquet and read again: lineage ends here, and lost executors cost nothing.

    With ``by`` each of these columns' values has a folder of its own, so that a filter on them reads no others.
    """
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
