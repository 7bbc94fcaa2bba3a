"""The response log as a stream: the state of each request, updated as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import text


def stream_state(responses: DataFrame) -> DataFrame:
    """A stream of each touched request's new state (update mode).

    Completed once a terminal row was seen; latest by ordinal, whatever the order of arrival. Spark keeps a flag, a count and one
    row for each request.
    """
    end = text.is_terminal(F.col("status"), F.col("error_state"))
    last = F.max_by(F.struct("status", "error_state"), "ordinal")
    out = responses.groupBy("request_id").agg(F.bool_or(end).alias("completed"), F.count("*").alias("attempts"), last.alias("l"))
    return out.select("request_id", "completed", "attempts", F.col("l.status").alias("latest_status"), F.col("l.error_state").alias("latest_error"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over what is there, a batch at a time, into ``path``; returns each request's last state."""
    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream_state(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    got = stream.sparkSession.read.parquet(path)
    cols = ["completed", "attempts", "latest_status", "latest_error"]
    return got.groupBy("request_id").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("request_id", "s.*")
