"""The append-only response log: selection, latest state, pending requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import text


def select_response(responses: DataFrame) -> DataFrame:
    """One row per request: a success beats anything else, then the later ordinal."""
    cols = [c for c in responses.columns if c != "request_id"]
    ok = (F.col("status") == "success").cast("int")
    best = responses.where("request_id is not null").groupBy("request_id").agg(F.max_by(F.struct(*cols), F.struct(F.coalesce(ok, F.lit(0)), "ordinal")).alias("r"))
    return best.select("request_id", "r.*")


def log_state(responses: DataFrame) -> DataFrame:
    """(request_id, completed, attempts, latest_status, latest_error, latest): completed stays once a row was terminal."""
    end = text.is_terminal(F.col("status"), F.col("error_state"))
    last = F.max_by(F.struct("status", "error_state"), "ordinal")
    out = responses.where(F.coalesce(F.col("request_id").cast("string"), F.lit("")) != "").groupBy("request_id").agg(F.bool_or(end).alias("completed"), F.count("*").alias("attempts"), last.alias("l"))
    status, error = F.col("l.status"), F.col("l.error_state")
    kind = F.when(status.eqNullSafe("success"), "success").when(text.is_retryable(status, error), "retryable").otherwise("permanent")
    return out.select("request_id", "completed", "attempts", status.alias("latest_status"), error.alias("latest_error"), kind.alias("latest"))


def terminal_counts(state: DataFrame) -> DataFrame:
    """One row: requests whose latest row is a success, retryable or permanent, and the terminal ones."""
    n = lambda k: F.count_if(F.col("latest") == k)
    return state.agg(n("success").alias("success"), n("retryable").alias("retryable"), n("permanent").alias("permanent"), (n("success") + n("permanent")).alias("terminal"), F.count_if(F.col("completed")).alias("completed"))


def pending(requests: DataFrame, responses: DataFrame, limit: int | None = None) -> DataFrame:
    """Requests without a terminal row, in their order; permanent errors are not tried again."""
    done = log_state(responses).where("completed").select("request_id")
    out = requests.join(done, "request_id", "left_anti")
    return out.orderBy("ordinal").limit(limit) if limit is not None else out
