"""Predictions, scores and evaluation rows, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.functions import text, unions
from lexgrove.functions.exact import rate
from lexgrove.operators import truth
from lexgrove.operators.runlog import select_response


def _parsed(rows: DataFrame, limit: int, literals: bool) -> DataFrame:
    ok = F.col("status") == "success"
    task, said = F.col("task"), F.col("final_answer_text")
    as_bool = F.when(ok & (task != "T2"), text.parse_bool(said, limit))
    as_set = F.when(ok & (task == "T2"), text.parse_list(said, F.col("option_count"), limit, literals))
    return rows.withColumn("parsed_bool", as_bool).withColumn("parsed_set", as_set)


def _judged(rows: DataFrame, error: Column) -> DataFrame:
    rows = rows.withColumn("parse_error", error).withColumn("format_valid", F.col("parse_error").isNull())
    hit = text.answer_matches(F.col("task"), F.col("parsed_bool"), F.col("parsed_set"), F.col("gold_bool"), F.col("gold_set"))
    return rows.withColumn("correct", F.col("format_valid") & hit)


def normal_gold(rows: DataFrame, gold: str | None = None) -> DataFrame:
    """Gold answers by task: T2 a set (none: empty), others a truth value (none: false).

    With ``gold``, a column of JSON text or VARIANT, gold_bool and gold_set come out of it, with ``gold_malformed``: text that is no
    JSON, and for T2 anything but whole numbers in an array or a value that counts as false. A malformed answer has neither.
    """
    two = F.col("task") == "T2"
    none = F.array().cast("array<int>")
    if gold is not None:
        rows = unions.with_variant(rows, gold, "__gold", "gold_malformed")
        value = F.col("__gold")
        numbers = unions.whole_numbers(value)
        odd = two & numbers.isNull() & unions.truth(value)
        rows = rows.withColumn("gold_malformed", F.col("gold_malformed") | F.coalesce(odd, F.lit(False)))
        fine = ~F.col("gold_malformed")
        rows = rows.withColumns({"gold_set": F.when(two & fine, F.coalesce(numbers, none)), "gold_bool": F.when(~two & fine, unions.truth(value))})
        return rows.drop("__gold")
    return rows.withColumns({"gold_set": F.when(two, F.coalesce("gold_set", none)), "gold_bool": F.when(~two, F.coalesce("gold_bool", F.lit(False)))})


def predictions(scored: DataFrame) -> DataFrame:
    """The prediction records of scored requests: parsed answer, error, and whether answer and reasoning were cut.

    A text over the limit counts as cut; response columns that the log lacks count as false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in scored.columns else F.lit(False)
    own = [c for c in ("sample_id", "request_id") if c in scored.columns]
    return scored.select(
        *own, "task", "parsed_bool", "parsed_set", F.col("parse_error").alias("parse_error_type"), (flag("text_cut") | flag("answer_truncated")).alias("answer_truncated"),
        flag("reasoning_available").alias("reasoning_available"), flag("reasoning_truncated").alias("reasoning_truncated"),
    )


def scores(requests: DataFrame, responses: DataFrame, limit: int = 2000, literals: bool = True) -> DataFrame:
    """Scored requests that have a response. Refusals replace parse errors of successes; other errors keep their text."""
    rows = _parsed(requests.join(select_response(responses).withColumnRenamed("ordinal", "response_ordinal"), "request_id"), limit, literals)
    bad = text.parse_error(F.col("task"), F.col("final_answer_text"), F.col("parsed_bool"), F.col("parsed_set"), limit)
    bad = F.when(bad.isNotNull() & text.is_refusal(F.col("final_answer_text")), text.REFUSAL).otherwise(bad)
    error = F.when(F.col("status") == "success", bad).otherwise(F.coalesce(F.when(F.col("error_state") != "", F.col("error_state")), F.lit(text.PROVIDER)))
    cut = (F.col("status") == "success") & (F.length(F.coalesce("final_answer_text", F.lit(""))) > limit)
    return _judged(rows.withColumn("text_cut", cut), error)


def evaluation_rows(requests: DataFrame, responses: DataFrame, limit: int = 2000, literals: bool = True) -> DataFrame:
    """Every request: those without a response are wrong, with their own error. Refusals are no kind of error here."""
    rows = _parsed(requests.join(select_response(responses).withColumnRenamed("ordinal", "response_ordinal"), "request_id", "left"), limit, literals)
    bad = text.parse_error(F.col("task"), F.col("final_answer_text"), F.col("parsed_bool"), F.col("parsed_set"), limit)
    failed = F.coalesce(F.when(F.col("error_state") != "", F.col("error_state")), F.lit(text.PROVIDER))
    error = F.when(F.col("status").isNull(), text.MISSING).when(F.col("status") == "success", bad).otherwise(failed)
    rows = _judged(rows, error)
    truth = F.col("task").isin("T1", "T3")
    return rows.select(
        *requests.columns, F.coalesce("status", F.lit("missing")).alias("status"), "parsed_bool", "parsed_set", "parse_error", "format_valid", "correct",
        F.coalesce(F.col("status") != "success", F.lit(False)).alias("provider_error"),
        F.when(F.col("task") == "T2", F.size("gold_set")).alias("gold_set_size"), F.when(F.col("parsed_set").isNotNull(), F.size("parsed_set")).alias("predicted_set_size"),
        F.when(truth, F.coalesce(F.col("parsed_bool"), F.lit(False))).alias("pred_true"), F.when(truth, F.col("gold_bool")).alias("gold_true"),
    ).withColumn("predicted_size_label", F.coalesce(F.col("predicted_set_size").cast("string"), F.lit("invalid")))


def _measures() -> list[Column]:
    hit, w = F.col("correct").cast("int"), F.col("sampling_weight")
    return [F.count("*").alias("total"), F.sum(hit).cast("long").alias("hits"), rate(F.sum(hit), F.count("*")).alias("accuracy"), F.sum(w).alias("weight"), rate(F.sum(w * hit), F.sum(w)).alias("weighted_accuracy")]


SLICES = ((), ("family",), ("task",), ("information",), ("cell",), ("a_count",), ("b_count",), ("family", "cell"), ("family", "task"), ("family", "task", "information"))
REPORT_SLICES = ((), ("family",), ("task",), ("information",), ("a_count",), ("b_count",), ("task", "information"), ("task", "cell"), ("family", "task"), ("family", "information"))


def slice_table(rows: DataFrame, slices: tuple[tuple[str, ...], ...] = SLICES) -> DataFrame:
    """All slices in one pass of grouping sets: (slice, label, total, hits, accuracy, weight, weighted_accuracy).

    ``label`` joins the values with "|"; null values are groups of their own.
    """
    rows = rows.withColumn("cell", F.concat_ws(",", "a_count", "b_count"))
    cols = sorted({c for s in slices for c in s})
    rows = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in cols), "correct", "sampling_weight")
    made = rows.groupingSets([[F.col(c) for c in s] for s in slices], *cols).agg(*_measures(), *(F.grouping(c).alias(f"g_{c}") for c in cols))
    name = F.concat_ws(",", *(F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in cols))
    label = F.concat_ws("|", *(F.when(F.col(f"g_{c}") == 0, F.col(c)) for c in cols))
    return made.select(name.alias("slice"), label.alias("label"), "total", "hits", "accuracy", "weight", "weighted_accuracy")


def information_effect(rows: DataFrame) -> DataFrame:
    """Base samples that have all three information levels: their number and the hits at each level."""
    wide = rows.groupBy("base_sample_id").pivot("information", ["I0", "I1", "I2"]).agg(F.max_by(F.col("correct").cast("int"), "ordinal")).where("I0 is not null and I1 is not null and I2 is not null")
    return wide.agg(F.count("*").alias("paired"), *(F.coalesce(F.sum(i), F.lit(0)).cast("long").alias(f"hits_{i}") for i in ("I0", "I1", "I2")))


def binary_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and rates over T1 and T3; an answer that is not valid counts as predicted false."""
    t = rows.where(F.col("task").isin("T1", "T3"))
    n = lambda g, p: F.count_if((F.col("gold_true") == g) & (F.col("pred_true") == p))
    c = t.groupBy(*keys).agg(F.count("*").alias("n"), n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn"))
    v = F.col
    return c.select(
        *keys, "n", "tp", "fp", "fn", "tn", rate(v("tp") + v("tn"), v("n")).alias("accuracy"), rate(v("tp"), v("tp") + v("fp")).alias("positive_precision"), rate(v("tp"), v("tp") + v("fn")).alias("positive_recall"),
        rate(v("tn"), v("tn") + v("fn")).alias("negative_precision"), rate(v("tn"), v("tn") + v("fp")).alias("negative_recall"), rate(v("tp") + v("fp"), v("n")).alias("predicted_true_rate"),
    )


def matrix(values: DataFrame, value: str) -> DataFrame:
    """a_count by b_count: the mean of ``value`` in columns b0 to b5; null where there is none."""
    wide = values.groupBy("a_count").pivot("b_count", [0, 1, 2, 3, 4, 5]).agg(F.avg(value))
    return wide.withColumnsRenamed({str(b): f"b{b}" for b in range(6)})


def set_size_table(rows: DataFrame) -> DataFrame:
    """T2: gold size 0 to 2 by predicted size 0 to 4 or invalid, with counts and shares of the row; absent pairs are 0."""
    spark = rows.sparkSession
    golds = spark.range(3).select(F.col("id").cast("int").alias("gold_set_size"))
    labels = spark.range(1).select(F.explode(F.array(*map(F.lit, ("0", "1", "2", "3", "4", "invalid")))).alias("predicted_size_label"))
    n = rows.where("task = 'T2'").groupBy("gold_set_size", "predicted_size_label").agg(F.count("*").alias("n"))
    full = golds.join(F.broadcast(labels), F.lit(True)).join(n, ["gold_set_size", "predicted_size_label"], "left").fillna(0, ["n"])
    total = full.groupBy("gold_set_size").agg(F.sum("n").alias("t"))
    return full.join(total, "gold_set_size").select("gold_set_size", "predicted_size_label", F.col("n").cast("long").alias("n"), F.coalesce(rate(F.col("n"), F.col("t")), F.lit(0.0)).alias("share"))


def parse_error_table(rows: DataFrame) -> DataFrame:
    return rows.where("parse_error is not null").groupBy("task", "parse_error").agg(F.count("*").alias("n"))


def overall(rows: DataFrame) -> DataFrame:
    """One row: totals, accuracy, weighted accuracy, valid, invalid and provider errors."""
    return rows.agg(
        F.count("*").alias("total"), F.count_if(F.col("correct")).alias("hits"), rate(F.count_if(F.col("correct")), F.count("*")).alias("accuracy"),
        rate(F.sum(F.col("sampling_weight") * F.col("correct").cast("int")), F.sum("sampling_weight")).alias("weighted_accuracy"),
        F.count_if(F.col("format_valid")).alias("valid"), F.count_if(~F.col("format_valid")).alias("invalid"), F.count_if(F.col("provider_error")).alias("provider_errors"),
    )


def selection_rates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """How often candidates were selected."""
    return candidates.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("selected")).alias("chosen"), rate(F.count_if(F.col("selected")), F.count("*")).alias("share"))


def candidate_frame(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """(request_id, family, information, a_count, b_count, gold_set_size, pos, category, selected) of each candidate of T2 rows.

    ``rows`` are evaluation rows with a1, branches, bs and candidates. A candidate in the gold set is positive; one
    under a1 and a branch that an exclusion takes out is B-excluded.
    """
    t2 = rows.where("task = 'T2'")
    traced = truth.trace(t2.select(F.col("request_id").alias("key"), "family", "a1", "branches", "bs", "candidates"), closed)
    kept = t2.select(F.col("request_id").alias("key"), "information", "a_count", "b_count", "gold_set_size", "gold_set", "parsed_set")
    both = traced.join(kept, "key")
    branch = ~F.col("has_branches") | (F.size("branch_hits") > 0)
    kind = truth.category(F.array_contains("gold_set", F.col("pos")), F.col("inside_a1"), branch, F.size("b_hits") > 0)
    chosen = F.coalesce(F.array_contains("parsed_set", F.col("pos")), F.lit(False))
    return both.select(F.col("key").alias("request_id"), "family", "information", "a_count", "b_count", "gold_set_size", "pos", kind.alias("category"), chosen.alias("selected"))


def usage(responses: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Responses with ``completion_tokens`` (0 if none), ``finish_reason`` and ``raw_malformed``, out of the raw answer as JSON text or VARIANT.

    The first choice tells the reason under one of two names, empty ones passed over; without a reason, ``unknown``. A raw answer
    that is no JSON, or no object, is malformed.
    """
    rows = unions.with_variant(responses, raw, "__raw", "raw_malformed")
    value = F.col("__raw")
    get = lambda p, kind: F.try_variant_get(value, p, kind)
    said = lambda name: F.nullif(get(f"$.choices[0].{name}", "string"), F.lit(""))
    odd = value.isNotNull() & ~unions.kind(value).isin("object", "null")
    rows = rows.withColumns({
        "completion_tokens": F.coalesce(get("$.usage.completion_tokens", "long"), F.lit(0)), "finish_reason": F.coalesce(said("finish_reason"), said("stop_reason"), F.lit("unknown")),
        "raw_malformed": F.col("raw_malformed") | F.coalesce(odd, F.lit(False)),
    })
    return rows.drop("__raw")


def usage_table(responses: DataFrame, raw: str = "raw_response") -> DataFrame:
    """(finish_reason, n, completion_tokens, malformed) of responses."""
    return usage(responses, raw).groupBy("finish_reason").agg(F.count("*").alias("n"), F.sum("completion_tokens").alias("completion_tokens"), F.count_if("raw_malformed").alias("malformed"))


def as_percent(value: Column) -> Column:
    """A share with two decimals and a percent sign; empty for null and NaN."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "").otherwise(F.format_string("%.2f%%", value.cast("double") * 100))


def as_number(value: Column) -> Column:
    """Whole numbers with commas, others with four decimals; empty for null and NaN."""
    x = value.cast("double")
    whole = F.format_number(x, 0)
    return F.when(x.isNull() | F.isnan(x), "").when(x == F.floor(x), whole).otherwise(F.format_string("%.4f", x))


def markdown(headers: list[str], rows: list[list]) -> str:
    """A table of a report: floats with four decimals, nothing for None and NaN."""
    def cell(v) -> str:
        if v is None or isinstance(v, float) and v != v:
            return ""
        return f"{v:.4f}" if isinstance(v, float) else str(v)

    lines = [headers, ["---"] * len(headers), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def matrix_payload(table: DataFrame) -> dict:
    """A matrix of a few rows as index, columns and values for JSON; what is missing is None."""
    rows = sorted(table.collect(), key=lambda r: r["a_count"])
    names = [c for c in table.columns if c != "a_count"]
    used = [c for c in names if any(r[c] is not None for r in rows)]
    return {"index": [r["a_count"] for r in rows], "columns": [int(c[1:]) for c in used], "values": [[r[c] for c in used] for r in rows]}


def records(table: DataFrame, *order: str) -> list[dict]:
    """Rows of a report's table, which is small, as dictionaries."""
    return [r.asDict(recursive=True) for r in (table.orderBy(*order) if order else table).collect()]


def accuracy_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, hits, accuracy); null keys are groups, no keys give one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("correct").alias("hits"), rate(F.count_if("correct"), F.count("*")).alias("accuracy"))


def evaluation_metrics(rows: DataFrame, responses: DataFrame, candidates: DataFrame | None = None) -> dict:
    """All numbers of a report as one JSON object; raises without a request."""
    whole = overall(rows).first().asDict()
    if not whole["total"]:
        raise ValueError("a report needs at least one request")
    seen = responses.agg(F.count("*").alias("rows"), F.count_distinct("request_id").alias("ids")).first()
    out = {"overall": whole | {"response_rows_seen": seen["rows"], "responses_selected": rows.where("status <> 'missing'").count()}}
    out["parse_errors"] = records(parse_error_table(rows), "task", "parse_error")
    out["accuracy_slices"] = records(slice_table(rows, REPORT_SLICES), "slice", "label")
    out["overall_accuracy_matrix"] = matrix_payload(matrix(rows.withColumn("x", F.col("correct").cast("double")), "x"))
    out["binary_metrics"] = records(binary_metrics(rows, ["task"]), "task")
    cells = binary_metrics(rows, ["task", "a_count", "b_count"])
    names = ("positive_precision", "positive_recall", "negative_precision", "negative_recall")
    out["binary_matrices"] = {t: {m: matrix_payload(matrix(cells.where(F.col("task") == t), m)) for m in names} for t in ("T1", "T3")}
    t2 = rows.where("task = 'T2'")
    out["t2_accuracy_by_gold_set_size"] = records(accuracy_table(t2, ["gold_set_size"]), "gold_set_size")
    out["t2_predicted_size_distribution"] = records(set_size_table(rows), "gold_set_size", "predicted_size_label")
    if "raw_response" in responses.columns:
        out["usage"] = records(usage_table(select_response(responses)), "finish_reason")
    if candidates is not None:
        out["t2_candidate_summary"] = records(selection_rates(candidates, ["category"]), "category")
        out["t2_candidate_by_b_count"] = records(selection_rates(candidates, ["b_count", "category"]), "b_count", "category")
    return out
