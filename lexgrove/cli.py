"""Command line: stages over Parquet tables ``node`` and ``edge`` and a run folder.

A configuration file gives families, quotas, caps and provider settings; without one the defaults hold. Tables
go to the run folder as Parquet, manifests and reports as JSON.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexgrove.operators import audits, constraint, probe, rendering, runner, sampling, scoring, taxonomy
from lexgrove.operators.ranks import numbered
from lexgrove.operators.runlog import pending
from lexgrove.operators.work import written
from lexgrove.sources import config as settings
from lexgrove.sources import files, parts

LOG = (
    "request_id string, status string, error_state string, final_answer_text string, run_receive_sequence long, answer_truncated boolean, reasoning_available boolean, "
    "reasoning_truncated boolean, raw_response variant"
)


def _config(a) -> settings.Experiment:
    got = settings.load_experiment(a.config, a.providers) if a.config else settings.Experiment()
    if a.min_positive is not None:
        got = replace(got, resources=replace(got.resources, min_final_positive_count=a.min_positive))
    if a.quota is not None:
        got = replace(got, product=replace(got.product, wordnet_quota_per_stratum=a.quota, babelnet_quota_per_stratum=a.quota))
    return got


def _graph(spark: SparkSession, a, c: settings.Experiment) -> constraint.Graph:
    on = c.resources.families()
    return constraint.graph(spark.read.parquet(f"{a.data}/node").where(F.col("family").isin(on)), spark.read.parquet(f"{a.data}/edge").where(F.col("family").isin(on)))


def _seeds(g: constraint.Graph, c: settings.Experiment) -> DataFrame:
    seeds = g.node.where("usable").select("family", F.col("object_id").alias("seed"))
    n = c.resources.max_seed_per_family
    return sampling.seed_indexes(seeds, n).drop("seed_index") if n else seeds


def _out(df: DataFrame, a, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{a.run}/{name}")
    return df.sparkSession.read.parquet(f"{a.run}/{name}")


def _counted(df: DataFrame, a, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As ``_out``, with metrics of the rows that are written, observed by the write itself."""
    seen = Observation(name)
    table = _out(df.observe(seen, F.count("*").alias("rows"), *(c.alias(k) for k, c in metrics.items())), a, name)
    return table, {k: v if v is not None else 0 for k, v in seen.get.items()}


def _json(a, name: str, value) -> None:
    files.write_json(f"{a.run}/{name}", value)


def audit(spark, a):
    c = _config(a)
    g = _graph(spark, a, c)
    _out(constraint.feasibility(g, _seeds(g, c), c.resources.min_final_positive_count, c.tasks), a, "feasibility")
    _out(audits.object_inventory(g.node, g), a, "object_inventory")
    _json(a, "resource_audit.json", {r.pop("family"): r for r in scoring.records(audits.resource_audit(g.node, g.sizes))})
    _out(g.node, a, "resource_snapshot")
    _json(a, "dataset_config_snapshot.json", settings.dataset_snapshot(c))
    _json(a, "stage_status.json", {"stage": "audit", "complete": False})


def _scope(c: settings.Experiment) -> sampling.Scope:
    """Families, tasks and cells in the configured order."""
    return sampling.Scope(tuple(c.resources.families()), tuple(c.tasks), tuple(c.matrix.a_count), tuple(c.matrix.b_count))


def _tasks(c: settings.Experiment) -> dict[str, Column]:
    return {t: F.count_if(F.col("task") == t) for t in c.tasks}


def _status(a, stage: str, reason: str) -> None:
    _json(a, "stage_status.json", {"stage": stage, "complete": False, "reason": reason})


def freeze(spark, a):
    c = _config(a)
    g = _graph(spark, a, c)
    seeds, low, p, scope = _seeds(g, c), c.resources.min_final_positive_count, c.product, _scope(c)
    cores = written(constraint.seed_cores(g, seeds, low), "cores")
    _json(a, "dataset_config_snapshot.json", settings.dataset_snapshot(c))
    if p.tier == "full":
        base = sampling.full_frame(cores, g, p.product_id, p.candidate_window_limit, scope=scope).withColumnRenamed("ordinal", "own")
        family = F.array_position(F.array(*map(F.lit, scope.families)), F.col("family"))
        full = sampling.with_information(base, p.product_id).withColumn("at", family)
        full, seen = _counted(numbered(full, ["at", "own", "information"], name="ordinal").drop("at", "own"), a, "samples", **_tasks(c))
        kept = parts.write_parts(full, f"{a.run}/sample_parts", "ordinal", -(-p.shard_size // len(sampling.INFORMATION)) * len(sampling.INFORMATION))
        report = sampling.stream_validation(full, g.closed, duplicates=False)
        made = sampling.rolling_hash(full, ["ordinal"], "sample_hash")
        _json(a, "sample_manifest.json", {"product_id": p.product_id, "product_tier": p.tier, "validation": report, "samples_hash": made, "dataset_sample_hash": made, "parts": kept["parts"], "sample_count": seen["rows"], "samples_by_task": {t: seen[t] for t in c.tasks}})
        _status(a, "freeze", "samples are frozen; nothing has been asked yet")
        if not report["passed"]:
            raise SystemExit(f"validation failed: {report}")
        return
    known = Path(a.run, "feasibility").exists()
    populations = spark.read.parquet(f"{a.run}/feasibility").groupBy("family", "a_count", "b_count").agg(F.max("feasible_seed_cell_count").alias("population")) if known else None
    base, strata = sampling.stratified(
        cores, g, seeds, p.quotas(), p.product_id, p.tier, p.candidate_scheduler, c.budgets.seed, c.budgets.caps(), p.candidate_window_limit, populations, scope=scope,
    )
    full = written(sampling.with_information(base, p.product_id), "samples")
    bad = written(sampling.violations(full, g.closed), "violations")
    if (n := bad.count()):
        raise SystemExit(f"{n} violations, first {bad.first()}")
    full, seen = _counted(sampling.in_order(full, scope, ["variant", "information"]), a, "samples", **_tasks(c))
    _out(strata, a, "strata")
    made = sampling.manifest(base, strata, p.product_id, p.tier, p.quotas(), low, p.candidate_scheduler, p.candidate_window_limit)
    made |= {
        "dataset_sample_hash": sampling.list_hash(full, ["ordinal"], "sample_hash"), "source_feasibility": "feasibility" if known else None,
        "samples_by_task": {t: seen[t] for t in c.tasks}, "matrix": {"a_count": list(scope.a_counts), "b_count": list(scope.b_counts)}, "tasks": list(scope.tasks), "reuse_caps": c.budgets.caps(),
    }
    _json(a, "sample_manifest.json", made)
    _status(a, "freeze", "samples are frozen; nothing has been asked yet")


def render(spark, a):
    node = spark.read.parquet(f"{a.data}/node")
    samples = spark.read.parquet(f"{a.run}/samples")
    frozen = files.read_json(f"{a.run}/sample_manifest.json")
    empty = F.count_if(F.coalesce(F.length("prompt"), F.lit(0)) == 0)
    nested = F.count_if(~F.col("sample_request_hash").eqNullSafe(F.col("request_hash")))
    asked, seen = _counted(rendering.prompt(rendering.with_nodes(samples, node)), a, "requests", empty_prompts=empty, nested_hash_mismatches=nested)
    hashed = sampling.rolling_hash if frozen.get("product_tier") == "full" else sampling.list_hash
    _json(a, "render_manifest.json", {"request_count": seen["rows"], "empty_prompts": seen["empty_prompts"], "nested_hash_mismatches": seen["nested_hash_mismatches"], "renderer_version": sampling.RENDERER_VERSION, "request_hash": hashed(asked, ["ordinal"], "request_hash")})
    files.write_jsonl(rendering.nested(asked, samples.columns), f"{a.run}/rendered_requests")
    _status(a, "render", "requests are rendered; nothing has been asked yet")


def _responses(spark, a) -> DataFrame:
    return files.read_jsonl(spark, f"{a.run}/responses.jsonl", LOG).withColumnRenamed("run_receive_sequence", "ordinal")


def _requests(spark, a) -> DataFrame:
    """Requests, with their place in the dataset's order as ``ordinal``."""
    r = spark.read.parquet(f"{a.run}/requests")
    return r.withColumn("option_count", F.size("candidates")).withColumnRenamed("weight", "sampling_weight")


def preflight_run(spark, a):
    c = _config(a)
    report = runner.preflight(spark.read.parquet(f"{a.run}/requests"), _responses(spark, a), c, a.provider, Path(a.run), a.limit or None)
    print(json.dumps(report, ensure_ascii=False))
    if not report["ok"]:
        sys.exit(1)


def run(spark, a):
    c = _config(a)
    if not settings.may_run(c.provider.name, a.provider):
        raise SystemExit(f"provider {a.provider} is not configured")
    if a.provider != "mock":
        raise SystemExit("only the mock provider is built in; give runner.Run a provider of your own")
    s = settings.settings_for_run(c, a.provider)
    folder = Path(a.run)
    Path(a.run, runner.PAUSE_FILE).unlink(missing_ok=True)
    asked = _requests(spark, a).select("request_id", "ordinal", "task", "prompt", "system_prompt", "gold_bool", "gold_set")
    total = asked.count()
    before = runner.log_state(_responses(spark, a)).where("completed").count()
    # Only what is pending comes to the driver, one partition at a time, in the dataset's order.
    todo = pending(asked, _responses(spark, a)).orderBy("ordinal")
    rows = (r.asDict() for r in todo.toLocalIterator())
    limits = runner.Limits(a.workers or s.max_concurrency, s.max_retries, s.retry_backoff_seconds, s.request_interval_seconds, a.adaptive or s.concurrency_mode == "adaptive", s.retryable_cooldown_seconds)
    outcome = runner.Run(folder, runner.MockProvider(), limits).go(rows, a.limit or None)
    made = runner.run_manifest(folder, outcome, s, a.command, total, before)
    print(json.dumps({**outcome, "requests": total, "complete": made["complete"]}))


def pause(spark, a):
    Path(a.run).mkdir(parents=True, exist_ok=True)
    Path(a.run, runner.PAUSE_FILE).touch()


def reparse(spark, a):
    asked, said = _requests(spark, a), _responses(spark, a)
    scored = written(scoring.scores(asked, said, _config(a).answer_parse_char_limit), "scored")
    _, predicted = _counted(scoring.predictions(scored), a, "predictions")
    kept = ["base_sample_id", "sample_id", "request_id", "task", "family", "a_count", "b_count", "information", "sampling_weight", "gold_bool", "gold_set", "parsed_bool", "parsed_set", "correct", "format_valid", "parse_error"]
    _, kept_scores = _counted(scored.select(*kept, "ordinal"), a, "scores", hits=F.count_if("correct"), valid=F.count_if("format_valid"))
    slices = _out(scoring.slice_table(scored), a, "score_slices")
    summary = {"slices": scoring.records(slices, "slice", "label"), "information_effect": scoring.records(scoring.information_effect(scored))}
    _json(a, "reparse_manifest.json", {"requests": asked.count(), "responses": said.count(), "predictions": predicted["rows"], "scores": kept_scores["rows"], "hits": kept_scores["hits"], "valid": kept_scores["valid"], "mode": "reparse", "no_api_requests_sent": True, "summary": summary})


def report(spark, a):
    said = _responses(spark, a)
    rows = _out(scoring.evaluation_rows(_requests(spark, a), said), a, "evaluation_rows")
    candidates = None
    if Path(a.run, "resource_snapshot").exists() or Path(a.data, "edge").exists():
        node = spark.read.parquet(f"{a.run}/resource_snapshot" if Path(a.run, "resource_snapshot").exists() else f"{a.data}/node")
        candidates = _out(scoring.candidate_frame(rows, taxonomy.closure(written(taxonomy.usable_edges(node, spark.read.parquet(f"{a.data}/edge")), "edge"))), a, "t2_candidates")
    _json(a, "evaluation_metrics.json", scoring.evaluation_metrics(rows, said, candidates))


def universe_audit(spark, a):
    c = _config(a)
    g = _graph(spark, a, c)
    counts = _out(audits.structural_counts(g), a, "structural_counts")
    probed = written(probe.probe_cores(g), "probed")
    _out(probe.probe_summary(probed, counts), a, "probe_summary")
    _out(audits.sampling_frame(audits.scaled_task_populations(probed, counts)), a, "universe_sampling_frame")
    _out(audits.object_inventory(g.node, g), a, "object_inventory")
    _out(taxonomy.graph_audit(g.node, g.edge, g.sizes, g.children), a, "graph_audit")
    _out(taxonomy.top_nodes(g.edge, g.sizes, g.children), a, "top_nodes")


def seed_audit(spark, a):
    c = _config(a)
    g = _graph(spark, a, c)
    seeds, low = _seeds(g, c), c.resources.min_final_positive_count
    searched = constraint.search(g, seeds, low, need_negative=False)
    found = searched.counted()
    cells = _out(audits.seed_cells(found, constraint.counted_reasons(g, searched), seeds, searched.first(audits.EXAMPLES)), a, "lowest_viable_cells")
    counts = _out(audits.threshold_populations(found, g.node), a, "threshold_populations")
    _out(audits.threshold_summary(counts), a, "threshold_summary")
    _out(audits.threshold_shortages(counts), a, "threshold_shortages")
    _out(audits.top_heads(searched.found), a, "top_heads")
    frame = _out(audits.sampling_frame(audits.task_populations(cells)), a, "sampling_frame")
    _json(a, "recipe_seed_audit_summary.json", scoring.records(audits.sampling_summary(frame))[0])
    _out(probe.probe_frame(searched.first(probe.PROBE_ROWS)), a, "probe_frame")


def _frame(spark, a, g, c) -> DataFrame:
    if Path(a.run, "probe_frame").exists():
        return spark.read.parquet(f"{a.run}/probe_frame")
    return written(probe.probe_frame(constraint.seed_cores(g, _seeds(g, c), c.resources.min_final_positive_count, need_negative=False)), "probe_frame")


def depth_audit(spark, a):
    c = _config(a)
    g = _graph(spark, a, c)
    compared = _out(audits.depth_comparison(_frame(spark, a, g, c), g), a, "depth_comparison")
    _out(audits.depth_summary(compared), a, "depth_summary")
    _out(audits.depth_cells(compared), a, "depth_cells")


def scheduler_audit(spark, a):
    counts = spark.read.parquet(f"{a.run}/threshold_populations")
    _out(audits.scheduler_scenarios(counts, audits.QUOTAS, a.threshold), a, "scheduler_scenarios")
    _out(audits.gold_size_plan(counts, audits.QUOTAS, a.threshold), a, "gold_size_plan")


def scheduler_probe(spark, a):
    c = _config(a)
    g = _graph(spark, a, c)
    made = _out(probe.simulate(probe.probe_windows(_frame(spark, a, g, c), g), threshold=a.threshold), a, "simulation")
    _out(probe.strategy_metrics(made), a, "strategy_metrics")


COMMANDS = {
    "audit": audit, "freeze": freeze, "render": render, "run": run, "resume": run, "preflight-run": preflight_run, "pause": pause, "reparse": reparse, "report": report,
    "recipe-universe-audit": universe_audit, "recipe-seed-audit": seed_audit, "recipe-b-depth-audit": depth_audit, "recipe-scheduler-audit": scheduler_audit, "recipe-candidate-scheduler-probe": scheduler_probe,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexgrove", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--data", default="data")
    p.add_argument("--run", default="run")
    p.add_argument("--config")
    p.add_argument("--providers")
    p.add_argument("--provider", default="mock")
    for name in ("min-positive", "quota"):
        p.add_argument(f"--{name}", type=int)
    for name, value in (("limit", 0), ("workers", 0), ("threshold", 5)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--adaptive", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    COMMANDS[a.command](spark or SparkSession.builder.appName("lexgrove").getOrCreate(), a)


if __name__ == "__main__":
    main()
