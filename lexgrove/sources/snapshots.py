"""What a run keeps of its dataset: node snapshots, feasibility, thresholds, requests, numbered shards."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.operators.ranks import numbered
from lexgrove.sources import parts
from lexgrove.sources.files import read_json, read_jsonl, write_json

NODE = (
    "family string, object_id string, surface string, gloss string, synonyms array<string>, children array<string>, parents array<string>, "
    "usable_flags map<string,boolean>, metadata map<string,string>"
)
FEASIBILITY = (
    "dataset_family string, task string, constraint_cell array<int>, a_count int, b_count int, information_policy string, closure_size_distribution map<string,bigint>, usable_seed_count bigint, "
    "feasible_seed_cell_count bigint, usable_candidate_count bigint, direct_usable_child_count bigint, B_sources array<string>, available_primary_negative_source array<string>, "
    "hard_negative_available boolean, easy_negative_available boolean, t1_capacity bigint, t2_pool_space_estimate bigint, t3_pool_space_estimate bigint, status string, reason string, "
    "surface_coverage double, gloss_coverage double, final_positive_min bigint, final_positive_max bigint, negative_pool_min bigint, negative_pool_max bigint, recommended_pool_size bigint, "
    "budget_seed_limit bigint, budget_max_base_samples bigint"
)
#: Values of columns that older files lack.
DEFAULTS = {
    "information_policy": "paired_I0_I1_I2_per_base_sample_id", "surface_coverage": 1.0, "gloss_coverage": 1.0, "final_positive_min": 0, "final_positive_max": 0, "negative_pool_min": 0,
    "negative_pool_max": 0, "recommended_pool_size": 4, "budget_seed_limit": 0, "budget_max_base_samples": 0,
}
#: Files of a dataset that a run takes along, beside its configuration.
CONTEXT = ("resource_audit.json", "feasibility.jsonl", "resource_snapshot.json", "samples.jsonl", "sample_manifest.json", "render_manifest.json")


def write_snapshot(node: DataFrame, path: str) -> None:
    """Nodes as a table; the nested JSON object of families and ids is an export of small hierarchies only (``export_snapshot``)."""
    node.write.mode("overwrite").parquet(path)


def export_snapshot(node: DataFrame, path: str) -> None:
    """{family: {object_id: node}} as JSON; a node's row at a time passes the driver."""
    out: dict[str, dict[str, dict]] = {}
    for r in node.orderBy("family", "object_id").toLocalIterator():
        row = r.asDict(recursive=True)
        out.setdefault(row.pop("family"), {})[row["object_id"]] = row
    write_json(path, out)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of an exported snapshot, usable as it stands; a missing file gives none."""
    if not Path(path).exists():
        return spark.createDataFrame([], NODE)
    lines = spark.read.text(path, wholetext=True)
    inner = NODE.replace("family string, ", "")
    parsed = lines.select(F.explode(F.from_json("value", f"map<string,map<string,struct<{', '.join(x.replace(' ', ':', 1) for x in inner.split(', '))}>>>")).alias("family", "nodes"))
    each = parsed.select("family", F.explode("nodes").alias("id", "n"))
    return each.select("family", F.coalesce("n.object_id", "id").alias("object_id"), *(F.col(f"n.{c.split()[0]}") for c in inner.split(", ")[1:]))


def edges_of(node: DataFrame) -> DataFrame:
    """(family, parent, child) from the nodes' children."""
    return node.select("family", F.col("object_id").alias("parent"), F.explode("children").alias("child")).distinct()


def load_feasibility(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a feasibility file with all columns; those that older files lack have their defaults."""
    return read_jsonl(spark, path, FEASIBILITY).fillna(DEFAULTS)


def populations(feasibility: DataFrame) -> DataFrame:
    """(family, a_count, b_count, population) of a feasibility table."""
    return feasibility.groupBy(F.col("dataset_family").alias("family"), "a_count", "b_count").agg(F.max("feasible_seed_cell_count").alias("population"))


def load_threshold_audit(spark: SparkSession, path: str) -> DataFrame:
    """(family, a_count, b_count, threshold, T1, T2_any, T2_all_gold_sizes, T3) from a threshold audit's JSON file."""
    counts = "struct<T1:bigint,T2_any:bigint,T2_all_gold_sizes:bigint,T3:bigint>"
    schema = f"cell_rows array<struct<dataset_family:string,a_count:int,b_count:int,counts_by_min_final_positive:map<string,{counts}>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("cell_rows").alias("r")).select("r.*")
    each = rows.select(F.col("dataset_family").alias("family"), "a_count", "b_count", F.explode("counts_by_min_final_positive").alias("threshold", "n"))
    return each.select("family", "a_count", "b_count", F.col("threshold").cast("int").alias("threshold"), "n.*")


def copy_context(requests_path: str, run: str) -> dict[str, str]:
    """Takes a dataset's files along to a run's folder, where they aren't yet, and rewrites the paths in manifests as relative ones.

    The dataset's configuration comes without its provider.
    """
    source, target, out = Path(requests_path).parent, Path(run), {}
    target.mkdir(parents=True, exist_ok=True)
    own = target / "dataset_config_snapshot.json"
    for path in (source / "dataset_config_snapshot.json", source / "config_snapshot.json", own):
        if path.exists():
            write_json(str(own), {k: v for k, v in read_json(str(path)).items() if k != "provider"})
            out[own.name] = str(own)
            break
    for name in CONTEXT:
        if (source / name).exists() and not (target / name).exists():
            (target / name).write_bytes((source / name).read_bytes())
        if (target / name).exists():
            out[name] = str(target / name)
    for name, paths in (("sample_manifest.json", {"source_feasibility": "feasibility.jsonl"}), ("render_manifest.json", {"samples_path": "samples.jsonl", "resource_snapshot_path": "resource_snapshot.json"})):
        if (target / name).exists():
            write_json(str(target / name), read_json(str(target / name)) | paths)
    return out


def load_requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Requests of a file or folder of numbered parts, with ``ordinal``, their place: parts by name, then lines that are not blank.

    ``schema`` names the fields; parts are read in byte ranges. A line that is no such record has nulls. A missing path gives none.
    """
    if not Path(path).exists():
        return spark.createDataFrame([], f"{schema}, ordinal bigint")
    return parts.read_records(spark, path, schema).select("r.*", "ordinal")


def write_parts(rows: DataFrame, folder: str, index: str, rows_per_group: int = 3, shard_rows: int = 100_000) -> int:
    """Files part-00000.jsonl and on, rows by ``index`` (the 0-based number of their base group) and then as sorted by all columns; returns their number.

    A file closes once it has ``shard_rows`` rows; groups of ``rows_per_group`` are never split. Tasks write the files, and go on
    with a write that was broken off (``parts.write_parts``).
    """
    cols = sorted(c for c in rows.columns if c != index)
    line = F.to_json(F.struct(*(F.col(f"`{c}`") for c in cols)), {"ignoreNullFields": "false"})
    placed = numbered(rows, [index, line], name="__place")
    return len(parts.write_parts(placed, folder, "__place", -(-shard_rows // rows_per_group) * rows_per_group, cols)["parts"])


def part_faults(folder: str, rows_per_group: int = 3) -> list[str]:
    """What is wrong with a folder of numbered parts: gaps in the numbers, empty files, split groups."""
    out = []
    for k, path in enumerate(sorted(Path(folder).glob("part-*.jsonl"))):
        if path.name != f"part-{k:05d}.jsonl":
            out.append(f"expected part-{k:05d}.jsonl, found {path.name}")
            break
        with path.open(encoding="utf-8") as f:
            n = sum(1 for line in f if line.strip())
        if not n:
            out.append(f"{path.name} is empty")
        elif n % rows_per_group:
            out.append(f"{path.name} splits a group")
    return out
