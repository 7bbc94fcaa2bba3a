"""Sharding by a k-d tree over metadata: distributed weighted medians along the widest dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrove.llm.common import read, written

SHARDS = 40
ROW_BYTES = 16
#: Bins of each histogram; a cut is refined until it is this close to its target, as a share of a shard, or a single value is left.
BINS, CLOSE = 4096, 0.002
#: Groups of equal texts of more than this share of a shard's bytes are placed before the tree is built, at most ``shards`` / LARGE of
#: them; those of more than a whole shard's bytes fit in none, and are dealt in parts of this share.
LARGE = 0.05
#: Rows of a shard that are numbered together, about.
SLOT_ROWS = 20_000
#: Dimensions: bytes of the text (in steps of a thousandth of a doubling), language, source, doc_id.
AXES = ("k0", "k1", "k2", "k3")
#: Bits of a dimension's value and, below, of a hash by which equal values are told apart.
_VALUE, _TIE = 40, 22


@dataclass
class Node:
    """A part of the rows that gets ``shards`` shards; the first shard's number is ``first``."""

    first: int
    shards: int
    axis: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def _routed(units: DataFrame, level: list[Node]) -> DataFrame:
    """Units one level further down; written, so that conditions do not pile up."""
    arms = [f"when node = {n.first} and {AXES[n.axis]} >= ({n.cut}) then {n.right.first}" for n in level]
    return written(units.withColumn("node", F.expr("case " + " ".join(arms) + " else node end")), "level")


def _histograms(units: DataFrame, jobs: dict[int, tuple[str, int, int]]) -> dict[int, dict[int, int]]:
    """For each node (by its first shard): bytes in each of BINS bins of a column between lo and hi."""
    arms = [f"when node = {n} and {col} between ({lo}) and ({hi}) then ({col} - ({lo})) div {_width(lo, hi)}" for n, (col, lo, hi) in jobs.items()]
    got = units.select("node", F.expr("case " + " ".join(arms) + " end").cast("int").alias("bin"), "bytes").where("bin is not null").groupBy("node", "bin").agg(F.sum("bytes").alias("w"))
    out: dict[int, dict[int, int]] = {n: {} for n in jobs}
    for r in got.collect():
        out[r["node"]][r["bin"]] = int(r["w"])
    return out


def _width(lo: int, hi: int) -> int:
    return (hi - lo) // BINS + 1


def _cuts(units: DataFrame, wanted: dict[int, tuple[str, int, int, float]], slack: float) -> dict[int, int]:
    """For each node the value at which the bytes below come closest to those wanted.

    Histograms are refined within one bin until the bin's bytes are within ``slack`` or it holds one value;
    all nodes of a level share a pass.
    """
    state, done = {n: [c, lo, hi, want] for n, (c, lo, hi, want) in wanted.items()}, {}
    while state:
        found = _histograms(units, {n: (c, lo, hi) for n, (c, lo, hi, _) in state.items()})
        for n in list(state):
            col, lo, hi, want = state[n]
            width, bins = _width(lo, hi), sorted(found[n].items())
            k, w = bins[-1] if bins else (0, 0)
            for k, w in bins:
                if want < w or k == bins[-1][0]:
                    break
                want -= w
            if width == 1 or w <= slack:
                done[n] = lo + (k + (want > w / 2)) * width
                del state[n]
            else:
                state[n] = [col, lo + k * width, min(hi, lo + (k + 1) * width - 1), want]
    return done


def split(units: DataFrame, shards: int, room: list[float] | None = None) -> DataFrame:
    """``units`` (k0..k3, bytes: long) with ``node``: the shard each falls into, by a k-d tree built a level at a time.

    A node is split so that each part gets its shards' share of the node's ``room`` (equal, if not given) in bytes; floor(s/2)
    of s shards go left. The dimension is the one whose values spread widest, as a share of the spread over all units.
    """
    room = [max(x, 1e-9) for x in room] if room else [1.0] * shards
    units = units.withColumn("node", F.lit(0))
    spread: list[int] = []
    level = [Node(0, shards)]
    while level := [n for n in level if n.shards > 1]:
        got = units.groupBy("node").agg(F.sum("bytes").alias("w"), *(f(k).alias(f"{f.__name__}{k}") for k in AXES for f in (F.min, F.max))).collect()
        facts = {r["node"]: r for r in got}
        level = [n for n in level if n.first in facts]
        if not level:
            break
        spread = spread or [max(1, facts[0][f"max{k}"] - facts[0][f"min{k}"]) for k in AXES]
        slack = CLOSE * sum(int(f["w"]) for f in facts.values()) / shards
        wanted = {}
        for n in level:
            f = facts[n.first]
            lo, hi = [f[f"min{k}"] for k in AXES], [f[f"max{k}"] for k in AXES]
            n.axis = max(range(len(AXES)), key=lambda a: ((hi[a] - lo[a]) / spread[a], -a))
            wanted[n.first] = (AXES[n.axis], lo[n.axis], hi[n.axis], float(f["w"]) * _share(room, n))
        cuts = _cuts(units, wanted, slack)
        for n in level:
            n.cut = cuts[n.first]
            n.left, n.right = Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)
        units = _routed(units, level)
        level = [c for n in level for c in (n.left, n.right)]
    return units


def _share(room: list[float], n: Node) -> float:
    """The left part's share of a node's room."""
    left = sum(room[n.first : n.first + n.shards // 2])
    return left / sum(room[n.first : n.first + n.shards])


def place_large(groups: list[tuple[int, int]], room: list[float]) -> dict[int, int]:
    """The shard of each large group (g, bytes): the largest first, into the shard with most room, which shrinks."""
    out = {}
    for g, size in sorted(groups, key=lambda x: (-x[1], x[0])):
        s = max(range(len(room)), key=lambda i: (room[i], -i))
        out[g] = s
        room[s] -= size
    return out


def _in_order(text: Column) -> Column:
    """A number of 40 bits that orders texts as their first five bytes do; null and empty ones come first."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 1, _VALUE // 8)), _VALUE // 4, "0"), 16, 10).cast("long")


def units(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, dict[int, int], list[float]]:
    """Rows with their unit (g, part); the units that the tree deals, with their bytes and dimensions; the shards of large groups; and the room that is left in each shard.

    A unit is what stays together: the rows of one text, by a hash; or, if those exceed a whole shard's bytes, a part of them
    by a hash of doc_id. At most ``shards`` / LARGE groups are large or dealt in parts: these alone come to the driver and are
    broadcast. Language, source and doc_id of a unit are those of its least row.
    """
    total, low, high = rows.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id")).first()
    target = (total or 0) / shards
    most = max(1, int(LARGE * target))
    sizes = rows.groupBy("g").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most)
    found = [(r["g"], int(r["bytes"])) for r in sizes.collect()]
    room = [target] * shards
    where = place_large([x for x in found if x[1] <= target], room)
    spark = rows.sparkSession
    hot = spark.createDataFrame([(g, -(-n // most)) for g, n in found if n > target], "g long, parts int")
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("parts")).cast("int"), F.lit(0))
    rows = written(rows.join(F.broadcast(hot), "g", "left").withColumn("part", part).drop("parts"), "rows")
    large = spark.createDataFrame([(g,) for g in where], "g long")
    small = rows.join(F.broadcast(large), "g", "left_anti")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "lang", "source", "size")).alias("m")
    each = small.groupBy("g", "part").agg(F.sum("size").alias("bytes"), least)
    place = F.coalesce((F.col("m.doc_id").cast("double") - F.lit(float(low or 0))) / F.lit(max(1.0, float(high or 0) - float(low or 0))), F.lit(0.0)) * float((1 << _VALUE) - 1)
    tie = F.shiftrightunsigned(F.xxhash64("g", "part"), 64 - _TIE)
    values = (F.floor(F.log2(F.col("m.size").cast("double")) * 1000), _in_order(F.col("m.lang")), _in_order(F.col("m.source")), F.floor(place))
    return rows, each.select("g", "part", "bytes", *(F.shiftleft(v.cast("long"), _TIE).bitwiseOR(tie).alias(k) for k, v in zip(AXES, values))), where, room


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: shards of near-equal bytes.

    A row's size is its text's UTF-8 bytes (null: none) and ROW_BYTES. A tree over size, language, source and
    doc_id deals whole groups of equal texts, so that copies share a shard. Groups of more than LARGE of a shard's bytes are
    placed first, and the tree fills the room they leave. A group that no shard can hold is dealt in parts, rows
    that agree in doc_id and text together. Null languages,
    sources and doc_ids come first in their dimension; the columns lang and source may be missing, others are not
    read. Slots count from 0 in each shard without gaps. An empty table gives an empty result; with few rows shards can be empty.
    """
    text = F.coalesce("text", F.lit(""))
    asked = docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g"),
        *((F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in ("lang", "source")),
    )
    rows, parts_of, where, room = units(written(asked, "keys"), shards)
    placed = split(written(parts_of, "units"), shards, room).select("g", "part", F.col("node").alias("shard"))
    placed = placed.unionByName(docs.sparkSession.createDataFrame([(g, 0, s) for g, s in where.items()], "g long, part int, shard int"))
    sets = max(16, rows.count() // (shards * SLOT_ROWS) + 1)
    tie = F.xxhash64("doc_id", "g")
    placed = rows.join(placed, ["g", "part"])
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", tie.alias("tie"), F.pmod(tie, F.lit(sets)).cast("int").alias("set")), "placed")
    counts = placed.groupBy("shard", "set").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("set").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "set", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "set").orderBy("tie", "doc_id", "size"))
    out = placed.withColumn("own", own).join(starts, ["shard", "set"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
