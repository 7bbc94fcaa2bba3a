"""SimHash near-duplicates: segment-popcount embedding, grid join under Manhattan distance, exact check.

``components`` links 64-bit fingerprints of four-word shingles at four or fewer differing bits: every choice
of half the axes is a grid, so no link is missed. ``near_duplicates`` serves similarities of 0.8 or more over
five-word shingles, where dozens of bits differ: fingerprints are 256 bits wide, and seeded choices of axes
are the grids, as many as a stated share of the links at that similarity needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from lexgrove.llm.common import free_name, read, shuffle_parts, written
from lexgrove.llm.graph import connected_components

SHINGLE = 4
DISTANCE = 4
#: Bytes of an embedded fingerprint (each holds the counts of four 2-bit segments) that serve as grid axes.
AXES = 8
#: Buckets up to this size compare all their values at once; larger ones walk from value to value.
SMALL, WIDE_SMALL = 32, 512
#: Shingles, 64-bit words and similarity of wide fingerprints; share of the links at that similarity that the grids are to find.
WIDE_SHINGLE, WIDE_WORDS, SIMILARITY, FOUND = 5, 4, 0.8, 0.95
#: Differing bits of wide fingerprints up to which they link. Measured on prose: 0.94 of the pairs between 0.80 and 0.85 in
#: Jaccard similarity, 0.99 and more above, 0.42 between 0.70 and 0.75, none below 0.55 link.
WIDE_DISTANCE = 44
#: Values that a grid's cell is to hold on average, as a power of two.
CELL_BITS = 5.0
_EVEN = 0x5555555555555555
_BLOCK = 1 << 16
_MIX = np.asarray([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _shingles(raw: bytes | None, shingle: int) -> Iterator[list[bytes]]:
    """Blocks of a text's shingles, repeats included; a text with fewer words than a shingle is one, one without words has none."""
    words = (raw or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        if words:
            yield [joined]
        return
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    ends = ends[shingle - 1 :]
    for at in range(0, len(starts), _BLOCK):
        yield [joined[s:e] for s, e in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])]


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles; a bit is set if over half the shingles' hashes have it.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer words than a shingle
    is one shingle; a text without words (or null) has fingerprint 0.
    """
    h, counts, m = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    for block in _shingles(raw, shingle):
        hashes = np.fromiter((h(x, 42) for x in block), np.uint64, len(block))
        counts += _bit_counts(hashes.reshape(-1, 1))
        m += len(block)
    return int(np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many rows have each bit of their 64-bit words."""
    raw = np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), -1)
    return np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)


def wide_fingerprint(raw: bytes | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """As ``fingerprint``, of WIDE_WORDS 64-bit words: the shingle's XXH3 (128 bits) and two mixtures of it."""
    h, counts, m = xxhash.xxh3_128_digest, np.zeros(64 * WIDE_WORDS, np.int64), 0
    for block in _shingles(raw, shingle):
        two = np.frombuffer(b"".join([h(x) for x in block]), "<u8").reshape(-1, 2)
        more = (two ^ (two >> np.uint64(29))) * _MIX
        counts += _bit_counts(np.hstack([two, more ^ (more >> np.uint64(32))]))
        m += len(block)
    return np.packbits(counts * 2 > m, bitorder="little").view("<u8")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        *carried, texts = b.columns
        texts = texts.cast(pa.binary()).to_pylist()
        got = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*carried, pa.array(got)], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; 64 bits as a signed long."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _masks() -> list[int]:
    """One mask for each choice of AXES - DISTANCE of the axes; as signed longs."""
    out = []
    for axes in combinations(range(AXES), AXES - DISTANCE):
        m = sum(0xFF << (8 * a) for a in axes)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _first_cell() -> np.ndarray:
    """For each set of axes on which two vectors differ (as 8 bits): the first grid in which they still meet."""
    order = {axes: i for i, axes in enumerate(combinations(range(AXES), AXES - DISTANCE))}
    out = np.full(256, -1, np.int64)
    for bits in range(256):
        same = tuple(a for a in range(AXES) if not bits >> a & 1)[: AXES - DISTANCE]
        if len(same) == AXES - DISTANCE:
            out[bits] = order[same]
    return out


def embed(fp: np.ndarray) -> np.ndarray:
    """Counts of set bits of each 2-bit segment, in unary (0, 1, 3), packed.

    The Manhattan distance of two count vectors is the number of differing bits of this form, and never
    exceeds the Hamming distance of the fingerprints.
    """
    fp = fp.astype(np.uint64)
    even, shifted = np.uint64(_EVEN), fp >> np.uint64(1)
    return ((fp | shifted) & even) | ((fp & shifted & even) << np.uint64(1))


def _forest(fp: np.ndarray, distance: int = DISTANCE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links among rows of ``fp`` (words in columns), as row numbers.

    A visited row leaves the set it is compared with, so that a dense group costs little more than its size.
    """
    a, b, left = [], [], np.arange(len(fp))
    queue: list[int] = []
    while len(left) or queue:
        if not queue:
            queue, left = [int(left[0])], left[1:]
        x = queue.pop()
        if not len(left):
            break
        near = np.bitwise_count(fp[left] ^ fp[x]).sum(axis=1, dtype=np.int32) <= distance
        if near.any():
            hit = left[near]
            a.append(np.full(len(hit), x))
            b.append(hit)
            queue.extend(hit.tolist())
            left = left[~near]
    return a, b


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each of ``n`` rows to the least row it is connected with over the links (a, b): fewer than n."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(n))
    return root[at], at


def _bucket_links(cell: np.ndarray, fp: np.ndarray, distance: int, small: int, first: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) that keep the links of whole buckets connected; rows of a bucket lie together.

    With ``first`` a pair that meets in several grids is taken in the first of them only.
    """
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = (cell[1:] != cell[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    a, b = [], []
    for s, k in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        x, y = _forest(fp[s : s + k], distance)
        a += [v + s for v in x]
        b += [v + s for v in y]
    size = np.repeat(sizes, sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    run[(size == 1) | (size > small)] = -1
    code = embed(fp)
    for d in range(1, min(small, n)):
        i = np.flatnonzero((run[d:] == run[:-d]) & (run[d:] >= 0))
        if not len(i):
            break
        # The Manhattan bound goes first, word by word, then the fingerprints themselves.
        bound = np.zeros(len(i), np.int32)
        for w in range(fp.shape[1]):
            bound += np.bitwise_count(code[i, w] ^ code[i + d, w])
            keep = bound <= distance
            i, bound = i[keep], bound[keep]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]).sum(axis=1, dtype=np.int32) <= distance]
        if first is not None and len(i):
            differ = (code[i, 0] ^ code[i + d, 0]).view(np.uint8).reshape(-1, 8) != 0
            i = i[first[np.packbits(differ, axis=1, bitorder="little")[:, 0]] == cell[i, 0].astype(np.int64)]
        a.append(i)
        b.append(i + d)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _stars(np.concatenate(a), np.concatenate(b), n)


def _link_batches(keys: int, words: int, distance: int, small: int, exact: bool):
    """Rows (``keys`` key columns, ``words`` fingerprint columns) come sorted by key; a bucket may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _first_cell() if exact else None
        names = [f"{e}{w}" for e in ("src", "dst") for w in range(words)]
        rest: list[np.ndarray] = []

        def table() -> pa.RecordBatch:
            rows = np.concatenate(rest)
            fp = np.ascontiguousarray(rows[:, keys:])
            a, b = _bucket_links(rows[:, :keys], fp, distance, small, first)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(fp[e, w]).view(np.int64)) for e in (a, b) for w in range(words)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(keys + words)], axis=1)
            if rest and (rest[-1][-1, :keys] != rows[0, :keys]).any():
                yield table()
                rest = []
            last = np.flatnonzero((rows[:, :keys] != rows[-1, :keys]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                rest.append(rows[:cut])
                yield table()
                rest = []
            rest.append(rows[cut:])
        if rest:
            yield table()

    return run


def links(values: DataFrame) -> DataFrame:
    """(src, dst): a spanning forest of the links between distinct values ``fp`` that differ in at most DISTANCE bits.

    The count vectors of two such values are within DISTANCE in Manhattan distance, so at least half of
    their eight axes agree; every choice of half the axes is a grid, and values that share a cell of it
    are compared, by the Manhattan bound first and then exactly. No link between two values is lost: both
    ends are connected over returned links. All pairs of a dense cell are never returned. Null values take no part.
    """
    spark = values.sparkSession
    even = F.lit(_EVEN)
    half = F.shiftrightunsigned("fp", 1)
    code = F.col("fp").bitwiseOR(half).bitwiseAND(even).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(even), 1))
    masks = F.array(*(F.lit(m).cast("long") for m in _masks()))
    cells = (
        values.where("fp is not null").select("fp", code.alias("code"))
        .select("fp", "code", F.posexplode(masks).alias("cell", "mask"))
        .select(F.col("cell").cast("long").alias("cell"), F.col("code").bitwiseAND(F.col("mask")).alias("key"), "fp")
    )
    parts = shuffle_parts(spark)
    return (
        cells.repartition(parts, "cell", "key")
        .sortWithinPartitions("cell", "key")
        .mapInArrow(_link_batches(2, 1, DISTANCE, SMALL, True), "src0 long, dst0 long")
        .toDF("src", "dst")
    )


def _labels(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of ``rows``: the smallest doc_id among those reachable."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = written(named, "components")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return named.join(smallest, "root").select("fp", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, itself included.

    Equal fingerprints are one node. Null texts count as texts without words; a null doc_id keeps its
    row and never names a component unless all its members are null. Rows with the same doc_id each stay.
    An empty table gives an empty result.
    """
    rows = written(fingerprints(docs), "fingerprints")
    return rows.join(_labels(rows), "fp").select("doc_id", "fp", "component_id")


# --- wide fingerprints -----------------------------------------------------------------------------

_W = [f"w{i}" for i in range(WIDE_WORDS)]


def _wide_batches(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *carried, texts = b.columns
            got = np.asarray([wide_fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()], "<u8").reshape(-1, WIDE_WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([*carried, *(pa.array(np.ascontiguousarray(got[:, w])) for w in range(WIDE_WORDS))], [*columns, *_W])

    return run


def grid_plan(n: int, similarity: float = SIMILARITY, found: float = FOUND) -> tuple[int, int]:
    """Axes of a grid and number of grids for ``n`` values.

    An axis is the count of a 2-bit segment, worth 1.5 bits; a cell is to hold 2**CELL_BITS values whatever n.
    Two fingerprints at a similarity differ in a share p of their bits (their angle over pi) and agree on an axis
    with probability (1-p)**2 + p*p/2, so each grid joins them with that to the number of axes; the grids
    are as many as leave a share of 1 - ``found`` apart. They grow as n to the power 0.3.
    """
    axes = max(8, math.ceil((math.log2(max(n, 2)) - CELL_BITS) / 1.5))
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meet = ((1 - p) ** 2 + p * p / 2) ** axes
    return axes, math.ceil(math.log(1 - found) / math.log(1 - meet))


def _grid_batches(axes: int, grids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.random.default_rng(20)
        masks = np.zeros((grids, WIDE_WORDS), np.uint64)
        for g in range(grids):
            for seg in r.choice(32 * WIDE_WORDS, axes, replace=False).tolist():
                masks[g, seg // 32] |= np.uint64(3 << (2 * (seg % 32)))
        for b in batches:
            fp = np.stack([b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(WIDE_WORDS)], axis=1)
            code = embed(fp)
            for g in range(grids):
                # One 64-bit key for a grid and its cell: a clash of two only means more to compare.
                key = np.full(len(fp), g + 1, np.uint64)
                for w in range(WIDE_WORDS):
                    key = (key ^ (code[:, w] & masks[g, w])) * _MIX[w % 2]
                    key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns], ["key", *_W])

    return run


def wide_links(values: DataFrame, distance: int = WIDE_DISTANCE) -> DataFrame:
    """(src, dst) as 32-byte values: links of a spanning forest among distinct wide fingerprints w0..w3.

    Every returned link is exact; FOUND of the links at SIMILARITY, and more of closer ones, meet in a cell.
    """
    axes, grids = grid_plan(values.count())
    made = ", ".join(f"{w} long" for w in _W)
    cells = values.select(*_W).mapInArrow(_grid_batches(axes, grids), f"key long, {made}")
    ends = ", ".join(f"{e}{w} long" for e in ("src", "dst") for w in range(WIDE_WORDS))
    found = cells.repartition(shuffle_parts(values.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_link_batches(1, WIDE_WORDS, distance, WIDE_SMALL, False), ends)
    return found.select(_as_node([f"src{w}" for w in range(WIDE_WORDS)]).alias("src"), _as_node([f"dst{w}" for w in range(WIDE_WORDS)]).alias("dst"))


def _as_node(words: list[str]):
    return F.unhex(F.concat(*(F.lpad(F.hex(w), 16, "0") for w in words)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each group the row with its smallest doc_id stays, a null one last.

    Wide fingerprints over five-word shingles link at WIDE_DISTANCE or fewer differing bits, which is where a
    similarity of SIMILARITY lies; a group is what links connect. Equal fingerprints are one node; texts without
    words (null ones too) are equal. Rows are told apart by two hashes of all their values, so that rows with a
    null or a shared doc_id each count in their own group; of equal rows one stays. An empty table gives an
    empty result; further columns are kept.
    """
    named, other = free_name(docs.columns, "row_a"), free_name(docs.columns, "row_b")
    values = [v for f in docs.schema for v in (F.col(f"`{f.name}`").isNull(), _hashable(f))]
    keyed = docs.withColumns({named: F.xxhash64(*values), other: F.xxhash64(F.lit(1), *values)})
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = keyed.select("doc_id", F.col(named).alias("a"), F.col(other).alias("b"), "text")
    rows = asked.mapInArrow(_wide_batches(["doc_id", "a", "b"]), f"doc_id {kind}, a long, b long, " + ", ".join(f"{w} long" for w in _W))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "a", "b")).alias("r")
    nodes = written(rows.groupBy(*_W).agg(first), "fingerprints")
    roots = connected_components(wide_links(nodes))
    own = nodes.withColumn("node", _as_node(_W)).join(roots, "node", "left")
    stay = own.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("r").alias("r")).select(F.col("r.a").alias(named), F.col("r.b").alias(other))
    kept = keyed.join(stay, [named, other], "left_semi")
    copy = free_name(keyed.columns, "copy")
    kept = kept.withColumn(copy, F.row_number().over(Window.partitionBy(named, other).orderBy(F.lit(1)))).where(F.col(copy) == 1)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _hashable(f: StructField) -> Column:
    """A column's value, or its JSON if it holds maps, which have no hash."""
    value = F.col(f"`{f.name}`")
    return F.to_json(F.struct(value.alias("v"))) if "map<" in f.dataType.simpleString() else value


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
