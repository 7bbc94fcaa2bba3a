"""Best-fit packing of token pieces, with bounds that certify a partition's number of sequences."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import read, written

LIMIT = 1024
END_ID = 2
#: Distinct chunks that a worker remembers, and the longest it remembers.
REMEMBERED, CHUNK = 400_000, 48
#: Rounds of packing; all but the last exchange pieces.
ROUNDS = 3
#: Where a partition has more sequences than its bound, so many of its emptiest ones are packed anew, in turn, until it meets it. The
#: search fills one sequence at a time by subset sums, in time that grows with the square of the number: larger pools cost more and
#: may save another sequence; what is given up is never a piece, and ``certificate`` tells how many sequences it can be.
POOLS = (60, 120, 240)
_SPACED = re.compile(r"\s ")


def tokenizer_files() -> tuple[str, str, str]:
    """Paths of the tokenizer and of the same vocabulary as ranks, and the split pattern."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class Encoder:
    """Ids of a byte-level BPE, as little-endian unsigned 32-bit bytes.

    A match of the split pattern never goes on over a space that follows a character other than white
    space, so that a text can be cut there and each chunk's ids remembered. Texts with white space
    before a space are encoded whole. The end-of-text string counts as that special token, as the
    tokenizer itself has it.
    """

    def __init__(self, ranks: str, pattern: str, special: dict[str, int] | None = None) -> None:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = {"<|endoftext|>": 50256} if special is None else special
        self.bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if _SPACED.search(text):
            return self._whole(text)
        head, *chunks = text.split(" ")
        known = self.known
        got = list(map(known.get, chunks))
        if None in got:
            if len(known) > REMEMBERED:
                known.clear()
            for i, x in enumerate(got):
                if x is None:
                    c = chunks[i]
                    x = known.get(c)
                    if x is None:
                        x = self._whole(" " + c)
                        if len(c) <= CHUNK:
                            known[c] = x
                    got[i] = x
        return (self._whole(head) if head else b"") + b"".join(got)

    def encode(self, text: str) -> bytes:
        if self.cut and any(s in text for s in self.special):
            return b"".join(np.asarray([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.cut.split(text) if x)
        return self._plain(text)


def _piece_batches(ranks: str, pattern: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Loaded for each task and freed with it: a vocabulary that idle workers kept would count against every other stage.
        encoder = Encoder(ranks, pattern)
        end = np.asarray([END_ID], "<u4").tobytes()
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = encoder.encode(t or "") + end
                n = len(ids) // 4
                at, k = 0, n % limit or limit
                for p in range(-(-n // limit)):
                    rows.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + k)]))
                    at, k = at + k, limit
            own = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and an end id, cut if over ``limit``.

    Only the first piece of a cut document is shorter than ``limit``. Null texts count as empty.
    """
    _, ranks, pattern = tokenizer_files()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_piece_batches(ranks, pattern, limit), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def dual_feasible_bound(counts: np.ndarray, limit: int = LIMIT) -> int:
    """Least number of sequences for ``counts[k]`` pieces of length k, by dual feasible functions.

    Each function maps lengths so that what fits in a sequence maps to at most 1; the largest sum of
    images bounds the number from below. Used here: the identity, the step functions that call lengths
    over ``limit - e`` whole and drop those under ``e``, and the rounding functions with k steps.
    """
    size = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * size).sum()) // limit)
    total, weight = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * size)])
    for e in range(1, limit // 2 + 1):
        whole = total[limit + 1] - total[limit - e + 1]
        rest = weight[limit - e + 1] - weight[e]
        best = max(best, int(whole + -(-int(rest) // limit)))
    for k in range(1, 101):
        scaled = size * (k + 1)
        image = np.where(scaled % limit == 0, size * k, (scaled // limit) * limit)
        best = max(best, -(-int((counts * image).sum()) // (limit * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the bins' loads: longest first, into the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(limit + 1)]
    has = 0  # bit r: a bin has room r
    loads: list[int] = []
    for i in order.tolist():
        k = int(lengths[i])
        fit = has >> k
        if fit and k:
            r = k + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                has &= ~(1 << r)
        else:
            b, r = len(loads), limit
            loads.append(0)
        bins[i], offsets[i] = b, loads[b]
        loads[b] += k
        left = r - k
        if left:
            room[left].append(b)
            has |= 1 << left
    return bins, offsets, np.asarray(loads, np.int64)


def _fullest(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of positions in ``lengths`` (longest first): each takes the longest left and the set that fills it best."""
    left, bins = list(range(len(lengths))), []
    mask = (1 << (limit + 1)) - 1
    while left:
        head, left = left[0], left[1:]
        room = limit - lengths[head]
        reach = [1]
        for i in left:
            reach.append((reach[-1] | reach[-1] << lengths[i]) & mask)
            if reach[-1] >> room & 1:
                break
        at = (reach[-1] & ((1 << (room + 1)) - 1)).bit_length() - 1
        taken = []
        for n in range(len(reach) - 1, 0, -1):
            if not reach[n - 1] >> at & 1:
                taken.append(left[n - 1])
                at -= lengths[left[n - 1]]
        bins.append([head, *taken])
        gone = set(taken)
        left = [i for i in left if i not in gone]
    return bins


def repack(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, loads: np.ndarray, limit: int = LIMIT, pool: int = POOLS[0]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs the pieces of the ``pool`` emptiest bins anew, and takes the outcome if it has fewer bins."""
    open_ = np.argsort(loads, kind="stable")[:pool]
    where = np.flatnonzero(np.isin(bins, open_))
    where = where[np.argsort(-lengths[where], kind="stable")]
    new = _fullest(lengths[where].tolist(), limit)
    if len(new) >= len(open_):
        return bins, offsets, loads
    bins, offsets = bins.copy(), offsets.copy()
    for b, members in zip(open_.tolist(), new):
        at = 0
        for i in members:
            j = where[i]
            bins[j], offsets[j] = b, at
            at += int(lengths[j])
    used, bins = np.unique(bins, return_inverse=True)
    return bins, offsets, np.bincount(bins, weights=lengths, minlength=len(used)).astype(np.int64)


def _pack_partition(limit: int, round_no: int, pools: tuple[int, ...] = POOLS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs one partition's pieces; marks the bins that stay and those whose pieces are exchanged."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        lengths = table.column("length").to_numpy()
        bins, offsets, loads = best_fit_decreasing(lengths, limit)
        bound = dual_feasible_bound(np.bincount(lengths, minlength=limit + 2)[: limit + 2], limit)
        for pool in pools:
            if len(loads) > bound:
                bins, offsets, loads = repack(lengths, bins, offsets, loads, limit, pool)
        gap = len(loads) - bound
        # A certified partition keeps all but its emptiest bin; another gives up all bins that are not full.
        stays = loads == limit
        if gap <= 0:
            stays[:] = True
            stays[np.argmin(loads)] = loads.min() == limit
        seq = (np.int64(round_no) << np.int64(56)) + (np.int64(part) << np.int64(32)) + bins
        out = table.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offsets)).append_column("stays", pa.array(stays[bins]))
        yield from out.to_batches(max_chunksize=50_000)

    return run


def pack(pieces_: DataFrame, limit: int = LIMIT, per_part: int = 150_000, rounds: int = ROUNDS, pools: tuple[int, ...] = POOLS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, in as few sequences of ``limit`` as it can.

    Partitions of about ``per_part`` pieces are packed best-fit decreasing. A partition whose number of
    sequences meets its lower bound is certified and keeps them, but for its emptiest one. The pieces in
    unfilled sequences of the others are dealt anew over fewer partitions, and packed again; in the last
    round all stays as it is. Pieces of length ``limit`` fill a sequence alone and move nowhere. Each round's outcome is written to the
    shared folder, so that a lost executor never repeats it in another way. ``certificate`` bounds what more rounds or larger pools could save.
    """
    cols = pieces_.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_.schema)
    made = f"{kinds}, sequence_id long, offset long, stays boolean"
    own = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    full = pieces_.where(F.col("length") == limit).select(*cols, (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, todo = [written(full, "full")], pieces_.where(F.col("length") < limit)
    n = todo.count()
    for r in range(rounds):
        if not n:
            break
        last = r == rounds - 1
        parts = max(1, -(-n // per_part))
        dealt = todo.withColumn("__p", F.pmod(own + r, F.lit(parts))).repartition(parts, "__p") if parts > 1 else todo.withColumn("__p", F.lit(0)).coalesce(1)
        dealt = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32").drop("__p")
        packed = written(dealt.mapInArrow(_pack_partition(limit, r, pools), made), "packed")
        if last:
            done.append(packed.drop("stays"))
            break
        done.append(packed.where("stays").drop("stays"))
        todo = packed.where("not stays").select(*cols)
        left = todo.count()
        if left >= n:
            done[-1] = packed.drop("stays")
            break
        n = left
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def certificate(packed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(sequences, bound, gap): how many sequences there are, the least there can be, and the difference; one row, zeros without pieces.

    The bound comes from the number of pieces of each length, at most ``limit`` numbers.
    """
    counts = np.zeros(limit + 2, np.int64)
    for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    bound = dual_feasible_bound(counts, limit)
    made = packed.agg(F.count_distinct("sequence_id").alias("sequences"))
    return made.select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))


def pack_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pieces of every document with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty, and have the end id only; rows with a null or a shared doc_id each have their own pieces.
    An empty table gives an empty result; further columns are not read.
    """
    return pack(written(pieces(docs, limit), "pieces"), limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
