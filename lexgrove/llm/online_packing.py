"""Online packing by sums of squares: each document goes into the fill level that keeps levels evenly used."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import read

LIMIT = 4096
END_ID = 2
#: Windows that a task holds open at once, 16 kB of ids each; beyond them the emptiest one fills the fullest.
OPEN = 1024
#: Distinct chunks that a task remembers, and the longest it remembers.
REMEMBERED, CHUNK = 600_000, 48
#: Bytes of text that are encoded together, and bytes of ids that leave together.
TOGETHER, SENT = 1 << 23, 1 << 22
_NEVER = np.int64(1) << 60


def tokenizer_file() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


#: Stands for a word's end in the ranks below; lower-casing leaves none in a word.
WORD_END = "Z"
#: Letters of scripts whose classes have long been settled; chunks with others are left to the tokenizer itself.
_OTHER = re.compile("[^\x00-\u017f\u0391-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of a byte-level BPE with word ends that drops white space, as little-endian unsigned 32-bit bytes.

    No token and no step of its normalisation reaches over a space, a tab or a line's end, so a text is cut there, and the
    ids of each chunk are remembered. New chunks are normalised, split into words and encoded together by the vocabulary's
    ranks, with one character for the end of a word; merges have the order of ids, which is checked. Chunks that hold a special
    token or rare characters go through the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bpe = Tokenizer.from_file(path)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {t["content"] for t in spec["added_tokens"]}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"the merges of {path} are not in the order of ids")
        byte = _byte_of_character()
        ranks = {}
        for token, i in vocab.items():
            if token not in special:
                core = token.removesuffix(end)
                ranks[bytes(byte[c] for c in core) + (WORD_END.encode() if core != token else b"")] = i
        self.space = ranks[f" {WORD_END}".encode()]
        self.ranks = tiktoken.Encoding("words", pat_str=f"[^{WORD_END}]+{WORD_END}", mergeable_ranks=ranks, special_tokens={})
        words = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(f"{words}| ").findall
        self.slow = re.compile("|".join([_OTHER.pattern, *map(re.escape, sorted(special))]))
        self.known: dict[str, bytes] = {"": b""}

    def _new(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without white space: all in one string, with a space after each as a word of its own."""
        text = " ".join([*chunks, ""])
        if self.slow.search(text):
            whole = {c: np.asarray(self.bpe.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in chunks if self.slow.search(c)}
            rest = [c for c in chunks if c not in whole]
            whole.update(zip(rest, self._new(rest)))
            return [whole[c] for c in chunks]
        text = text.lower() if text.isascii() else self.bpe.normalizer.normalize_str(text)
        marked = WORD_END.join([*self.words(text), ""])
        ids = np.asarray(self.ranks.encode_ordinary(marked), "<u4")
        ends = np.flatnonzero(ids == self.space)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(ends + 1).tolist()], ends.tolist())]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text; the ids of a chunk that comes often are looked up once and copied together."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        chunks = lists.flatten().dictionary_encode()
        own, codes = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        found = list(map(self.known.get, own))
        new = [c for c, x in zip(own, found) if x is None]
        if new:
            fresh = dict(zip(new, self._new(new)))
            found = [fresh[c] if x is None else x for c, x in zip(own, found)]
            self.known.update([(c, x) for c, x in fresh.items() if len(c) <= CHUNK])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        starts = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        raw = ids[np.arange(ends[-1]) + np.repeat(starts, n)].tobytes()
        at = (4 * ends[lists.offsets.to_numpy()]).tolist()
        for start, end in zip(at, at[1:]):
            yield raw[start:end]


class Packer:
    """Windows by fill level. ``count[h]`` is the number of open windows that hold h ids.

    A piece of n ids goes from level h to h + n, or opens a window at level n, whichever leaves the smallest sum of
    squared counts; of equals the fullest window. Full windows leave at once. ``sent`` collects the windows
    that have left, as lists of pieces (key, start, ids, length of the document).
    """

    def __init__(self, limit: int = LIMIT, open_: int = OPEN) -> None:
        self.limit, self.most, self.open = limit, open_, 0
        self.count = np.zeros(limit + 1, np.int64)
        self.windows: list[list[list[tuple]]] = [[] for _ in range(limit + 1)]
        #: What the sum of squares gains by a window that comes to a level, and by one that goes.
        self.comes, self.goes = np.ones(limit + 1, np.int64), np.full(limit + 1, _NEVER)
        self.comes[limit] = 0
        self.sent: list[list[tuple]] = []

    def _count(self, h: int, by: int) -> None:
        n = self.count[h] = self.count[h] + by
        self.open += by
        self.comes[h] = 2 * n + 1
        self.goes[h] = 1 - 2 * n if n else _NEVER

    def _put(self, window: list[tuple], level: int) -> None:
        if level == self.limit:
            self.sent.append(window)
        elif level:
            self.windows[level].append(window)
            self._count(level, 1)

    def _take(self, level: int) -> list[tuple]:
        self._count(level, -1)
        return self.windows[level].pop()

    def add(self, key: object, ids: bytes) -> None:
        """A document's ids: full windows as long as they last, and the rest as one piece."""
        n, total, at = self.limit, len(ids) // 4, 0
        while total - at >= n:
            self.sent.append([(key, at, ids[4 * at : 4 * (at + n)], total)])
            at += n
        if total > at:
            self._place((key, at, ids[4 * at :], total), total - at)
            while self.open > self.most:
                self._settle()

    def _place(self, piece: tuple, n: int) -> None:
        gain = self.goes[1 : self.limit - n + 1] + self.comes[1 + n :]
        level = len(gain) - int(gain[::-1].argmin()) if len(gain) else 0
        if level and gain[level - 1] <= self.comes[n]:
            self._put([*self._take(level), piece], level + n)
        else:
            self._put([piece], n)

    def _settle(self) -> None:
        """The emptiest window's pieces fill the fullest one; the piece that does not fit is cut."""
        used = np.flatnonzero(self.count)
        high, low = int(used[-1]), int(used[0])
        full = self._take(high)
        rest = self._take(low)
        room = self.limit - high
        while rest and room:
            key, start, ids, total = rest.pop()
            n = len(ids) // 4
            if n > room:
                rest.append((key, start, ids[: 4 * (n - room)], total))
                start, ids, n = start + n - room, ids[4 * (n - room) :], room
            full.append((key, start, ids, total))
            room -= n
        self._put(full, self.limit - room)
        self._put(rest, sum(len(p[2]) // 4 for p in rest))

    def finish(self) -> None:
        """Settles what is open; the last window is cut into lengths that are powers of two, which need no padding."""
        while self.open > 1:
            self._settle()
        if not self.open:
            return
        level = int(np.flatnonzero(self.count)[0])
        pieces = self._take(level)[::-1]
        for bit in range(level.bit_length() - 1, -1, -1):
            room, window = level & 1 << bit, []
            while room:
                key, start, ids, total = pieces.pop()
                n = min(room, len(ids) // 4)
                if 4 * n < len(ids):
                    pieces.append((key, start + n, ids[4 * n :], total))
                window.append((key, start, ids[: 4 * n], total))
                room -= n
            if window:
                self.sent.append(window)


def _together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about TOGETHER bytes of text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + TOGETHER)))
        yield batch.slice(at, to - at)
        at = to


def _pack_batches(path: str, end_id: int, limit: int, open_: int, kind: pa.DataType):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = WordEncoder(path), Packer(limit, open_)
        end = np.asarray([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 33

        def leave() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for window in packer.sent:
                at = 0
                for key, start, ids, total in window:
                    n = len(ids) // 4
                    rows.append((key, start, n, ids, total, number, at))
                    at += n
                number += 1
            packer.sent.clear()
            key, *rest = zip(*rows)
            long = pa.int64()
            kinds = [long, long, pa.binary(), long, long, long]
            return pa.RecordBatch.from_arrays([pa.array(key, kind), *map(pa.array, rest, kinds)], names)

        for b in batches:
            for part in _together(b):
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    packer.add(key, ids + end)
                    if 4 * limit * len(packer.sent) >= SENT:
                        yield leave()
        packer.finish()
        if packer.sent:
            yield leave()

    return run


def pack(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, open_windows: int = OPEN, tokenizer: str | None = None) -> DataFrame:
    """Pieces of every document and their places: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit numbers, ``start`` counts the document's ids before the piece, and
    ``doc_tokens`` all of them with the end id. Each task packs the documents of its partition as they come, in memory that
    ``open_windows`` bounds; nothing is shuffled. All sequences are full, but for a partition's last ones, whose lengths are
    distinct powers of two. Documents are cut where they pass a window, and where a window of the most open ones, or of those
    left at the end, fills another. Equal texts are packed like any others.

    Null and empty texts have the end id only; rows with a null or a shared doc_id each have their own pieces. An empty table
    gives an empty result; further columns are not read. Which documents share a sequence depends on the order of rows in
    partitions: where it is not fixed, as it is for files, write the result before reading it twice.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    made = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    run = _pack_batches(tokenizer or tokenizer_file(), end_id, limit, open_windows, to_arrow_type(kind))
    return docs.select("doc_id", "text").mapInArrow(run, made)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` of all ``documents``, with checksums in place of ids; nulls, ties and empty tables as there."""
    packed = pack(read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
