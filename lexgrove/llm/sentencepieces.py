"""SentencePiece encoding and decoding by a batched numpy Viterbi over words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import read

SPACE = "▁"
#: Bytes of text that are encoded together, distinct words that a worker remembers, and the longest it remembers.
TOGETHER, REMEMBERED, LONGEST = 3_000_000, 450_000, 32
#: Words of more characters than this (unspaced text, encoded data) go alone, so many characters at a time.
ALONE, WINDOW = 512, 1 << 16
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_BIG = np.int64(1 << 40)
_FRONT = np.uint64(42)


def default_model() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Pieces:
    """What a model file holds: pieces, scores, kinds; ``bpe`` or else a unigram model."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
    bpe: bool
    prefix: bool


def load(path: str) -> Pieces:
    """Reads a model with the identity normalizer whose pieces hold the space mark at their beginning only."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only BPE and unigram models without a normalizer are supported")
    out = Pieces(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(p.type for p in m.pieces), m.trainer_spec.model_type == 2, n.add_dummy_prefix)
    if any(SPACE in p.lstrip(SPACE) for p, k in zip(out.texts, out.kinds) if k == 1) or 4 in out.kinds:
        raise ValueError("pieces go over words")
    return out


def _mixed(codes: np.ndarray, by: np.uint64) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * by
    return x ^ (x >> np.uint64(29))


class Encoder:
    """Encodes words in batches.

    Words advance together, a character at a time. For each end the substrings up to the longest piece are
    probed by hash among the sorted piece keys, and the best candidate's length is the backpointer. In
    a unigram model the best has the largest sum of scores. In a BPE model merges decide: a prefix's
    last piece is the one that is compatible with the last piece of the prefix before it, that is, no merge of
    better rank goes over their border while either is built; there is exactly one, so the maximum is
    over candidates with all others at minus infinity. Runs of spaces have pieces of equal rank, which
    BPE joins from the left, and are cut apart from the word. A word of more than ALONE characters has no others to
    advance with: all its substrings are probed together, window by window, and only the choice goes from end to end.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.bpe, self.prefix = pieces.bpe, pieces.prefix
        normal = [i for i, k in enumerate(pieces.kinds) if k == 1]
        self.white = {len(pieces.texts[i]): i for i in normal if set(pieces.texts[i]) == {SPACE}}
        use = [i for i in normal if not self.bpe or len(pieces.texts[i]) == 1 or SPACE * 2 not in pieces.texts[i][:2]]
        if self.bpe:
            use = [i for i in use if len(pieces.texts[i]) == 1] + sorted((i for i in use if len(pieces.texts[i]) > 1), key=lambda i: (-pieces.scores[i], i))
        texts = [pieces.texts[i] for i in use]
        self.ids = np.asarray([*use, 0], "<u4")
        self.unknown = len(use)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds)) if k == 6}
        self.unk_id = next((i for i, k in enumerate(pieces.kinds) if k == 2), 0)
        self.longest = max(map(len, texts), default=1)
        self.powers = [np.cumprod(np.asarray([1, *[b] * self.longest], np.uint64)) for b in (_A, _B)]
        self.lengths = np.asarray([*map(len, texts), 1], np.int64)
        h = [self._hash(texts, k) for k in (0, 1)]
        order = np.argsort(h[0], kind="stable")
        self.keys, self.checks, self.rank = h[0][order], h[1][order], order.astype(np.int64)
        self.own = [np.append(x, np.uint64(0)) for x in h]
        low = min((pieces.scores[i] for i in normal), default=0.0)
        self.scores = np.asarray([*(pieces.scores[i] for i in use), low - 10.0])
        self.texts, self.known_rank = texts, {t: i for i, t in enumerate(texts)}
        if self.bpe:
            self._splits(texts)
            self.halves = self.left.tolist(), self.right.tolist()
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> _FRONT] = True
        self.known: dict[str, bytes] = {}

    def _hash(self, texts: list[str], k: int) -> np.ndarray:
        out = []
        by = int((_A, _B)[k])
        for t in texts:
            x = 0
            for c in _mixed(np.frombuffer(t.encode("utf-32-le"), "<u4"), (_B, _A)[k]).tolist():
                x = (x * by + c) & 0xFFFFFFFFFFFFFFFF
            out.append(x)
        return np.asarray(out, np.uint64)

    def _splits(self, texts: list[str]) -> None:
        """The last merge of each piece; pieces that their own merges do not give are taken out of the keys."""
        rank = {t: i for i, t in enumerate(texts)}
        left, right = np.arange(len(texts) + 1), np.arange(len(texts) + 1)
        gone = []
        for i, t in enumerate(texts):
            if len(t) == 1:
                continue
            parts, last = list(t), None
            while len(parts) > 1:
                best = min(((rank.get(a + b, _BIG), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(_BIG, 0))
                if best[0] == _BIG:
                    break
                k = best[1]
                last = parts[k], parts[k + 1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) > 1:
                gone.append(i)
            else:
                left[i], right[i] = rank[last[0]], rank[last[1]]
        self.left, self.right = left, right
        if gone:
            keep = ~np.isin(self.rank, gone)
            self.keys, self.checks, self.rank = self.keys[keep], self.checks[keep], self.rank[keep]
            for i in gone:
                del self.known_rank[texts[i]]

    def _find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Ranks of substrings by their two hashes; -1 where there is no such piece. Most end at a bitmap of the keys' first bits."""
        out = np.full(len(h1), -1, np.int64)
        some = np.flatnonzero(self.seen[h1 >> _FRONT])
        if len(some):
            h = h1[some]
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == h) & (self.checks[at] == h2[some])
            out[some[hit]] = self.rank[at[hit]]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the border between pieces a and b, both given by rank."""
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a != self.unknown) & (b != self.unknown) & (a >= 0))
        a, b = a[live], b[live]
        limit = np.full(len(live), _BIG)
        p1, p2 = self.powers
        while len(live):
            n = self.lengths[b]
            fits = self.lengths[a] + n <= self.longest
            both = self._find(self.own[0][a] * p1[n] + self.own[0][b], self.own[1][a] * p2[n] + self.own[1][b])
            bad = fits & (both >= 0) & (both < limit)
            ok[live[bad]] = False
            na, nb = self.right[a], self.left[b]
            base_a, base_b, more = na == a, nb == b, a > b
            use_a = ~base_a & (more | base_b)
            use_b = ~base_b & (~more | base_a)
            limit = np.where(use_a, a, b + 1)
            go = ~bad & (use_a | use_b)
            a, b = np.where(use_a, na, a)[go], np.where(use_b, nb, b)[go]
            live, limit = live[go], limit[go]
        return ok

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each non-empty word, little-endian unsigned 32-bit."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > ALONE).tolist():
            out[i] = self._alone(words[i])
        short = np.flatnonzero(sizes <= ALONE)
        if len(short) < len(words):
            for i, x in zip(short.tolist(), self.words([words[i] for i in short])):
                out[i] = x
            return out
        for k in np.unique(np.ceil(np.log2(np.maximum(sizes, 8)))).tolist():
            group = np.flatnonzero(np.ceil(np.log2(np.maximum(sizes, 8))) == k)
            step = max(1, 1_000_000 // (1 << int(k)))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                part = part[np.argsort(-sizes[part], kind="stable")]
                for i, x in zip(part.tolist(), self._advance([words[i] for i in part], sizes[part])):
                    out[i] = x
        return out

    def _advance(self, words: list[str], sizes: np.ndarray) -> list[bytes]:
        n, top = len(words), int(sizes[0])
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        codes = np.zeros((n, top), np.uint32)
        codes[np.arange(top) < sizes[:, None]] = flat
        h1, h2 = np.zeros((top + 1, n), np.uint64), np.zeros((top + 1, n), np.uint64)
        for e in range(top):
            h1[e + 1] = h1[e] * _A + _mixed(codes[:, e], _B)
            h2[e + 1] = h2[e] * _B + _mixed(codes[:, e], _A)
        last = np.full((top + 1, n), -1, np.int64)
        back = np.zeros((top + 1, n), np.int32)
        total = np.zeros((top + 1, n)) if not self.bpe else None
        counts = np.searchsorted(-sizes, -np.arange(top + 1), side="right")
        for e in range(1, top + 1):
            m = int(counts[e])
            if self.bpe:
                for size in range(min(e, self.longest), 0, -1):
                    todo = np.flatnonzero(back[e, :m] == 0)
                    if not len(todo):
                        break
                    s = e - size
                    got = self._find(h1[e, todo] - h1[s, todo] * self.powers[0][size], h2[e, todo] - h2[s, todo] * self.powers[1][size])
                    hit = got >= 0
                    rows, cand = todo[hit], got[hit]
                    fine = self._compatible(last[s, rows], cand)
                    last[e, rows[fine]] = cand[fine]
                    back[e, rows[fine]] = size
            else:
                best = np.full(m, -np.inf)
                for size in range(min(e, self.longest), 0, -1):
                    s = e - size
                    got = self._find(h1[e, :m] - h1[s, :m] * self.powers[0][size], h2[e, :m] - h2[s, :m] * self.powers[1][size])
                    value = np.where(got >= 0, total[s, :m] + self.scores[got], -np.inf)
                    better = value > best
                    best[better], last[e, :m][better], back[e, :m][better] = value[better], got[better], size
                lone = self._find(_mixed(codes[:m, e - 1], _B), _mixed(codes[:m, e - 1], _A)) < 0
                value = total[e - 1, :m] + self.scores[-1]
                worse = lone & (value > best)
                best[worse], last[e, :m][worse], back[e, :m][worse] = value[worse], self.unknown, 1
                total[e, :m] = best
            none = np.flatnonzero(back[e, :m] == 0)
            last[e, none], back[e, none] = self.unknown, 1
        # Backwards over all words at once, then forwards in order.
        at, cols, ends, ranks = sizes.copy(), [], [], []
        while (live := np.flatnonzero(at > 0)).size:
            cols.append(live)
            ends.append(at[live])
            ranks.append(last[at[live], live])
            at[live] -= back[at[live], live]
        col, end, rank = (np.concatenate(x) for x in (cols, ends, ranks))
        order = np.lexsort((end, col))
        col, end, rank = col[order], end[order], rank[order]
        raw, cuts = self.ids[rank].tobytes(), np.searchsorted(col, np.arange(n + 1)).tolist()
        out = [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
        for c in np.unique(col[rank == self.unknown]).tolist():
            out[c] = self._with_unknown(words[c], rank[cuts[c] : cuts[c + 1]].tolist(), end[cuts[c] : cuts[c + 1]].tolist())
        return out

    def _with_unknown(self, word: str, ranks: list[int], ends: list[int]) -> bytes:
        """Ids where some character is no piece: its bytes, or one unknown id for a run of such characters."""
        part: list[int] = []
        for r, e in zip(ranks, ends):
            if r != self.unknown:
                part.append(int(self.ids[r]))
            elif self.bytes:
                part.extend(self.bytes[x] for x in word[e - 1].encode())
            elif not part or part[-1] != self.unk_id:
                part.append(self.unk_id)
        return np.asarray(part, "<u4").tobytes()

    def _keeps(self, a: int, b: int) -> bool:
        """As ``_compatible``, for one border."""
        if a < 0 or a == self.unknown or b == self.unknown:
            return True
        left, right = self.halves
        limit = _BIG
        while True:
            if self.known_rank.get(self.texts[a] + self.texts[b], _BIG) < limit:
                return False
            na, nb = right[a], left[b]
            if na == a and nb == b:
                return True
            if na != a and (a > b or nb == b):
                limit, a = a, na
            else:
                limit, b = b + 1, nb

    def _alone(self, word: str) -> bytes:
        """Ids of one long word, WINDOW characters at a time; time and memory grow with its length only."""
        codes = np.frombuffer(word.encode("utf-32-le"), "<u4")
        n = len(codes)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        total, low = [0.0], float(self.scores[-1])
        scores = self.scores.tolist() if not self.bpe else []
        for at in range(0, n, WINDOW):
            lo, hi = max(0, at - self.longest), min(n, at + WINDOW)
            m1, m2 = _mixed(codes[lo:hi], _B), _mixed(codes[lo:hi], _A)
            h1, h2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            found: list[list[tuple[int, int]]] = [[] for _ in range(hi - lo + 1)]
            for size in range(1, min(self.longest, hi - lo) + 1):
                k = hi - lo - size + 1
                h1, h2 = h1[:k] * _A + m1[size - 1 :], h2[:k] * _B + m2[size - 1 :]
                got = self._find(h1, h2)
                starts = np.flatnonzero(got >= 0)
                for s, r in zip(starts.tolist(), got[starts].tolist()):
                    found[s + size].append((size, r))
            for e in range(at + 1, hi + 1):
                if self.bpe:
                    for size, r in reversed(found[e - lo]):
                        if self._keeps(last[e - size], r):
                            last[e], back[e] = r, size
                            break
                else:
                    best = -math.inf
                    for size, r in reversed(found[e - lo]):
                        if (v := total[e - size] + scores[r]) > best:
                            best, last[e], back[e] = v, r, size
                    if (not found[e - lo] or found[e - lo][0][0] > 1) and (v := total[e - 1] + low) > best:
                        best, last[e], back[e] = v, self.unknown, 1
                    total.append(best)
                if not back[e]:
                    last[e], back[e] = self.unknown, 1
        ranks, ends, e = [], [], n
        while e:
            ranks.append(last[e])
            ends.append(e)
            e -= back[e]
        ranks.reverse()
        ends.reverse()
        if self.unknown in ranks:
            return self._with_unknown(word, ranks, ends)
        return self.ids[np.asarray(ranks)].tobytes()

    def _run(self, n: int) -> bytes:
        """Ids of n spaces that no word takes in: the longest pieces from the left."""
        top = max(self.white, default=1)
        out = [self.white[top]] * (n // top)
        n %= top
        while n:
            k = max((w for w in self.white if w <= n), default=1)
            out.append(self.white.get(k, self.unk_id))
            n -= k
        return np.asarray(out, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as bytes; words that are not remembered are encoded together."""
        split = []
        for t in texts:
            t = t.replace(SPACE, " ") if SPACE in t else t
            split.append((t if self.prefix or not t else t[1:] if t[0] == " " else "\0" + t).split(" ") if t else [])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = list({c for s in split for c in s if c and c not in known})
        extra: dict[str, bytes] = {}
        for c, ids in zip(new, self.words([c[1:] if c[0] == "\0" and not self.prefix else SPACE + c for c in new])):
            (known if len(c) <= LONGEST else extra)[c] = ids
        lone = np.asarray([self.white.get(1, 0)], "<u4").tobytes()
        out = []
        for s in split:
            if "" not in s:
                try:
                    out.append(b"".join([known[c] for c in s]))
                except KeyError:
                    out.append(b"".join([known.get(c) or extra[c] for c in s]))
                continue
            parts, run = [], 0
            for c in s:
                if not c:
                    run += 1
                    continue
                ids = known.get(c) or extra[c]
                if run and ids[:4] == lone and self.bpe:
                    parts += [self._run(run + 1), ids[4:]]
                else:
                    parts += [self._run(run) if run else b"", ids]
                run = 0
            out.append(b"".join([*parts, self._run(run) if run else b""]))
        return out


class Decoder:
    """Texts of ids: each piece's bytes in turn, without the space that encoding puts first."""

    def __init__(self, pieces: Pieces) -> None:
        self.prefix = pieces.prefix
        self.table = [bytes([int(t[3:5], 16)]) if k == 6 else t.replace(SPACE, " ").encode() if k in (1, 4, 5) else b" \xe2\x81\x87 " if k == 2 else b"" for t, k in zip(pieces.texts, pieces.kinds)]

    def decode(self, ids: bytes) -> str:
        """Bytes that are not UTF-8 become U+FFFD, ids beyond the model nothing."""
        table, n = self.table, len(self.table)
        got = np.frombuffer(ids, "<u4")
        raw = b"".join([table[i] for i in (got if not len(got) or int(got.max()) < n else got[got < n]).tolist()])
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_TOOLS: dict[type, tuple[Pieces, object]] = {}


def _tool(kind: type, pieces: Pieces):
    """One for each worker, with what it remembers."""
    if kind not in _TOOLS or _TOOLS[kind][0] != pieces:
        _TOOLS[kind] = (pieces, kind(pieces))
    return _TOOLS[kind][1]


def _slices(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about TOGETHER bytes of a column."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(b.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + TOGETHER)))
        yield b.slice(at, to - at)
        at = to


def _encode_batches(pieces, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _tool(Encoder, pieces.value)
        for b in batches:
            for part in _slices(b, "text"):
                ids = e.encode([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*columns, "piece_ids"])

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` with ``piece_ids``: each whole text's ids as little-endian unsigned 32-bit bytes.

    Null and empty texts have no ids. An own column of that name is replaced.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load(model or default_model()))
    base = docs.drop("piece_ids")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(_encode_batches(pieces, base.columns), f"{kinds}, piece_ids binary")


def _decode_batches(pieces, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _tool(Decoder, pieces.value)
        for b in batches:
            for part in _slices(b, "piece_ids"):
                texts = [d.decode(x or b"") for x in part.column(part.schema.get_field_index("piece_ids")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return run


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``: the text of ``piece_ids``; null ids give an empty text. An own column of that name is replaced."""
    pieces = rows.sparkSession.sparkContext.broadcast(load(model or default_model()))
    base = rows.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(_decode_batches(pieces, base.columns), f"{kinds}, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and checksums of ids and decoded texts; same: the text came back as it was."""
    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = decode(coded)
    return back.select(
        "doc_id", (F.octet_length("piece_ids") / 4).cast("long").alias("n_ids"), F.crc32("piece_ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"),
    )
