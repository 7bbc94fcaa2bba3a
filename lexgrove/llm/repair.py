"""Conversation structure repair: the cheapest edits that give system, user and assistant turns their order.

A layer of the dynamic programme is a row. Its edits are macros, a run of inserts and then keep, rerole or delete, written as
codes of which none begins another: so audits of a layer compare as their parents' ranks and then their codes, and a layer holds
ranks and parent pointers instead of strings. Layers compose, so a conversation may lie in any number of partitions.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import read, shuffle_parts, written

SPACE = " \t\n\x0b\x0c\r"
#: States after some turns: none yet, a system turn, a user turn, an assistant turn.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NONE, ASSISTANT)
#: What an inserted or reroled turn becomes in each state; there is one choice only.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = ("", "system", "user", "assistant")
#: Macros in the order of their letters: inserts, then the row's edit.
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 3, 4, 3, 3
FINE, GOES, TRUNCATED = range(3)
LEGAL = ("su", "ua", "au")
_MOST = (1 << 63) - 1
#: Characters of repaired turns that travel in one row between partitions.
_CHUNK = 1 << 20


def _after(state: int, code: str, initial: str) -> int | None:
    """The state that a macro leads to, None where it breaks the order."""
    for _ in range(len(code) - 1):
        state = NEXT[state]
    edit = code[-1]
    if edit == "D":
        return state
    if edit == "R":
        return NEXT[state]
    if initial == "s":
        return SYSTEM if state == NONE else None
    return NEXT[state] if initial and initial == ROLES[NEXT[state]][0] else None


@functools.cache
def _moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(from, code, to, cost) for a row."""
    edits = {"K": KEEP_COST, "R": REROLE_COST, "D": DELETE_COST}
    if fault == TRUNCATED:
        edits["K"] += TRUNCATED_COST
        edits["R"] += TRUNCATED_COST
    if fault == GOES:
        edits = {"D": DELETE_COST}
    out = []
    for state in range(4):
        for c, code in enumerate(CODES):
            to = _after(state, code, initial)
            if code[-1] in edits and to is not None:
                out.append((state, c, to, (len(code) - 1) * INSERT_COST + edits[code[-1]]))
    return out


Layer = tuple[tuple[int | None, ...], tuple[int, ...]]


@functools.cache
def layer(costs: tuple[int | None, ...], ranks: tuple[int, ...], initial: str, fault: int) -> tuple[int, Layer, tuple]:
    """The next layer: what all its costs hold in common, (costs beyond that, ranks of audits), and (parent, code) of each state.

    States that another one beats whatever follows are left out: after an assistant turn all can follow that can after a
    system turn, and all that can at the start for the price of a deletion. So layers are few, and each is made once.
    """
    best: dict[int, tuple[int, int, int, int]] = {}
    for state, code, to, cost in _moves(initial, fault):
        if costs[state] is not None:
            key = costs[state] + cost, ranks[state], code, state
            if to not in best or key < best[to]:
                best[to] = key
    if ASSISTANT in best:
        for state, more in ((NONE, DELETE_COST), (SYSTEM, 0)):
            if state in best and best[state][0] > best[ASSISTANT][0] + more:
                del best[state]
    least = min(k[0] for k in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    made = tuple(best[s][0] - least if s in best else None for s in range(4))
    placed = tuple(order.index(s) if s in best else -1 for s in range(4))
    return least, (made, placed), tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


def start_layer(state: int) -> Layer:
    return tuple(0 if s == state else None for s in range(4)), tuple(0 if s == state else -1 for s in range(4))


def run_layers(kinds: list[tuple[str, int]], state: int) -> tuple[int, Layer, list[tuple]]:
    """Layers of rows (initial, fault) from a state: common cost, last layer, and the pointers of each."""
    total, at, back = 0, start_layer(state), []
    for initial, fault in kinds:
        least, at, pointers = layer(*at, initial, fault)
        total += least
        back.append(pointers)
    return total, at, back


def best_end(at: Layer) -> tuple[int, int, int]:
    """(cost beyond the common one, rank, state) of the cheapest end, the inserts that are still missing included."""
    costs, ranks = at
    return min((c + INSERT_COST * missing(s), ranks[s], s) for s, c in enumerate(costs) if c is not None)


def missing(state: int) -> int:
    """Inserts that end a conversation in order."""
    n = 0
    while state not in ENDS:
        state, n = NEXT[state], n + 1
    return n


def codes_to(back: list[tuple], state: int) -> list[int]:
    """Codes of the rows that lead to a state of the last layer."""
    out = []
    for pointers in reversed(back):
        state, code = pointers[state]
        out.append(code)
    return out[::-1]


@dataclass
class Facts:
    """Counts over a run of rows, and what joins it to the next run."""

    turns: int = 0
    least: int | None = None
    most: int | None = None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    rows: int = 0
    first: str = ""
    last: str = ""

    def join(self, o: Facts) -> Facts:
        """Counts of this run and the one behind it; turns are sorted, so only one can be in both."""
        if not o.rows:
            return self
        if not self.rows:
            return o
        known = [x for x in (self.least, o.least) if x is not None]
        shared = self.most is not None and self.most == o.least
        return Facts(
            self.turns + o.turns - shared, min(known, default=None), o.most if o.most is not None else self.most,
            self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated,
            self.illegal + o.illegal + (self.last + o.first not in LEGAL), self.rows + o.rows, self.first, o.last,
        )

    def gaps(self) -> int:
        return 0 if self.least is None else min(self.most - self.least + 1 - self.turns, _MOST)


@dataclass
class Run:
    """Rows of one conversation that lie together in a partition."""

    conv_id: object
    kinds: list[tuple[str, int]] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    facts: Facts = field(default_factory=Facts)

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool, blank: bool, truncated: bool) -> None:
        """Equal rows at once: only the first of a conversation's is no duplicate."""
        initial = role[:1] or "?"
        keeps = first and not blank
        self.kinds += [(initial, (TRUNCATED if truncated else FINE) if keeps else GOES)] + [(initial, GOES)] * (copies - 1)
        self.roles += [role] * copies
        self.texts += [text] * copies
        known = turn is not None
        one = Facts(
            int(known), turn, turn, copies if blank else 0, 0 if blank else copies - first, int(keeps and truncated),
            copies - 1, copies, initial, initial,
        )
        self.facts = self.facts.join(one)

    def repaired(self, codes: list[int], state: int, inserts: int) -> tuple[str, list[str], list[str]]:
        """(audit, roles, texts) by the codes of the rows from a state, with inserts at the end."""
        roles, texts = [], []
        for i, c in enumerate(codes):
            code = CODES[c]
            for _ in range(len(code) - 1):
                state = NEXT[state]
                roles.append(ROLES[state])
                texts.append("")
            if code[-1] != "D":
                state = _after(state, code[-1], self.kinds[i][0])
                roles.append(self.roles[i] if code[-1] == "K" else ROLES[state])
                texts.append(self.texts[i])
        for _ in range(inserts):
            state = NEXT[state]
            roles.append(ROLES[state])
            texts.append("")
        return "".join([CODES[c] for c in codes]) + "I" * inserts, roles, texts


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with planted faults: conv_id, turn, role, text, copies (0: dropped).

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops a row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?``, 3
    repeats it, 4 makes it a user's. Nulls count as one space there, in roles and in texts.
    """
    def word(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    at = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), at.alias("at"))
    copies = F.when(F.col("at") == 0, 0).when(F.col("at") == 3, 2).otherwise(1).cast("long")
    text = F.when(F.col("at").isin(0, 1), "").when(F.col("at") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("at") == 0, "").when(F.col("at") == 4, "user").otherwise(F.col("role"))
    # What is dropped has no turn either: it is one row of its conversation in what follows.
    turn = F.when(F.col("at") != 0, F.col("turn"))
    return rows.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def marked(turns: DataFrame) -> DataFrame:
    """Distinct rows of each turn with their number and faults: conv_id, turn, role, text, copies, first, blank, truncated.

    ``first``: no row of the conversation before it has its role and text. Equal rows are counted where they lie before
    anything is shuffled, and what is joined to find first ones is a digest and a turn.
    """
    conv = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    key = F.unhex(F.sha2(F.concat(conv, F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = turns.withColumn("key", key)
    firsts = rows.where("copies > 0").groupBy("key").agg(F.min(F.struct(F.col("turn").alias("first_turn"))).alias("f"))
    units = rows.groupBy("conv_id", "turn", "role", "text", "key").agg(F.sum("copies").alias("copies"))
    said = F.rtrim("text", F.lit(SPACE))
    return units.join(firsts, "key", "left").select(
        "conv_id", "turn", "role", "text", "copies", F.coalesce(F.col("turn").eqNullSafe(F.col("f.first_turn")), F.lit(False)).alias("first"),
        (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>, repaired_sha256 string"
_REPAIRED = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _digest(roles: list[str], texts: list[str]) -> str:
    return hashlib.sha256("\n".join([f"{r}:{t}" for r, t in zip(roles, texts)]).encode()).hexdigest()


def _result(facts: Facts, cost: int, audit: str, repaired: list[dict] | None, digest: str) -> tuple:
    return facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, min(cost, _MOST), audit, repaired, digest


def _solved(run: Run, turns: bool) -> tuple:
    """The result of a conversation that lies in one partition."""
    total, at, back = run_layers(run.kinds, NONE)
    more, _, state = best_end(at)
    audit, roles, texts = run.repaired(codes_to(back, state), NONE, missing(state))
    whole = [{"role": r, "text": t} for r, t in zip(roles, texts)] if turns else None
    return _result(run.facts, total + more, audit, whole, _digest(roles, texts))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    run = None
    for b in batches:
        for conv, turn, role, text, copies, first, blank, truncated in zip(*(c.to_pylist() for c in b.columns)):
            if run is None or run.conv_id != conv:
                if run is not None:
                    yield run
                run = Run(conv)
            if copies:
                run.add(turn, role, text, copies, first, blank, truncated)
    if run is not None:
        yield run


_SUMMARY = pa.struct([("total", pa.list_(pa.int64())), ("costs", pa.list_(pa.list_(pa.int64()))), ("ranks", pa.list_(pa.list_(pa.int64())))])
_FACTS = pa.struct([(n, pa.string() if n in ("first", "last") else pa.int64()) for n in Facts.__dataclass_fields__])
_ROW = pa.struct([("at", pa.int64()), ("initial", pa.string()), ("fault", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _solve(kind: pa.DataType, turns: bool):
    """Results of conversations within a partition; summaries and rows of its first and last, which may go on in others."""
    done = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _REPAIRED), ("repaired_sha256", pa.string())]
    schema = pa.schema([("conv_id", kind), ("part", pa.int64()), ("done", pa.struct(done)), ("summary", _SUMMARY), ("facts", _FACTS), ("row", _ROW)])
    names = [n for n, _ in done]

    def open_rows(run: Run, part: int) -> Iterator[tuple]:
        ran = [run_layers(run.kinds, s)[:2] for s in range(4)]
        summary = {"total": [t for t, _ in ran], "costs": [list(c) for _, (c, _) in ran], "ranks": [list(r) for _, (_, r) in ran]}
        yield run.conv_id, part, None, summary, vars(run.facts), None
        for i, ((initial, fault), role, text) in enumerate(zip(run.kinds, run.roles, run.texts)):
            yield run.conv_id, part, None, None, None, {"at": i, "initial": initial, "fault": fault, "role": role, "text": text}

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        # Twice the partition's number, and one more for its last conversation: in the order of all rows.
        part, was, first = 2 * TaskContext.get().partitionId(), None, True
        for run in _runs(batches):
            if was is not None:
                if first:
                    yield from open_rows(was, part)
                else:
                    yield was.conv_id, part, dict(zip(names, _solved(was, turns))), None, None, None
                first = False
            was = run
        if was is not None:
            yield from open_rows(was, part if first else part + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for r in results(batches):
            rows.append(r)
            size += 200 + (len(r[5]["text"]) if r[5] else 0)
            if size > _CHUNK:
                yield _batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return run


@dataclass
class Open:
    """A conversation's runs in partitions, joined: where each run starts and ends, and the result but for its turns."""

    conv_id: object
    facts: Facts
    cost: int
    #: By partition number: place, state at the start, state at the end, inserts behind it.
    runs: dict[int, tuple[int, int, int, int]]


def joined(rows: list) -> Open:
    """The cheapest edits over the runs of one conversation, from their summaries alone."""
    facts, total, at, back = Facts(), 0, start_layer(NONE), []
    for r in rows:
        facts = facts.join(Facts(**r["facts"].asDict()))
        best: dict[int, tuple[int, int, int, int]] = {}
        for s, cost in enumerate(at[0]):
            if cost is None:
                continue
            for to, more in enumerate(r["summary"]["costs"][s]):
                if more is not None:
                    # Of one start, the run's own ranks tell the ends apart; of two, the ranks before it.
                    key = cost + r["summary"]["total"][s] + more, at[1][s], r["summary"]["ranks"][s][to], s
                    if to not in best or key < best[to]:
                        best[to] = key
        least = min(k[0] for k in best.values())
        order = sorted(best, key=lambda s: best[s][1:3])
        total += least
        at = tuple(best[s][0] - least if s in best else None for s in range(4)), tuple(order.index(s) if s in best else -1 for s in range(4))
        back.append({s: k[3] for s, k in best.items()})
    more, _, state = best_end(at)
    ends, runs = missing(state), {}
    for i in range(len(rows) - 1, -1, -1):
        before = back[i][state]
        runs[rows[i]["part"]] = i, before, state, ends if i == len(rows) - 1 else 0
        state = before
    return Open(rows[0]["conv_id"], facts, total + more, runs)


_PIECE = "conv int, place int, at int, audit string, repaired array<struct<role:string,text:string>>"


def _repair_runs(plans):
    """Repaired turns of each run that was left open, a part of them a row."""
    schema = pa.schema([("conv", pa.int32()), ("place", pa.int32()), ("at", pa.int32()), ("audit", pa.string()), ("repaired", _REPAIRED)])

    def pieces(conv: int, where: tuple[int, int, int, int], run: Run) -> Iterator[tuple]:
        place, before, state, inserts = where
        _, _, back = run_layers(run.kinds, before)
        audit, roles, texts = run.repaired(codes_to(back, state), before, inserts)
        part, size, n = [], 0, 0
        for r, t in zip(roles, texts):
            part.append({"role": r, "text": t})
            size += len(r) + len(t)
            if size > _CHUNK:
                yield conv, place, n, audit if not n else "", part
                part, size, n = [], 0, n + 1
        yield conv, place, n, audit if not n else "", part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = Run(None), None
        for b in batches:
            for part, row in zip(*(c.to_pylist() for c in b.columns)):
                if at != part:
                    if at is not None:
                        for p in pieces(*plans.value[at], now):
                            yield _batch([p], schema)
                    now, at = Run(None), part
                if row is not None:
                    now.kinds.append((row["initial"], row["fault"]))
                    now.roles.append(row["role"])
                    now.texts.append(row["text"])
        if at is not None:
            for p in pieces(*plans.value[at], now):
                yield _batch([p], schema)

    return run


def _join_runs(turns: bool):
    """A conversation's pieces in their order: the audit, and the digest, which takes one piece at a time."""
    schema = pa.schema([("conv", pa.int32()), ("audit", pa.string()), ("repaired", _REPAIRED), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, audit, whole, any_ = None, None, [], [], False
        for b in batches:
            for i in range(b.num_rows):
                conv, _, _, letters, part = (c[i].as_py() for c in b.columns)
                if conv != at:
                    if at is not None:
                        yield _batch([(at, "".join(audit), whole if turns else None, digest.hexdigest())], schema)
                    at, digest, audit, whole, any_ = conv, hashlib.sha256(), [], [], False
                audit.append(letters)
                for t in part:
                    digest.update((("\n" if any_ else "") + f"{t['role']}:{t['text']}").encode())
                    any_ = True
                if turns:
                    whole += part
        if at is not None:
            yield _batch([(at, "".join(audit), whole if turns else None, digest.hexdigest())], schema)

    return run


def repair(rows: DataFrame, turns: bool = True) -> DataFrame:
    """One row per conversation of ``marked`` rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired,
    repaired_sha256; ``repaired`` is the array of (role, text), null unless ``turns`` asks for it.

    Rows are dealt by ranges of (conv_id, turn, role, the text's beginning) and sorted, so a conversation of any size is
    dealt over as many partitions as it fills; a task holds one conversation's rows of its partition. Of the first and last
    conversation of a partition, which may go on in others, four rows of costs and ranks for each state come to
    the driver, which joins them; their rows are repaired where they are. A digest needs its bytes in order: it takes one piece
    of such a conversation after the other.

    Turns go by ``turn`` (null first), equal ones by role and text. A role without a letter is kept nowhere. A conversation
    without rows has zeros, an empty audit and the digest of nothing. Rows with a null conv_id are one conversation. Numbers
    beyond 64 bits count as the largest long. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType
    keys = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(shuffle_parts(spark), *keys, F.left("text", F.lit(64))).sortWithinPartitions(*keys, "text")
    made = f"conv_id {kind.simpleString()}, part long, done struct<{RESULT.replace(' ', ':').replace(',:', ',')}>, summary struct<total:array<long>,costs:array<array<long>>,ranks:array<array<long>>>, "
    made += "facts struct<" + ",".join(f"{n}:{'string' if n in ('first', 'last') else 'long'}" for n in Facts.__dataclass_fields__) + ">, "
    made += "row struct<at:long,initial:string,fault:long,role:string,text:string>"
    out = written(dealt.mapInArrow(_solve(to_arrow_type(kind), turns), made), "repaired")
    done = out.where(F.col("done").isNotNull()).select("conv_id", "done.*")
    heads = out.where(F.col("summary").isNotNull()).select("conv_id", "part", "summary", "facts").orderBy("part").collect()
    if not heads:
        return done
    groups: list[list] = []
    for r in heads:
        if groups and groups[-1][0]["conv_id"] == r["conv_id"]:
            groups[-1].append(r)
        else:
            groups.append([r])
    opens = [joined(g) for g in groups]
    # Two short entries a partition at most.
    sent = spark.sparkContext.broadcast({part: (i, where) for i, o in enumerate(opens) for part, where in o.runs.items()})
    facts = [(i, o.conv_id, *_result(o.facts, o.cost, "", None, "")[:6]) for i, o in enumerate(opens)]
    table = spark.createDataFrame(facts, f"conv int, conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    left = out.where(F.col("row").isNotNull() | F.col("summary").isNotNull()).select("part", "row")
    left = left.repartition("part").sortWithinPartitions("part", F.col("row.at").asc_nulls_first())
    pieces = left.mapInArrow(_repair_runs(sent), _PIECE).repartition("conv").sortWithinPartitions("conv", "place", "at")
    digests = pieces.mapInArrow(_join_runs(turns), "conv int, audit string, repaired array<struct<role:string,text:string>>, repaired_sha256 string")
    whole = digests.join(F.broadcast(table), "conv")
    return done.unionByName(whole.select(done.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repair`` of all ``conversations`` after ``damaged``; nulls, ties and empty tables as there."""
    rows = marked(damaged(read(spark, sf_dir, "conversations")))
    return repair(written(rows, "marked"), turns=False).drop("repaired")
