"""Chat formatting: a state machine over roles, and text segments with loss flags from a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.llm.common import read

_ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles under the loss mask, and the turn order as a state machine.

    ``moves`` maps a state to the roles that may come next; a role is the state it leads to. A
    conversation is in order if every role is allowed and the last state is in ``ends``. ``foreign``
    lists control strings of other templates, which are escaped in texts as well. No control string may
    hold the escape character, be a single character, or overlap another one's beginning with its end.
    """

    open: str = "<|turn|>"
    body: str = "<|text|>"
    close: str = "<|end|>"
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def controls(self) -> tuple[str, ...]:
        all_ = tuple(dict.fromkeys([self.open, self.body, self.close, *self.foreign]))
        for a in all_:
            if len(a) < 2 or _ESCAPE in a:
                raise ValueError(f"control string {a!r}")
            for b in all_:
                if any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        return all_


def escaped(text: Column, template: Template) -> Column:
    """Doubles the escape character, and puts one into each control string, behind its first character."""
    out = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE * 2))
    for c in template.controls():
        out = F.replace(out, F.lit(c), F.lit(c[0] + _ESCAPE + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, n_turns, segments, formatted, in_order, bad_turn.

    ``segments`` is an array of (text, loss); joined, the texts are ``formatted``. Turns go by ``turn``
    (null first), equal ones by role and text. Null roles and texts count as empty; rows with a null
    conv_id are one conversation. Every conversation is formatted; ``in_order`` says whether the state machine takes
    its roles, and ``bad_turn`` is the first position (from 0) that it does not, or the number of turns if the end
    is missing. Further columns of ``turns`` are not used. An empty table gives an empty result.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A turn is formatted where it is read; only its three segments are gathered.
    made = rows.select(
        "conv_id", "turn", "role", "text",
        F.array(
            F.struct(F.concat(F.lit(template.open), escaped(F.col("role"), template), F.lit(template.body)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(F.col("text"), template).alias("text"), F.col("role").isin(*template.loss).alias("loss")),
            F.struct(F.lit(template.close + "\n").alias("text"), F.lit(False).alias("loss")),
        ).alias("segments"),
    )
    whole = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segments"))).alias("t"))
    table = F.create_map(*[x for s, roles in template.moves.items() for r in roles for x in (F.lit(f"{s}\x00{r}"), F.lit(r))])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        to = F.try_element_at(table, F.concat(acc["state"], F.lit("\x00"), role))
        bad = F.coalesce(acc["bad"], F.when(to.isNull(), acc["n"]))
        return F.struct(F.coalesce(to, F.lit("?")).alias("state"), (acc["n"] + 1).alias("n"), bad.alias("bad"))

    ran = F.aggregate(F.col("t.role"), start, step)
    out = whole.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.flatten("t.segments").alias("segments"), ran.alias("ran"))
    bad = F.coalesce("ran.bad", F.when(~F.col("ran.state").isin(*template.ends), F.col("ran.n")))
    return out.select("conv_id", "n_turns", "segments", F.array_join("segments.text", "").alias("formatted"), bad.isNull().alias("in_order"), bad.alias("bad_turn"))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """Array of (role, text) from a formatted conversation."""
    parts = F.slice(F.split(formatted, _quoted(template.open)), 2, 1 << 30)
    tail = len(template.close) + 1

    def turn(x: Column) -> Column:
        two = F.split(F.substring(x, F.lit(1), F.length(x) - tail), _quoted(template.body), 2)
        return F.struct(unescaped(two[0]).alias("role"), unescaped(two[1]).alias("text"))

    return F.transform(parts, turn)


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


#: A conversation that holds control strings in its texts.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in PROBE])).alias("r")).select("r.*")
    made = format_conversations(turns.unionByName(probe))
    said = made.withColumn("back", read_back(F.col("formatted"))).withColumn(
        "loss", F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    )
    turns_text = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "in_order",
    )


def _oracle(template: Template = Template()) -> str:
    def esc(col: str) -> str:
        out = f"replace({col}, '\\', '\\\\')"
        for c in template.controls():
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    marks = len(template.open) + len(template.body) + len(template.close) + 1
    moves = ", ".join(f"('{s}', '{r}')" for s, roles in template.moves.items() for r in roles)
    said = "string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant')"
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), o AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS was,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NULL AS last FROM r
), f AS (
  SELECT *, (was, role) IN ({moves}) AND (NOT last OR role = 'assistant') AS fine FROM o
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(length(coalesce({said}, '')) AS BIGINT) AS loss_chars, sha256(coalesce({said}, '')) AS loss_sha256,
       CAST(sum({marks} + length({esc('role')}) + length({esc('text')})) AS BIGINT) AS formatted_chars,
       bool_and(fine) AS in_order
FROM f GROUP BY conv_id
"""


ORACLE = _oracle()
