"""Surface filters, answer parsing and log predicates."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Refusals are told by these substrings of the lower-cased text.
REFUSAL_MARKERS = ("i can't", "i cannot", "i am unable", "unable to answer", "cannot answer", "can't answer", "无法", "不能回答", "无法回答", "不能提供")
# An error is worth another try if its lower-cased text holds one of these.
RETRYABLE_MARKERS = ("429", "rate limit", "server overloaded", "timeout", "temporarily unavailable", "connection")
# An excluded synonym, the mark of a proper name, and the one id with preferred surfaces excluded from it.
EXCLUDED_SURFACE, PROPER_MARK = "弥", "ProperName"

NULL_OUTPUT, FORMAT_ERROR, REFUSAL, MISSING, PROVIDER = "Null Output", "Format Error", "Refusal", "Missing Response", "Provider Error"


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def is_refusal(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), REFUSAL_MARKERS)


def is_retryable(status: Column, error: Column) -> Column:
    return ~status.eqNullSafe("success") & contains_any(F.lower(F.coalesce(error, F.lit(""))), RETRYABLE_MARKERS)


def is_terminal(status: Column, error: Column) -> Column:
    return ~is_retryable(status, error)


def is_han(text: Column) -> Column:
    """Han characters throughout; one closing line feed is let through."""
    return F.coalesce(text.rlike(r"^[一-鿿]+\n?\z"), F.lit(False))


def is_clean_lemma(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[A-Za-z]+\z"), F.lit(False))


def ordered_distinct(values: Column) -> Column:
    """Distinct values in the order of their first occurrence, without nulls and empty strings."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))


def clean_han_synonyms(values: Column) -> Column:
    return ordered_distinct(F.filter(values, lambda v: is_han(v) & (v != EXCLUDED_SURFACE)))


#: Fixed value: the surfaces that come before the first synonym of an id.
PREFERRED_SURFACES = {"bn:00054288n": ["迷因", "模因"]}


def preferred_surface(values: Column, object_id: Column, preferred: dict[str, list[str]] | None = None) -> Column:
    """The first synonym among an id's preferred ones (PREFERRED_SURFACES if none are given), else its first, else an empty string."""
    preferred = PREFERRED_SURFACES if preferred is None else preferred
    first = F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))
    out = first
    for key, wanted in preferred.items():
        hit = F.try_element_at(F.filter(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(values, w)), F.lit(1))
        out = F.when(object_id == key, F.coalesce(hit, first)).otherwise(out)
    return out


def is_proper_name(marks: Column) -> Column:
    return F.array_join(F.coalesce(marks, F.array().cast("array<string>")), " ").contains(PROPER_MARK)


def stripped(text: Column) -> Column:
    """Without white space at both ends, any Unicode kind and the separators 0x1C to 0x1F."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+\z", "")


def limited(text: Column, limit: int) -> Column:
    return stripped(F.substring(F.coalesce(text, F.lit("")), 1, limit))


def parse_bool(text: Column, limit: int = 2000) -> Column:
    """true or false by the leading ASCII letters; null for anything else."""
    word = F.lower(F.regexp_extract(limited(text, limit), r"^([A-Za-z]+)", 1))
    return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))


_PLAIN = r"^\[\s*((0|[1-9][0-9]{0,8})\s*(,\s*(0|[1-9][0-9]{0,8})\s*)*)?\]$"


def first_bracket(text: Column, limit: int = 2000) -> Column:
    return F.regexp_extract(limited(text, limit), r"\[[^\]]*\]", 0)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _literal_list(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lists that only a literal parser reads: other bases, underscores, comments, truth values."""

    def one(text):
        try:
            got = ast.literal_eval(text)
        except (SyntaxError, ValueError, MemoryError, RecursionError, TypeError):
            return None
        if not isinstance(got, list) or any(not isinstance(x, int) for x in got):
            return None
        # What exceeds 32 bits is out of any range of options; -1 stands for it.
        return [int(x) if -1 <= x < 2**31 else -1 for x in got]

    for s in texts:
        yield s.map(one)


def parse_list(text: Column, options: Column, limit: int = 2000, literals: bool = True) -> Column:
    """Distinct integers from 1 to ``options`` in the first brackets, in order; null for anything else.

    Plain decimal lists stay in native functions; with ``literals`` other list literals go to a parser.
    """
    inside = first_bracket(text, limit)
    plain = inside.rlike(_PLAIN)
    numbers = F.filter(F.transform(F.split(F.regexp_replace(inside, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    odd = F.when(~plain & (inside != "") & inside.rlike(r"[0-9A-Za-z]"), inside)
    got = F.when(plain, numbers)
    if literals:
        got = F.coalesce(got, _literal_list(odd))
    fine = (F.size(F.array_distinct(got)) == F.size(got)) & F.forall(got, lambda x: (x >= 1) & (x <= options))
    return F.when(fine, got)


def parse_error(task: Column, text: Column, as_bool: Column, as_set: Column, limit: int = 2000) -> Column:
    got = F.when(task == "T2", as_set.isNotNull()).otherwise(as_bool.isNotNull())
    return F.when(limited(text, limit) == "", NULL_OUTPUT).when(~got, FORMAT_ERROR)


def answer_matches(task: Column, as_bool: Column, as_set: Column, gold_bool: Column, gold_set: Column) -> Column:
    same_set = F.array_sort(F.array_distinct(as_set)) == F.array_sort(F.array_distinct(gold_set))
    return F.coalesce(F.when(task == "T2", same_set).otherwise(as_bool == gold_bool), F.lit(False))
