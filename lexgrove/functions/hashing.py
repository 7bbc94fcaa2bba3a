"""Content-addressed identity: canonical JSON and prefixes of its SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys in code-point order, raw Unicode and explicit nulls.

    JSON escapes of control characters are lower case, as in most JSON writers.
    """
    body = F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
    # Only control characters are written as \u00XX; a doubled backslash before is part of a text.
    return F.when(body.contains("\\u00"), lower_escapes(body)).otherwise(body)


def lower_escapes(body: Column) -> Column:
    out = body
    for hi in "01":
        for lo in "ABCDEF":
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{hi}{lo}", rf"$1\\u00{hi}{lo.lower()}")
    return out


def stable_hash(length: int = 16, **fields: Column) -> Column:
    """The first ``length`` hex digits of the SHA-256 of the canonical JSON."""
    return F.substring(F.sha2(canonical_json(**fields), 256), 1, length)
