"""Columns that hold one of several kinds (an answer that is a truth value or a list, a raw response, a payload), as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_variant(rows: DataFrame, column: str) -> bool:
    return isinstance(rows.schema[column].dataType, T.VariantType)


def with_variant(rows: DataFrame, column: str, name: str, malformed: str) -> DataFrame:
    """``rows`` with ``name``, the column's JSON text (or VARIANT) as VARIANT, and ``malformed``: a text that is no JSON. Null is null, and well-formed."""
    if is_variant(rows, column):
        return rows.withColumns({name: F.col(column), malformed: F.lit(False)})
    rows = rows.withColumn(name, F.try_parse_json(F.col(column)))
    return rows.withColumn(malformed, F.col(column).isNotNull() & F.col(name).isNull())


def kind(value: Column) -> Column:
    """``null``, ``boolean``, ``number``, ``string``, ``array`` or ``object``; null for no value at all."""
    of = F.schema_of_variant(value)
    number = of.isin("BIGINT", "DOUBLE", "FLOAT") | of.startswith("DECIMAL")
    return (
        F.when(value.isNull(), None).when(of == "VOID", "null").when(of == "BOOLEAN", "boolean").when(number, "number").when(of.startswith("ARRAY"), "array")
        .when(of.startswith("OBJECT"), "object").otherwise("string")
    )


def truth(value: Column) -> Column:
    """Whether the value counts as true: not null, false, zero, or an empty text, array or object."""
    k, said = kind(value), value.cast("string")
    out = F.when(k == "boolean", F.try_variant_get(value, "$", "boolean")).when(k == "number", F.try_variant_get(value, "$", "double") != 0)
    return F.coalesce(out.when(k == "string", said != "").when(k == "array", said != "[]").when(k == "object", said != "{}"), F.lit(False))


def whole_numbers(value: Column) -> Column:
    """An array's whole numbers in order; null for another kind, and for an array that holds anything else."""
    items = F.try_variant_get(value, "$", "array<variant>")
    numbers = F.transform(items, lambda x: F.when(kind(x) == "number", F.try_variant_get(x, "$", "double")))
    fits = F.forall(numbers, lambda x: x.isNotNull() & (x == F.floor(x)) & (F.abs(x) < 2**31))
    return F.when((kind(value) == "array") & fits, F.transform(numbers, lambda x: x.cast("int")))
