"""Navigation of JSON values without a schema: keys, indexes, all values of a repeated key, typed reading.

Values are VARIANT columns. Reading is strict: a number with a fraction is no integer, ``8080.0`` neither, and a text
is no number. What isn't there, or has another type, is null; a JSON null is a value that :func:`is_null` tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.locate import json_members
from .json import _at, _tag


def parse(df: DataFrame, column: str, into: str = "value") -> DataFrame:
    """``df`` with the value of each document; of repeated keys the last counts. What isn't JSON is null."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return df.withColumn(into, F.try_parse_json(column))


def at(value: Column, *steps: str | int) -> Column:
    """The value at the end of a path of keys and indexes; negative indexes and other types lead nowhere."""
    for step in steps:
        value = _at(value, step) if isinstance(step, str) else F.try_variant_get(value, f"$[{step}]", "variant") if step >= 0 else F.lit(None).cast("variant")
    return value


def is_null(value: Column) -> Column:
    return F.coalesce(F.is_variant_null(value), F.lit(False))


def as_int(value: Column) -> Column:
    """A whole number of 64 bits that was written without a fraction or exponent."""
    return F.when(_tag(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def as_double(value: Column) -> Column:
    """Any number."""
    return F.when(_tag(value).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(value, "$", "double"))


def as_string(value: Column) -> Column:
    return F.when(_tag(value) == "STRING", F.try_variant_get(value, "$", "string"))


def as_bool(value: Column) -> Column:
    return F.when(_tag(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def items(value: Column) -> Column:
    """The elements of an array."""
    return F.when(_tag(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def members(value: Column) -> Column:
    """The last value of each key of an object."""
    return F.when(_tag(value) == "OBJECT", F.try_variant_get(value, "$", "map<string,variant>"))


def kind(value: Column) -> Column:
    """``null``, ``bool``, ``int``, ``double``, ``string``, ``array`` or ``object``; null where there is no value."""
    names = {"VOID": "null", "BOOLEAN": "bool", "BIGINT": "int", "DECIMAL": "double", "DOUBLE": "double", "STRING": "string", "ARRAY": "array", "OBJECT": "object"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), _tag(value))


def all_of(text: Column, path: str, key: str) -> Column:
    """Every value of a repeated ``key`` in the object at ``path`` of a document, in document order; null if there is no object.

    A parsed value keeps the last one only, so this reads the text.
    """

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for documents in batches:
            found = [json_members(d.as_py().encode(), path) if d.is_valid else None for d in documents]
            yield pa.array([None if f is None else [v for k, v in f if k == key] for f in found], pa.list_(pa.string()))

    return F.transform(F.arrow_udf(read, "array<string>").asNondeterministic()(text), F.try_parse_json)
