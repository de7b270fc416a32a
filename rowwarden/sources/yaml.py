"""YAML documents in a column: PyYAML makes nodes, the 1.2 core schema resolves them, JSON decoding does the rest.

PyYAML is needed on the executors only when a column is decoded; importing this module doesn't need it.
"""

from __future__ import annotations

import json as _json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Schema
from . import json

#: Nodes that a document may have once its aliases are expanded.
MAX_NODES = 1 << 20

# Spellings of null, true and false, and forms of numbers in the core schema.
_NAMED = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_INT, _OCT, _HEX = re.compile(r"[-+]?[0-9]+"), re.compile(r"0o[0-7]+"), re.compile(r"0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?")


def _scalar(text: str):
    """A plain scalar; infinities and NaN stay text, since JSON has none."""
    if text in _NAMED:
        return _NAMED[text]
    if _INT.fullmatch(text):
        return int(text)
    if _OCT.fullmatch(text) or _HEX.fullmatch(text):
        return int(text, 0)
    return float(text) if _FLOAT.fullmatch(text) else text


def _value(node, depth: int, left: list[int]):
    left[0] -= 1
    if left[0] < 0 or depth > json.MAX_DEPTH:
        raise ValueError("too many nodes or levels")
    if node.id == "scalar":
        return node.value if node.style is not None else _scalar(node.value)
    if node.id == "sequence":
        return [_value(x, depth + 1, left) for x in node.value]
    own, merged = {}, {}
    for key, value in node.value:
        if key.id != "scalar":
            raise ValueError("a key is not a scalar")
        read = _value(value, depth + 1, left)
        if key.value == "<<" and key.style is None:
            # Explicit keys win over merged ones, earlier sources over later ones.
            for source in read if isinstance(read, list) else [read]:
                if not isinstance(source, dict):
                    raise ValueError("a merged value is not a mapping")
                merged = source | merged
        else:
            own[key.value] = read
    return merged | own


def _documents(text: str | None) -> list[str] | None:
    import yaml

    if text is None:
        return None
    try:
        return [_json.dumps(_value(n, 0, [MAX_NODES]), ensure_ascii=False, allow_nan=False) for n in yaml.compose_all(text, Loader=yaml.BaseLoader)]
    except (yaml.YAMLError, ValueError, RecursionError):
        return None


def documents(text: Column) -> Column:
    """The JSON texts of all documents of a YAML stream; null if any of it can't be read."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_documents(x.as_py()) for x in texts], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def decode(df: DataFrame, schema: Schema, column: str, *, max_bytes: int = json.MAX_BYTES) -> DataFrame:
    """As :func:`json.decode` for YAML; a stream of no or several documents is malformed."""
    all_ = df.withColumn("_yaml", documents(F.when(F.octet_length(column) <= max_bytes, F.col(column))))
    one = all_.withColumn("_yaml", F.when(F.size("_yaml") == 1, F.get("_yaml", F.lit(0))))
    return json.decode(one, schema, "_yaml", max_bytes=max_bytes).drop("_yaml")


def decode_all(df: DataFrame, schema: Schema, column: str, *, max_bytes: int = json.MAX_BYTES) -> DataFrame:
    """A row for every document of every stream, with its place ``_document``; a stream that can't be read is one row."""
    all_ = df.withColumn("_yaml", documents(F.when(F.octet_length(column) <= max_bytes, F.col(column))))
    each = all_.select("*", F.posexplode_outer("_yaml").alias("_document", "_one")).drop("_yaml")
    return json.decode(each, schema, "_one", max_bytes=max_bytes).drop("_one")


def encode(text: Column) -> Column:
    """YAML of the JSON texts that :func:`operators.encode.encode_json` makes: block style, keys in order."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import yaml

        class Writer(yaml.SafeDumper):
            """Quotes what the core schema would take for something else than text."""

        Writer.add_representer(str, lambda w, s: w.represent_scalar("tag:yaml.org,2002:str", s, style=None if _scalar(s) == s else "'"))
        for texts in batches:
            yield pa.array([None if x.as_py() is None else yaml.dump(_json.loads(x.as_py()), Dumper=Writer, sort_keys=False, allow_unicode=True, width=2**31) for x in texts], pa.string())

    return F.arrow_udf(run, "string")(text)
