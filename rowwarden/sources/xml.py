"""XML documents in a column: read by the placement of the schema's fields, then decoded and coerced as JSON.

Attributes, character data and child elements are kept apart while reading. A field finds its value where it is
placed; an attribute and an element may stand in for each other, as they share the keys, and where both are there
the placement decides. Elements that repeat are arrays, or the last counts. Prefixes of namespaces don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from json import dumps
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import free_name
from ..rules import SchemaError, issue
from ..schema import ArrayOf, MapOf, Schema, opened
from . import json

_BAD, _TEXT, _MARK, _ITEM, _ENTRY = "_malformed", "#text", "@", "item", "entry"
_REPEATED = r"""<[^\s<>/!?][^<>]*?\s([^\s=<>/"']+)\s*=\s*(?:"[^"]*"|'[^']*')[^<>]*?\s\1\s*="""


def _read(type_, where: str) -> T.DataType:
    kind, inner = opened(type_)
    if kind == "schema":
        return read_type(inner)
    if kind == "array":
        return T.ArrayType(_read(inner, where))
    if kind == "map":
        return T.StructType([T.StructField(_ENTRY, T.ArrayType(T.StructType([T.StructField(f"{_MARK}key", T.StringType()), T.StructField("value", _read(inner, where))])))])
    if kind == "variant":
        raise SchemaError(f"{where}: XML has no form for variants")
    return T.StringType()


def read_type(schema: Schema) -> T.StructType:
    """All that ``schema`` may find in an element: attributes, child elements and character data, as text."""
    out = []
    for f in schema.active:
        where, kind = f"{schema.name}.{f.name}", opened(f.type)[0]
        if f.extras:
            raise SchemaError(f"{where}: unknown elements aren't read")
        made = T.StructType([T.StructField(_ITEM, _read(f.type, where))]) if f.xml == "wrapped" else _read(f.type, where)
        for k in (schema.key(f), *f.aliases):
            out += [T.StructField(k, made), *([T.StructField(f"{_MARK}{k}", T.StringType())] if kind == "scalar" else [])]
        if f.xml == "text":
            out.append(T.StructField(_TEXT, T.StringType()))
    return T.StructType(out)


def _shaped(type_, c: Column) -> Column:
    """What was read of a value, in the shape of JSON."""
    kind, inner = opened(type_)
    if kind == "schema":
        return F.when(c.isNotNull(), _fields(inner, c))
    if kind == "array":
        return F.transform(c, lambda x: _shaped(inner, x))
    if kind == "map":
        entries = c[_ENTRY]
        keys = F.array_distinct(F.filter(F.transform(entries, lambda e: e[f"{_MARK}key"]), lambda k: k.isNotNull()))
        last = lambda k: F.element_at(F.filter(entries, lambda e: e[f"{_MARK}key"] == k), -1)["value"]
        none = F.array().cast("array<string>")
        return F.when(c.isNotNull(), F.map_from_arrays(F.coalesce(keys, none), F.transform(F.coalesce(keys, none), lambda k: _shaped(inner, last(k)))))
    return c


def _fields(schema: Schema, c: Column) -> Column:
    out = []
    for f in schema.active:
        kind = opened(f.type)[0]
        for k in (schema.key(f), *f.aliases):
            if f.xml == "wrapped":
                value = F.when(c[k].isNotNull(), F.coalesce(_shaped(f.type, c[k][_ITEM]), F.from_json(F.lit("[]"), "array<string>") if opened(opened(f.type)[1])[0] == "scalar" else F.slice(_shaped(f.type, c[k][_ITEM]), 1, 0)))
            elif kind == "scalar":
                attribute, text = c[f"{_MARK}{k}"], [c[_TEXT]] if f.xml == "text" else []
                value = F.coalesce(*([attribute, c[k]] if f.xml == "attribute" else [*text, c[k], attribute]))
            else:
                value = _shaped(f.type, c[k])
            out.append(value.alias(k))
    return F.struct(*out)


def _coerced_type(type_):
    kind, inner = opened(type_)
    return _coerced(inner) if kind == "schema" else ArrayOf(_coerced_type(inner)) if kind == "array" else MapOf(_coerced_type(inner)) if kind == "map" else type_


def _holds_schema(type_) -> bool:
    kind, inner = opened(type_)
    return kind == "schema" or kind in ("array", "map") and _holds_schema(inner)


def _coerced(schema: Schema) -> Schema:
    """``schema`` with scalars converted from text, throughout."""
    fields = [replace(f, type=_coerced_type(f.type)) if _holds_schema(f.type) else f for f in schema.fields]
    return replace(schema, fields=fields, coerce=True)


def decode(df: DataFrame, schema: Schema, column: str, *, max_bytes: int = json.MAX_BYTES) -> DataFrame:
    """As :func:`json.decode` for XML; the name of the root element is free.

    A text that isn't well formed, is too long, holds a document type, or goes on after its root, is malformed; one
    that repeats an attribute has a ``duplicate_key``. Items of wrapped arrays are ``item`` elements, those of maps
    ``entry`` elements with a key and a value, as they are written. An empty wrapper is an empty array, an absent one
    is absent. Unknown elements are never seen, so the policy for unknown keys has no effect.
    """
    text = F.col(column)
    root = F.regexp_extract(text, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<([^\s/>!?]+)", 1)
    closed = F.regexp_extract(text, r"(?s)</([^\s>]+)\s*>\s*(?:<!--(?:(?!-->).)*-->\s*)*\z", 1)
    alone = text.rlike(r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<[^<>]*/>\s*\z")
    repeated = F.regexp_extract(text, _REPEATED, 1)
    ok = (F.octet_length(text) <= max_bytes) & ((closed == root) & (root != "") | alone) & ~F.contains(text, F.lit("<!DOCTYPE")) & (repeated == "")
    kind = T.StructType([*read_type(schema).fields, T.StructField(_BAD, T.StringType())])
    options = {"attributePrefix": _MARK, "valueTag": _TEXT, "ignoreNamespace": "true", "columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE", "inferSchema": "false"}
    raw, whole = free_name(df, "_raw"), free_name(df, "_xml")
    read = df.withColumn(raw, F.from_xml(F.when(ok, text), kind.json(), options))
    read = read.withColumn(whole, F.when(F.col(raw).isNotNull() & F.col(f"{raw}.{_BAD}").isNull(), F.to_json(_fields(schema, F.col(raw)))))
    decoded = json.decode(read.drop(raw), _coerced(schema), whole, max_bytes=max_bytes).drop(whole)
    again = F.array(issue("duplicate_key", F.lit(""), None, repeated))
    return decoded.withColumn("_issues", F.when(F.coalesce(repeated != "", F.lit(False)) & F.exists("_issues", lambda i: i["code"] == "malformed_document"), again).otherwise(F.col("_issues")))


def projected(element: ElementTree.Element, depth: int) -> str | dict:
    """An element without attributes and children is its text; any other has members by name, repeated ones as a list."""
    if depth < 0:
        raise RecursionError
    if not element.attrib and not len(element):
        return element.text or ""
    out: dict[str, list] = {}
    for k, v in element.attrib.items():
        out.setdefault(k.rpartition("}")[2], []).append(v)
    for text, child in [(element.text, None), *((c.tail, c) for c in element)]:
        if child is not None:
            out.setdefault(child.tag.rpartition("}")[2], []).append(projected(child, depth - 1))
        if text and text.strip():
            out.setdefault("", []).append(text)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def project(df: DataFrame, column: str, *, into: str = "value", max_depth: int = json.MAX_DEPTH) -> DataFrame:
    """``df`` with each document as a VARIANT, without a schema, as :func:`projected`: attributes and children share the keys,
    character data beside them is under an empty key, and every scalar is a text, whatever it looks like.

    A text that isn't well formed, holds a document type, or is nested too deeply, is null.
    """

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for documents in batches:
            out = []
            for d in documents.to_pylist():
                try:
                    out.append(None if d is None or "<!DOCTYPE" in d else dumps(projected(ElementTree.fromstring(d.encode()), max_depth), ensure_ascii=False))
                except (ElementTree.ParseError, RecursionError, ValueError):
                    out.append(None)
            yield pa.array(out, pa.string())

    return df.withColumn(into, F.try_parse_json(F.arrow_udf(read, "string").asNondeterministic()(F.col(column))))
