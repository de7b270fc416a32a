"""Schemas as data: written to JSON with their rules and read back, carried by a table, and compared."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from .functions import dates
from .rules import BUILDERS, CONSTANTS, Rule, SchemaError, all_, each
from .schema import REQUIRED, ArrayOf, Field, MapOf, Schema, opened

VERSION = 1
_DATES = {f.__name__: f for f in (dates.iso8601, dates.unix_seconds, dates.unix_millis, dates.http_date)}
_PLAIN = ("optional", "key", "coerce", "ignore", "extras", "enum", "xml")
_LISTS = ("aliases", "preprocess", "cases")
_EMPTY = Field("", "string")


def _rule(r: Rule) -> dict:
    if r.each or r.inner:
        out: dict[str, Any] = {"rule": "each" if r.each else "all", "inner": [_rule(x) for x in r.inner]}
    elif r.made:
        out = {"rule": r.made[0], "args": list(r.made[1])}
    elif name := next((n for n, c in CONSTANTS.items() if c.code == r.code), None):
        out = {"rule": name}
    else:
        raise SchemaError(f"rule {r.code} isn't one that a manifest can hold")
    return out | ({"message": r.message} if r.message else {})


def _read_rule(x: dict) -> Rule:
    if x["rule"] in ("each", "all"):
        made = (each if x["rule"] == "each" else all_)(*map(_read_rule, x["inner"]))
    elif x["rule"] in CONSTANTS:
        made = CONSTANTS[x["rule"]]
    elif x["rule"] in BUILDERS:
        made = BUILDERS[x["rule"]](*x.get("args", ()))
    else:
        raise SchemaError(f"unknown rule {x['rule']!r}")
    return made.or_(x["message"]) if "message" in x else made


def _type(type_: Any) -> Any:
    kind, inner = opened(type_)
    return {kind: _type(inner)} if kind in ("array", "map") else {"schema": encode(inner)} if kind == "schema" else inner


def _read_type(x: Any) -> Any:
    if isinstance(x, str):
        return x
    (kind, inner), = x.items()
    if kind == "schema":
        return decode(inner)
    of = _read_type(inner)
    if isinstance(of, str):
        return f"array<{of}>" if kind == "array" else f"map<string,{of}>"
    return (ArrayOf if kind == "array" else MapOf)(of)


def _date(parser) -> str:
    if hasattr(parser, "format"):
        return f"pattern:{parser.format}"
    if _DATES.get(parser.__name__) is not parser:
        raise SchemaError("a date parser of one's own can't be in a manifest")
    return parser.__name__


def _read_date(name: str):
    return dates.pattern(name.removeprefix("pattern:")) if name.startswith("pattern:") else _DATES[name]


def _field(f: Field) -> dict:
    out = {"name": f.name, "type": _type(f.type)}
    out |= {k: getattr(f, k) for k in _PLAIN if getattr(f, k) != getattr(_EMPTY, k)} | {k: list(getattr(f, k)) for k in _LISTS if getattr(f, k)}
    out |= {k: getattr(f, k) for k in ("default", "fallback") if getattr(f, k) is not REQUIRED}
    if f.rules:
        out["rules"] = [_rule(r) for r in f.rules]
    if f.dates:
        out["dates"] = [_date(d) for d in f.dates]
    return out | {k: True for k in ("transform", "inverse") if getattr(f, k) is not None}


def _read_field(x: dict, code: dict) -> Field:
    plain = {k: x[k] for k in (*_PLAIN, "default", "fallback") if k in x} | {k: tuple(x[k]) for k in _LISTS if k in x}
    for k in ("transform", "inverse"):
        if x.get(k):
            if (x["name"], k) not in code:
                raise SchemaError(f"{x['name']}: its {k} is code and has to be given")
            plain[k] = code[x["name"], k]
    return Field(x["name"], _read_type(x["type"]), tuple(_read_rule(r) for r in x.get("rules", ())), dates=tuple(_read_date(d) for d in x.get("dates", ())), **plain)


def encode(schema: Schema) -> dict:
    """``schema`` as plain data: fields in order with types, keys, presence, defaults and rules.

    Functions aren't data: transforms and inverses are only named, and checks are left out but for their number.
    """
    out = {"version": VERSION, "name": schema.name, "keys": schema.keys, "unknown": schema.unknown, "coerce": schema.coerce, "fields": [_field(f) for f in schema.fields]}
    return out | ({"checks": len(schema.checks)} if schema.checks else {})


def decode(data: dict, *, checks: tuple = (), code: dict | None = None) -> Schema:
    """The schema that was encoded; ``checks``, and ``code`` by name of field and ``"transform"`` or ``"inverse"``, are what data can't hold."""
    if data.get("version") != VERSION:
        raise SchemaError(f"manifest of version {data.get('version')!r}")
    if data.get("checks", 0) != len(checks):
        raise SchemaError(f"{data['name']}: its {data.get('checks', 0)} checks are code and have to be given")
    return Schema(data["name"], [_read_field(f, code or {}) for f in data["fields"]], data["keys"], data["unknown"], checks, data["coerce"])


def dumps(schema: Schema) -> str:
    return json.dumps(encode(schema), ensure_ascii=False, sort_keys=True)


def loads(text: str, **code) -> Schema:
    return decode(json.loads(text), **code)


def attach(df: DataFrame, schema: Schema) -> DataFrame:
    """``df`` whose columns carry the contract of their field in their metadata, which Parquet and Delta keep."""
    whole = encode(schema)
    head = {k: v for k, v in whole.items() if k != "fields"}
    for f, data in zip(schema.fields, whole["fields"], strict=True):
        if (key := schema.key(f)) in df.columns:
            df = df.withMetadata(key, {**df.schema[key].metadata, "contract": json.dumps(head | {"fields": [data]}, ensure_ascii=False)})
    return df


def attached(df: DataFrame, **code) -> Schema | None:
    """The schema whose fields the columns of ``df`` carry, in their order; null if none does."""
    found = [json.loads(f.metadata["contract"]) for f in df.schema if "contract" in f.metadata]
    return decode(found[0] | {"fields": [x for c in found for x in c["fields"]]}, **code) if found else None


def changes(old: Schema, new: Schema) -> list[tuple[str, str, Any, Any]]:
    """What differs between two versions: path of the field (empty for the schema), what of it, before and after."""
    return list(_changes(encode(old), encode(new), ""))


def _changes(a: dict, b: dict, path: str):
    for k in sorted({*a, *b} - {"fields", "version"}):
        if a.get(k) != b.get(k):
            nested = isinstance(a.get(k), dict) and isinstance(b.get(k), dict) and k == "type"
            inner = [x for x in (a.get(k), b.get(k)) if isinstance(x, dict) and "schema" in x]
            if nested and len(inner) == 2:
                yield from _changes(a[k]["schema"], b[k]["schema"], path)
            else:
                yield path, k, a.get(k), b.get(k)
    before, after = ({f["name"]: f for f in x.get("fields", ())} for x in (a, b))
    for name in [*before, *(n for n in after if n not in before)]:
        at = f"{path}.{name}" if path else name
        if name not in after or name not in before:
            yield at, "removed" if name not in after else "added", before.get(name), after.get(name)
        else:
            yield from _changes(before[name], after[name], at)
