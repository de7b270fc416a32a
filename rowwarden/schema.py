"""Schemas: declared fields, checked when they are declared, compiled to columns by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

from .functions.text import KEY_STYLES, PREPROCESS
from .rules import Rule, SchemaError, variant_of

REQUIRED = object()

#: Names of scalar types, their Spark types, and the kind of rule that applies.
SCALARS: dict[str, tuple[T.DataType, str]] = {
    "string": (T.StringType(), "string"), "long": (T.LongType(), "number"), "int": (T.IntegerType(), "number"), "double": (T.DoubleType(), "number"),
    "float": (T.FloatType(), "number"), "boolean": (T.BooleanType(), "boolean"), "timestamp": (T.TimestampType(), "date"),
}


@dataclass(frozen=True)
class ArrayOf:
    """An array whose elements have a type that a name can't say, such as a Schema."""

    of: Any


@dataclass(frozen=True)
class MapOf:
    """A map from strings to such a type."""

    of: Any


def opened(type_: Any) -> tuple[str, Any]:
    """``("array" | "map", type within)`` or ``("schema" | "variant" | "scalar", type)``."""
    if isinstance(type_, Schema):
        return "schema", type_
    if isinstance(type_, ArrayOf):
        return "array", type_.of
    if isinstance(type_, MapOf):
        return "map", type_.of
    if isinstance(type_, str):
        name = type_.replace(" ", "")
        if name.startswith("array<") and name.endswith(">"):
            return "array", name[6:-1]
        if name.startswith("map<string,") and name.endswith(">"):
            return "map", name[11:-1]
        if name == "variant":
            return "variant", name
        if name in SCALARS:
            return "scalar", name
    raise SchemaError(f"unknown type {type_!r}; types are scalar names, array<...>, map<string,...>, variant, ArrayOf, MapOf and Schema")


def spark_type_of(type_: Any) -> T.DataType:
    kind, inner = opened(type_)
    if kind == "schema":
        return inner.to_struct_type()
    if kind == "array":
        return T.ArrayType(spark_type_of(inner))
    if kind == "map":
        return T.MapType(T.StringType(), spark_type_of(inner))
    return T.VariantType() if kind == "variant" else SCALARS[inner][0]


def type_name(type_: Any) -> str:
    kind, inner = opened(type_)
    if kind in ("array", "map"):
        return f"array<{type_name(inner)}>" if kind == "array" else f"map<string,{type_name(inner)}>"
    return inner.name if kind == "schema" else inner


@dataclass(frozen=True)
class Field:
    """One field: its type is a scalar name, ``array<...>``, ``map<string,...>``, ``variant``, a nested Schema, or ArrayOf
    or MapOf any of these.

    ``cases`` are the texts of an enum, or the whole numbers of a closed one. A closed one reports others; an ``open`` one keeps them, and encoding
    refuses them unless it is ``round_trips``.

    An ``ignore`` field is never read; with a ``default`` decoding produces that. ``default`` stands in for absence and is then validated; ``fallback`` replaces whatever is wrong, with a
    warning. ``dates`` are parsers in the order they are tried. ``transform`` runs after the rules; encoding
    such a field needs ``inverse``. ``xml`` places a field in encoded XML: an ``element`` (an array repeats it), an
    ``attribute``, the ``text`` of its element, or an array ``wrapped`` in one element.
    """

    name: str
    type: Any
    rules: Sequence[Rule] = ()
    optional: bool = False
    default: Any = REQUIRED
    fallback: Any = REQUIRED
    key: str | None = None
    aliases: Sequence[str] = ()
    coerce: bool = False
    preprocess: Sequence[str] = ()
    dates: Sequence[Callable[[Column], Column]] = ()
    transform: Callable[[Column], Column] | None = None
    inverse: Callable[[Column], Column] | None = None
    ignore: bool = False
    extras: bool = False
    cases: Sequence[str | int] = ()
    enum: str = "closed"
    xml: str = "element"

    @property
    def checked(self) -> list[Rule]:
        """The rules, and that of a closed enum."""
        return [*self.rules, *([variant_of(*self.cases)] if self.cases and self.enum == "closed" else [])]

    @property
    def element(self) -> str | None:
        kind, inner = opened(self.type)
        return inner if kind == "array" and isinstance(inner, str) and inner in SCALARS else None

    @property
    def kind(self) -> str:
        kind, inner = opened(self.type)
        return "struct" if kind == "schema" else SCALARS[inner][1] if kind == "scalar" else kind

    @property
    def required(self) -> bool:
        return not self.optional and self.default is REQUIRED and self.fallback is REQUIRED

    def spark_type(self) -> T.DataType:
        return spark_type_of(self.type)


@dataclass(frozen=True)
class Check:
    """A check of the whole row: ``test`` gives a message or null, reported at ``field``."""

    field: str
    test: Callable[[dict[str, Column]], Column]
    code: str | None = None


@dataclass(frozen=True)
class Schema:
    """Fields in order, with the style of keys, the policy for unknown keys, and checks."""

    name: str
    fields: Sequence[Field]
    keys: str = "camel"
    unknown: str = "ignore"
    checks: Sequence[Check] = field(default=())
    coerce: bool = False

    def __post_init__(self) -> None:
        if self.keys not in KEY_STYLES or self.unknown not in ("ignore", "warn", "reject", "collect"):
            raise SchemaError(f"{self.name}: unknown key style or policy")
        if len([f for f in self.fields if f.xml == "text"]) > 1:
            raise SchemaError(f"{self.name}: more than one field is the text of its XML element")
        if len(self.active) > 64:
            raise SchemaError(f"{self.name}: more than 64 fields")
        seen: set[str] = set()
        for f in self.fields:
            self._check(f)
            for k in [] if f.ignore or f.extras else [self.key(f), *f.aliases]:
                if k in seen:
                    raise SchemaError(f"{self.name}: key {k!r} is declared twice")
                seen.add(k)
        extras = [f for f in self.fields if f.extras]
        if len(extras) > 1 or self.unknown == "collect" and not extras:
            raise SchemaError(f"{self.name}: collecting unknown keys needs exactly one extras field")
        names = {f.name for f in self.fields}
        for c in self.checks:
            if c.field not in names:
                raise SchemaError(f"{self.name}: check of an undeclared field {c.field!r}")

    def _check(self, f: Field) -> None:
        where = f"{self.name}.{f.name}"
        try:
            opened(f.type)
            spark_type_of(f.type)
        except SchemaError as e:
            raise SchemaError(f"{where}: {e}") from e
        if f.enum not in ("closed", "open", "round_trips") or not all(isinstance(c, str if f.type == "string" else int) for c in f.cases) or f.cases and f.type not in ("string", "long", "int"):
            raise SchemaError(f"{where}: cases are those of strings or whole numbers, in an enum that is closed, open or round_trips")
        if f.cases and f.type != "string" and f.enum != "closed":
            raise SchemaError(f"{where}: an enum of numbers is closed")
        kind = opened(f.type)[0]
        if f.xml not in ("element", "attribute", "text", "wrapped") or f.xml in ("attribute", "text") and kind != "scalar" or f.xml == "wrapped" and kind != "array":
            raise SchemaError(f"{where}: XML attributes and text are scalars, wrapped fields are arrays")
        for r in f.rules:
            r.check_type(f.kind, SCALARS[f.element][1] if f.element in SCALARS else None)
        if bad := [p for p in f.preprocess if p not in PREPROCESS]:
            raise SchemaError(f"{where}: unknown preprocessing {bad}")
        if f.preprocess and f.type != "string":
            raise SchemaError(f"{where}: preprocessing is for strings")
        if f.dates and f.type != "timestamp" and f.element != "timestamp":
            raise SchemaError(f"{where}: date formats are for timestamps")
        if f.inverse and not f.transform:
            raise SchemaError(f"{where}: an inverse needs a transform")
        if f.extras and not (isinstance(f.type, str) and f.type.replace(" ", "") == "map<string,variant>"):
            raise SchemaError(f"{where}: extras are a map<string,variant>")

    @property
    def active(self) -> list[Field]:
        return [f for f in self.fields if not f.ignore]

    def key(self, f: Field) -> str:
        return f.key or KEY_STYLES[self.keys](f.name)

    def known_keys(self) -> list[str]:
        return [k for f in self.active if not f.extras for k in (self.key(f), *f.aliases)]

    def to_struct_type(self) -> T.StructType:
        """The manifest of the schema: its fields with their keys and presence in the metadata."""
        return T.StructType([T.StructField(f.name, f.spark_type(), not f.required, {"key": self.key(f), "required": f.required, "default": f.default is not REQUIRED}) for f in self.fields])

