"""Binding of a table's columns to a schema, once, before any job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PREPROCESS
from ..operators.validate import _none, rule_issues
from ..rules import SchemaError, issue
from ..schema import REQUIRED, SCALARS, Schema


@dataclass(frozen=True)
class BoundPlan:
    """Position of each field's column, -1 where it is absent; the first of equal names counts."""

    schema: Schema
    positions: dict[str, int]

    @property
    def missing_required(self) -> list[str]:
        return [self.schema.key(f) for f in self.schema.active if f.required and self.positions[f.name] < 0]


def bind(df: DataFrame, schema: Schema) -> BoundPlan:
    for f in schema.active:
        if f.type not in SCALARS:
            raise SchemaError(f"{schema.name}.{f.name}: tables bind scalar fields only")
    first: dict[str, int] = {}
    for k, name in enumerate(df.columns):
        first.setdefault(name, k)
    return BoundPlan(schema, {f.name: next((first[k] for k in (schema.key(f), *f.aliases) if k in first), -1) for f in schema.active})


def _narrowed(raw: Column, kind: T.DataType, source: T.DataType | None) -> Column:
    """``raw`` in another type where that keeps its value; text isn't taken for numbers, nor the other way round."""
    if source is None or source == kind:
        return raw.cast(kind)
    number = lambda t: isinstance(t, (T.NumericType,))
    if number(source) != number(kind) or isinstance(source, T.StringType) != isinstance(kind, T.StringType) or isinstance(source, T.BooleanType) != isinstance(kind, T.BooleanType):
        return F.lit(None).cast(kind)
    return F.when(F.coalesce(raw.try_cast(kind).cast(source) == raw, F.lit(False)), raw.try_cast(kind))


def missing_values(df: DataFrame, schema: Schema, *keep: str) -> DataFrame:
    """A ``missing`` issue at ``[key].field`` for every required value that a row lacks or that doesn't narrow exactly.

    These are the rows that :func:`batch` leaves out; ``keep`` names the columns that tell them apart.
    """
    plan = bind(df, schema)
    label = F.concat_ws(",", *[F.col(k).cast("string") for k in keep])
    found = []
    for f in schema.active:
        if f.required and (at := plan.positions[f.name]) >= 0:
            value = _narrowed(F.col(df.columns[at]), f.spark_type(), df.schema[at].dataType)
            found.append(F.when(value.isNull(), F.array(issue("missing", F.concat(F.lit("["), label, F.lit("]."), F.lit(schema.key(f)))))).otherwise(_none()))
    return df.select(*keep, F.explode(F.concat(*found) if found else _none()).alias("issue")).select(*keep, "issue.*")


def batch(df: DataFrame, schema: Schema, *keep: str) -> tuple[DataFrame, list[dict]]:
    """Typed values with ``_issues`` and ``_warnings``, and one ``missing_column`` per absent required column.

    Texts are preprocessed first; transforms come last, after the rules. With a missing column there are no values. A null takes the default; a value that doesn't narrow exactly reads
    as missing. Rows that lack a required value go; rows that break rules stay, with their issues.
    """
    plan = bind(df, schema)
    if plan.missing_required:
        kinds = {schema.key(f): f.type for f in schema.active}
        return df.limit(0), [{"code": "missing_column", "path": k, "params": {"expected": kinds[k]}} for k in plan.missing_required]
    unique = df.toDF(*[f"_{k}" for k in range(len(df.columns))])
    out, found, warned, present = [F.col(f"_{df.columns.index(k)}").alias(k) for k in keep], [], [], F.lit(True)
    for f in schema.active:
        at = plan.positions[f.name]
        kind = f.spark_type()
        raw: Column = F.col(f"_{at}") if at >= 0 else F.lit(None).cast(kind)
        value = _narrowed(raw, kind, df.schema[at].dataType if at >= 0 else None)
        for step in f.preprocess:
            value = PREPROCESS[step](value)
        if f.default is not REQUIRED:
            value = F.when(raw.isNull(), F.lit(f.default).cast(kind)).otherwise(value)
        bad = rule_issues(f, value, F.lit(schema.key(f)))
        if f.fallback is not REQUIRED:
            use = value.isNull() | (F.size(bad) > 0)
            warned.append(F.when(use, F.array(issue("fallback_applied", F.lit(schema.key(f))))).otherwise(_none()))
            value = F.when(use, F.lit(f.fallback).cast(kind)).otherwise(value)
        else:
            found.append(bad)
        if f.required:
            present = present & value.isNotNull()
        out.append((f.transform(value) if f.transform else value).alias(f.name))
    every = F.concat(*found) if found else _none()
    return unique.where(present).select(*out, every.alias("_issues"), (F.concat(*warned) if warned else _none()).alias("_warnings")), []
