"""Validation of rows: issues as a column, as a table, or as a split into good and quarantined rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..rules import ISSUE, issue
from ..schema import REQUIRED, SCALARS, Field, Schema, opened

EMPTY = f"array<{ISSUE}>"


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def _none() -> Column:
    return F.array().cast(EMPTY)


def rule_issues(f: Field, value: Column, path: Column) -> Column:
    """Issues of one field: an array per field, so that wide schemas stay within generated code."""
    element = SCALARS[f.element][1] if f.element in SCALARS else None
    found = [c for r in f.checked for c in r.issues(value, f.kind, path, element)]
    return F.concat(*found) if found else _none()


def joined(prefix: Column | None, key: str) -> Column:
    """The path of a field below ``prefix``."""
    return F.lit(key) if prefix is None else F.concat(prefix, F.lit(f".{key}"))


def at_index(path: Column, k: Column) -> Column:
    return F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))


def holds_schema(type_) -> bool:
    """Whether a type is or holds a schema, at any depth."""
    kind, inner = opened(type_)
    return kind == "schema" or kind in ("array", "map") and holds_schema(inner)


def check_issues(schema: Schema, values: dict[str, Column], prefix: Column | None = None) -> list[Column]:
    by_name = {f.name: f for f in schema.fields}
    out = []
    for c in schema.checks:
        message = c.test(values)
        found = F.struct((F.lit(c.code) if c.code else message).alias("code"), joined(prefix, schema.key(by_name[c.field])).alias("path"), F.create_map(F.lit("message"), message).alias("params"), F.lit(None).cast("string").alias("received"))
        out.append(F.when(message.isNotNull(), F.array(found.cast(ISSUE))).otherwise(_none()))
    return out


def checked(schema: Schema, values: dict[str, Column], prefix: Column | None = None) -> list[Column]:
    """Issues of the checks of ``schema``, for values that have all required fields."""
    found = check_issues(schema, values, prefix)
    present = reduce(lambda a, f: a & values[f.name].isNotNull() if f.required else a, schema.active, F.lit(True))
    return [F.when(present, F.concat(*found)).otherwise(_none())] if found else []


def _within(type_, c: Column, path: Column) -> Column:
    """Issues of the schemas that a value is or holds."""
    kind, inner = opened(type_)
    if kind == "schema":
        return F.when(c.isNotNull(), F.concat(_none(), *_nested(inner, lambda n: c[n], path))).otherwise(_none())
    if kind == "array":
        each = lambda x, k: F.when(x.isNull(), F.array(issue("missing", at_index(path, k)))).otherwise(_within(inner, x, at_index(path, k)))
        return F.coalesce(F.flatten(F.transform(c, each)), _none())
    at = lambda e: F.concat(path, F.lit("."), e["key"])
    each = lambda e: F.when(e["value"].isNull(), F.array(issue("missing", at(e)))).otherwise(_within(inner, e["value"], at(e)))
    return F.coalesce(F.flatten(F.transform(F.map_entries(c), each)), _none())


def _nested(schema: Schema, value, prefix: Column | None) -> list[Column]:
    """Issues of the rules of all fields, of the schemas within them, and of the checks."""
    out = []
    for f in schema.active:
        c, path = value(f.name), joined(prefix, schema.key(f))
        if f.fallback is REQUIRED and f.transform is None:
            if f.checked:
                out.append(rule_issues(f, c, path))
            if holds_schema(f.type):
                out.append(_within(f.type, c, path))
        if f.required:
            out.append(F.when(c.isNull(), F.array(issue("missing", path))).otherwise(_none()))
    return out + checked(schema, {f.name: value(f.name) for f in schema.active}, prefix)


def annotate(df: DataFrame, schema: Schema, *, into: str = "_issues", path: Column | None = None, max_issues: int = 100) -> DataFrame:
    """``df`` with an array of at most ``max_issues`` issues per row, and ``<into>_truncated``.

    Rules run on every field but those with a fallback or a transform, and on the fields of schemas within structs,
    arrays and maps; checks run where all required fields are there. A null that is optional has no issues, a null
    element of an array or map of schemas is missing. Only columns and built-in functions: nothing is shuffled or leaves the JVM.
    """
    found = _nested(schema, F.col, path)
    every = F.concat(*found) if found else _none()
    return df.withColumn(into, every).withColumn(f"{into}_truncated", F.size(into) > max_issues).withColumn(into, F.slice(into, 1, max_issues))


def issues(df: DataFrame, schema: Schema, *keys: str, **options) -> DataFrame:
    """One row per issue with ``keys``, its place in the row, its fields, and whether its row had more issues than are kept."""
    return annotate(df, schema, **options).select(*keys, "_issues_truncated", F.posexplode("_issues").alias("seq", "issue")).select(*keys, "seq", "issue.*", F.col("_issues_truncated").alias("truncated"))


def split(df: DataFrame, schema: Schema, **options) -> tuple[DataFrame, DataFrame]:
    """Good rows as they were, and quarantined rows with their issues."""
    marked = annotate(df, schema, **options)
    return marked.where(F.size("_issues") == 0).drop("_issues", "_issues_truncated"), marked.where(F.size("_issues") > 0)


def capped(found: DataFrame, *order: str, max_issues: int = 100) -> tuple[DataFrame, bool]:
    """The first issues of a whole batch, and whether there were more."""
    return found.orderBy(*order, "seq").limit(max_issues), found.limit(max_issues + 1).count() > max_issues


@dataclass(frozen=True)
class Batch:
    """The first issues and the first warnings of a batch in order of its rows, and how many there are in all."""

    issues: list
    warnings: list
    n_issues: int
    n_warnings: int
    n_rows: int
    n_failed: int

    @property
    def issues_truncated(self) -> bool:
        return self.n_issues > len(self.issues)

    @property
    def warnings_truncated(self) -> bool:
        return self.n_warnings > len(self.warnings)


def collect_batch(df: DataFrame, *order: str, issues: str = "_issues", warnings: str | None = None, max_issues: int = 100, max_warnings: int = 100) -> Batch:
    """Issues of a batch of rows with an ``issues`` column, in order of the columns ``order``, each kind up to its own limit.

    One pass: rows are counted as they go by, and of each task only its first ``max_issues`` rows with issues, and
    ``max_warnings`` with warnings, meet those of the others; nothing is sorted as a whole. Rows that are equal in ``order``
    come in order of their issues.
    """
    seen = Observation()
    warned = F.col(warnings) if warnings else F.array().cast(EMPTY)
    count = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    slim = df.select(*order, F.col(issues).alias("_i"), warned.alias("_w"))
    slim = slim.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.when(F.size("_i") > 0, 1).otherwise(0)), F.lit(0)).alias("failed"), count("_i").alias("issues"), count("_w").alias("warnings"))
    kinds = F.array(F.struct(F.lit("issue").alias("kind"), F.lit(max_issues).alias("most"), F.slice("_i", 1, max(1, max_issues)).alias("found")), F.struct(F.lit("warning").alias("kind"), F.lit(max_warnings).alias("most"), F.slice("_w", 1, max(1, max_warnings)).alias("found")))
    each = slim.select(*order, F.explode(kinds).alias("k")).select(*order, "k.*").where(F.size("found") > 0)
    first = Window.partitionBy("kind").orderBy(*order, F.to_json("found"))
    kept = each.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max(max_issues, max_warnings, 1))
    # Of few rows now: those that begin below the limit of their kind.
    before = F.sum(F.size("found")).over(Window.partitionBy("kind").orderBy("_n")) - F.size("found")
    kept = kept.withColumn("_before", before).where(F.col("_before") < F.col("most"))
    rows = kept.select("kind", "most", "_n", *order, F.posexplode("found").alias("seq", "issue")).select("kind", "most", "_n", *order, "seq", "issue.*").collect()
    drop = {"kind", "most", "_n"}
    picked = {kind: [{k: v for k, v in r.asDict(True).items() if k not in drop} for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: (r["_n"], r["seq"]))][:most] for kind, most in (("issue", max_issues), ("warning", max_warnings))}
    total = seen.get
    return Batch(picked["issue"], picked["warning"], total["issues"], total["warnings"], total["rows"], total["failed"])


class InvalidRows(ValueError):
    """Rows broke the schema; ``issues`` holds the first of what was found."""

    def __init__(self, found: list):
        super().__init__(f"{len(found)} issues or more, the first: {found[0]}")
        self.issues = found


def assert_valid(df: DataFrame, schema: Schema, *keys: str, max_issues: int = 100) -> None:
    if found := issues(df, schema, *keys).limit(max_issues).collect():
        raise InvalidRows(found)


def lookup_check(clean: DataFrame, other: DataFrame, on: Column, *, taken: bool, code: str, path: str) -> DataFrame:
    """Issues of rows that must not (``taken``) or must have a partner in another table; a semi or anti join."""
    return clean.join(other, on, "left_semi" if taken else "left_anti").withColumn("issue", issue(code, F.lit(path)))


def counts(found: DataFrame) -> DataFrame:
    """Issues by path and code."""
    return found.groupBy("path", "code").agg(F.count(F.lit(1)).alias("n"))
