"""Rules: each compiles to a column that is null where a value is fine and an issue where it isn't."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import wraps

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import formats
from .functions.text import graphemes

ISSUE = "struct<code:string,path:string,params:map<string,string>,received:string>"


class SchemaError(ValueError):
    """A schema or rule that can't mean anything, found when it is declared."""


def issue(code: str | Column, path: Column, params: dict | None = None, received: Column | None = None) -> Column:
    pairs = [x for k, v in sorted((params or {}).items()) for x in (F.lit(k), v if isinstance(v, Column) else F.lit(str(v)))]
    shown = F.create_map(*pairs) if pairs else F.lit(None)
    return F.struct((code if isinstance(code, Column) else F.lit(code)).alias("code"), path.alias("path"), shown.cast("map<string,string>").alias("params"), (received.cast("string") if received is not None else F.lit(None).cast("string")).alias("received")).cast(ISSUE)


@dataclass(frozen=True)
class Rule:
    """A predicate of violation per type of value (``string``, ``number``, ``array``, ``date``), a code and parameters."""

    code: str
    violated: dict[str, Callable[[Column], Column]] = field(hash=False)
    params: tuple = ()
    message: str | None = None
    inner: tuple = ()
    each: bool = False
    hint: Callable[[Column], Column] | None = None
    made: tuple = ()

    def or_(self, message: str) -> Rule:
        """The same rule with a message of its own."""
        return replace(self, message=message)

    def check_type(self, kind: str, element: str | None) -> None:
        for rule in self.inner:
            rule.check_type(element if self.each else kind, None)
        if self.each and kind != "array" or not self.inner and kind not in self.violated:
            raise SchemaError(f"rule {self.code} doesn't apply to {kind}")

    def issues(self, value: Column, kind: str, path: Column, element: str | None = None) -> list[Column]:
        """Columns of arrays of issues; a null value has none."""
        if self.each:
            return [F.flatten(F.transform(F.coalesce(value, F.array()), lambda x, i: F.concat(*[c for r in self.inner for c in r.issues(x, element or "string", F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))])))]
        if self.inner:
            return [c for r in self.inner for c in r.issues(value, kind, path, element)]
        params = dict(self.params) | ({"message": self.message} if self.message else {}) | ({"didYouMean": self.hint(value)} if self.hint else {})
        found = issue(self.code, path, params, None if kind == "array" else value)
        return [F.when(value.isNotNull() & self.violated[kind](value), F.array(found)).otherwise(F.array().cast(f"array<{ISSUE}>"))]


def _rule(code: str, params: dict | None = None, **violated: Callable[[Column], Column]) -> Rule:
    return Rule(code, violated, tuple((params or {}).items()))


def named(builder: Callable[..., Rule]) -> Callable[..., Rule]:
    """A builder whose rules remember its name and arguments, so that a manifest can hold them."""

    @wraps(builder)
    def make(*args) -> Rule:
        return replace(builder(*args), made=(builder.__name__, args))

    return make


def _real(c: Column) -> Column:
    return ~F.isnan(c.cast("double"))


@named
def min_(n) -> Rule:
    return _rule("too_small", {"minimum": n}, string=lambda c: graphemes(c) < n, number=lambda c: c < n, array=lambda c: F.size(c) < n)


@named
def max_(n) -> Rule:
    return _rule("too_large", {"maximum": n}, string=lambda c: graphemes(c) > n, number=lambda c: (c > n) & _real(c), array=lambda c: F.size(c) > n)


@named
def range_(a, b) -> Rule:
    return _rule("not_in_range", {"minimum": a, "maximum": b}, number=lambda c: _real(c) & ~c.between(a, b))


@named
def length(n: int) -> Rule:
    return _rule("wrong_length", {"length": n}, string=lambda c: graphemes(c) != n)


not_empty = _rule("empty", string=lambda c: c == "", array=lambda c: F.size(c) == 0)


@named
def regex(pattern: str) -> Rule:
    """Some part of the text matches; a pattern that doesn't compile is an error of declaration.

    It is compiled by the engine that will run it if a session is there, else by Python's.
    """
    context = SparkContext._active_spark_context
    try:
        if context is not None and context._jvm is not None:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern.replace(r"\z", r"\Z"))
    except (re.error, Py4JJavaError, IllegalArgumentException) as e:
        raise SchemaError(f"invalid pattern {pattern!r}: {str(e).splitlines()[0]}") from e
    return _rule("pattern_mismatch", {"pattern": pattern}, string=lambda c: ~c.rlike(pattern))


email = _rule("invalid_email", string=lambda c: ~formats.is_email(c))
hostname = _rule("invalid_hostname", string=lambda c: ~formats.is_hostname(c))
url = _rule("invalid_url", string=lambda c: ~formats.is_url(c))
uuid = _rule("invalid_uuid", string=lambda c: ~formats.is_uuid(c))
ascii_ = _rule("not_ascii", string=lambda c: ~formats.is_ascii(c))
trimmed = _rule("not_trimmed", string=lambda c: ~formats.is_trimmed(c))
lowercased = _rule("not_lowercased", string=lambda c: ~formats.is_lowercased(c))


@named
def prefix(s: str) -> Rule:
    return _rule("missing_prefix", {"prefix": s}, string=lambda c: ~c.startswith(s))


@named
def suffix(s: str) -> Rule:
    return _rule("missing_suffix", {"suffix": s}, string=lambda c: ~c.endswith(s))


@named
def contains(s: str) -> Rule:
    return _rule("missing_substring", {"substring": s}, string=lambda c: ~c.contains(s))


@named
def one_of(*options) -> Rule:
    return _rule("not_one_of", {"options": ", ".join(f'"{o}"' if isinstance(o, str) else str(o) for o in options)}, string=lambda c: ~c.isin(*options), number=lambda c: ~c.isin(*options))


def nearest(value: Column, options: Sequence[str]) -> Column:
    """The first of the nearest options within one edit, or two for texts of over four bytes; a swap is one edit."""
    limit = F.when(F.octet_length(value) <= 4, 1).otherwise(2)
    swaps = {o: [s for k in range(len(o) - 1) if (s := o[:k] + o[k + 1] + o[k] + o[k + 2 :]) != o] for o in options}
    scored = [F.struct(F.when(value.isin(*swaps[o]), 1).otherwise(F.levenshtein(value, F.lit(o))).alias("d"), F.lit(k).alias("k"), F.lit(o).alias("o")) for k, o in enumerate(options)]
    best = F.array_min(F.array(*scored))
    return F.when(best["d"].between(1, limit), best["o"])


@named
def variant_of(*options: str | int) -> Rule:
    """A closed set of texts, with the nearest one as a hint, or of whole numbers."""
    rule = _rule("unknown_variant", {"options": ", ".join(map(str, options))}, string=lambda c: ~c.isin(*options), number=lambda c: ~c.isin(*options))
    return replace(rule, hint=lambda c: nearest(c, options)) if all(isinstance(o, str) for o in options) else rule


positive = _rule("not_positive", number=lambda c: ~_real(c) | ~(c > 0))
negative = _rule("not_negative", number=lambda c: ~_real(c) | ~(c < 0))
non_negative = _rule("negative", number=lambda c: c < 0)
finite = _rule("not_finite", number=lambda c: ~_real(c) | (F.abs(c.cast("double")) == float("inf")))


@named
def multiple_of(m) -> Rule:
    """The remainder is nothing or all of ``m``, within 1e-9; every value is a multiple of zero."""

    def violated(c: Column) -> Column:
        r = F.abs(F.try_mod(c.cast("double"), F.lit(float(m))))
        return F.coalesce((r > 1e-9) & (F.abs(r - abs(m)) > 1e-9), F.lit(False))

    return _rule("not_multiple", {"multipleOf": m}, number=violated)


@named
def count(a: int, b: int | None = None) -> Rule:
    b = a if b is None else b
    return _rule("wrong_count", {"minimum": a, "maximum": b}, array=lambda c: ~F.size(c).between(a, b))


unique = _rule("not_unique", array=lambda c: F.size(F.array_distinct(c)) != F.size(c))


def each(*rules: Rule) -> Rule:
    return Rule("each", {}, inner=rules, each=True)


def all_(*rules: Rule) -> Rule:
    return Rule("all", {}, inner=rules)


def _instant(iso: str) -> Column:
    try:
        at = datetime.fromisoformat(iso.replace("Z", "+00:00"))
    except ValueError as e:
        raise SchemaError(f"invalid date bound {iso!r}") from e
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return F.timestamp_seconds(F.lit(at.timestamp()))


@named
def before(iso: str) -> Rule:
    bound = iso
    _check_bounds(iso)
    return _rule("date_not_before", {"bound": bound}, date=lambda c: ~(c < _instant(iso)))


@named
def after(iso: str) -> Rule:
    _check_bounds(iso)
    return _rule("date_not_after", {"bound": iso}, date=lambda c: ~(c > _instant(iso)))


@named
def between(lo: str, hi: str) -> Rule:
    _check_bounds(lo, hi)
    return _rule("date_not_between", {"minimum": lo, "maximum": hi}, date=lambda c: ~c.between(_instant(lo), _instant(hi)))


def _check_bounds(*bounds: str) -> None:
    for b in bounds:
        try:
            datetime.fromisoformat(b.replace("Z", "+00:00"))
        except ValueError as e:
            raise SchemaError(f"invalid date bound {b!r}") from e


def flat(rules: Sequence[Rule]) -> list[Rule]:
    """Rules with conjunctions opened."""
    return [x for r in rules for x in (flat(r.inner) if r.inner and not r.each else [r])]


#: Rules without arguments, by the names under which manifests hold them.
CONSTANTS = {"not_empty": not_empty, "email": email, "hostname": hostname, "url": url, "uuid": uuid, "ascii_": ascii_, "trimmed": trimmed, "lowercased": lowercased, "positive": positive, "negative": negative, "non_negative": non_negative, "finite": finite, "unique": unique}
BUILDERS = {f.__name__: f for f in (min_, max_, range_, length, regex, prefix, suffix, contains, one_of, variant_of, multiple_of, count, before, after, between)}
