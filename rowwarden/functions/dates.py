"""Dates from text as epoch seconds in a double: arithmetic only, null where the text doesn't match."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_ISO = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(\.\d+)?(?:[Zz]|([+-])(\d{2}):?(\d{2})?)\z"
#: The same with an offset that exists.
_ZONED = _ISO.replace(r"([+-])(\d{2}):?(\d{2})?", r"[+-](?:[01]\d|2[0-3]):?(?:[0-5]\d)?")


def _int(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def _seconds(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Epoch seconds of a civil time in UTC; second 60 carries. Null for days and times that don't exist.

    Each part is written once: parts are expressions of the text, and a calendar that names them again and again
    would evaluate them as often.
    """
    return F.unix_seconds(F.try_make_timestamp(y, mo, d, h, mi, s, F.lit("UTC")))


def iso8601(c: Column) -> Column:
    """Time and offset are mandatory; lower-case t and z, second 60, ``+05:`` and ``-0800`` pass.

    One match tells the shape; up to the seconds all parts stand at fixed places.
    """
    part = lambda at, n: _int(F.substring(c, at, n))
    at = _seconds(part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), part(18, 2))
    # An offset of hours and minutes as one number, 530 for +05:30: 36 times it and 24 times its minutes are its seconds.
    zone = F.rpad(F.translate(F.regexp_extract(c, r"[+-]\d{2}:?(?:\d{2})?\z", 0), ":", ""), 5, "0").try_cast("int")
    offset = F.when(F.endswith(c, F.lit("Z")) | F.endswith(c, F.lit("z")), 0).otherwise(zone * 36 + zone % 100 * 24)
    fraction = F.when(F.substring(c, 20, 1) == ".", F.concat(F.lit("0"), F.regexp_extract(c, r"\.\d+", 0)).try_cast("double")).otherwise(0.0)
    return F.when(c.rlike(_ZONED), (at - offset).cast("double") + fraction)


#: What stands at each place of an ISO 8601 time, for the reason why one can't be read.
_PLACES = [("a year of 4 digits", r"\d", 4), ("-", "-", 1), ("a month of 2 digits", r"\d", 2), ("-", "-", 1), ("a day of 2 digits", r"\d", 2), ("T", "[Tt ]", 1), ("an hour of 2 digits", r"\d", 2), (":", ":", 1), ("a minute of 2 digits", r"\d", 2), (":", ":", 1), ("a second of 2 digits", r"\d", 2)]


def iso_stop(c: Column) -> tuple[Column, Column]:
    """Where and why reading a time as ISO 8601 stops: a place in characters from 0, and a reason; null for one that can be read."""
    pieces = [p for _, p, n in _PLACES for _ in range(n)]
    nested = r"(?:(?:\.\d+)?(?:[Zz]|[+-](?:\d(?:\d:?)?)?)?)?"
    for piece in reversed(pieces):
        nested = f"(?:{piece}{nested})?"
    at = F.length(F.regexp_extract(c, f"^{nested}", 0))
    begins, wanted, k = [], [], 0
    for name, _, n in _PLACES:
        begins.append(k)
        wanted.append(name)
        k += n
    shape = F.lit("expected a zone")
    for begin, name in zip(begins, wanted, strict=True):
        end = begin + next(n for (b, (_, _, n)) in zip(begins, _PLACES, strict=True) if b == begin)
        shape = F.when(at.between(begin, end - 1), f"expected {name}").otherwise(shape)
    part = lambda p, n: F.substring(c, p, n)
    limits = [(5, "month", part(6, 2), ~_int(part(6, 2)).between(1, 12)), (8, "day", part(9, 2), F.lit(True)), (11, "hour", part(12, 2), _int(part(12, 2)) > 23), (14, "minute", part(15, 2), _int(part(15, 2)) > 59), (17, "second", part(18, 2), _int(part(18, 2)) > 60)]
    no_day = F.try_make_timestamp(_int(part(1, 4)), _int(part(6, 2)), _int(part(9, 2)), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")).isNull()
    place, why = F.lit(20), F.lit("the zone is out of range")
    for p, name, text, wrong in reversed(limits):
        test = no_day if name == "day" else wrong
        place = F.when(test, p).otherwise(place)
        why = F.when(test, F.concat(F.lit(f"{name} "), text, F.lit(" is out of range"), *([F.lit(" for "), part(1, 7)] if name == "day" else []))).otherwise(why)
    bad = iso8601(c).isNull() & c.isNotNull()
    after = c.rlike(_ISO[:-2])  # the shape is whole, and more follows
    return F.when(bad, F.when(c.rlike(_ISO), place).otherwise(at)), F.when(bad, F.when(c.rlike(_ISO), why).when(after, "expected the end").otherwise(shape))


def unix_seconds(c: Column) -> Column:
    x = F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), c.try_cast("double"))
    return F.when(F.abs(x) <= 2.0**53, x)


def unix_millis(c: Column) -> Column:
    x = F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?\z"), c.try_cast("double")) / 1000
    return F.when(F.abs(x) <= 2.0**53, x)


def http_date(c: Column) -> Column:
    """IMF-fixdate of exactly 29 characters, the obsolete form with a two-digit year (pivot 70), or asctime."""
    month = "(" + "|".join(MONTHS) + ")"
    number = lambda m: F.floor((F.position(m, F.lit("".join(MONTHS))) + 2) / 3).cast("int")
    fix = rf"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), \d{{2}} {month} \d{{4}} \d{{2}}:\d{{2}}:\d{{2}} GMT\z"
    old = rf"^(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day, \d{{2}}-{month}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}} GMT\z"
    asc = rf"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) {month} [ \d]\d \d{{2}}:\d{{2}}:\d{{2}} \d{{4}}\z"
    # Once a form is known, its parts stand at fixed places, in the obsolete form from the end: day, month, year, hour, minute, second.
    part = lambda at, n=2: _int(F.trim(F.substring(c, at, n)))
    month_at = lambda at: number(F.substring(c, at, 3))
    seconds = lambda y, mo, d, h: _seconds(y, month_at(mo), part(d), part(h), part(h + 3), part(h + 6)).cast("double")
    century = F.when(part(-15) >= 70, 1900).otherwise(2000)
    return F.when(c.rlike(fix), seconds(part(13, 4), 9, 6, 18)).when(c.rlike(old), seconds(part(-15) + century, -19, -22, -12)).when(c.rlike(asc), seconds(part(21, 4), 5, 9, 12))


def pattern(format_: str):
    """A parser of a fixed pattern of yyyy MM dd HH mm ss SSS Z, quoted and other literals; UTC without a zone.

    ``Z`` is z in either case, or an offset with its minutes.
    """
    if not all(x in format_ for x in ("yyyy", "MM", "dd")):
        raise ValueError("a date pattern needs yyyy, MM and dd")
    names, out = [], []
    for m in re.finditer(r"yyyy|MM|dd|HH|mm|ss|SSS|Z|''|'([^']*)'|.", format_):
        if m.group() in ("yyyy", "MM", "dd", "HH", "mm", "ss", "SSS"):
            names.append(m.group())
            out.append(rf"(\d{{{len(m.group())}}})")
        elif m.group() == "Z":
            names.append("Z")
            out.append(r"([Zz]|[+-](?:[01]\d|2[0-3]):?[0-5]\d)")
        elif m.group() == "''":
            out.append("'")
        else:
            out.append(re.escape(m.group(1) if m.group(1) is not None else m.group()))
    expression = "^" + "".join(out) + r"\z"

    def parse(c: Column) -> Column:
        value = {n: _int(F.regexp_extract(c, expression, k + 1)) for k, n in enumerate(names) if n != "Z"}
        zero = F.lit(0)
        at = _seconds(*[value.get(n, zero) for n in ("yyyy", "MM", "dd", "HH", "mm", "ss")])
        if "Z" in names:
            zone = _int(F.translate(F.regexp_extract(c, expression, names.index("Z") + 1), ":", ""))
            at = at - (zone * 36 + zone % 100 * 24)
        return F.when(c.rlike(expression), at.cast("double") + value.get("SSS", zero) / 1000)

    parse.format = format_
    return parse


def chain(c: Column, parsers: Sequence) -> tuple[Column, Column]:
    """The first parser's value that isn't null, and whether a later one than the first gave it.

    Each parser is written once: the values are an array, of which the first with a value is taken. An array
    function also keeps the parsers of long chains out of one method of generated code.
    """
    values = F.transform(F.array(c), lambda x: F.array(*[p(x) for p in parsers]))[0]
    found = F.filter(F.zip_with(values, F.sequence(F.lit(0), F.lit(len(parsers) - 1)), lambda v, k: F.struct(v.alias("v"), k.alias("k"))), lambda e: e["v"].isNotNull())
    first = F.get(found, F.lit(0))
    return first["v"], F.coalesce(first["k"] > 0, F.lit(False))


def iso_text(seconds: Column) -> Column:
    """Whole seconds as ISO 8601 in UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
