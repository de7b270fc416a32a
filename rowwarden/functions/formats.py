"""Predicates for the formats of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the formats. Always \z: a final newline must not pass.
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_ATEXT = "[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]"
HOSTNAME = rf"^(?=.{{1,253}}\.?\z)(?:{_LABEL}\.)*(?![0-9]+\.?\z){_LABEL}\.?\z"
EMAIL = rf"^(?=[^@]{{1,64}}@){_ATEXT}+(?:\.{_ATEXT}+)*@(?=.{{1,253}}\.?\z)(?:{_LABEL}\.)+(?![0-9]+\.?\z){_LABEL}\.?\z"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20\x7F]+\z"
UUID = r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\z"


def is_email(c: Column) -> Column:
    return (F.octet_length(c) <= 320) & c.rlike(EMAIL)


def is_hostname(c: Column) -> Column:
    return c.rlike(HOSTNAME)


def is_url(c: Column) -> Column:
    return c.rlike(URL)


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*\z")


def is_trimmed(c: Column) -> Column:
    return ~c.rlike(r"^[ \t\n\r]|[ \t\n\r]\z")


def is_lowercased(c: Column) -> Column:
    return c == F.lower(c)
