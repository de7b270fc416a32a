"""Text functions with byte-exact ASCII rules, and lengths in grapheme clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def graphemes(text: Column) -> Column:
    """Number of grapheme clusters; ASCII without CR takes the cheap way."""
    return F.when(text.rlike(r"^[\x00-\x0C\x0E-\x7F]*\z"), F.length(text)).otherwise(F.size(F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))))


def invalid_utf8_at(data: Column) -> Column:
    """The first byte of a binary value that can't be read as UTF-8, from 0: overlong forms, surrogates and values beyond the
    last character too. Null where all can. Only values that aren't valid leave the JVM."""

    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(value: bytes | None) -> int | None:
            try:
                value and value.decode()
            except UnicodeDecodeError as e:
                return e.start
            return None

        for values in batches:
            yield pa.array([one(v) for v in values.to_pylist()], pa.int64())

    return F.arrow_udf(first, "bigint").asNondeterministic()(F.when(~F.is_valid_utf8(data.cast("string")), data))


#: Steps of preprocessing; all touch ASCII only.
PREPROCESS: dict[str, Callable[[Column], Column]] = {
    "trim": lambda c: F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+\z", ""),
    "lowercase": lambda c: F.translate(c, _UPPER, _LOWER),
    "uppercase": lambda c: F.translate(c, _LOWER, _UPPER),
    "collapse": lambda c: F.regexp_replace(c, r"[ \t\n\r]+", " "),
}


def snake(words: list[str]) -> str:
    return "_".join(w.lower() for w in words)


def words_of(identifier: str) -> list[str]:
    """Words of an identifier; a run of capitals is one word, and its last capital starts the next if lower case follows."""
    import re

    return re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+", identifier)


#: How identifiers become keys.
KEY_STYLES: dict[str, Callable[[str], str]] = {
    "camel": lambda s: s,
    "snake": lambda s: snake(words_of(s)),
    "kebab": lambda s: snake(words_of(s)).replace("_", "-"),
    "pascal": lambda s: s[:1].upper() + s[1:],
    "screaming": lambda s: snake(words_of(s)).upper(),
}


def edit_distance(a: str, b: str) -> int:
    """Edits between two names; a swap of neighbours is one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def nearest_name(name: str, known: list[str]) -> str | None:
    """The first of the nearest known names within one edit, or two for names of over four bytes."""
    limit = 1 if len(name.encode()) <= 4 else 2
    scored = [(edit_distance(name, k), i, k) for i, k in enumerate(known) if abs(len(name) - len(k)) <= limit]
    best = min(scored, default=None)
    return best[2] if best and 0 < best[0] <= limit else None
