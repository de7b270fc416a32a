"""Secret scan: known forms, and sliding windows of high Shannon entropy.

Candidate strings are long runs of the characters that keys are written in. Over each run, for each class
of characters, a window slides; one count changes on each side per step, so the entropy is kept up to date
from those two changes. Windows above the threshold of their class merge into spans. Spans that the
allow-list matches are suppressed. Spans of known forms are reported whatever the list says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import free_name

# Forms of known secrets, with the least length of what they hold.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Characters of one encoding; windows of ``width`` with at least ``bits`` of entropy count, if they mix ``groups`` of lower, upper and digit.

    ``turns`` is the least number of places in a window where a letter meets a digit: names with a number have few.
    """

    name: str
    characters: str
    width: int
    bits: float
    groups: int
    turns: int = 0


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("hex", _DIGITS + "abcdefABCDEF", 24, 3.0, 2),
    CharClass("base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", 20, 3.6, 3),
    CharClass("lower", _DIGITS + _LOWER, 24, 3.6, 2, 4),
    CharClass("upper", _DIGITS + _LOWER.upper(), 24, 3.6, 2, 4),
)
#: Strings that look random but aren't secret: UUIDs, dates, version numbers, and paths or names of words and numbers.
ALLOW = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9:-]+)?",
    r"v?[0-9]+(?:[._-][0-9]+)+",
    r"[/_+=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[/_+=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[/_+=-]*",
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


def _group(c: str) -> int:
    return 0 if c in _LOWER else 1 if c in _DIGITS else 2 if c.isalpha() else 3


def _turn(run: str, k: int) -> int:
    """1 where a letter and a digit meet at ``k``."""
    a, b = _group(run[k - 1]), _group(run[k])
    return int(a != b and 1 in (a, b) and 3 not in (a, b))


def entropy_windows(run: str, kind: CharClass) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows of ``run`` that reach the entropy of ``kind``."""
    width = kind.width
    if len(run) < width:
        return
    part = [0.0] + [c / width * log2(width / c) for c in range(1, width + 1)]
    counts: dict[str, int] = {}
    groups = [0, 0, 0, 0]
    entropy, turns, begin, stop = 0.0, 0, -1, -1
    for k, c in enumerate(run):
        if k >= width:
            gone = run[k - width]
            n = counts[gone]
            counts[gone] = n - 1
            groups[_group(gone)] -= 1
            entropy += part[n - 1] - part[n]
            turns -= _turn(run, k - width + 1) if kind.turns else 0
        n = counts.get(c, 0)
        counts[c] = n + 1
        groups[_group(c)] += 1
        entropy += part[n + 1] - part[n]
        turns += _turn(run, k) if kind.turns and k else 0
        if k >= width - 1 and entropy >= kind.bits - 1e-9 and turns >= kind.turns and sum(x > 0 for x in groups[:3]) >= kind.groups:
            if begin >= 0 and k - width + 1 > stop:
                yield begin, stop
                begin = -1
            if begin < 0:
                begin = k - width + 1
            stop = k + 1
    if begin >= 0:
        yield begin, stop


def spans(text: str | None, classes: Sequence[CharClass] = CLASSES, allow: re.Pattern | None = None) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of all secrets, ascending; positions are code points."""
    if not text:
        return []
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        if word.isalpha() or word.isdigit() or allow is not None and allow.fullmatch(word):
            continue
        for kind in classes:
            for run in re.finditer(f"[{re.escape(kind.characters)}]{{{kind.width},}}", word):
                for a, b in entropy_windows(run.group(), kind):
                    found = (m.start() + run.start() + a, 3, m.start() + run.start() + b)
                    if allow is None or not allow.fullmatch(text[found[0] : found[2]]):
                        out.append(found)
    return sorted(set(out))


_TYPE = "struct<starts:array<int>,kinds:array<int>,ends:array<int>>"


def annotate(docs: DataFrame, *, text: str = "text", classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW, into: str = "secrets") -> DataFrame:
    """Add ``into``: an array of ``(kind, start, end)`` structs in order of start, then of kind.

    Kinds are ``assign``, ``access``, ``hex`` and ``entropy``; positions are code points, ends exclusive. A
    null or empty text has none. Rows are independent: nothing is shuffled, repeated rows get equal results.
    """
    allowed = "|".join(f"(?:{a})" for a in allow)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        listed = re.compile(allowed) if allowed else None
        kind = pa.list_(pa.int32())
        for texts in batches:
            found = [spans(x.as_py(), classes, listed) for x in texts]
            yield pa.StructArray.from_arrays([pa.array([[s[k] for s in x] for x in found], kind) for k in range(3)], names=["starts", "kinds", "ends"])

    raw = free_name(docs, "_secrets_raw")
    names = F.array(*map(F.lit, KINDS))
    zipped = F.transform(F.arrays_zip(f"{raw}.starts", f"{raw}.kinds", f"{raw}.ends"), lambda x: F.struct(F.get(names, x["kinds"]).alias("kind"), x["starts"].alias("start"), x["ends"].alias("end")))
    return docs.withColumn(raw, F.arrow_udf(run, _TYPE).asNondeterministic()(F.col(text))).withColumn(into, zipped).drop(raw)


def remove(docs: DataFrame, *, kinds: Sequence[str] = KINDS, **options) -> DataFrame:
    """``docs`` without the rows that hold a secret of one of ``kinds``; options as for :func:`annotate`."""
    found = free_name(docs, "_secrets")
    return annotate(docs, into=found, **options).where(~F.exists(found, lambda s: s["kind"].isin(*kinds))).drop(found)
