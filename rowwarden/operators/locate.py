"""Where issues are in the documents they were found in: bytes, lines and columns, of failing rows only.

Decoding works on parsed values, which know no positions. Only documents with issues are read again, once each and
as bytes, for the places of the values that their issues name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE = "struct<seq:int,offset:long,length:long,line:long,column:long,excerpt:string>"

_TOKEN = re.compile(rb'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|([{}\[\]:,])|([^ \t\n\r{}\[\]:,"]+))', re.DOTALL)
_BLANK = re.compile(rb"[ \t\n\r]*")
_PLAIN = re.compile(rb"(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)\Z")
_TAG = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)([^\s/>]+)((?:\s+[^\s=/>]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(/?)>", re.DOTALL)
_ATTRIBUTE = re.compile(rb"([^\s=/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.DOTALL)


def json_places(doc: bytes, max_depth: int = 64, again: list[tuple[str, str]] | None = None) -> tuple[dict[str, tuple[int, int]], int | None]:
    """Begin and end of every value by its path, the last of repeated keys, and where the document stops being JSON.

    ``again`` takes the path and the key of every key that its object has had before.
    """
    found: dict[str, tuple[int, int]] = {}
    open_: list[list] = []  # whether an object, path, begin, next index, keys
    at, path, expect = 0, "", "value"
    while m := _TOKEN.match(doc, at):
        kind = m.lastindex
        begin, at, mark = m.start(kind), m.end(), m.group(kind)
        if kind == 1 and expect in ("key", "key or end"):
            above = open_[-1][1]
            name = json.loads(mark, strict=False)
            path, expect = f"{above}.{name}" if above else name, ":"
            if again is not None and name in open_[-1][4]:
                again.append((path, name))
            open_[-1][4].add(name)
        elif kind != 2 and expect in ("value", "value or end") and (kind == 1 or _PLAIN.match(mark)):
            found[path], expect = (begin, at), "next"
        elif kind == 2 and mark in b"{[" and expect in ("value", "value or end") and len(open_) < max_depth:
            open_.append([mark == b"{", path, begin, 0, set()])
            path, expect = (path, "key or end") if mark == b"{" else (f"{path}[0]", "value or end")
        elif kind == 2 and mark == b":" and expect == ":":
            expect = "value"
        elif kind == 2 and mark == b"," and expect == "next" and open_:
            open_[-1][3] += 1
            expect, path = ("key", path) if open_[-1][0] else ("value", f"{open_[-1][1]}[{open_[-1][3]}]")
        elif kind == 2 and mark in b"}]" and open_ and expect in ("next", "key or end" if mark == b"}" else "value or end") and open_[-1][0] == (mark == b"}"):
            _, path, start, *_ = open_.pop()
            found[path], expect = (start, at), "next"
        else:
            return found, begin
        if expect == "next" and not open_:
            rest = _BLANK.match(doc, at).end()
            return found, None if rest == len(doc) else rest
    return found, _BLANK.match(doc, at).end()


def json_members(doc: bytes, path: str = "") -> list[tuple[str, str]] | None:
    """Keys and texts of the values of the object at ``path``, repeated ones too, in order; null if there is none."""
    found, stop = json_places(doc, 1 << 16)
    if stop is not None or path not in found or doc[found[path][0] : found[path][0] + 1] != b"{":
        return None
    begin, end = found[path]
    out, at = [], begin + 1
    while m := _TOKEN.match(doc, at, end - 1):
        if m.lastindex == 2:
            at = m.end()
            continue
        name, at = json.loads(m.group(1), strict=False), _TOKEN.match(doc, m.end(), end).end()
        first = _BLANK.match(doc, at).end()
        depth = 0
        while m := _TOKEN.match(doc, at, end - 1):
            mark = m.group(2)
            if mark == b"," and not depth:
                break
            depth += (mark in (b"{", b"[")) - (mark in (b"}", b"]"))
            at = m.end()
        out.append((name, doc[first:at].decode()))
    return out


def xml_places(doc: bytes, max_depth: int = 64) -> tuple[dict[str, tuple[int, int]], int | None]:
    """As :func:`json_places` for XML: the content of elements and the values of attributes, without prefixes of names.

    Elements that repeat have an index each besides the place of the first by name.
    """
    found: dict[str, tuple[int, int]] = {}
    open_: list[tuple[str, int, dict[str, int]]] = []
    name = lambda raw: raw.decode("utf-8", "replace").rpartition(":")[2]
    for m in _TAG.finditer(doc):
        if m.group(2) is None:
            continue
        if m.group(1):
            if not open_:
                return found, m.start()
            path, begin, _ = open_.pop()
            begin = begin + len(doc[begin : m.start()]) - len(doc[begin : m.start()].lstrip())
            for p in path.split("\0"):
                found.setdefault(p, (begin, max(begin, begin + len(doc[begin : m.start()].rstrip()))))
            continue
        path = ""
        if open_:
            above, _, seen = open_[-1]
            key = name(m.group(2))
            seen[key] = seen.get(key, -1) + 1
            tops = [f"{a}.{key}" if a else key for a in above.split("\0")]
            path = "\0".join([*(t for t in tops if not seen[key]), *(f"{t}[{seen[key]}]" for t in tops)])
        for a in _ATTRIBUTE.finditer(doc, m.start(3), m.end(3)):
            k = 2 if a.group(2) is not None else 3
            for p in path.split("\0"):
                found.setdefault(f"{p}.{name(a.group(1))}" if p else name(a.group(1)), a.span(k))
        if not m.group(4):
            open_.append((path, m.end(), {}))
    return found, len(doc) if open_ else None


def excerpt(doc: bytes, breaks: np.ndarray, line: int, column: int, length: int) -> str:
    """Two lines before a place, its own with carets below, and the one after, with their numbers."""
    last = min(len(breaks) + 1, line + 1)
    width, out = len(str(last)), []
    for n in range(max(1, line - 2), last + 1):
        lo, hi = int(breaks[n - 2]) + 1 if n > 1 else 0, int(breaks[n - 1]) if n <= len(breaks) else len(doc)
        if n == last and n > line and lo == len(doc):
            break
        text = doc[lo:hi].removesuffix(b"\r")
        out.append(f"  {n:>{width}} │ {text.decode('utf-8', 'replace')}")
        if n == line:
            out.append(f"  {'':>{width}} │ {' ' * (column - 1)}{'^' * max(1, min(length, len(text) - column + 1))}")
    return "\n".join(out)


def places(doc: bytes, paths: list[str], kind: str = "json", max_depth: int = 64, excerpts: bool = False) -> list[dict]:
    """A place for each path, in order of offset and those without one last. An issue of the whole document is where reading stops."""
    try:
        doc.decode()
        found, stop = (json_places if kind == "json" else xml_places)(doc, max_depth)
    except UnicodeDecodeError as e:
        found, stop = {}, e.start
    breaks = np.flatnonzero(np.frombuffer(doc, np.uint8) == 10)
    out = []
    for seq, path in enumerate(paths):
        span = (stop, min(stop + 1, len(doc))) if path == "" and stop is not None else found.get(path) if path else None
        row = {"seq": seq, "offset": None, "length": None, "line": None, "column": None, "excerpt": None}
        if span is not None:
            before = int(np.searchsorted(breaks, span[0], "left"))
            row |= {"offset": span[0], "length": span[1] - span[0], "line": before + 1, "column": span[0] - (int(breaks[before - 1]) if before else -1)}
            if excerpts:
                row["excerpt"] = excerpt(doc, breaks, row["line"], row["column"], row["length"])
        out.append(row)
    return sorted(out, key=lambda r: (r["offset"] is None, r["offset"] or 0))


def place_column(document: Column, issues: Column, *, kind: str = "json", max_depth: int = 64, excerpts: bool = False) -> Column:
    """An array of :data:`PLACE` for the issues of a document, in order of position; null where there are none."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for documents, paths in batches:
            rows = [places(d.as_py(), p.as_py(), kind, max_depth, excerpts) if p.is_valid else None for d, p in zip(documents, paths, strict=True)]
            yield pa.array(rows, pa.list_(pa.struct([("seq", pa.int32()), *[(x, pa.int64()) for x in ("offset", "length", "line", "column")], ("excerpt", pa.string())])))

    failing = F.size(issues) > 0
    bytes_ = F.coalesce(F.when(failing, document.cast("binary")), F.lit(b""))
    return F.arrow_udf(run, f"array<{PLACE}>").asNondeterministic()(bytes_, F.when(failing, F.transform(issues, lambda i: i["path"])))


def locate(df: DataFrame, column: str, *, issues: str = "_issues", kind: str = "json", max_depth: int = 64, excerpts: bool = False) -> DataFrame:
    """``df`` whose ``issues`` have ``offset``, ``length``, ``line`` and ``column`` in the document in ``column``, in order of position.

    Offsets and columns count bytes of UTF-8; lines and columns begin at 1. Issues of values that aren't there have no
    place and come last; those of a whole document are at the first byte that can't be read. ``excerpts`` adds the lines
    around each. Documents without issues aren't read. A null document has no places.
    """
    if kind not in ("json", "xml"):
        raise ValueError("documents are json or xml")
    text = F.col(column)
    if not isinstance(df.select(column).schema[0].dataType, (T.StringType, T.BinaryType)):
        raise TypeError(f"{column} must be text or binary")
    found = place_column(text, F.col(issues), kind=kind, max_depth=max_depth, excerpts=excerpts)
    staged = df.withColumn("_places", found)
    names = ["offset", "length", "line", "column", *(["excerpt"] if excerpts else [])]
    one = lambda p: F.struct(*[F.element_at(F.col(issues), p["seq"] + 1)[x].alias(x) for x in ("code", "path", "params", "received")], *[p[x].alias(x) for x in names])
    return staged.withColumn(issues, F.coalesce(F.transform("_places", one), F.transform(F.array().cast(f"array<{PLACE}>"), one))).drop("_places")
