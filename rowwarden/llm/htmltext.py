"""Main text of web pages by differences between neighbouring pages, with marked template left out.

A page is read into lines of text, one per block. Pages of a host are put in order of URL path, equal ones
once; the lines of a page are aligned with those of its neighbours by longest common subsequence, and lines
that neighbours share are deleted as template. Two things limit that rule, because it alone gives wrong
results. Template that differs from page to page, such as menus of links, is recognised by its element, role
or class. And lines inside an article element are kept even if neighbours share them: articles repeat too.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import if_small, materialize

# Elements whose content isn't text, elements of the template, those of them that hold no article, elements that do,
# elements that end a line of text, elements without content, words of class and id that mark template, words that
# may stand beside those, words of reader comments, words of what stands beside an article, elements whose id is a
# name to link to, and roles that mark template.
SILENT = frozenset("script style noscript template head title svg iframe object canvas audio video select textarea datalist button".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav noframes noscript ol optgroup option p plaintext pre script search section select style summary table tbody td template textarea tfoot th thead title tr ul xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion discussions disqus dialog footer form header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
BESIDE = frozenset("site page main top bottom left right box bar block list section area container wrapper inner outer primary secondary global posts articles links link buttons button item items content text reader readers user users visitor visitors".split())
COMMENTS = frozenset("comment comments discussion discussions disqus reply replies respond".split())
SIDE = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs footer menu nav navbar navigation newsletter pager pagination promo promoted related sidebar sponsor sponsored".split())
NAMED = frozenset("h1 h2 h3 h4 h5 h6 p".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|[\s/]*=")
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.IGNORECASE) for n in ("script", "style", "textarea", "title", "noscript", "iframe")}
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Neighbours on either side, and how many of all of them have to share a line for it to be template.
REACH, WITNESSES = 2, 2


@dataclass
class Line:
    text: str
    article: bool


@dataclass
class _Element:
    """An open element: its place above, and what its tag says."""

    name: str
    above: _Element | None
    marked: int = 0  # as template, unless it holds an article: see _marked
    silent: bool = False
    holds: bool = False  # an article or main element below it
    gone: bool | None = None
    article: bool = field(init=False)
    beside: bool = field(init=False)  # this or one above stands beside articles

    def __post_init__(self) -> None:
        self.article = self.name in MAIN or self.above is not None and self.above.article
        self.beside = self.marked > 1 or self.name in ASIDE or self.above is not None and self.above.beside

    def left_out(self) -> bool:
        """Whether this or an element above is silent or marked; each element is looked at once."""
        path: list[_Element] = []
        at: _Element | None = self
        while at is not None and at.gone is None:
            path.append(at)
            at = at.above
        gone = at is not None and bool(at.gone)
        for x in reversed(path):
            gone = x.gone = gone or x.silent or x.marked == 3 or x.marked > 0 and not x.holds
        return gone


def _tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """``("text", text, {})``, ``("open", name, attributes)`` and ``("close", name, {})`` in page order, in linear time."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], {}
            return
        if lt > at:
            yield "text", page[at:lt], {}
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            end = n if end < 0 else end
            yield "text", html.escape(page[lt + 9 : end], quote=False), {}
            at = end + 3
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := _NAME.match(page, lt):
            name, closing, attributes, at = m.group(1).lower(), page[lt + 1] == "/", {}, m.end()
            while at < n and page[at] != ">":
                if not (m := _ATTRIBUTE.match(page, at)):
                    at += 1
                    continue
                at = m.end()
                if m.group(1):
                    attributes.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
            at += 1
            yield ("close" if closing else "open"), name, attributes
            if not closing and name in _RAW:
                end = _RAW[name].search(page, at)
                at = end.start() if end else n
        else:
            yield "text", "&lt;", {}
            at = lt + 1


def _noise(names: str, words: frozenset[str]) -> bool:
    """Whether one of the class names or ids consists of words that mark template and words that may stand beside them."""
    for name in names.lower().split():
        found = _WORDS.findall(name)
        if found and any(w in words for w in found) and all(w in words or w in BESIDE for w in found):
            return True
    return False


def _marked(name: str, attributes: dict[str, str], inside: bool) -> int:
    """Whether an element is marked as template: 1, 2 as what stands beside an article, 3 as reader comments, else 0.

    ``inside`` an article its own headers and hidden parts aren't, and ids of sections only if they say comments.
    """
    classes, own = attributes.get("class", ""), attributes.get("id", "")
    if name in NAMED:
        own = ""
    if _noise(classes, COMMENTS) or name not in MAIN and _noise(own, COMMENTS):
        return 3
    if name in MAIN:
        return 0
    if name in CHROME and not (inside and name == "header"):
        return 1
    if not attributes or name in ("html", "body"):
        return 0
    if not inside and ("hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower()):
        return 1
    if attributes.get("role", "").lower() in ROLES:
        return 1
    words = NOISE - {"header"} if inside else NOISE
    own = "" if inside and name == "section" else own
    if not (_noise(classes, words) or _noise(own, words)):
        return 0
    return 2 if _noise(classes, SIDE) or _noise(own, SIDE) else 1


def lines(page: str | None) -> list[Line]:
    """Lines of visible text outside marked template, in page order, with white space made single blanks.

    Marks by class, id or role, and forms and headers, don't count on an element that holds an article. Those of
    reader comments always do, and those of what stands beside articles if the page has an article elsewhere.
    """
    top, free, others = _Element("", None), False, []
    here, out, piece = top, [], []  # out: raw text of a block and its element
    opened: Counter[str] = Counter()

    def back(to: _Element) -> None:
        """Closes all elements below ``to``."""
        nonlocal here
        while here is not to:
            opened[here.name] -= 1
            here = here.above

    def flush() -> None:
        if piece:
            out.append(("".join(piece), here))
            piece.clear()

    for kind, value, attributes in _tokens(page or ""):
        if kind == "text":
            piece.append(value)
            continue
        name = value
        if name in BLOCK:
            flush()
        if name in VOID:
            continue
        if kind == "close":
            at: _Element | None = here if opened[name] else None
            while at is not None and at.name != name:
                at = at.above
            if at is not None:
                if name not in BLOCK and (here.marked or at.marked or here.silent):
                    flush()
                elif any_block(here, at):
                    flush()
                back(at.above)
            continue
        if name in ("p", "li", "tr", "td"):
            # These end where the next of their kind begins.
            at = here
            while at is not None and at.name not in BLOCK and at.name:
                at = at.above
            if at is not None and at.name == name:
                back(at.above)
        new = _Element(name, here, _marked(name, attributes, here.article), name in SILENT)
        if name not in BLOCK and (new.marked or new.silent):
            flush()
        if name in MAIN and not new.marked:
            if here.beside:
                others.append(here)
            else:
                free = True
                holding(here)
        here = new
        opened[name] += 1
    flush()
    if not free:
        for at in others:
            holding(at)
    shown = []
    for raw, element in out:
        text = _SPACE.sub(" ", html.unescape(raw)).strip()
        if text and not element.left_out():
            shown.append(Line(text, element.article))
    return shown


def holding(at: _Element | None) -> None:
    """Says of an element and those above that they hold an article."""
    while at is not None and not at.holds:
        at.holds = at.name not in ASIDE
        at = at.above


def any_block(here: _Element, at: _Element) -> bool:
    """Whether an element from ``here`` up to ``at`` ends a line."""
    while here is not at:
        if here.name in BLOCK:
            return True
        here = here.above
    return False


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, after equal beginnings and ends."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(a) - hi, len(a))}
    common = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    x = [k for k in range(lo, len(a) - hi) if a[k] in common]
    y = [k for k in range(lo, len(b) - hi) if b[k] in common]
    # Lengths by Hunt and Szymanski: for each length, the last place in b that ends one.
    places: dict[object, list[int]] = {}
    for k in reversed(y):
        places.setdefault(b[k], []).append(k)
    ends: list[int] = []
    nodes: list[tuple[int, object]] = []
    for k in x:
        for p in places[a[k]]:
            n = bisect_left(ends, p)
            node = (k, nodes[n - 1] if n else None)
            if n == len(ends):
                ends.append(p)
                nodes.append(node)
            else:
                ends[n], nodes[n] = p, node
    node = nodes[-1] if nodes else None
    while node is not None:
        found.add(node[0])
        node = node[1]
    return found


def template_lines(own: list, neighbours: list[list]) -> list[int]:
    """Places of the lines that ``WITNESSES`` neighbours share, or the only neighbour there is, in order."""
    times = np.zeros(len(own), dtype=int)
    for other in neighbours:
        times[list(shared_lines(own, other))] += 1
    return np.flatnonzero(times >= max(1, min(WITNESSES, len(neighbours)))).tolist()


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", text: str = "html", into: str = "text") -> DataFrame:
    """``page_id``, ``url`` and ``into``, the main text of every page.

    Pages of a host are ordered by path; those with equal lines stand once, at their first path. A page is
    compared with the ``REACH`` pages on either side: their places in the order of all pages are known, so
    that neighbours meet in a join and no host is one task, and partitions don't matter. A line that only one
    of several neighbours shares stays: that neighbour may be a near copy. Three or more near copies in a row
    that have no article element lose the lines they share.

    Null or empty HTML has an empty text, a null URL the host and path of an empty one. Every row gives one
    row, repeated ones too. Time is linear in the length of a page but for the alignment of lines. Other
    columns are ignored, whatever their names.
    """
    rest = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages_ in batches:
            texts, articles, hashes = [], [], []
            for s in pages_:
                found = lines(s.as_py())
                texts.append([x.text for x in found])
                articles.append([x.article for x in found])
                hashes.append([xxhash.xxh64_intdigest(x.text) - 2**63 for x in found])
            yield pa.StructArray.from_arrays([pa.array(texts, pa.list_(pa.string())), pa.array(articles, pa.list_(pa.bool_())), pa.array(hashes, pa.list_(pa.int64()))], names=["texts", "articles", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            drop = [template_lines(own, near) for own, near in zip(t.column("hashes").to_pylist(), t.column("near").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("host"), t.column("sig"), pa.array(drop, pa.list_(pa.int32()))], names=["host", "sig", "drop"])

    host, path = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)).alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path")
    parsed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host, path, F.arrow_udf(read, "texts array<string>, articles array<boolean>, hashes array<long>").asNondeterministic()(F.col(text)).alias("l"))
    parsed = materialize(parsed.select("page_id", "url", "host", "path", "l.*", F.struct(F.xxhash64("l.hashes").alias("a"), F.xxhash64(F.lit(1), "l.hashes").alias("b")).alias("sig")), "lines")
    distinct = parsed.where(F.size("hashes") > 0).groupBy("host", "sig").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.min(F.array_min(F.transform("articles", lambda x: x.cast("int")))).alias("closed"))
    order = distinct.repartitionByRange("host", "path", "sig").sortWithinPartitions("host", "path", "sig").withColumn("at", F.monotonically_increasing_id())
    order = materialize(order, "order")
    part = F.shiftright("at", 33).alias("part")
    counts = order.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    placed = order.join(F.broadcast(before), part == before["part"]).select("host", "sig", "hashes", "closed", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("pos"))
    wanted = placed.where("closed = 0")
    asked = wanted.select("host", F.explode(F.array(*[F.col("pos") + d for d in range(-REACH, REACH + 1) if d])).alias("pos"), F.col("pos").alias("of"))
    near = asked.join(placed.select("host", "pos", F.col("hashes")), ["host", "pos"]).groupBy("host", F.col("of").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "hashes"))), lambda x: x["hashes"]).alias("near"))
    met = wanted.join(near, ["host", "pos"]).select("host", "sig", "hashes", "near")
    drop = materialize(met.mapInArrow(compare, "host string, sig struct<a:long,b:long>, drop array<int>").where(F.size("drop") > 0), "template")
    found = parsed.join(if_small(drop, drop.count(), 200_000), ["host", "sig"], "left")
    kept = F.filter(F.col("texts"), lambda x, k: F.get("articles", k) | ~F.coalesce(F.array_contains("drop", k), F.lit(False)))
    return found.select("page_id", "url", F.array_join(kept, " ").alias(into))
