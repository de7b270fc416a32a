"""Benchmark decontamination with suffix arrays of the training text.

Each run of training texts gets a suffix array over its words, and every suffix of every benchmark item
is binary-searched in it. The occurrences found give the longest verbatim match and its place for each
pair of document and item, and the share of each document's words that benchmark windows cover.

A suffix can match a benchmark window only if all words of its first window are benchmark words. The
array therefore holds just those suffixes; leaving out the others changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name
from ._text import ALNUM, FOLD, hash_spans, lists, slabs, word_spans

#: Words of a benchmark window; a shorter item is one window.
WINDOW = 13
#: Bytes of benchmark text in one broadcast index; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 32 << 20

_RESULT = "n_words long, hits array<int>, matches array<struct<item_id:string,item_pos:int,doc_pos:int,n_words:int>>"
_MATCH = pa.struct([("item_id", pa.string()), ("item_pos", pa.int32()), ("doc_pos", pa.int32()), ("n_words", pa.int32())])


def scan(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and the index of each text's first word."""
    folded = FOLD[buf]
    starts, ends, first = word_spans(folded, offs, ALNUM)
    return hash_spans(folded, starts, ends), first


class SuffixArray:
    """Order of the suffixes of a word sequence, by prefix doubling to ``depth`` words."""

    def __init__(self, words: np.ndarray, depth: int):
        self.words = words
        rank, n, k = np.unique(words, return_inverse=True)[1].astype(np.int64), len(words), 1
        while k < depth and n and rank.max() < n - 1:
            after = np.zeros(n, dtype=np.int64)
            after[: n - k] = rank[k:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
            k *= 2
        self.order = np.argsort(rank, kind="stable")

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``queries``, the range of suffixes in order that start with its words."""
        return self._bound(queries, False), self._bound(queries, True)

    def _bound(self, queries: np.ndarray, upper: bool) -> np.ndarray:
        n, width = len(self.order), queries.shape[1]
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), n)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            at = self.order[mid]
            below = np.full(len(open_), upper)  # an equal prefix lies below the upper bound only
            undecided = np.arange(len(open_))
            for k in range(width):
                place = at[undecided] + k
                have = np.where(place < n, self.words[np.minimum(place, n - 1)], -1)
                want = queries[open_[undecided], k]
                differ = have != want
                below[undecided[differ]] = have[differ] < want[differ]
                undecided = undecided[~differ]
                if not undecided.size:
                    break
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo


class Benchmark:
    """Words and distinct windows of a block of benchmark items."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        parts = [(h[a:b]) for _, _, buf, offs in slabs(pa.array(texts, pa.string())) for h, first in [scan(buf, offs)] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.ids = ids
        self.vocabulary = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, words in enumerate(parts):
            if len(words):
                by_width.setdefault(min(window, len(words)), []).append((k, np.searchsorted(self.vocabulary, words)))
        #: For each width: the distinct windows, and for each the items and positions where it stands.
        self.groups = []
        for width, items in sorted(by_width.items()):
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(w, width) for _, w in items])
            item = np.concatenate([np.full(len(w) - width + 1, k) for k, w in items])
            place = np.concatenate([np.arange(len(w) - width + 1) for _, w in items])
            distinct, which = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            count = np.bincount(which.ravel(), minlength=len(distinct))
            self.groups.append((width, distinct, item[order], place[order], np.cumsum(count) - count, count))
        self.least = min(by_width, default=0)
        self.depth = max(by_width, default=0)

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of windows in the texts: arrays of word index, item, position in the item, width."""
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        if not len(words) or not self.least:
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words
        # Runs of benchmark words that stay within a text.
        begin, end = known.copy(), known.copy()
        cut = np.zeros(len(words) + 1, dtype=bool)
        cut[first] = True
        begin[1:] &= ~known[:-1] | cut[1:-1]
        end[:-1] &= ~known[1:] | cut[1:-1]
        b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        keep = e - b >= self.least
        b, e = b[keep], e[keep]
        if not len(b):
            return none
        size = e - b + 1  # and a word that matches nothing
        start = np.cumsum(size) - size
        source = np.arange(size.sum()) - np.repeat(start - b, size)
        last = start + size - 1
        sequence = at[np.minimum(source, len(at) - 1)]
        sequence[last] = -1
        suffixes = SuffixArray(sequence, self.depth)
        found = []
        for width, distinct, item, place, head, count in self.groups:
            lo, hi = suffixes.find(distinct)
            some = np.flatnonzero(hi > lo)
            for w in some:
                spots = source[suffixes.order[lo[w] : hi[w]]]
                own = slice(head[w], head[w] + count[w])
                found.append((np.repeat(spots, count[w]), np.tile(item[own], len(spots)), np.tile(place[own], len(spots)), np.full(len(spots) * count[w], width)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else none


def _longest(spot: np.ndarray, item: np.ndarray, place: np.ndarray, width: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text and item, its longest match: arrays of text, item, position in the item, word of the text, words."""
    doc = np.searchsorted(first, spot, "right") - 1
    order = np.lexsort((spot, place - spot, item, doc))
    doc, item, place, spot, width = (x[order] for x in (doc, item, place, spot, width))
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (place[1:] - spot[1:] != place[:-1] - spot[:-1]) | (spot[1:] != spot[:-1] + 1)
    head = np.flatnonzero(new)
    words = np.diff(np.append(head, len(doc))) - 1 + width[head]
    doc, item, place, spot = (x[head] for x in (doc, item, place, spot))
    order = np.lexsort((place, spot, -words, item, doc))
    doc, item, place, spot, words = (x[order] for x in (doc, item, place, spot, words))
    best = np.ones(len(doc), dtype=bool)
    best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return tuple(x[best] for x in (doc, item, place, spot - first[doc], words))


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:n]) > 0


def search(texts: pa.Array, benchmark: Benchmark, before: pa.Array | None = None) -> pa.Array:
    """Matches of one block of benchmark items in a batch of texts; ``before`` is the result for earlier blocks."""
    out = []
    for lo, hi, buf, offs in slabs(texts):
        words, first = scan(buf, offs)
        n_docs = hi - lo
        spot, item, place, width = benchmark.occurrences(words, first)
        starts, ends = spot, spot + width
        earlier = before[lo:hi].to_pylist() if before is not None else [None] * n_docs
        for k, x in enumerate(earlier):
            if x:
                h = np.asarray(x["hits"], dtype=np.int64) + first[k]
                starts, ends = np.append(starts, h[0::2]), np.append(ends, h[1::2])
        covered = _covered(starts, ends, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        # A run that crosses texts is cut at their borders.
        border = first[1:-1]
        inner = border[(border > 0) & (border < len(words))]
        inner = np.unique(inner[covered[inner] & covered[inner - 1]]) if len(words) else inner
        edge = np.sort(np.concatenate((edge, inner, inner)))
        of = np.searchsorted(first, edge[0::2], "right") - 1
        hits = lists((edge - np.repeat(first[of], 2)).astype(np.int32), 2 * np.bincount(of, minlength=n_docs), pa.int32())
        d, i, p, s, w = _longest(spot, item, place, width, first) if len(spot) else (np.zeros(0, np.int64),) * 5
        rows: list[list[dict]] = [list(x["matches"]) if x else [] for x in earlier]
        for dd, ii, pp, ss, ww in zip(d.tolist(), i.tolist(), p.tolist(), s.tolist(), w.tolist(), strict=True):
            rows[dd].append({"item_id": benchmark.ids[ii], "item_pos": pp, "doc_pos": ss, "n_words": ww})
        out.append(pa.StructArray.from_arrays([pa.array(np.diff(first), pa.int64()), hits, pa.array(rows, pa.list_(_MATCH))], names=["n_words", "hits", "matches"]))
    return pa.concat_arrays(out) if out else pa.array([], type=pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("matches", pa.list_(_MATCH))]))


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        rows = part.orderBy("i", "t").collect()
        yield [r[0] for r in rows], [r[1] for r in rows]


def matches(texts: Column, spark, blocks: Iterator[tuple[list[str], list[str]]], window: int = WINDOW) -> Column:
    """A column of ``n_words``, ``hits`` (starts and ends of covered words) and ``matches`` (the longest for each item)."""
    found = F.lit(None).cast(f"struct<{_RESULT}>")
    for ids, items in blocks:
        shipped = spark.sparkContext.broadcast((ids, items))

        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            block = Benchmark(*shipped.value, window)
            for texts, before in batches:
                yield search(texts, block, before if before.null_count < len(before) else None)

        found = F.arrow_udf(run, _RESULT).asNondeterministic()(texts, found)
    return found


def annotate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, one_in: int = 20, block_bytes: int = BLOCK_BYTES, into: str = "contamination") -> DataFrame:
    """Add a struct column ``into``: ``n_words``, ``n_hit``, ``matches``, ``contaminated``.

    ``matches`` holds for each item with an occurring window its longest verbatim match and the place of it
    in both texts. A document is contaminated if windows cover at least one in ``one_in`` of its words. A column
    that is named ``into`` already is replaced.

    Texts stay in place: there is no shuffle. The benchmark is broadcast in blocks of about ``block_bytes`` of text,
    all of which live at once. A null text has no words; items whose id or text is null, or that have no
    words, match nothing; repeated documents get equal results; items that share an id count as one.
    """
    raw = free_name(docs, "_contamination_raw")
    found = docs.withColumn(raw, matches(F.col(text), docs.sparkSession, _blocks(benchmark, item_id, item_text, block_bytes), window))
    r = F.col(raw)
    hit = F.aggregate(F.sequence(F.lit(0), (F.size(r.hits) / 2).cast("int") - 1), F.lit(0).cast("long"), lambda a, k: a + F.get(r.hits, 2 * k + 1) - F.get(r.hits, 2 * k))
    hit = F.when(F.size(r.hits) > 0, hit).otherwise(F.lit(0).cast("long"))
    return found.withColumn(into, F.struct(r.n_words.alias("n_words"), hit.alias("n_hit"), r.matches.alias("matches"))).withColumn(into, F.col(into).withField("contaminated", (F.col(into).n_hit > 0) & (F.col(into).n_hit * one_in >= F.col(into).n_words))).drop(raw)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without its contaminated rows; options as for :func:`annotate`."""
    flag = free_name(docs, "_contamination")
    return annotate(docs, benchmark, into=flag, **options).where(~F.col(flag).contaminated).drop(flag)
