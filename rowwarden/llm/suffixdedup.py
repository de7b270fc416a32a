"""Removal of byte strings that occur more than once, by a distributed merge sort of suffixes that knows common prefixes.

Any run of ``length`` bytes holds a piece of ``gram`` bytes whose hash is the smallest in it, and equal runs hold it
at the same place. The suffixes that begin at such pieces are the only ones to sort: each stands for all the runs
whose smallest piece it begins with. Pieces that occur once are left out first, as their runs occur once too.

Every task sorts the suffixes of its texts, cut where the runs end, into one sorted run, and writes it front-coded:
the length of the prefix shared with the suffix before, and the rest; the bytes to the left of a suffix go along,
coded in the same way. Ranges of these runs meet and are merged by a loser tree, whose losers remember the prefix
that they share with their winner, so that no byte of a known prefix is compared again; the merge yields the common
prefixes of the whole range. Two runs of bytes are equal if their suffixes share enough to the right and their left
contexts enough to the left. Equal suffixes on either side of the border of two ranges are told by a digest.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import free_name, if_few, if_small, materialize
from ._text import buffers, lists, mix, slabs

LENGTH = 200
#: Bytes that one numpy pass of a long text covers.
PIECE = 4 << 20
#: Suffixes of one sorted run, bytes of one range of the merge, and ranges at most; larger inputs get larger ranges.
RUN_ITEMS, RANGE_BYTES, MAX_RANGES = 50_000, 6 << 20, 1 << 12
#: One suffix in so many is a candidate for a border of ranges; as many are taken for each range.
SAMPLED, PER_RANGE = 256, 16

_U = np.uint64
_BYTES = np.random.default_rng(20240611).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_A, _B = _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)


def gram_of(length: int) -> int:
    """Bytes of a piece: the largest power of two up to a third of ``length``."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def _pieces(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that hold every run of ``length`` bytes whole, each run's start in exactly one."""
    for lo in range(0, max(size, 1), PIECE):
        yield lo, min(size, lo + PIECE + length - 1)
        if lo + PIECE + length - 1 >= size:
            return


def suffixes(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Text, place, hash of the piece there, and the first and last start of the runs it stands for, of each suffix to sort."""
    found = [_suffixes(buf, offs, length)] if len(buf) <= PIECE or len(offs) > 2 else [tuple(x + lo if k in (1, 3, 4) else x for k, x in enumerate(_suffixes(buf[lo:hi], np.array([0, hi - lo]), length))) for lo, hi in _pieces(len(buf), length)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _suffixes(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    gram, n = gram_of(length), len(buf)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, m = _BYTES[buf], 1
    while m < gram:
        left = h[:-m]
        h = ((left ^ (left >> _U(29))) * _A ^ (left >> _U(32))) + h[m:] * _B
        m *= 2
    h = mix(h)
    mask = _U((1 << n.bit_length()) - 1)
    least, m, width = (h & ~mask) | np.arange(len(h), dtype=_U), 1, length - gram + 1
    while 2 * m <= width:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    if m < width:
        least = np.minimum(least[: len(least) - (width - m)], least[width - m :])
    edge = np.zeros(n + 1, dtype=np.int32)
    last = np.maximum(offs[:-1], offs[1:] - length + 1)
    np.add.at(edge, offs[:-1], 1)
    np.add.at(edge, last, -1)
    starts = np.flatnonzero(np.cumsum(edge[: len(least)]) > 0)
    if not len(starts):
        return _suffixes(buf[:0], offs[:1], length)
    place = (least[starts] & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    p, s1, s2 = place[new], starts[new], starts[np.append(new[1:], len(starts)) - 1]
    return np.searchsorted(offs, p, "right") - 1, p, h[p], s1, s2


def profile(texts: pa.Array, length: int) -> pa.Array:
    """For each text the hashes of its pieces, none more than twice, and a few suffixes as candidates for borders."""
    out = []
    for lo, hi, buf, offs in slabs(texts):
        text, p, h, _, s2 = suffixes(buf, offs, length)
        count, order = np.zeros(hi - lo, np.int64), np.lexsort((h, text))
        t, x = text[order], h[order]
        if len(x) > 2:
            again = np.concatenate(([False, False], (x[2:] == x[:-2]) & (t[2:] == t[:-2])))
            t, x = t[~again], x[~again]
        np.add.at(count, t, 1)
        some = np.flatnonzero(mix(h ^ (p.astype(_U) * _A)) % _U(SAMPLED) == 0)
        rows: list[list[dict]] = [[] for _ in range(hi - lo)]
        for k in some.tolist():
            rows[text[k]].append({"gram": int(h[k : k + 1].view(np.int64)[0]), "suffix": buf[p[k] : s2[k] + length].tobytes()})
        kind = pa.list_(pa.struct([("gram", pa.int64()), ("suffix", pa.binary())]))
        out.append(pa.StructArray.from_arrays([lists(x.view(np.int64), count, pa.int64()), pa.array(rows, kind)], names=["grams", "samples"]))
    return pa.concat_arrays(out)


def common(a: bytes, b: bytes) -> int:
    """Bytes that two strings share from the start."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def front_code(items: list[tuple[bytes, bytes, bool]]) -> tuple[bytes, bytes]:
    """Sorted suffixes with their left contexts, read leftwards, and whether there are several: lengths, and what isn't shared with the one before."""
    heads, rest, r, s = [], [], b"", b""
    for right, left, many in items:
        c, d = common(r, right), common(s, left)
        heads.append((c, len(right), d, len(left), many))
        rest += (right[c:], left[d:])
        r, s = right, left
    return np.array(heads, dtype=np.uint16).tobytes(), b"".join(rest)


def decode(heads: bytes, rest: bytes) -> Iterator[tuple[int, bytes, bytes, bool]]:
    """What :func:`front_code` was given, with the prefix that each shares with the one before."""
    r, s, at = b"", b"", 0
    for c, n, d, m, many in np.frombuffer(heads, np.uint16).reshape(-1, 5).tolist():
        mid, end = at + n - c, at + n - c + m - d
        r, s, at = r[:c] + rest[at:mid], s[:d] + rest[mid:end], end
        yield c, r, s, bool(many)


def merge(runs: list[list[tuple]]) -> tuple[list[tuple], list[int]]:
    """Sorted runs as one, with the prefix that each suffix shares with the one before; items are ``(shared, suffix, ...)``.

    A loser tree: each inner node keeps the stream that lost there and the prefix that its suffix shares with the
    winner. Both comparands of a match share known prefixes with the last suffix taken; the one that shares more comes
    first, and only if they share as much are bytes compared, from there on.
    """
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    streams = [iter(r) for r in runs] + [iter(())] * (size - k)
    head = [next(s, None) for s in streams]
    shared = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        h = shared[a]
        x, y = x[1], y[1]
        c = h + common(x[h:], y[h:])
        first = c == len(x) or c < len(y) and x[c] < y[c]
        won, lost = (a, b) if first else (b, a)
        shared[lost] = c
        return won, lost

    level = list(range(size))
    while len(level) > 1:
        up = []
        for j in range(0, len(level), 2):
            won, lost = play(level[j], level[j + 1])
            losers[len(level) // 2 + j // 2] = lost
            up.append(won)
        level = up
    w, out, prefixes = level[0], [], []
    while (item := head[w]) is not None:
        out.append(item)
        prefixes.append(shared[w])
        head[w] = after = next(streams[w], None)
        shared[w] = after[0] if after is not None else 0
        node = (w + size) >> 1
        while node:
            w, losers[node] = play(w, losers[node])
            node >>= 1
    return out, prefixes


def repeated(right: list[bytes], prefixes: np.ndarray, left: list[bytes], many: np.ndarray, length: int) -> np.ndarray:
    """For each of some merged suffixes and each number of bytes to the left, whether the run that begins there occurs again."""
    n, width = len(right), length - gram_of(length) + 1
    least = length - np.array([len(x) for x in right], dtype=np.int64)
    most = np.array([len(x) for x in left], dtype=np.int64)
    order = sorted(range(n), key=left.__getitem__)
    beside = np.array([0] + [common(left[a], left[b]) for a, b in zip(order[:-1], order[1:], strict=True)], dtype=np.int64)
    order = np.array(order, dtype=np.int64)
    out = np.zeros((n, width), dtype=bool)
    place = np.empty(n, dtype=np.int64)
    for a in range(width):
        live = np.flatnonzero((least <= a) & (a <= most))
        if not len(live):
            continue
        place[order] = np.cumsum(beside < a)
        both = np.cumsum(prefixes < length - a)[live] * (n + 1) + place[live]
        ranked = np.argsort(both, kind="stable")
        same = both[ranked][1:] == both[ranked][:-1]
        again = np.zeros(len(live), dtype=bool)
        again[ranked[1:][same]] = again[ranked[:-1][same]] = True
        out[live, a] = again | many[live]
    return out


_RUN = "range int, run long, base int, heads binary, rest binary, same binary, items array<int>, places array<int>"


def _runs(length: int, borders: list[bytes], run_items: int):
    """A function of batches of texts with their marked pieces: front-coded ranges of sorted runs, and the places of their suffixes."""

    def write(run: int, items: dict[tuple[bytes, bytes], list[int]], texts: list[tuple[bytes, list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
        ordered = sorted(items)
        number = np.empty(len(ordered), dtype=np.int32)
        rows, lo = [], 0
        for k, key in enumerate(ordered):
            number[items[key][0]] = k
        while lo < len(ordered):
            r = bisect_right(borders, ordered[lo][0])
            hi = len(ordered) if r == len(borders) else _below(ordered, borders[r], lo)
            rows.append((r, run, lo, *front_code([(a, b, items[a, b][1] > 1) for a, b in ordered[lo:hi]]), None, None, None))
            lo = hi
        rows += [(None, run, None, None, None, same, number[ids].tolist(), places) for same, ids, places in texts]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for at in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 1000], strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RUN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, items, texts = TaskContext.get().partitionId() << 24, {}, []
        for batch in batches:
            same, marks = batch["same"].to_pylist(), batch["marks"]
            for lo, _, buf, offs in slabs(batch["text"]):
                text, p, h, s1, s2 = suffixes(buf, offs, length)
                raw = buf.tobytes()
                for k in range(len(offs) - 1):
                    a, b = np.searchsorted(text, [k, k + 1])
                    own = a + np.flatnonzero(np.isin(h[a:b].view(np.int64), np.asarray(marks[lo + k].values)))
                    ids = []
                    for at, x, y in zip(p[own].tolist(), s1[own].tolist(), s2[own].tolist(), strict=True):
                        entry = items.setdefault((raw[at : y + length], raw[x:at][::-1]), [len(items), 0])
                        entry[1] += 1
                        ids.append(entry[0])
                    if ids:
                        texts.append((same[lo + k], ids, (p[own] - offs[k]).tolist()))
                    if len(items) >= run_items:
                        yield from write(number, items, texts)
                        number, items, texts = number + 1, {}, []
        if items:
            yield from write(number, items, texts)

    return run


def _below(ordered: list[tuple[bytes, bytes]], border: bytes, lo: int) -> int:
    """The first of ``ordered`` from ``lo`` on whose suffix isn't below ``border``."""
    hi = len(ordered)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if ordered[mid][0] < border else (lo, mid)
    return lo


_FOUND = "run long, items array<int>, bits binary, digest binary, item int, left int, known boolean"


def _merged(length: int, borders: list[bytes]):
    """A function of the runs of one range: the repeated runs of bytes by suffix, and those that may repeat beyond its borders."""
    gram = gram_of(length)

    def run(table: pa.Table) -> pa.Table:
        r = table["range"][0].as_py()
        runs = []
        for number, base, heads, rest in zip(*(table[c].to_pylist() for c in ("run", "base", "heads", "rest")), strict=True):
            runs.append([(*x, number, base + k) for k, x in enumerate(decode(heads, rest))])
        items, prefixes = merge(runs)
        prefixes = np.array(prefixes, dtype=np.int64)
        # What each suffix shares with the borders of the range.
        reach = np.zeros(len(items), dtype=np.int64)
        if r > 0:
            reach = np.minimum.accumulate(np.concatenate(([common(items[0][1], borders[r - 1])], prefixes[1:])))
        if r < len(borders):
            reach = np.maximum(reach, np.minimum.accumulate(np.concatenate(([common(items[-1][1], borders[r])], prefixes[:0:-1])))[::-1])
        many = np.array([x[3] for x in items])
        after = np.append(prefixes[1:], 0)
        keep = np.flatnonzero(many | (np.maximum(prefixes, after) >= gram) | (reach >= gram))
        prefixes = np.where(np.concatenate(([True], np.diff(keep) > 1)), 0, prefixes[keep])
        items, reach = [items[k] for k in keep], reach[keep]
        dup = repeated([x[1] for x in items], prefixes, [x[2] for x in items], many[keep], length)
        rows = []
        by_run: dict[int, list[int]] = {}
        for k in np.flatnonzero(dup.any(axis=1)).tolist():
            by_run.setdefault(items[k][4], []).append(k)
        for number, ks in by_run.items():
            rows.append((number, [items[k][5] for k in ks], np.packbits(dup[ks], axis=1).tobytes(), None, None, None, None))
        seen = set()
        for k in np.flatnonzero(reach >= gram).tolist():
            _, right, left, _, number, item = items[k]
            for a in range(max(length - len(right), length - int(reach[k])), len(left) + 1):
                digest = hashlib.blake2b(left[:a][::-1] + right[: length - a], digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    rows.append((number, None, None, digest, item, a, bool(dup[k, a])))
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


_SPANS = pa.schema([("same", pa.binary()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _spans(length: int):
    """A function of the places of one sorted run and what was found of its suffixes: the bytes to remove from each text."""
    width = length - gram_of(length) + 1

    def run(places: pa.Table, found: pa.Table) -> pa.Table:
        every = [np.asarray(x.values, dtype=np.int64) for x in places["items"]]
        bits = np.zeros((1 + max((int(x.max()) for x in every), default=-1), width), dtype=bool)
        for items, packed, more in zip(found["items"], found["bits"].to_pylist(), found["more"].to_pylist(), strict=True):
            if packed is not None:
                own = np.asarray(items.values)
                bits[own] |= np.unpackbits(np.frombuffer(packed, np.uint8).reshape(len(own), -1), axis=1, count=width).astype(bool)
            for x in more or []:
                bits[x["item"], x["left"]] = True
        out = []
        for same, items, at in zip(places["same"].to_pylist(), every, places["places"], strict=True):
            which, left = np.nonzero(bits[items])
            if not len(which):
                continue
            starts = np.unique(np.asarray(at.values, dtype=np.int64)[which] - left)
            new = np.concatenate(([True], starts[1:] > starts[:-1] + length))
            out.append((same, starts[new].tolist(), (starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1] + length).tolist()))
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, _SPANS, strict=True)], schema=_SPANS)

    return run


def _same(text: str):
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 32))


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, run_items: int = RUN_ITEMS, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``copies``: ``same`` and ``rows`` of the texts that several rows have; ``spans``: ``same``, ``begins``, ``ends`` of the bytes to
    remove from others, which may hold some of the former too. ``same`` is the first half of the SHA-256 of a text."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield profile(texts, length)

    found = F.arrow_udf(scan, "grams array<long>, samples array<struct<gram:long,suffix:binary>>").asNondeterministic()("text")
    profiles = materialize(keyed.select("doc_id", _same("text").alias("same"), found.alias("f")).select("doc_id", "same", "f.*"), "profiles")
    copies = profiles.groupBy("same").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first")).where("rows > 1")
    copies = materialize(copies, "copies")
    n_copies = copies.count()
    one_each = lambda df: df.join(if_small(copies.select("same", "first", F.lit(True).alias("copied")), n_copies), "same", "left").where("copied is null or doc_id <=> first")
    # Pieces that occur in one place only have no equal run; of the others the texts keep the hashes.
    unique = one_each(profiles)
    spread = unique.select("same", F.explode("grams").alias("gram"))
    shared = materialize(spread.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "grams")
    n_shared, n_places = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shared = shared.select("gram")
    marks = spread.join(if_small(shared, n_shared), "gram", "left_semi").groupBy("same").agg(F.collect_set("gram").alias("marks"))
    marks = materialize(marks, "marks")
    # Borders between ranges, from a bounded sample of the suffixes that take part.
    ranges = int(min(MAX_RANGES, max(1, -(-n_places * (2 * length - gram_of(length)) // range_bytes))))
    sample = unique.select(F.explode("samples").alias("s")).select("s.*").join(if_small(shared, n_shared), "gram", "left_semi").select("suffix")
    share = min(1.0, PER_RANGE * ranges / max(1, n_places / SAMPLED))
    drawn = sample.where(F.pmod(F.xxhash64("suffix"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(4 * PER_RANGE * ranges)
    drawn = sorted(bytes(r.suffix) for r in drawn.collect()) if ranges > 1 else []
    borders = sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []
    near = one_each(keyed.withColumn("same", _same("text"))).select("same", "text").join(if_few(marks, "marks"), "same")
    runs = materialize(near.mapInArrow(_runs(length, borders, run_items), _RUN), "runs")
    parts = runs.where("range is not null").select("range", "run", "base", "heads", "rest")
    merged = materialize(parts.groupBy("range").applyInArrow(_merged(length, borders), _FOUND), "merged")
    opened = merged.where("digest is not null")
    twice = opened.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    beyond = opened.where("not known").join(twice, "digest").groupBy("run").agg(F.collect_list(F.struct("item", "left")).alias("more"))
    none = F.lit(None).cast("array<struct<item:int,left:int>>")
    hits = merged.where("items is not null").select("run", "items", "bits", none.alias("more")).union(beyond.select("run", F.lit(None).cast("array<int>"), F.lit(None).cast("binary"), "more"))
    places = runs.where("same is not null").select("run", "same", "items", "places")
    spans = places.groupBy("run").cogroup(hits.groupBy("run")).applyInArrow(_spans(length), "same binary, begins array<int>, ends array<int>")
    return copies.select("same", "rows"), materialize(spans.dropDuplicates(["same"]), "spans")


def strip(texts: pa.Array, begins: pa.Array, ends: pa.Array) -> pa.Array:
    """The bytes of each text that lie outside the spans; null where there are no spans."""
    buf, offs = buffers(texts)
    out = []
    for k, (b, e) in enumerate(zip(begins, ends, strict=True)):
        if not b.is_valid:
            out.append(None)
            continue
        own = buf[offs[k] : offs[k + 1]]
        b, e = np.asarray(b.values), np.asarray(e.values)
        out.append(b"".join(own[x:y].tobytes() for x, y in zip([0, *e.tolist()], [*b.tolist(), len(own)], strict=True)))
    return pa.array(out, pa.binary())


def _stripped(text, begins, ends):
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for t, b, e in batches:
            yield strip(t, b, e)

    return F.arrow_udf(run, "binary").asNondeterministic()(F.when(begins.isNotNull(), text), begins, ends)


def _marked(docs: DataFrame, doc_id: str, text: str, length: int, options: dict) -> tuple[DataFrame, tuple[str, ...]]:
    copies, spans = repeated_spans(docs, doc_id=doc_id, text=text, length=length, **options)
    names = tuple(free_name(docs, x) for x in ("_same", "_rows", "_begins", "_ends", "_kept"))
    s, n, b, e, k = names
    copies = copies.select(F.col("same").alias(s), F.col("rows").alias(n))
    spans = spans.select(F.col("same").alias(s), F.col("begins").alias(b), F.col("ends").alias(e))
    joined = docs.withColumn(s, _same(text)).join(if_small(copies, copies.count()), s, "left").join(if_few(spans, b), s, "left")
    whole = F.col(n).isNotNull() & (F.octet_length(text) >= length)
    joined = joined.withColumn(b, F.when(whole, F.array(F.lit(0))).otherwise(F.col(b))).withColumn(e, F.when(whole, F.array(F.octet_length(text))).otherwise(F.col(e)))
    return joined.withColumn(k, _stripped(F.col(text), F.col(b), F.col(e))), names


def summary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of the bytes left.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in this text or another row's,
    as judged on the input; all occurrences go. A null text is empty; texts shorter than ``length`` keep all. Rows
    that repeat an id and a text are two occurrences. Ids may be null.
    """
    found, (_, _, b, e, k) = _marked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", length, options)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    removed = F.when(F.col(b).isNotNull(), size - F.octet_length(k)).otherwise(F.lit(0)).cast("long")
    kept = F.sha2(F.when(F.col(b).isNotNull(), F.col(k)).otherwise(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 256)
    return found.select("doc_id", size.alias("n_bytes"), removed.alias("n_removed"), F.coalesce(F.size(b), F.lit(0)).cast("long").alias("n_spans"), kept.alias("kept_sha256"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """``docs`` whose ``text`` has lost its repeated bytes; characters that lose some of their bytes go too.

    Edge cases as for :func:`summary`; a null text stays null.
    """
    found, (_, _, b, _, k) = _marked(docs, doc_id, text, length, options)
    whole = F.arrow_udf(lambda kept: pa.array([x and x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string()), "string")
    kept = F.when(F.octet_length(k) == 0, "").otherwise(whole(F.col(k)))
    return found.withColumn(text, F.when(F.col(b).isNotNull(), kept).otherwise(F.col(text))).select(*docs.columns)
