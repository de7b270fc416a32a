"""Removal of repeated passages, found through anchors at the positions of a difference cover.

A cover D modulo a period v has, for any two positions, a shift below v that takes both into D. So two equal
runs of ``length`` words share an aligned pair of windows of ``length - v + 1`` words that begin at positions
whose remainder is in D, wherever the runs stand. Only those windows, the anchors, are hashed and grouped.
Around an anchor that occurs in another document, the whole runs of ``length`` words are hashed and compared;
those that also start in a smaller document are removed. Two independent hashes of 64 bits each stand for a run.

Documents with the same words are settled first: all but the smallest lose every word that a run covers, and
since the smallest holds the same runs, none of them has to take part in what follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import free_name, if_few, if_small, materialize
from ._text import NONSPACE, hash_spans, lists, ranges, slabs, window_hashes, word_spans

LENGTH = 50
# A perfect difference set, in which every remainder modulo 31 is the difference of one pair.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)


def _shape(length: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover for runs of ``length`` words: every position is in the cover of short runs."""
    return (PERIOD, COVER) if length >= PERIOD + 4 else (1, (0,))


def _clean(buf: np.ndarray) -> np.ndarray:
    """Bytes with every white space as a blank."""
    return np.where(NONSPACE[buf], buf, np.uint8(32))


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc_end: int) -> bytes:
    """The words of one text, joined by one blank; ``buf`` has blanks for white space."""
    if not len(starts):
        return b""
    lo = starts[0]
    size = doc_end - lo + 1
    keep = np.bincount(starts - lo, minlength=size) - np.bincount(np.minimum(ends + 1, doc_end) - lo, minlength=size)
    return buf[lo:doc_end][np.cumsum(keep[:-1]) > 0].tobytes().rstrip(b" ")


def _digest(words: bytes) -> bytes:
    return hashlib.sha256(words).digest()[:16]


def profile(texts: pa.Array, length: int) -> pa.Array:
    """Words, hash of the word sequence, digest of the words, and anchors of each text in a batch."""
    period, cover = _shape(length)
    width = length - period + 1
    inside = np.zeros(period, dtype=bool)
    inside[list(cover)] = True
    out = []
    for _, _, raw, offs in slabs(texts):
        buf = _clean(raw)
        starts, ends, first = word_spans(raw, offs, NONSPACE)
        h = hash_spans(raw, starts, ends)
        n = np.diff(first)
        count = np.where(n >= length, n - width + 1, 0)
        place = ranges(count)
        chosen = inside[place % period]
        doc = np.repeat(np.arange(len(n)), count)[chosen]
        anchors = window_hashes(h, width, np.repeat(first[:-1], count)[chosen] + place[chosen])
        digest, same = [], []
        for k in range(len(n)):
            words = _joined(buf, starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], offs[k + 1])
            digest.append(hashlib.sha256(words).hexdigest())
            same.append(_digest(words))
        out.append(pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(digest), lists(anchors.view(np.int64), np.bincount(doc, minlength=len(n)), pa.int64())], names=["n_words", "same", "sha", "anchors"]))
    return pa.concat_arrays(out)


def runs(texts: pa.Array, marks: pa.Array, same: pa.Array, length: int) -> pa.Array:
    """For each text, the starts and both hashes of the runs that hold a whole anchor that begins at one of ``marks``.

    A text whose words don't hash to ``same`` isn't the one that was marked, and gets none.
    """
    period, _ = _shape(length)
    out = []
    for lo, hi, raw, offs in slabs(texts):
        buf = _clean(raw)
        starts, ends, first = word_spans(raw, offs, NONSPACE)
        h = hash_spans(raw, starts, ends)
        places, counts = [], []
        for k in range(lo, hi):
            a, b = first[k - lo], first[k - lo + 1]
            p = np.zeros(0, np.int64)
            if _digest(_joined(buf, starts[a:b], ends[a:b], offs[k - lo + 1])) == same[k].as_py():
                m = np.asarray(marks[k].values, dtype=np.int64)
                at = np.zeros(b - a + 1, dtype=bool)
                for shift in range(period):
                    at[np.maximum(m - shift, b - a - (b - a) * (m >= shift))] = True
                p = np.flatnonzero(at[: max(0, b - a - length + 1)])
            places.append(p)
            counts.append(len(p))
        counts = np.array(counts)
        p = np.concatenate([*places, np.zeros(0, np.int64)])
        at = np.repeat(first[:-1], counts) + p
        hashes = [lists(window_hashes(w, length, at).view(np.int64), counts, pa.int64()) for w in (h, hash_spans(raw, starts, ends, 1))]
        out.append(pa.StructArray.from_arrays([lists(p.astype(np.int32), counts, pa.int32()), *hashes], names=["places", "hashes", "checks"]))
    return pa.concat_arrays(out)


def _covered(places: np.ndarray, length: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def strip(texts: pa.Array, places: pa.Array, same: pa.Array, length: int) -> pa.Array:
    """Each text without the words of the runs that begin at ``places``: words removed, and the rest joined by blanks.

    Null for a text whose words don't hash to ``same``.
    """
    removed, kept = [], []
    for lo, hi, raw, offs in slabs(texts):
        buf = _clean(raw)
        starts, ends, first = word_spans(raw, offs, NONSPACE)
        for k in range(lo, hi):
            a, b, stop = first[k - lo], first[k - lo + 1], offs[k - lo + 1]
            if not places[k].is_valid or _digest(_joined(buf, starts[a:b], ends[a:b], stop)) != same[k].as_py():
                removed.append(None)
                kept.append(None)
                continue
            gone = _covered(np.asarray(places[k].values, dtype=np.int64), length, b - a)
            removed.append(int(gone.sum()))
            kept.append(_joined(buf, starts[a:b][~gone], ends[a:b][~gone], stop).decode())
    return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["n_removed", "kept"])


def _over(function, kind: str, *columns: str):
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b, c in batches:
            yield function(a, b, c)

    return F.arrow_udf(run, kind).asNondeterministic()(*columns)


def repeated_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables that :func:`deduplicate` and :func:`summary` are made of, all narrow and written to shared storage:

    ``profiles``: one row per document with ``doc_id``, ``n_words``, ``same`` (hash of its words), ``sha``;
    ``copies``: ``same`` and ``first``, the smallest id, of word sequences that several ids have;
    ``places``: ``doc_id``, ``same`` and the starts of the runs to remove, of the documents that aren't copies.
    """
    period, cover = _shape(length)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield profile(texts, length)

    kind = "n_words long, same binary, sha string, anchors array<long>"
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scanned = keyed.select("doc_id", F.arrow_udf(scan, kind).asNondeterministic()("text").alias("p"))
    profiles = materialize(scanned.select("doc_id", "p.*"), "profiles")
    ids = profiles.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= length))
    copies = materialize(ids.groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("same", "first"), "copies")
    n_copies = copies.count()

    # Anchors of the first of each word sequence, one row per place.
    unique = ids.join(if_small(copies, n_copies), "same", "left").where("first is null or doc_id = first").select("doc_id", "same", "anchors")
    spread = unique.select("doc_id", "same", F.posexplode("anchors").alias("k", "anchor"))
    shared = spread.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    shared = materialize(shared, "anchors")
    place = F.floor(F.col("k") / len(cover)).cast("int") * period + F.get(F.array(*map(F.lit, cover)), F.col("k") % len(cover))
    marked = spread.join(if_small(shared, shared.count()), "anchor", "left_semi").select("doc_id", "same", place.alias("place"))
    marks = materialize(marked.groupBy("doc_id", "same").agg(F.sort_array(F.collect_set("place")).alias("marks")), "marks")

    # Whole runs around shared anchors, and the smallest document of each.
    near = keyed.join(if_few(marks, "marks"), "doc_id")
    found = near.select("doc_id", "same", _over(lambda t, m, s: runs(t, m, s, length), "places array<int>, hashes array<long>, checks array<long>", "text", "marks", "same").alias("r"))
    found = materialize(found.select("doc_id", "same", "r.*"), "runs")
    each = found.select("doc_id", "same", F.explode(F.arrays_zip("places", "hashes", "checks")).alias("r")).select("doc_id", "same", F.col("r.places").alias("place"), F.col("r.hashes").alias("run"), F.col("r.checks").alias("check"))
    first = each.groupBy("run", "check").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("run", "check", "first")
    # Written first, so that the join deals both sides anew and can split a run that very many documents hold.
    first = materialize(first, "first")
    gone = each.join(first, ["run", "check"]).where("doc_id > first")
    places = materialize(gone.groupBy("doc_id", "same").agg(F.collect_set("place").alias("places")), "places")
    return profiles.drop("anchors"), copies, places


def summary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of the words left.

    A word goes if it lies in a run of ``length`` words that also starts in a document with a smaller id, as
    judged on the input. A null text has no words; a document with a null id is smaller than none and none is
    smaller than it, so it keeps all; rows that repeat an id and a text get equal results.
    """
    profiles, copies, places = repeated_runs(docs, doc_id=doc_id, text=text, length=length)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stripped = keyed.join(if_few(places, "places"), "doc_id").select("doc_id", "same", _over(lambda t, p, s: strip(t, p, s, length), "n_removed long, kept string", "text", "places", "same").alias("s"))
    digests = stripped.where("s.kept is not null").select("doc_id", "same", "s.n_removed", F.sha2(F.col("s.kept").cast("binary"), 256).alias("kept")).groupBy("doc_id", "same").agg(F.max(F.struct("n_removed", "kept")).alias("s"))
    digests = materialize(digests, "digests")
    joined = profiles.join(if_small(copies, copies.count()), "same", "left").join(if_small(digests, digests.count()), ["doc_id", "same"], "left")
    copy = (F.col("n_words") >= length) & F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return joined.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("s.n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("s.kept", "sha")).alias("kept_sha256"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` whose ``text`` has lost its repeated runs; texts that lose none stay as they are, others are joined by blanks.

    Edge cases as for :func:`summary`.
    """
    profiles, copies, places = repeated_runs(docs, doc_id=doc_id, text=text, length=length)
    gone = profiles.join(if_small(copies, copies.count()), "same").where((F.col("n_words") >= length) & (F.col("doc_id") > F.col("first")))
    every = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_words") / length) - 1, F.lit(0)).cast("int")), lambda k: F.least(k * length, F.col("n_words") - length).cast("int"))
    whole = gone.select("doc_id", "same", every.alias("places")).distinct()
    todo = materialize(places.unionByName(whole), "todo")
    i, p, s, r = (free_name(docs, x) for x in ("_id", "_places", "_same", "_stripped"))
    todo = todo.select(F.col("doc_id").alias(i), F.col("places").alias(p), F.col("same").alias(s))
    joined = docs.join(if_few(todo, p), docs[doc_id] == F.col(i), "left")
    stripped = joined.withColumn(r, _over(lambda t, p, s: strip(t, p, s, length), "n_removed long, kept string", text, p, s))
    return stripped.withColumn(text, F.coalesce(F.col(r).kept, F.col(text))).select(*docs.columns)
