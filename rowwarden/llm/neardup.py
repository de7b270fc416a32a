"""Near duplicates by a chosen-path set similarity join over minwise tokens.

Every text becomes the set of its word shingles; equal sets are one node from there on. A tree starts with a
minwise token per set and puts the sets that share it in one place. A place with few sets is compared
exhaustively: sketches tell which of its sets may be linked, and these are compared on full sets. A larger
place is first compared with a pivot, the set that seems most central, also on full sets, and then branches along one or two further minwise
tokens that it selects. Sets that are linked already through a pivot go along, but only to meet sets that
aren't. Independent trees repeat this until the recall aimed at is reached.

Which sets are compared doesn't depend on the size of a group beyond that; every link reported is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name, if_few, if_small, materialize, require_integral
from ._text import FOLD, NONSPACE, hash_spans, lists, mix, ranges, slabs, window_hashes, word_spans
from .graphs import components

#: Minwise tokens of a set.
TOKENS = 64
#: Sets of a place that are compared exhaustively: their sketches take 64 KB.
LEAF = 1024
#: Tokens that a larger place selects on average: one, and a second one in a quarter of the places. The reciprocal
#: of the similarity keeps a pair of that similarity together in one branch on average, and no set in many more.
BRANCHES = 1.25
#: Trees whose large places are compared with their pivots before all others.
EARLY = 2
#: Levels of branching that the number of trees reckons with.
DEPTH = 10
#: Sets of a large place whose tokens tell what its centre is.
VOTERS = 128
#: Tokens along which a place branches before its sets meet the next pivot: one at first, where most sets part at
#: once, and more from the third level on, where few are left and each level costs as many jobs.
STRIDES = (1, 1, 3)
#: Sets and shingles that one task compares in full; of a larger cell, each pair of blocks is a task.
CELL_SETS, CELL_SHINGLES = 1024, 1_000_000
#: Sets of a chunk of a large place that one task compares with the pivot.
CHUNK_SETS = 256
#: Levels after which a place that its tokens don't split is compared in full without sketches.
LEVELS = 24
#: Recall of links that the number of trees is chosen for.
RECALL = 0.999

_U = np.uint64
_rng = np.random.default_rng(20240607)
_FLIP = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)[:, None]
_TURN = (_rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * _U(2) + _U(1))[:, None]


def trees(similarity: float, recall: float = RECALL) -> int:
    """Trees that find a pair of this similarity with the given probability, through ``DEPTH`` levels of branching.

    A branch keeps the pair with the similarity as probability; the pair survives a level if any branch keeps it.
    """
    alive = 1.0
    for _ in range(DEPTH):
        alive = 1 - (1 - similarity * alive) * (1 - (BRANCHES - 1) * similarity * alive)
    return min(TOKENS, max(1, ceil(log(1 - recall) / log(1 - similarity * alive))))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text the ascending hashes of its distinct shingles; a shorter text is one shingle."""
    folded = FOLD[buf]
    starts, ends, first = word_spans(folded, offs, NONSPACE)
    h = hash_spans(folded, starts, ends)
    grams = window_hashes(h, words)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        else:
            yield window_hashes(h[a:b], b - a) ^ _U(b - a) if b > a else grams[:0]


def minwise(values: np.ndarray) -> np.ndarray:
    best = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=_U)
    for k in range(0, len(values), 2048):
        np.minimum(best, ((values[None, k : k + 2048] ^ _FLIP) * _TURN).min(axis=1), out=best)
    return (best >> _U(32)).astype(np.uint32)


def profile(texts: pa.Array, words: int) -> pa.Array:
    out = []
    with np.errstate(over="ignore"):
        for lo, hi, buf, offs in slabs(texts):
            size, same, tokens = [], [], np.zeros((hi - lo, TOKENS), dtype=np.uint32)
            for k, s in enumerate(shingle_sets(buf, offs, words)):
                size.append(len(s))
                same.append(hashlib.sha256(s.tobytes()).digest()[:16])
                tokens[k] = minwise(s)
            sketch = (tokens ^ (tokens >> np.uint32(8)) ^ (tokens >> np.uint32(16))).astype(np.uint8)
            out.append(pa.StructArray.from_arrays([
                pa.array(size, pa.int64()), pa.array(same, pa.binary()), lists(tokens.view(np.int32).ravel(), np.full(hi - lo, TOKENS), pa.int32()),
                pa.array([x.tobytes() for x in sketch], pa.binary()),
            ], names=["n_shingles", "same", "tokens", "sketch"]))
    return pa.concat_arrays(out)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    return label


def leaf_cells(node: np.ndarray, rep: np.ndarray, part: np.ndarray, sketch: np.ndarray, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the arrays, and the cell of each: sets of equal ``node`` that sketches connect.

    Sketches of a pair have to agree in ``agree`` bytes; sets of equal ``part`` are linked already, and a cell
    holds more than one part. A cell is named by its members, so that equal cells of several trees are one.
    """
    new = np.ones(len(node), dtype=bool)
    new[1:] = node[1:] != node[:-1]
    head = np.flatnonzero(new)
    place = np.arange(len(node)) - np.repeat(head, np.diff(np.append(head, len(node))))
    done, a, b = np.cumsum(place), [], []
    lo = 0
    while lo < len(node):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + 50_000, "right")))
        count = place[lo:hi]
        left = np.repeat(np.arange(lo, hi), count)
        right = left - np.repeat(count, count) + ranges(count)
        other = part[left] != part[right]
        left, right = left[other], right[other]
        close = (sketch[left] == sketch[right]).sum(axis=1) >= agree
        a.append(left[close])
        b.append(right[close])
        lo = hi
    a, b = np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)
    root = _roots(len(node), a, b)
    some = np.unique(np.concatenate((a, b)))
    total = np.zeros(len(node), dtype=_U)
    with np.errstate(over="ignore"):
        np.add.at(total, root[some], mix(rep[some].astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1)))
    return some, total[root[some]].view(np.int64)


def _whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a sorted stream in tables that don't cut a run of equal ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of few sets: rare shingles by their pairs, frequent ones as a matrix product."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    out = np.zeros(n * n, dtype=np.int64)
    order = np.argsort(which, kind="stable")
    times = often[which[order]]
    rare = owner[order][(times > 1) & (times <= 32)]
    times = times[(times > 1) & (times <= 32)]
    head = np.arange(len(rare)) - ranges(often[(often > 1) & (often <= 32)])
    for lo in range(0, len(rare), 100_000):
        count = times[lo : lo + 100_000]
        out += np.bincount(np.repeat(rare[lo : lo + 100_000], count) * n + rare[np.repeat(head[lo : lo + 100_000], count) + ranges(count)], minlength=n * n)
    out = out.reshape(n, n)
    column = np.cumsum(often > 32) - 1
    kept = often[which] > 32
    row, col = owner[kept], column[which[kept]]
    for lo in range(0, int(column[-1]) + 1, 2048):
        here = (col >= lo) & (col < lo + 2048)
        m = np.zeros((n, 2048), dtype=np.float32)
        m[row[here], col[here] - lo] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def exact_roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Components of sets linked when ``100 * intersection >= percent * union``: the first member of each."""
    if len(sets) < 2:
        return np.arange(len(sets))
    size = np.array([len(s) for s in sets])
    shared = intersections(sets)
    a, b = np.nonzero(np.triu(100 * shared >= percent * (size[:, None] + size[None, :] - shared), 1))
    return _roots(len(sets), a, b)


def linked_to_first(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets are linked to the first."""
    out = np.zeros(len(sets), dtype=bool)
    for k, s in enumerate(sets):
        if 100 * min(len(s), len(sets[0])) >= percent * max(len(s), len(sets[0])):
            shared = len(np.intersect1d(s, sets[0], assume_unique=True))
            out[k] = 100 * shared >= percent * (len(s) + len(sets[0]) - shared)
    return out


def _sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [s for _, _, buf, offs in slabs(texts) for s in shingle_sets(buf, offs, words)]


def _combined(table: pa.Table, column: str) -> pa.Array:
    chunks = table.column(column).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


class _Texts:
    """The texts that sets come from, and their comparison on full sets."""

    def __init__(self, keyed: DataFrame, reps: DataFrame, words: int, percent: int):
        self.keyed, self.reps, self.words, self.percent = keyed, reps, words, percent

    def _compare(self, rows: DataFrame, n_rows: int, star: bool) -> DataFrame:
        """Links ``a``, ``b`` found in each ``cell`` of rows ``cell``, ``rep``, ``same`` and ``first``.

        In a star only those to the set that comes first are looked for.
        """
        words, percent = self.words, self.percent
        texts = self.keyed.join(if_small(rows.withColumnRenamed("rep", "doc_id"), n_rows), "doc_id")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _whole_runs(batches, "cell"):
                cell, ids, same = t.column("cell").to_numpy(), t.column("doc_id").to_numpy(), t.column("same")
                cut = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    sets, at = _own_sets(_combined(t.slice(a, b - a), "text"), ids[a:b], same.slice(a, b - a).to_pylist(), words)
                    own = ids[a:b][at]
                    if star:
                        root = np.zeros(len(own), dtype=np.int64)
                        far = linked_to_first(sets, percent) & (own != own[:1])
                    else:
                        root = exact_roots(sets, percent)
                        far = root != np.arange(len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(own[far], pa.int64()), pa.array(own[root[far]], pa.int64())], names=["a", "b"])

        dealt = texts.repartition("cell").sortWithinPartitions("cell", F.desc("first"), "doc_id")
        return materialize(dealt.select("cell", "doc_id", "same", "text").mapInArrow(confirm, "a long, b long"), "links")

    def stars(self, pairs: DataFrame) -> DataFrame:
        """Links among pairs ``rep``, ``pivot``, each in a ``chunk`` of the pivot's."""
        cell = F.xxhash64("pivot", "chunk").alias("cell")
        pairs = materialize(pairs, "asked")
        rows = pairs.select("rep", cell, F.lit(False).alias("first")).union(pairs.select(F.col("pivot").alias("rep"), cell, F.lit(True).alias("first")).distinct())
        return self._compare(rows.join(self.reps.select("rep", "same"), "rep"), 2 * pairs.count(), star=True)

    def cells(self, members: DataFrame) -> DataFrame:
        """Links that connect what is linked within cells, from rows ``cell``, ``rep``.

        A cell with more sets or shingles than a task takes is dealt to blocks, and each pair of blocks is a cell.
        """
        rows = materialize(members.select("cell", "rep").distinct().join(self.reps.select("rep", "same", "n_shingles"), "rep"), "members")
        blocks = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_SETS), F.ceil(F.sum("n_shingles") / CELL_SHINGLES), F.lit(1))
        sizes = materialize(rows.groupBy("cell").agg(blocks.cast("int").alias("blocks")).where("blocks > 1"), "sizes")
        sized = rows.join(if_small(sizes, sizes.count()), "cell", "left").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != F.col("block"))
        pairs = F.transform(others, lambda k: F.xxhash64("cell", F.least(k, "block"), F.greatest(k, "block")))
        dealt = sized.select(F.explode(F.coalesce(pairs, F.array("cell"))).alias("cell"), "rep", "same", F.lit(False).alias("first"))
        dealt = materialize(dealt, "dealt")
        return self._compare(dealt, dealt.count(), star=False)


def _own_sets(texts: pa.Array, ids: np.ndarray, same: list[bytes], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sets of the rows that are the ones meant, each once, and their places."""
    sets, at, seen = [], [], set()
    for k, s in enumerate(_sets_of(texts, words)):
        if (ids[k], same[k]) not in seen and hashlib.sha256(s.tobytes()).digest()[:16] == same[k]:
            seen.add((ids[k], same[k]))
            sets.append(s)
            at.append(k)
    return sets, np.array(at, dtype=np.int64)


def _alike(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _centres(deep: DataFrame) -> DataFrame:
    """``node``, ``pivot`` and ``pivot_tokens``: of each place the set that agrees most with the commonest tokens.

    The tokens are counted over some ``VOTERS`` sets of a place. Sets not linked to a pivot yet come first. If
    the sets of a place derive from one of them, it is the one that all are linked to.
    """
    voters = deep.where(F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col("n") / VOTERS)) == 0)
    common = materialize(voters.groupBy("node").agg(F.array(*[F.mode(F.get("tokens", F.lit(k)), True) for k in range(TOKENS)]).alias("common")), "common")
    # The few rows of places go to the sets, which stay where they are: a task needn't take a whole place.
    met = deep.join(if_few(common, "common"), "node", "left").withColumn("rank", F.struct(F.col("part").isNull(), F.coalesce(_alike("tokens", "common"), F.lit(0)), F.xxhash64("rep"), "rep"))
    return met.groupBy("node").agg(F.max(F.struct("rank", "rep", "tokens")).alias("best")).select("node", F.col("best.rep").alias("pivot"), F.col("best.tokens").alias("pivot_tokens"))


def _paths(node: Column, depth: int) -> Column:
    """The places that a set with ``tokens`` goes to from a place, some tokens further."""
    places = F.array(node)
    for k in range(STRIDES[min(depth, len(STRIDES)) - 1]):
        token = lambda p, b: F.get("tokens", F.pmod(F.xxhash64(p, F.lit(b), F.lit(depth)), F.lit(TOKENS)).cast("int"))
        step = lambda p, b: F.xxhash64(p, F.lit(b), token(p, b))
        twice = lambda p, k=k: F.pmod(F.xxhash64(p, F.lit(depth), F.lit(k)), F.lit(1000)) < int(1000 * (BRANCHES - 1))
        places = F.flatten(F.transform(places, lambda p: F.when(twice(p), F.array(step(p, 0), step(p, 1))).otherwise(F.array(step(p, 0)))))
    return places


def links(reps: DataFrame, texts: _Texts, similarity: float, recall: float = RECALL) -> DataFrame:
    """Links ``a``, ``b`` between sets, confirmed on full sets, that connect what is linked.

    ``reps`` has ``rep``, ``tokens`` and ``sketch``. Sketches have to agree in a share that lies five standard
    deviations of their estimate below the similarity, so that they lose next to nothing. ``part`` names the
    pivot that a set is linked to; sets of equal part needn't be compared, and a place that holds but one part
    is done.
    """
    agree = int(TOKENS * (similarity - 0.25))
    starts = F.array(*[F.xxhash64(F.lit(t), F.get("tokens", F.lit(t))) for t in range(trees(similarity, recall))])
    level = reps.select("rep", F.explode(starts).alias("node")).withColumn("part", F.lit(None).cast("bigint"))
    edges, few, rest, depth = [], [], None, 0

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches, "node"):
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
            rep, part = t.column("rep").to_numpy(), t.column("part").to_numpy()
            at, cell = leaf_cells(t.column("node").to_numpy(), rep, part, sketch, agree)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(rep[at])], names=["cell", "rep"])

    def placed_in(level: DataFrame) -> DataFrame:
        """``level`` with ``n`` and ``large`` of each place that has two sets that aren't known to be linked."""
        parts = level.groupBy("node", "part").agg(F.count(F.lit(1)).alias("n"))
        held = F.coalesce(F.max(F.when(F.col("part").isNotNull(), F.col("n"))), F.lit(0))
        places = parts.groupBy("node").agg(F.sum("n").alias("n"), held.alias("held"))
        free = F.col("n") - F.col("held")
        large = (F.col("n") > LEAF) & ((free * F.col("n") > LEAF * LEAF) | (F.col("n") > 64 * LEAF))
        places = materialize(places.where((F.col("n") > 1) & (free > 0)).select("node", "n", large.alias("large")), "places")
        return materialize(level.join(places, "node"), "placed")

    def compared(deep: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Sets of large places with their pivot, and the links to it."""
        deep = materialize(deep.select("node", "rep", "part", "n").join(reps.select("rep", "tokens"), "rep"), "large")
        centres = materialize(_centres(deep), "centres")
        met = deep.join(if_few(centres, "pivot_tokens"), "node").withColumn("near", _alike("tokens", "pivot_tokens") >= agree).drop("pivot_tokens")
        chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / CHUNK_SETS)).alias("chunk")
        return met, texts.stars(met.where((F.col("rep") != F.col("pivot")) & F.col("near")).select("rep", "pivot", chunk).distinct())

    # What the large places of the first trees link is one part in all trees: large families go along but once.
    early = placed_in(reps.select("rep", F.explode(F.slice(starts, 1, EARLY)).alias("node")).withColumn("part", F.lit(None).cast("bigint"))).where("large")
    if not early.isEmpty():
        edges.append(compared(early)[1])
        parts = components(edges[0]).select(F.col("node").alias("rep"), F.col("component").alias("part"))
        level = level.drop("part").join(if_small(parts, parts.count()), "rep", "left").select("rep", "node", "part")

    while True:
        placed = placed_in(level)
        few.append(placed.where("not large").select("node", "rep", F.coalesce("part", "rep").alias("part")))
        deep = placed.where("large")
        if deep.isEmpty():
            break
        depth += 1
        if depth > LEVELS:
            rest = deep.select(F.col("node").alias("cell"), "rep")
            break
        met, star = compared(deep)
        edges.append(star)
        # Only a set that was compared with the pivot can be linked to it; the others needn't meet the links.
        covered = star.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), F.lit(True).alias("covered")).distinct()
        near = met.where("near").join(if_small(covered, covered.count()), ["rep", "pivot"], "left")
        # A set keeps the part it has: the pivot may be of another one, and then the two are linked by this edge.
        near = near.select("node", "rep", "tokens", F.coalesce("part", F.when(F.col("covered") | (F.col("rep") == F.col("pivot")), F.col("pivot"))).alias("part"))
        known = near.union(met.where("not near").select("node", "rep", "tokens", "part"))
        # Places are counted over the level and joined to it: written once, its paths are made once.
        level = materialize(known.select("rep", "part", F.explode(F.array_distinct(_paths(F.col("node"), depth))).alias("node")), "level")
    small = reduce(DataFrame.union, few).join(reps.select("rep", "sketch"), "rep")
    found = small.repartition("node").sortWithinPartitions("node").select("node", "rep", "part", "sketch").mapInArrow(leaves, "cell long, rep long")
    edges.append(texts.cells(found if rest is None else found.union(rest)))
    return reduce(DataFrame.union, edges)


def link(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    Documents are linked if their sets of distinct shingles of ``words`` words have
    ``100 * intersection >= percent * union``; a text with fewer words is one shingle. ``component_id`` is the
    smallest id reachable; ``kept`` tells whether it is the document's own. A null or empty text has no shingle
    and is linked with nothing, nor is a document whose id is null (its component is null, and it is kept).
    Rows that repeat an id and a text share a component and are all kept or all not; an id with several texts
    has the links of all of them. Other columns are ignored. Ids are whole numbers; other types are refused.
    """
    require_integral(docs, doc_id)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield profile(texts, words)

    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    kind = "n_shingles long, same binary, tokens array<int>, sketch binary"
    profiles = materialize(keyed.select("doc_id", F.arrow_udf(scan, kind).asNondeterministic()("text").alias("p")).select("doc_id", "p.*"), "profiles")
    filled = profiles.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    reps = filled.groupBy("same").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    reps = materialize(reps, "reps")
    final = components(links(reps, _Texts(keyed, reps, words, percent), percent / 100, recall))
    ids = reps.where("rep < last").select("rep", "same").withColumn("component_id", F.col("rep"))
    linked = reps.select("rep", "same").join(if_small(final, final.count()), F.col("rep") == F.col("node")).select("rep", "same", F.col("component").alias("component_id"))
    moved = materialize(ids.union(linked).groupBy("same").agg(F.min("component_id").alias("component_id")), "moved")
    known = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    joined = profiles.select("doc_id", "n_shingles", "same").join(if_small(moved, moved.count()), "same", "left")
    component = F.when(known, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Options as for :func:`link`."""
    name = free_name(docs, "_gone")
    gone = link(docs, doc_id=doc_id, **options).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone = materialize(gone, "gone")
    return docs.join(if_small(gone, gone.count()), F.col(doc_id) == F.col(name), "left_anti")
