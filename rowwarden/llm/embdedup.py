"""Near duplicates of embeddings through hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node. Vectors are dealt to shards; each shard gets a graph whose layers are nested
subsets, built from the top down: vectors enter a layer in batches, are searched from what the layer above
found, and keep diverse neighbours. Of more than ``PLAIN`` vectors of a length only a sample, the pivots, are
nodes of these layers, and every vector hangs below the pivot nearest to it: a batch of queries walks the graph
together and goes down from each pivot where links of a query can be. All queries pass every shard: a task opens
one graph and one block of queries, both bounded in bytes, without a copy of either per pair on disk. A query
with very many links is compared with the whole shard; all beams of a block are widened if an audit, which
compares some queries with the whole shard, misses links. Links are verified by cosine in double precision.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bound_batches, if_small, materialize, require_integral
from .graphs import components

DEGREE, SPARE, BEAM, BATCH = 16, 8, 64, 256
#: Shards; more once a shard would exceed ``SHARD_BYTES`` of vectors, which is what a task must hold, a few times over.
SHARDS, SHARD_BYTES = 6, 16 << 20
#: Vectors of a length up to which all are nodes of their graphs; pivots of so many that have more, and the bytes these may take.
PLAIN, PIVOTS, PIVOT_BYTES = 4096, lambda n: round((0.4 * n) ** (2 / 3)), 32 << 20
#: How far below its mean the similarity of a query to the pivot of a linked vector may be, in standard deviations.
SLACK = 2.8
#: Pivots of a shard by which is measured in how many directions they spread.
PIVOT_SAMPLE = 512
#: Shares of the vectors of a shard, those farthest from their pivots first, that have bounds of their own in each cell.
BANDS = (0.25, 0.6)
#: Bytes of similarities that are held at once, and links of a query from which on it is compared with the whole shard.
PIECE, MANY = 16 << 20, 1024
#: Queries of a batch, queries of a block that are audited, and the mean share of its links that a query with links must find.
BLOCK_ROWS, AUDITED, AUDIT_RECALL = 32768, 128, 0.99
#: Links of a query within a shard up to which it is also audited among those with few.
FEW = 16
#: Rows of results, with their digests, that may be broadcast.
BROADCAST_VECTORS = 200_000


def _select(sims: np.ndarray, vectors: np.ndarray, degree: int) -> np.ndarray:
    """For rows of candidates in falling similarity (``-inf``: none), which to keep: diverse ones first, then the nearest."""
    alike = np.matmul(vectors, vectors.transpose(0, 2, 1))
    keep = np.zeros(sims.shape, dtype=bool)
    for k in range(sims.shape[1]):
        blocked = np.where(keep, alike[:, k, :], -np.inf).max(axis=1)
        keep[:, k] = np.isfinite(sims[:, k]) & (sims[:, k] > blocked) & (keep.sum(axis=1) < degree)
    spare = np.isfinite(sims) & ~keep
    room = degree - keep.sum(axis=1, keepdims=True)
    return keep | spare & (np.cumsum(spare, axis=1) <= room)


class Graph:
    """Layers of neighbour lists over unit vectors; ``layers[0]`` is the top."""

    def __init__(self, vectors: np.ndarray, seed: int = 0):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.float32)
        n = len(vectors)
        self._seen = np.zeros(0, dtype=bool)
        level = np.floor(-np.log(np.random.default_rng(seed).uniform(1e-9, 1, n)) / np.log(DEGREE)).astype(int)
        self.layers: list[np.ndarray] = []
        self.entry = int(level.argmax()) if n else 0
        for floor in range(level.max(initial=0), -1, -1):
            members = np.flatnonzero(level >= floor)
            links = np.full((n, DEGREE + SPARE), -1, dtype=np.int32)
            members = np.concatenate(([self.entry], members[members != self.entry]))
            self._fill(links, members)
            self._mend(links, members)
            self.layers.append(links)

    def _fill(self, links: np.ndarray, members: np.ndarray) -> None:
        done = 1
        while done < len(members):
            new = members[done : done + min(BATCH, done)]
            q = self.vectors[new]
            start = self._descend(q)
            ids, sims = self._search(q, start, links, BEAM)
            own = q @ q.T
            own[np.triu_indices(len(new))] = -np.inf  # those before in the batch
            top = np.argsort(-own, axis=1)[:, : DEGREE]
            ids = np.concatenate([ids, new[top]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, top, 1)], axis=1)
            order = np.argsort(-sims, axis=1)[:, :BEAM]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            keep = _select(sims, self.vectors[np.maximum(ids, 0)], DEGREE)
            self._store(links, new, ids, keep)
            source, place = np.nonzero(keep)
            self._back(links, ids[source, place], new[source], sims[source, place])
            done += len(new)

    def _mend(self, links: np.ndarray, members: np.ndarray) -> None:
        """Gives every member that can't be reached from the entry a link from one of its neighbours, in spare places."""
        reached = np.zeros(len(links), dtype=bool)
        front = np.array([self.entry])
        lost = members
        while len(lost):
            while len(front):
                reached[front] = True
                front = np.unique(links[front])
                front = front[(front >= 0)]
                front = front[~reached[front]]
            lost = members[~reached[members]]
            for u in lost:
                near = links[u, :DEGREE]
                near = near[near >= 0]
                room = near[reached[near] & (links[near, -1] < 0)]
                if len(room):
                    links[room[0], DEGREE + int((links[room[0], DEGREE:] >= 0).sum())] = u
                    front = np.append(front, u)
            if len(lost) and not len(front):
                # None of the neighbours is reached or has room: any reached one with room will do.
                free = members[reached[members] & (links[members, -1] < 0)]
                best = free[int((self.vectors[free] @ self.vectors[lost[0]]).argmax())]
                links[best, DEGREE + int((links[best, DEGREE:] >= 0).sum())] = lost[0]
                front = lost[:1]

    def _store(self, links: np.ndarray, rows: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> None:
        order = np.argsort(~keep, axis=1, kind="stable")[:, :DEGREE]
        links[rows, :] = -1
        links[rows, : order.shape[1]] = np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(ids, order, 1), -1)

    def _back(self, links: np.ndarray, to: np.ndarray, new: np.ndarray, sims: np.ndarray) -> None:
        """Adds ``new`` to the lists of ``to``, keeping diverse neighbours where a list overflows."""
        order = np.lexsort((-sims, to))
        to, new = to[order], new[order]
        rows, head, count = np.unique(to, return_index=True, return_counts=True)
        rank = np.arange(len(to)) - np.repeat(head, count)
        wide = np.full((len(rows), 2 * DEGREE), -1, dtype=np.int64)
        wide[:, :DEGREE] = links[rows, :DEGREE]
        some = rank < DEGREE
        wide[np.repeat(np.arange(len(rows)), count)[some], DEGREE + rank[some]] = new[some]
        v = self.vectors[np.maximum(wide, 0)]
        s = np.where(wide >= 0, np.einsum("rkd,rd->rk", v, self.vectors[rows]), -np.inf)
        order = np.argsort(-s, axis=1)
        wide, s = np.take_along_axis(wide, order, 1), np.take_along_axis(s, order, 1)
        self._store(links, rows, wide, _select(s, self.vectors[np.maximum(wide, 0)], DEGREE))

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """Entry points from the layers that are there, one each."""
        start = np.full((len(q), 1), self.entry, dtype=np.int64)
        for links in self.layers:
            start = self._search(q, start, links, 4)[0][:, :1]
        return start

    def _search(self, q: np.ndarray, start: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search in one layer: ids and similarities in falling order, ``-1`` and ``-inf`` where there are fewer."""
        n, rows = len(self.vectors), len(q)
        if len(self._seen) < rows * n:
            self._seen = np.zeros(rows * n, dtype=bool)
        seen, touched = self._seen, []
        ids = np.full((rows, beam), -1, dtype=np.int64)
        sims = np.full((rows, beam), -np.inf, dtype=np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.einsum("rkd,rd->rk", self.vectors[start], q)
        touched.append((np.arange(rows)[:, None] * n + start).ravel())
        seen[touched[0]] = True
        open_ = np.isfinite(sims)
        active = np.arange(rows)
        step = np.arange(min(4, beam))
        while len(active):
            # The best of the beam that aren't expanded yet.
            order = np.argsort(~open_[active], axis=1, kind="stable")[:, step]
            expand = np.take_along_axis(open_[active], order, 1)
            at = np.take_along_axis(ids[active], order, 1)
            np.put_along_axis(sub := open_[active], order, False, 1)
            open_[active] = sub
            near = np.where(expand[:, :, None], links[np.maximum(at, 0)], -1).reshape(len(active), -1).astype(np.int64)
            r, c = np.nonzero(near >= 0)
            flat = active[r] * n + near[r, c]
            fresh = ~seen[flat]
            flat = np.unique(flat[fresh])
            seen[flat] = True
            touched.append(flat)
            row, ident = flat // n, flat % n
            s = np.einsum("kd,kd->k", self.vectors[ident], q[row])
            count = np.bincount(row, minlength=rows)
            width = int(count.max(initial=0))
            if width:
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                wide = np.full((len(active), beam + width), -1, dtype=np.int64)
                value = np.full((len(active), beam + width), -np.inf, dtype=np.float32)
                fresh_open = np.zeros((len(active), beam + width), dtype=bool)
                wide[:, :beam], value[:, :beam], fresh_open[:, :beam] = ids[active], sims[active], open_[active]
                local = np.searchsorted(active, row)
                wide[local, beam + place], value[local, beam + place], fresh_open[local, beam + place] = ident, s, True
                best = np.argsort(-value, axis=1, kind="stable")[:, :beam]
                ids[active], sims[active], open_[active] = (np.take_along_axis(x, best, 1) for x in (wide, value, fresh_open))
            active = active[open_[active].any(axis=1)]
        for flat in touched:  # only these: clearing all of it would take time in proportion to the shard
            seen[flat] = False
        return ids, sims

    def within(self, q: np.ndarray, least: float, beam: int) -> list[np.ndarray | None]:
        """For each query the ids found with at least this similarity, or None if even its widened beam is full of them."""
        out: list[np.ndarray | None] = [None] * len(q)
        n = len(self.vectors)
        todo = np.arange(len(q))
        for width in (beam, 4 * beam) if beam < n else (n,):
            again = []
            step = max(1, min(BATCH, 40_000_000 // max(n, 1)))
            for k in range(0, len(todo), step):
                rows = todo[k : k + step]
                ids, sims = self._search(q[rows], self._descend(q[rows]), self.layers[-1], width) if width < n else self._all(q[rows])
                good = sims >= least
                full = good.all(axis=1) & (width < n)
                for row, i, g in zip(rows[~full], ids[~full], good[~full], strict=True):
                    out[row] = i[g]
                again.append(rows[full])
            todo = np.concatenate([*again, np.zeros(0, np.int64)]).astype(np.int64)
        return out

    def _all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.broadcast_to(np.arange(len(self.vectors)), (len(q), len(self.vectors))), q @ self.vectors.T


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = np.asarray(raw, dtype=np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


class Cells:
    """A graph of pivots with every vector of a shard below the pivot that is nearest to it.

    A query that is linked to a vector is, by their cosine, near the pivot of that vector: at ``threshold`` times
    the vector's own similarity on average, less by what a random direction adds. A beam of ``BEAM`` allows for
    ``SLACK`` deviations of that, wider ones for more; at the full length of that part nothing can be missed.
    """

    def __init__(self, own: np.ndarray, cell: np.ndarray, graph: Graph):
        pivots = graph.vectors
        near = np.einsum("kd,kd->k", own, pivots[cell].astype(np.float64))
        band = np.searchsorted(np.quantile(near, BANDS), near, side="right")
        code = cell.astype(np.int64) * (len(BANDS) + 1) + band
        self.order = np.argsort(code, kind="stable")
        codes, self.first = np.unique(code[self.order], return_index=True)
        self.last = np.append(self.first[1:], len(own))
        self.pivot = codes // (len(BANDS) + 1)
        self.near = np.minimum.reduceat(near[self.order], self.first)
        self.vectors, self.graph = own[self.order].astype(np.float32), graph
        alike = (pivots[: PIVOT_SAMPLE] @ pivots[: PIVOT_SAMPLE].T)[~np.eye(min(len(pivots), PIVOT_SAMPLE), dtype=bool)]
        #: In how many directions the pivots spread evenly.
        self.spread = 1 / float(np.square(alike, dtype=np.float64).mean()) if len(pivots) > 8 else 1.0

    def _bounds(self, least: float, beam: int) -> np.ndarray:
        """The least similarity to its pivot with which a query goes down to each part of a cell."""
        share = min(1.0, SLACK * beam / BEAM / max(self.spread - 1, 1e-9) ** 0.5)
        near, least = np.clip(self.near, -1, 1), min(max(least, -1.0), 1.0)
        bounds = least * near - share * np.sqrt((1 - least * least) * (1 - near * near)) - 1e-5
        # What is nearer to its pivot than a link reaches can be asked for by all that are nearer still.
        return np.where(beam >= len(self.order), -2.0, np.minimum(bounds, least))

    def _walk(self, q: np.ndarray, bounds: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pivots that a batch of queries reaches, and their similarities to all of these, a row for each pivot."""
        n = len(self.graph.vectors)
        low = np.full(n, np.inf)
        np.minimum.at(low, self.pivot, bounds)
        row, best, opened = np.full(n, -1), np.full(n, -np.inf), np.zeros(n, dtype=bool)
        sims = np.empty((n, len(q)), dtype=np.float32)
        new, found = np.array([self.graph.entry]), np.zeros(0, dtype=np.int64)
        for depth, links in enumerate(self.graph.layers):
            opened[:] = False
            while True:
                if len(new):
                    row[new] = np.arange(len(found), len(found) + len(new))
                    part = sims[len(found) : len(found) + len(new)]
                    np.matmul(self.graph.vectors[new], q.T, out=part)
                    best[new] = part.max(axis=1)
                    found = np.append(found, new)
                # Those below which a query may go down, and the best others: only these in the layers above the last.
                rank = best[found]
                open_ = rank >= np.partition(rank, -min(beam, len(rank)))[-min(beam, len(rank))]
                if depth == len(self.graph.layers) - 1:
                    open_ |= rank >= low[found]
                at = found[open_ & ~opened[found]]
                if not len(at):
                    break
                opened[at] = True
                new = np.unique(links[at])
                new = new[new >= 0]
                new = new[row[new] < 0]
            new = np.zeros(0, dtype=np.int64)
        return row, sims

    def pairs(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries and ids found with at least this similarity, and the queries with too many of them, which aren't among these."""
        bounds = self._bounds(least, beam)
        row, sims = self._walk(q, bounds, beam)
        rows, ats, count = [], [], np.zeros(len(q), dtype=np.int64)
        for pivot, first, last, bound in zip(self.pivot.tolist(), self.first.tolist(), self.last.tolist(), bounds.tolist(), strict=True):
            if row[pivot] < 0:
                continue
            ask = np.flatnonzero(sims[row[pivot]] >= bound)
            step = max(1, PIECE // (4 * (last - first)))
            for lo in range(0, len(ask), step):
                part = ask[lo : lo + step]
                hit = np.flatnonzero(q[part] @ self.vectors[first:last].T >= least)
                if len(hit):
                    r, c = np.divmod(hit, last - first)
                    some = count[part[r]] <= MANY
                    r, c = part[r[some]], c[some]
                    rows.append(r.astype(np.int32))
                    ats.append((c + first).astype(np.int32))
                    count += np.bincount(r, minlength=len(q))
        full = np.flatnonzero(count > MANY)
        r, at = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (rows, ats))
        if len(full):
            some = count[r] <= MANY
            r, at = r[some], at[some]
        return r.astype(np.int64), self.order[at], full

    def within(self, q: np.ndarray, least: float, beam: int) -> list[np.ndarray | None]:
        """As :meth:`Graph.within`."""
        r, at, full = self.pairs(q, least, beam)
        order = np.argsort(r, kind="stable")
        out: list[np.ndarray | None] = list(np.split(at[order], np.searchsorted(r[order], np.arange(1, len(q)))))
        for k in full:
            out[k] = None
        return out


class Shard:
    """A graph with its vectors, and what is known of the components of its vectors so far."""

    def __init__(self, raw: np.ndarray, ids: np.ndarray, copies: np.ndarray, graph: Graph | Cells | None = None):
        self.own, self.ids, self.copies = _unit(raw), ids, copies
        self.graph = graph or Graph(self.own)
        self.root = np.arange(len(ids))

    def _pairs(self, q32: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries and what they find, and the queries that find too much."""
        if isinstance(self.graph, Cells):
            return self.graph.pairs(q32, least, beam)
        found = self.graph.within(q32, least, beam)
        full = np.flatnonzero([f is None for f in found])
        row = np.repeat(np.arange(len(q32)), [0 if f is None else len(f) for f in found])
        return row, np.concatenate([*(f for f in found if f is not None), np.zeros(0, np.int64)]).astype(np.int64), full

    def search(self, q_raw: np.ndarray, q_ids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links of each query to vectors of the shard, with their copies, and edges that connect what is linked."""
        least, beam = threshold - 1e-4, BEAM
        audit = np.unique(np.linspace(0, len(q_raw) - 1, AUDITED).astype(int))
        asked = _unit(q_raw[audit])
        truth = ((asked @ self.own.T) >= threshold) & (self.ids[None, :] != q_ids[audit][:, None])
        total = truth.sum(axis=1)
        # Queries of a large cluster, which find their links easily, don't speak for those with few links.
        kinds = [k for k in (total > 0, (total > 0) & (total <= FEW)) if k.any()]
        while kinds:
            row, at, full = self._pairs(asked.astype(np.float32), least, beam)
            got = np.bincount(row, weights=truth[row, at], minlength=len(audit))
            got[full] = total[full]
            recall = got / np.maximum(total, 1)
            if all(recall[k].mean() >= AUDIT_RECALL for k in kinds) or beam >= len(self.ids):
                break
            beam *= 2
        links, a, b = np.zeros(len(q_raw), dtype=np.int64), [], []
        for lo in range(0, len(q_raw), BLOCK_ROWS):
            q = _unit(q_raw[lo : lo + BLOCK_ROWS])
            row, at, full = self._pairs(q.astype(np.float32), least, beam)
            few = PIECE // (8 * q.shape[1])
            for k in range(0, len(row), few):
                self._count(q, q_ids[lo : lo + BLOCK_ROWS], lo, row[k : k + few], at[k : k + few], threshold, links, a, b)
            # Queries of a dense cluster: all cosines by one matrix product.
            few = max(1, PIECE // (8 * len(self.ids)))
            for k in range(0, len(full), few):
                some, dense = np.nonzero(q[full[k : k + few]] @ self.own.T >= threshold)
                self._count(q, q_ids[lo : lo + BLOCK_ROWS], lo, full[k : k + few][some], dense, None, links, a, b)
        return links, np.concatenate([*a, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.zeros(0, np.int64)]).astype(np.int64)

    def _count(self, q: np.ndarray, q_ids: np.ndarray, lo: int, row: np.ndarray, at: np.ndarray, threshold: float | None, links: np.ndarray, a: list, b: list) -> None:
        """Adds the links among these pairs, or all of them without a threshold, to ``links``, and edges to ``a`` and ``b``."""
        true = q_ids[row] != self.ids[at]
        if threshold is not None:
            true &= np.einsum("kd,kd->k", q[row], self.own[at]) >= threshold
        row, at = row[true], at[true]
        if not len(row):
            return
        links[lo : lo + len(q)] += np.bincount(row, weights=self.copies[at], minlength=len(q)).astype(np.int64)
        # A query and the components it meets become one; an edge for the query and for each component that joins.
        met = np.divmod(np.unique(row * len(self.root) + self.root[at]), len(self.root))
        labels, code = np.unique(met[1], return_inverse=True)
        queries, asks = np.unique(met[0], return_inverse=True)
        top = _roots(len(labels) + len(queries), code, asks + len(labels))
        moved = np.flatnonzero(top[: len(labels)] != np.arange(len(labels)))
        a += [q_ids[queries], self.ids[labels[moved]]]
        b += [self.ids[labels[top[len(labels) :]]], self.ids[labels[top[moved]]]]
        new = np.arange(len(self.root))
        new[labels] = labels[top[: len(labels)]]
        self.root = new[self.root]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new][root]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _prepared(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """``vec_id``, and of valid vectors their digest, length and components as bytes."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        n = batch.num_rows
        size = lists.value_lengths().fill_null(0).to_numpy()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)
        end = np.cumsum(size)
        wrong = np.append(0, np.cumsum(~np.isfinite(flat)))
        valid = (size > 0) & (wrong[end] == wrong[end - size]) & (~np.asarray(ids.is_null()))
        most = np.zeros(n)
        some = np.flatnonzero(size)
        if len(some):
            most[some] = np.maximum.reduceat(np.abs(flat), (end - size)[some])
        valid &= most > 0
        # A power of two brings components whose squares leave the range of doubles back into it, exactly.
        for k in np.flatnonzero(valid & ((most < 1e-100) | (most > 1e100))):
            flat[end[k] - size[k] : end[k]] = np.ldexp(flat[end[k] - size[k] : end[k]], 1 - np.frexp(most[k])[1])
        body, wide = flat.tobytes(), flat.itemsize
        v = [body[wide * (e - d) : wide * e] if ok else None for ok, d, e in zip(valid.tolist(), size.tolist(), end.tolist(), strict=True)]
        same = [None if x is None else hashlib.sha256(x).digest() for x in v]
        yield pa.RecordBatch.from_arrays([ids, pa.array(same, pa.binary()), pa.array(size.astype(np.int32), mask=~valid), pa.array(v, pa.binary())], names=["vec_id", "same", "d", "v"])


def _matrix(v: list[bytes], kind: type, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(v), dtype=kind).reshape(-1, d)


def link(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, shards: int = SHARDS) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector, for links of cosine ``threshold`` or more.

    Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing, nor do
    those whose id is null or vectors of different lengths. Rows that repeat an id and a vector count as several
    vectors and share a component. An empty table gives an empty result. Other columns are ignored. Ids are
    whole numbers; other types are refused.

    Every query passes every shard of its length, as blocks that meet in tasks and aren't shuffled for it. With
    pivots in proportion to the power 2/3 of the rows, the comparisons grow with about the power 5/3.
    """
    require_integral(vectors, vec_id)
    bound_batches(vectors.sparkSession)
    given = vectors.select(embedding).schema[0].dataType.elementType
    kind = np.float32 if isinstance(given, T.FloatType) else np.float64
    width = np.dtype(kind).itemsize
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<float>" if width == 4 else "array<double>").alias("v"))
    rows = materialize(rows.mapInArrow(lambda batches: _prepared(batches, kind), "vec_id long, same binary, d int, v binary"), "vectors")
    valid = rows.where("same IS NOT NULL")
    named = materialize(valid.groupBy("same", "d").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "named")
    sizes = {r.d: (r.n, r.first) for r in named.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).collect()}
    shards_of = {d: max(shards, -(-n * d * width // SHARD_BYTES)) for d, (n, _) in sizes.items()}
    pivots = _sampled(valid, named, {d: x for d, x in sizes.items() if x[0] > PLAIN}, kind)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its shard, and its cell there: the place of the nearest pivot among those of the shard."""
        for batch in batches:
            d, rep, v = batch.column("d").to_numpy(), batch.column("rep").to_numpy(), batch.column("v").to_pylist()
            shard, cell = np.zeros(len(d), dtype=np.int32), np.full(len(d), -1, dtype=np.int32)
            for size in np.unique(d).tolist():
                at = np.flatnonzero(d == size)
                if size not in pivots:
                    shard[at] = (rep[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards_of[size])
                    continue
                for lo in range(0, len(at), 2048):
                    part = at[lo : lo + 2048]
                    nearest = (_unit(_matrix([v[k] for k in part], kind, size)).astype(np.float32) @ pivots[size].T).argmax(axis=1)
                    shard[part], cell[part] = nearest % shards_of[size], nearest // shards_of[size]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(shard), pa.array(cell), batch.column("rep"), batch.column("copies"), batch.column("v")], names=["d", "shard", "cell", "rep", "copies", "v"])

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d, shard = (int(k) for k in key)
        pdf = pdf.sort_values(["cell", "rep"])
        raw = _matrix(pdf["v"].tolist(), kind, d)
        graph = Graph(pivots[d][shard :: shards_of[d]] if d in pivots else _unit(raw))
        graph._seen = None
        if d not in pivots:
            graph.vectors = None  # made anew from ``raw``
        body = pickle.dumps((graph, pdf["cell"].to_numpy()), protocol=5)
        return pd.DataFrame({"d": [d], "shard": [shard], "rep": [pdf["rep"].to_numpy().tobytes()], "copies": [pdf["copies"].to_numpy().tobytes()], "v": [raw.tobytes()], "graph": [body]})

    reps = valid.groupBy("same", "d").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).drop("same")
    dealt = reps.mapInArrow(deal, "d int, shard int, cell int, rep long, copies long, v binary")
    blocks = materialize(dealt.groupBy("d", "shard").applyInPandas(build, "d int, shard int, rep binary, copies binary, v binary, graph binary"), "blocks")
    asking = blocks.select(F.col("d").alias("q_d"), F.col("rep").alias("q_rep"), F.col("v").alias("q_v"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row] for c in batch.schema.names}
                if held != (key := (one["d"].as_py(), one["shard"].as_py())):
                    held, shard = key, _loaded(one, kind)
                q_ids = np.frombuffer(one["q_rep"].as_buffer(), dtype=np.int64)
                links, a, b = shard.search(np.frombuffer(one["q_v"].as_buffer(), dtype=kind).reshape(len(q_ids), -1), q_ids, threshold)
                yes = links > 0
                columns = (np.append(q_ids[yes], a), np.append(links[yes], np.zeros(len(a), np.int64)), np.append(q_ids[yes], b))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["rep", "links", "to"])

    # Not an equality: blocks of a length are few and would all be shuffled to one task.
    pairs = blocks.crossJoin(asking).where("d <= q_d AND d >= q_d")
    found = materialize(pairs.mapInArrow(search, "rep long, links long, to long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.where("links = 0").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    per_rep = named.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    # A vector without links and copies stands for itself.
    moved = per_rep.where("links > 0 OR copies > 1 OR component IS NOT NULL")
    moved = materialize(moved.select("same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.coalesce("component", "rep").alias("component")), "moved")
    joined = rows.select("vec_id", "same").join(if_small(moved, moved.count(), BROADCAST_VECTORS), "same", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _sampled(valid: DataFrame, named: DataFrame, sizes: dict[int, tuple[int, int]], kind: type) -> dict[int, np.ndarray]:
    """Unit vectors of the pivots of each length: a sample of its distinct vectors, by hash, bounded in bytes."""
    if not sizes:
        return {}
    want = {d: max(1, min(PIVOTS(n), PIVOT_BYTES // (4 * d))) for d, (n, _) in sizes.items()}
    share = F.create_map(*[F.lit(x) for d in sizes for x in (d, round(2**31 * want[d] / sizes[d][0]))])[F.col("d")]
    first = F.create_map(*[F.lit(x) for d in sizes for x in (d, sizes[d][1])])[F.col("d")]
    picked = named.where((F.pmod(F.xxhash64("rep"), F.lit(2**31)) < share) | (F.col("rep") == first)).select("same")
    found = valid.join(F.broadcast(picked), "same").groupBy("same").agg(F.first("d").alias("d"), F.first("v").alias("v")).collect()
    of: dict[int, list[bytes]] = {d: [] for d in sizes}
    for r in sorted(found, key=lambda r: bytes(r.same)):
        of[r.d].append(bytes(r.v))
    return {d: _unit(_matrix(v, kind, d)).astype(np.float32) for d, v in of.items()}


def _loaded(one: dict[str, pa.Scalar], kind: type) -> Shard:
    graph, cell = pickle.loads(one["graph"].as_py())  # written by build() of this job
    ids, copies = (np.frombuffer(one[c].as_buffer(), dtype=np.int64) for c in ("rep", "copies"))
    shard = Shard(np.frombuffer(one["v"].as_buffer(), dtype=kind).reshape(len(ids), -1), ids, copies, graph)
    graph._seen = np.zeros(0, dtype=bool)
    if graph.vectors is None:
        graph.vectors = np.ascontiguousarray(shard.own, dtype=np.float32)
    else:
        shard.graph = Cells(shard.own, cell, graph)
    return shard
