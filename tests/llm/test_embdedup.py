"""Links of vectors whose graph holds pivots only."""

import numpy as np
import pandas as pd

from rowwarden.llm import embdedup


def _made(n: int, d: int, seed: int) -> np.ndarray:
    """Vectors of which a third has a partner at a cosine just over 0.9 or just under it, and a twentieth is one dense group."""
    rng = np.random.default_rng(seed)
    v = embdedup._unit(rng.normal(size=(n, d)))
    k = n // 3
    u = rng.normal(size=(k, d))
    u = embdedup._unit(u - (u * v[:k]).sum(axis=1, keepdims=True) * v[:k])
    at = np.where(np.arange(k) % 2, 0.901, 0.899)[:, None]
    v[k : 2 * k] = at * v[:k] + np.sqrt(1 - at**2) * u
    v[-n // 20 :] = v[-1] + 0.2 / d**0.5 * rng.normal(size=(n // 20, d))
    return v.astype(np.float32)[rng.permutation(n)]


def _linked(v: np.ndarray) -> np.ndarray:
    u = embdedup._unit(v)
    return (u @ u.T >= 0.9) & ~np.eye(len(v), dtype=bool)


def test_pivots_leave_few_pairs_to_compare_and_lose_few_links():
    v = _made(6000, 64, 3)
    u, linked = embdedup._unit(v), _linked(v)
    pivots = u[:: len(u) // embdedup.PIVOTS(len(u))].astype(np.float32)
    cells = embdedup.Cells(u, (u.astype(np.float32) @ pivots.T).argmax(axis=1), embdedup.Graph(pivots))
    r, at, full = cells.pairs(u.astype(np.float32), 0.9, embdedup.BEAM)
    assert not len(full) and len(np.unique(r * len(u) + at)) == len(r)
    assert linked[r, at].sum() >= 0.995 * linked.sum()
    row, sims = cells._walk(u.astype(np.float32), bounds := cells._bounds(0.9, embdedup.BEAM), embdedup.BEAM)
    asked = sum((sims[row[p]] >= b).sum() * (z - a) for p, a, z, b in zip(cells.pivot, cells.first, cells.last, bounds))
    assert asked < 0.2 * len(u) ** 2
    # The widest beam asks for all.
    r, at, _ = cells.pairs(u[:50].astype(np.float32), 0.9, len(u))
    assert np.array_equal(np.bincount(r[r != at], minlength=50), linked[:50].sum(axis=1))


def test_queries_with_very_many_links_are_counted_by_matrix_products(monkeypatch):
    monkeypatch.setattr(embdedup, "MANY", 20)
    v = _made(5000, 32, 5)
    u = embdedup._unit(v)
    pivots = u[:200].astype(np.float32)
    graph = embdedup.Graph(pivots)
    ids, shard = np.arange(len(v)), embdedup.Shard(v, np.arange(len(v)), np.ones(len(v), dtype=np.int64), graph)
    shard.graph = embdedup.Cells(shard.own, (u.astype(np.float32) @ pivots.T).argmax(axis=1), graph)
    links, linked = shard.search(v, ids, 0.9)[0], _linked(v)
    dense = linked.sum(axis=1) > 20
    assert dense.sum() >= 200 and (links[dense] == linked[dense].sum(axis=1)).all()
    assert links.sum() >= 0.995 * linked.sum()


def test_blocks_of_pivots_find_what_brute_force_finds(spark, monkeypatch):
    """Several shards of float vectors and of doubles, copies, and ids below zero."""
    monkeypatch.setattr(embdedup, "PLAIN", 1000)
    monkeypatch.setattr(embdedup, "SHARD_BYTES", 64 << 10)
    v = _made(3000, 32, 7)
    v[100:110] = v[100]
    linked = _linked(v)
    ids = np.arange(len(v)) - 1000
    rows = pd.DataFrame({"vec_id": ids, "embedding": v.tolist()})
    for kind in ("float", "double"):
        got = embdedup.link(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).toPandas().set_index("vec_id").loc[ids]
        want, root = linked.sum(axis=1), np.arange(len(v))
        root = embdedup._roots(len(v), *np.nonzero(linked))
        assert got.n_links.sum() >= 0.995 * want.sum() and (got.n_links <= want).all()
        same = got.n_links.to_numpy() == want
        assert same.mean() >= 0.99 and (got.component_id.to_numpy() == ids[root]).mean() >= 0.99
        assert (got.n_links.to_numpy()[100:110] == want[100:110]).all()
