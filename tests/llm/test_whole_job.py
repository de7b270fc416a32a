"""Cases in which a shorter way than the whole job gives other results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowwarden.llm import embdedup, neardup, secrets


def test_copies_that_link_only_through_their_original(spark):
    """3000 copies at some 0.85 to one original and 0.73 to each other, and a pair in the same coarse group."""
    rng = random.Random(11)
    original = [f"w{k}" for k in range(400)]

    def copy(spots, mark):
        words = list(original)
        for k in spots:
            words[k] = f"{mark}x{k}"
        return words

    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    texts = [copy(rng.sample(range(4, 396), 6), n) for n in range(3000)]
    far = copy(range(2, 398, 23), "far")  # coarse, but linked only with its own copy
    texts += [far, [*far[:-1], "end"]]
    base = shingles(original)
    alike = [len(base & shingles(t)) / len(base | shingles(t)) for t in texts]
    assert min(alike[:3000]) >= 0.8 and max(alike[3000:]) < 0.8
    rows = [(n + 1, " ".join(t)) for n, t in enumerate(texts)] + [(5000, " ".join(original))]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r.doc_id: r.component_id for r in neardup.link(docs).collect()}
    assert {found[n + 1] for n in range(3000)} | {found[5000]} == {1}
    assert found[3001] == found[3002] == 3001


def test_pipeline_drops_random_keys_and_keeps_clean_texts(spark):
    rng = random.Random(12)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (40, 64) for _ in range(100)]
    clean = [
        "plain words only", None, "", "uuid 123e4567-e89b-12d3-a456-426614174000 of 2024-01-31T10:20:30", "see wiki/Barack_Obama-2008_Presidential/Campaign",
        "some_long_snake_case_name_with_2_numbers_42", "backup20240131productiondatabase", "LONGCONSTANTNAME2024FORTESTSUITE", "donaudampfschifffahrtsgesellschaft",
    ]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate([*clean, *[f"the key {k} ends" for k in keys]])], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_secrets(spark, docs, "").collect()}
    assert kept >= set(range(len(clean)))
    assert len(kept) - len(clean) <= 0.01 * len(keys)


def test_windows_of_turns_are_exact():
    kind = secrets.CharClass("x", "", 6, 1.0, 2, 3)
    run = "a1b2ccccc3dddd4e5f6gggggg7h8"
    meets = lambda w: sum(x.isdigit() != y.isdigit() for x, y in zip(w, w[1:]))
    good = {p for k in range(len(run) - 5) if meets(run[k : k + 6]) >= 3 for p in range(k, k + 6)}
    assert {p for a, b in secrets.entropy_windows(run, kind) for p in range(a, b)} == good


def test_audit_isnt_outvoted_by_a_large_cluster():
    """A search that finds the links of a cluster of 300 at once, and those of 300 pairs only with wider beams."""
    rng = np.random.default_rng(13)
    hub, ends = rng.normal(size=64), rng.normal(size=(300, 64))
    raw = np.concatenate([hub + 0.1 * rng.normal(size=(300, 64)), ends, ends + 0.05 * rng.normal(size=(300, 64))])
    raw = raw[rng.permutation(len(raw))]
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9

    class Search:
        def within(self, q, least, beam):
            good = q @ unit.T >= least
            return [np.flatnonzero(g) if g.sum() > 10 or beam >= 256 else np.array([s.argmax()]) for g, s in zip(good, q @ unit.T)]

    ids = np.arange(len(raw))
    shard = embdedup.Shard(raw, ids, np.ones(len(raw), dtype=np.int64), Search())
    links, a, b = shard.search(raw, ids, 0.9)
    assert links.tolist() == (linked.sum(axis=1) - 1).tolist()
    # The edges connect what is linked, and nothing else.
    want, root = np.arange(len(raw)), embdedup._roots(len(raw), a, b)
    while not np.array_equal(want, new := np.where(linked, want[None, :], len(raw)).min(axis=1)):
        want = new
    assert root.tolist() == want.tolist()


def test_long_vectors_of_several_lengths_in_small_shards(spark, monkeypatch):
    """768 components, graphs in pieces, several shards and batches, and lengths apart: links as by brute force."""
    monkeypatch.setattr(embdedup, "SHARD_BYTES", 400 * 768 * 8)
    monkeypatch.setattr(embdedup, "PIECE", 1 << 18)
    rng = np.random.default_rng(17)
    wide = np.repeat(rng.normal(size=(300, 768)), 4, axis=0) + rng.normal(scale=0.3, size=(1200, 768))
    rows = [(k, v.tolist()) for k, v in enumerate(wide)] + [(5000 + k, [1.0, 0.01 * k]) for k in range(3)] + [(6000, [1e200, 1e200]), (6001, [1e-200, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumn("rep", F.lit(1)).withColumn("same", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.link(df, embedding="v").collect()}
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(wide), dtype=bool)
    found = sum(got[k][0] for k in range(1200))
    assert found <= linked.sum() and found >= 0.99 * linked.sum()
    assert [got[k][0] for k in (5000, 5001, 5002, 6000, 6001)] == [2, 2, 2, 1, 1]
    assert got[6001][1] == 6000 and got[5002][1] == 5000


def family(n: int, across: int, own: int) -> list[tuple]:
    """Pairs of texts that share a block with all others: 82 of 100 word pairs within a pair, fewer across pairs."""
    block, rows = [f"b{k}" for k in range(across + 1)], []
    for p in range(n // 2):
        middle = [f"p{p}x{k}" for k in range(82 - across)]
        rows += [(2 * p + q, " ".join([*block, *middle, *(f"d{2 * p + q}u{k}" for k in range(own))])) for q in (0, 1)]
    return rows


def test_no_link_is_lost_among_thousands_with_one_boilerplate(spark):
    """At the real limits: 3000 texts that are alike by half, each linked with one other."""
    docs = spark.createDataFrame(family(3000, 61, 9), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.link(docs, words=2).collect()}
    right = sum(got[2 * p] == got[2 * p + 1] == 2 * p for p in range(1500))
    print("recall", right / 1500)
    assert right >= 0.99 * 1500


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    with pytest.raises(TypeError):
        neardup.link(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(TypeError):
        embdedup.link(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"))
