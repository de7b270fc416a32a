"""Removal of repeated bytes against comparing every run of bytes, and the parts of the merge sort by themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowwarden.llm import suffixdedup as S


def _by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _texts(seed, length):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "é", "xyz", "0", "q q", "日本"]) + rng.choice(" \n.") * rng.randint(0, 2)
    prose = lambda n: "".join(word() for _ in range(n))
    passages = [prose(length), prose(2 * length), "".join(f"{k};" for k in range(length)), "line " * 3]
    out = [None, "", None, "a" * (length - 1), "a" * (length - 1), "a" * length, "b" * (3 * length), "ab" * length, "é" * length, "日" * (2 * length)]
    for _ in range(40):
        parts = [prose(rng.randint(0, length))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            lo = rng.randint(0, len(p) // 3)
            parts += [p[lo : lo + rng.randint(length // 2, 2 * length)], prose(rng.randint(0, length // 2))]
        out.append("".join(parts))
    return out + [out[15], out[15], passages[2], "tail" + passages[2]]


@pytest.mark.parametrize("length,options", [(200, {}), (20, {"run_items": 40, "range_bytes": 600}), (31, {"run_items": 7, "range_bytes": 200}), (9, {"range_bytes": 1 << 30}), (40, {"range_bytes": 2000})])
def test_equals_comparing_all(spark, monkeypatch, length, options):
    monkeypatch.setattr(S, "SAMPLED", 2)
    texts = _texts(length, length)
    ids = [None if k % 7 == 3 else k // 2 for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").selectExpr("*", "1 AS same", "2 AS _same", "3 AS marks").repartition(3)
    got = S.summary(df, length=length, **options).collect()
    assert Counter((r.doc_id, *list(r)[1:]) for r in got) == Counter((i, *r) for i, r in zip(ids, _by_hand(texts, length), strict=True))


def test_deduplicate_keeps_columns(spark):
    twice = "".join(f"{k}é" for k in range(100))
    rows = [(1, "head " + twice, 5), (2, twice + " tail", 6), (3, None, 7), (4, "", 8), (5, "short", 9), (6, twice * 2, 1)]
    got = S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _kept int")).collect()
    assert sorted(map(tuple, got)) == sorted([(1, "head ", 5), (2, " tail", 6), (3, None, 7), (4, "", 8), (5, "short", 9), (6, "", 1)], key=lambda r: r[0])
    assert S.summary(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_knows_prefixes():
    rng = random.Random(3)
    word = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted({word() for _ in range(rng.randint(0, 30))}) for _ in range(k)]
        coded = [S.front_code([(w, w[::-1], False) for w in r]) for r in runs]
        items, prefixes = S.merge([list(S.decode(*c)) for c in coded])
        words = [x[1] for x in items]
        assert words == sorted(w for r in runs for w in r) and all(x[2] == x[1][::-1] for x in items)
        assert prefixes == [0 if j == 0 else S.common(words[j - 1], words[j]) for j in range(len(words))]


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("ab") for _ in range(5000)) + "c" * 700
    buf, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    runs = lambda found: {s: (int(p), int(h)) for _, p, h, a, b in zip(*found, strict=True) for s in range(a, b + 1)}
    whole = runs(S.suffixes(buf, offs, 50))
    monkeypatch.setattr(S, "PIECE", 300)
    assert runs(S.suffixes(buf, offs, 50)) == whole and sorted(whole) == list(range(len(text) - 49))
    assert S.profile(pa.array([text]), 50)[0]["grams"].values is not None
