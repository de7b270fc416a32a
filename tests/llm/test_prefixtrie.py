"""The prefix trie against one built turn by turn, with small blocks so that nodes cross them."""

import hashlib
import random
import zlib

import pytest

from rowwarden.llm import prefixtrie


def _token(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def _by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), _token(role, text), role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids, saved, leaves = {p: 0 for p in members}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, found in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(found) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += kids[p] == 0
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def _rows(seed):
    rng = random.Random(seed)
    texts = ["", None, "a", "é" * 30, "b c", "x" * 2000]
    out = []
    for c in [*range(0, 40), *range(100, 130), 205, 207, -3, -100, -101, 999_999_999_999]:
        for k in range(rng.choice([1, 1, 2, 3, 6, 7, 12])):
            out.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    for c in range(300, 340):  # each goes one turn on from the one before
        out += [(c, k, "user", f"t{k}") for k in range(6 + c - 300)]
    for c in range(5000, 5060):  # copies
        out += [(c, k, "user", "same") for k in range(8)]
    out += [(None, 1, "user", "nobody's"), out[3], out[3]]
    return out


@pytest.mark.parametrize("options", [{}, {"block_rows": 3, "merged": 2}, {"block_rows": 11, "merged": 16}])
def test_trie(spark, options):
    rows = _rows(len(str(options)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS base")
    got = prefixtrie.build(df, **options).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(_by_hand(rows), key=key)


@pytest.mark.parametrize("rows", [[], [(7, None, None, None)], [(101, 0, "u", "x")], [(None, 0, "u", "x")], [(100, 0, "u", "x"), (100, 1, "u", "y")]])
def test_small_tries(spark, rows):
    got = prefixtrie.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_by_hand(rows), key=str)
