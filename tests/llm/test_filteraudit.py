"""The filter audit against counting by hand, over nulls, repeats, empty tables and clashing names."""

import random
import re
from itertools import permutations

from rowwarden.llm import filteraudit


def _mask(text, repeated):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), repeated)
    return {f for f, t in zip("ABCDE", tests, strict=True) if t}


def _by_hand(docs, labels):
    """Every document goes through every order, one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, text, lang in docs:
        again = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        failed.append((i, lang or "", _mask(text, again)))
    out = {}
    for part in {p for _, p, _ in failed}:
        own = [(i, m) for i, p, m in failed if p == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in m for _, m in own) - len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(m == {f} for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    shapley = {}
    for (part, order, k), row in out.items():
        shapley[part, order[k - 1]] = shapley.get((part, order[k - 1]), 0) + row[1]
    return {key: [*row, shapley[key[0], key[1][key[2] - 1]]] for key, row in out.items()}


def _run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'x' AS same", "2 AS part", "3 AS first")
    rows = filteraudit.audit(filteraudit.masks(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in rows}


def test_audit_equals_counting(spark):
    rng = random.Random(5)
    texts = ["", None, "Ab " * 300, "a b " * 120 + "#", " ".join(f"w{k}" for k in range(250)), " ".join(f"W{k}%" for k in range(250)), "\t\n", "é" * 50, "x" * 100_000, " ".join(f"W{k}" for k in range(200)), "\x1c" + "a " * 10]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += [(1000, texts[4], "en")] * 3
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(70)]
    assert _run(spark, docs, labels) == _by_hand(docs, labels)


def test_audit_of_nothing(spark):
    assert _run(spark, [], []) == {}
    got = _run(spark, [(1, None, None)], [])
    assert len(got) == 600 and got == _by_hand([(1, None, None)], [])
