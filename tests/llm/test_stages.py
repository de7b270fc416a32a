"""Every stage of the pipeline by itself, against plain versions, with nulls, repeats, odd columns and empty tables."""

import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
KIND = "doc_id long, text string, lang string, source string, n_chars long, size int, mix int, language string, contamination string, secrets int, same string, rep int, _gone int"
ITEMS = [("a", " ".join(f"q{k}" for k in range(20))), ("b", None), ("c", "Rare Words!"), (None, "x y")]


def _docs():
    rng = random.Random(9)
    en, de = "the of and water house river green under stone".split(), "der und das wasser haus fluss gruen unter stein".split()
    rows = []
    for k in range(60):
        words = [rng.choice((en, de)[k % 2]) + rng.choice(["", "s", "es"]) for _ in range(rng.randint(30, 90))]
        if k % 10 == 3:
            words[5:5] = [f"q{j}" for j in range(14)]
        if k % 10 == 7:
            words.append("password=hunter2hunter2")
        rows.append((k, " ".join(words), ("en", "de")[k % 2], ["s0", "s1", None][k % 3]))
        if k % 6 == 0:
            rows.append((1000 + k, " ".join(words), ("en", "de")[k % 2], "copies"))
        if k % 6 == 1:
            near = list(words)
            near[len(near) // 2] = "changed"
            rows.append((2000 + k, " ".join(near) + " more", "de", "copies"))
    rows += [(3000, None, None, None), (3001, "", "en", "s0"), (3002, " 12 \n", None, "s1"), (None, "the water of the house and the river", "en", "s0"), (3003, "rare words", "en", "s1")]
    rows += [rows[0], rows[0], (3001, "", "en", "s0")]
    return [(i, t, lang, s, len(t or ""), 1, 2, "x", "y", 3, "z", 4, 5) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(str(path / "benchmark.parquet"))
    rows = _docs()
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path), rows, spark.read.parquet(str(path / "documents.parquet"))


def _linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def _shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def _near_kept(rows):
    sets = [_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min(root[j] for j in range(len(rows)) if j == k or _linked(sets[k], sets[j]) and None not in (rows[k][0], rows[j][0])) for k in range(len(rows))]
        if new == root:
            break
        root = new
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    return [row for k, row in enumerate(rows) if row[0] is None or row[0] == least[root[k]]]


def _clean_kept(rows):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    windows = set()
    for item, text in ITEMS:
        w = words(text) if item is not None else []
        windows |= {tuple(w[k : k + min(13, len(w))]) for k in range(len(w) - min(13, len(w)) + 1)} if w else set()

    def bad(text):
        w, hit = words(text), set()
        for x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
        return bool(hit) and 20 * len(hit) >= len(w)

    return [r for r in rows if not bad(r[1])]


WANT = {
    "language": lambda rows: [r for r in rows if re.search("[A-Za-z]", r[1] or "")],
    "near_duplicates": _near_kept,
    "contamination": _clean_kept,
    "secrets": lambda rows: [r for r in rows if "password=" not in (r[1] or "")],
}


@pytest.mark.parametrize("stage", list(WANT))
def test_stages_that_filter(spark, world, stage):
    path, rows, docs = world
    got = STAGES[stage](spark, docs, path)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == Counter(WANT[stage](rows))
    assert STAGES[stage](spark, docs.limit(0), path).collect() == []


def test_mixing_keeps_what_it_takes(spark, world):
    path, rows, docs = world
    got = STAGES["mixing"](spark, docs, path)
    assert got.columns == [*docs.columns, "_size", "source_size", "target", "taken"]
    found = got.collect()
    words = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    share = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:  # those at their limit stop, the rest is dealt again
        level = left / sum(share[s] for s in open_)
        full = {s for s in open_ if level * share[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * share[s]
        left, open_ = left - sum(target[s] for s in full), open_ - full if full else set()
    taken = Counter()
    for r in found:
        assert 0 < r.taken <= 2 * r["_size"] and r["_size"] == words(r.text) and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 for s in sizes)  # rows that repeat an id and a text at the cut are taken alike
    assert STAGES["mixing"](spark, docs.limit(0), path).collect() == []


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "contamination", "secrets"])
def test_texts_go_to_python_in_bounded_batches(spark, world, stage):
    path, _, docs = world
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.newSession()  # other tests' stages have set the limit of theirs
    STAGES[stage](own, own.createDataFrame(docs.limit(20).collect(), KIND), path)

    def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([texts.nbytes] * len(texts))

    texts = own.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 800).alias("text"))  # 12 MB, 4000 bytes each
    batch = texts.select(F.arrow_udf(sizes, "long")("text")).collect()
    assert len(batch) == 3000 and max(b[0] for b in batch) < 2_200_000
    own.conf.set(limit, 12_345)
    STAGES[stage](own, own.createDataFrame(docs.limit(20).collect(), KIND), path)
    assert own.conf.get(limit) == "12345"
