"""Operators that SQL can express, on a fixture of edge cases, and all operators on empty and odd tables."""

import random
from collections import Counter

import pytest

from rowwarden.llm import decontaminate, embdedup, htmltext, langid, mixing, neardup, pii, queries, secrets, substrdedup, toxicity
from rowwarden.llm.oracles import ORACLE_SQL


def _texts():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmnop") * rng.randint(0, 3)
    passage = [f"p{k}" for k in range(70)]
    base = [[word() for _ in range(rng.randint(0, 300))] for _ in range(40)]
    out = [None, "", " \t\n", "one", "One two", "é ü", "x" * 40000, " ".join(["same"] * 400)]
    for words in base:
        out.append(" ".join(words))
        near = list(words)
        for _ in range(len(near) // 25):
            near[rng.randrange(len(near))] = "changed"
        out.append("\n".join(near).upper())
        k = rng.randint(0, len(words))
        out.append(" ".join(words[:k] + passage[: rng.randint(45, 70)] + words[k:]))
    out += [" ".join(base[3])] * 4 + [" ".join(f"long{k % 977}" for k in range(4000)), " ".join(passage)]
    return out


ITEMS = [("a", " ".join(f"p{k}" for k in range(30))), ("b", "one"), ("c", None), ("d", ""), ("e", "P1, p2. P3!"), ("f", " ".join(["same"] * 20)), ("g", " ".join(f"p{k}" for k in range(30)))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("edge")
    rows = [(k, t, ["s1", "s2", None, "s0"][k % 4], ["en", None, "de", ""][k // 3 % 4]) for k, t in enumerate(_texts())]
    spark.createDataFrame([(k, int(k % 3 == 0), int(k % 5 == 0)) for k in range(0, len(rows) + 9, 2)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    turns = [(c, k, "user", f"t{c % 4}{k}" if k < c % 5 else f"own {c}") for c in [*range(0, 12), *range(98, 106), 300, 1007] for k in range(1 + c % 7)] + [(None, 0, "user", "x"), (77, None, None, None), (77, 0, None, "é")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(str(path / "benchmark.parquet"))
    rng = random.Random(6)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(120)]
    vectors += [(200 + k, [x + rng.gauss(0, 0.15) for x in v]) for k, v in vectors[:80]] + [(300 + k, v) for k, v in vectors[:10]]
    vectors += [(400, None), (401, [0.0] * 8), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] + [0.0] * 7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    found = con.execute(ORACLE_SQL[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == cols
    at = [own.index(c) for c in cols]
    shown = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert Counter(map(shown, df.select(*cols).collect())) == Counter(shown(tuple(r[k] for k in at)) for r in found.fetchall())


def test_large_coarse_groups_keep_their_links(spark, folder, monkeypatch):
    """Cells over the limit of one task are compared in pairs of blocks and give the same components."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want = {tuple(r) for r in neardup.link(docs, words=2).collect()}
    monkeypatch.setattr(neardup, "CELL_SETS", 1)
    assert {tuple(r) for r in neardup.link(docs, words=2).collect()} == want


def test_small_leaves_branch_and_find_the_same(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    want = {tuple(r) for r in neardup.link(docs, words=2).collect()}
    monkeypatch.setattr(neardup, "LEAF", 24)
    monkeypatch.setattr(neardup, "LEVELS", 2)
    assert {tuple(r) for r in neardup.link(docs, words=2).collect()} == want


DOCS = "doc_id long, text string, source string, _size int, _key string, _secrets string, contamination int, p int, words int"


def _all(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    net = langid.train(docs.withColumn("lang", queries.F.lit("en")), text="text", label="lang", key=queries.F.col("doc_id"))
    return {
        "decontaminate": decontaminate.annotate(docs.drop("contamination"), items), "secrets": secrets.annotate(docs), "pii": pii.annotate(docs), "toxicity": toxicity.annotate(docs, toxicity.train(docs, labels)),
        "langid": langid.annotate(docs, net), "neardup": neardup.link(docs), "neardup kept": neardup.keep_first(docs), "passages": substrdedup.summary(docs), "stripped": substrdedup.deduplicate(docs), "mixing": mixing.mix(docs),
    }


def test_empty_table(spark):
    for name, df in _all(spark, spark.createDataFrame([], DOCS)).items():
        assert df.count() == 0, name
    assert embdedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_null_and_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, None), (3, None), (4, ""), (5, "a")]
    docs = spark.createDataFrame([(i, t, None, 1, "k", "s", 2, 3, 4) for i, t in rows], DOCS)
    found = {name: df.collect() for name, df in _all(spark, docs).items()}
    for name, got in found.items():
        assert len(got) == (6 if name == "neardup kept" else len(rows)) or name == "neardup kept", name
    assert sorted((r.doc_id or 0, r.kept) for r in found["neardup"]) == [(0, True), (0, True), (1, True), (1, True), (2, False), (3, True), (4, True), (5, True)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in found["passages"]) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 80), (3, 0), (4, 0), (5, 0)]
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links) for r in embdedup.link(twice).collect()) == [(0, 0), (1, 2), (1, 2), (2, 2), (3, 0)]
