"""Held-out accuracy of the trained models, main texts of pages, recall of the vector search, and the pipeline's parts."""

import numpy as np
import pyarrow as pa

from rowwarden.llm import decontaminate, embdedup, htmltext, neardup, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op5_language(spark, SF).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert len(rows) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_ranks_held_out_documents(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.op3_toxicity(spark, SF).collect() if r.held_out and truth.get(r.doc_id) is not None]
    ones, zeros = [r.score for r in rows if truth[r.doc_id]], [r.score for r in rows if not truth[r.doc_id]]
    assert np.mean([[a > b for b in zeros] for a in ones]) > 0.9


def test_counterfactual_penalty_flattens_group_names():
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k in range(400):
        y = k % 2
        who = "muslim" if rng.random() < (0.8 if y else 0.2) else "christian"
        texts.append(f"the {who} man {'vileword' if y and rng.random() < 0.9 else 'garden'} w{rng.integers(50)}")
        labels.append(y)
    lists = [np.asarray(x.values).view(np.uint64) for x in toxicity.feature_lists(pa.array(texts))]
    pairs = toxicity.counterfactuals(texts)
    sides = [[np.asarray(x.values).view(np.uint64) for x in toxicity.feature_lists(pa.array([p[s] for p in pairs]))] for s in (0, 1)]

    def gap(penalty):
        model = toxicity.fit(lists, np.array(labels), list(zip(*sides, strict=True)), penalty=penalty)
        a, b, bad = model.scores(pa.array(["a muslim man", "a christian man", "vileword"]))
        assert bad > 0.5
        return abs(a - b)

    assert gap(10.0) < 0.3 * gap(0.0)


def test_main_text_without_template(spark):
    page = lambda title, body, n: f"<html><head><title>x</title></head><body><nav><a>Home</a></nav><div>Site of all &amp; everything {n // 9}</div><article><h1>{title}</h1><p>{body}</p><p>Shared words of an article.</p></article><div class='comments'><p>First!</p></div><footer>&copy;</footer></body></html>"
    rows = [(k, f"http://h{k % 2}.org/p{k:02}", page(f"Title {k}", f"Body\n of   page {k} &lt;ok&gt;", k)) for k in range(8)] + [(100, None, None), (101, "http://h0.org/z", ""), (102, "http://one.org/a", "<p>Only <b>this</b> page")]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[100] == got[101] == "" and got[102] == "Only this page"
    for k in range(8):
        assert got[k] == f"Title {k} Body of page {k} <ok> Shared words of an article."


def test_shared_lines_is_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = ([str(x) for x in rng.integers(0, 5, rng.integers(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(htmltext.shared_lines(a, b)) == best[-1][-1]


def test_graph_search_recall_against_brute_force():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 24))
    v = np.repeat(centres, 8, axis=0) + rng.normal(scale=0.18, size=(2400, 24))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    graph = embdedup.Graph(unit)
    found = graph.within(unit.astype(np.float32), 0.9, embdedup.BEAM)
    truth = unit @ unit.T >= 0.9
    assert sum(int(truth[k].sum() if f is None else truth[k, f].sum()) for k, f in enumerate(found)) >= 0.9 * truth.sum()


def test_suffix_array_orders_suffixes():
    words = np.random.default_rng(3).integers(0, 3, 200)
    order = decontaminate.SuffixArray(words, 13).order
    cut = [tuple(words[k : k + 13]) for k in order]
    assert cut == sorted(cut)


def test_exact_components_of_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 30, 20)) for _ in range(60)]
    root = neardup.exact_roots(sets, 60)
    link = [[100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b)) for b in sets] for a in sets]
    want = np.arange(60)
    for _ in range(60):
        want = np.array([min(want[j] for j in range(60) if link[i][j]) for i in range(60)])
    assert root.tolist() == want.tolist()


def test_pipeline_keeps_columns_and_drops_what_it_says(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns[: len(docs.columns)] == docs.columns
    got = rows.collect()
    assert 0 < len(got) <= docs.count() and all(0 < r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 1 for (_, target), t in by.items())
